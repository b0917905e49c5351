"""Export requests in their binary form: the protocol's messages to and from the JSON form.

A message is a table of its fields; decoding gives the members the JSON form has (64-bit numbers as
text, ids in hexadecimal, other bytes in base64), so that both forms are read by one set of rules.
"""

from __future__ import annotations

import base64
import struct

# Fields of the protocol's messages by number: name, kind, message. A trailing * is a repeated field.
MESSAGES: dict[str, dict[int, tuple[str, str]]] = {
    "LogsRequest": {1: ("resourceLogs", "ResourceLogs*")},
    "ResourceLogs": {1: ("resource", "Resource"), 2: ("scopeLogs", "ScopeLogs*"), 3: ("schemaUrl", "string")},
    "Resource": {1: ("attributes", "KeyValue*"), 2: ("droppedAttributesCount", "uint32")},
    "ScopeLogs": {1: ("scope", "Scope"), 2: ("logRecords", "LogRecord*"), 3: ("schemaUrl", "string")},
    "Scope": {1: ("name", "string"), 2: ("version", "string"), 3: ("attributes", "KeyValue*"), 4: ("droppedAttributesCount", "uint32")},
    "LogRecord": {1: ("timeUnixNano", "fixed64"), 2: ("severityNumber", "uint32"), 3: ("severityText", "string"), 5: ("body", "AnyValue"), 6: ("attributes", "KeyValue*"), 7: ("droppedAttributesCount", "uint32"), 8: ("flags", "fixed32"), 9: ("traceId", "id"), 10: ("spanId", "id"), 11: ("observedTimeUnixNano", "fixed64"), 12: ("eventName", "string")},
    "KeyValue": {1: ("key", "string"), 2: ("value", "AnyValue")},
    "AnyValue": {1: ("stringValue", "string"), 2: ("boolValue", "bool"), 3: ("intValue", "int64"), 4: ("doubleValue", "double"), 5: ("arrayValue", "ArrayValue"), 6: ("kvlistValue", "KeyValueList"), 7: ("bytesValue", "bytes")},
    "ArrayValue": {1: ("values", "AnyValue*")},
    "KeyValueList": {1: ("values", "KeyValue*")},
    "TracesRequest": {1: ("resourceSpans", "ResourceSpans*")},
    "ResourceSpans": {1: ("resource", "Resource"), 2: ("scopeSpans", "ScopeSpans*"), 3: ("schemaUrl", "string")},
    "ScopeSpans": {1: ("scope", "Scope"), 2: ("spans", "Span*"), 3: ("schemaUrl", "string")},
    "Span": {1: ("traceId", "id"), 2: ("spanId", "id"), 3: ("traceState", "string"), 4: ("parentSpanId", "id"), 5: ("name", "string"), 6: ("kind", "uint32"), 7: ("startTimeUnixNano", "fixed64"), 8: ("endTimeUnixNano", "fixed64"), 9: ("attributes", "KeyValue*"), 10: ("droppedAttributesCount", "uint32"), 11: ("events", "Event*"), 12: ("droppedEventsCount", "uint32"), 13: ("links", "Link*"), 14: ("droppedLinksCount", "uint32"), 15: ("status", "Status"), 16: ("flags", "fixed32")},
    "Event": {1: ("timeUnixNano", "fixed64"), 2: ("name", "string"), 3: ("attributes", "KeyValue*"), 4: ("droppedAttributesCount", "uint32")},
    "Link": {1: ("traceId", "id"), 2: ("spanId", "id"), 3: ("traceState", "string"), 4: ("attributes", "KeyValue*"), 5: ("droppedAttributesCount", "uint32"), 6: ("flags", "fixed32")},
    "Status": {2: ("message", "string"), 3: ("code", "uint32")},
}
_VARINT, _EIGHT, _SIZED, _FOUR = 0, 1, 2, 5
_WIRE = {"uint32": _VARINT, "int64": _VARINT, "bool": _VARINT, "fixed64": _EIGHT, "double": _EIGHT, "fixed32": _FOUR}
DEPTH = 100  # messages within messages; the protocol's own readers stop there


class Malformed(ValueError):
    """The bytes are no such message."""


def _varint(data: bytes, at: int, end: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= end or shift > 63:
            raise Malformed("a number is cut off")
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n & 0xFFFFFFFFFFFFFFFF, at
        shift += 7


def _scalar(kind: str, data: bytes, at: int, end: int):
    if kind == "string":
        return data[at:end].decode("utf-8", "replace")
    if kind == "id":
        return data[at:end].hex()
    return base64.b64encode(data[at:end]).decode()


def decode(message: str, data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> dict:
    """The message as members of its JSON form. Unknown fields are passed over; of a field stated
    twice that isn't repeated the last counts. Raises Malformed."""
    if depth > DEPTH:
        raise Malformed("too deep")
    table, out = MESSAGES[message], {}
    end = len(data) if end is None else end
    while at < end:
        tag, at = _varint(data, at, end)
        wire, stop = tag & 7, at
        if wire == _VARINT:
            n, stop = _varint(data, at, end)
        elif wire == _SIZED:
            size, at = _varint(data, at, end)
            stop = at + size
        elif wire in (_EIGHT, _FOUR):
            stop = at + (8 if wire == _EIGHT else 4)
        else:
            raise Malformed(f"wire type {wire}")
        if stop > end or not tag >> 3:
            raise Malformed("a field is cut off")
        name, kind = table.get(tag >> 3, ("", ""))
        many, kind = kind.endswith("*"), kind.rstrip("*")
        if kind and _WIRE.get(kind, _SIZED) == wire:
            if kind in MESSAGES:
                value = decode(kind, data, at, stop, depth + 1)
            elif wire == _SIZED:
                value = _scalar(kind, data, at, stop)
            elif kind == "bool":
                value = n != 0
            elif kind == "int64":
                value = str(n - (1 << 64) if n >> 63 else n)
            elif kind == "uint32":
                value = n & 0xFFFFFFFF
            elif kind == "double":
                value = struct.unpack_from("<d", data, at)[0]
            else:
                value = int.from_bytes(data[at:stop], "little")
                value = str(value) if kind == "fixed64" else value
            if many:
                out.setdefault(name, []).append(value)
            else:
                out[name] = value
        at = stop
    return out


def _number(n: int) -> bytes:
    n &= 0xFFFFFFFFFFFFFFFF
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def encode(message: str, members: dict) -> bytes:
    """The binary form of a message given in its JSON form, keys in camelCase; members that are null
    or unknown are left out."""
    out = bytearray()
    for number, (name, kind) in MESSAGES[message].items():
        found = members.get(name)
        for value in found if kind.endswith("*") and isinstance(found, list) else [found]:
            plain = kind.rstrip("*")
            if value is None:
                continue
            wire = _WIRE.get(plain, _SIZED)
            if plain in MESSAGES:
                body = encode(plain, value)
            elif plain == "string":
                body = value.encode()
            elif plain == "id":
                body = bytes.fromhex(value)
            elif plain == "bytes":
                body = base64.b64decode(value)
            elif plain == "double":
                body = struct.pack("<d", value)
            elif wire == _VARINT:
                body = _number(int(value))
            else:
                body = int(value).to_bytes(8 if wire == _EIGHT else 4, "little")
            out += _number(number << 3 | wire) + (_number(len(body)) if wire == _SIZED else b"") + body
    return bytes(out)
