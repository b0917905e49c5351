"""Export requests (logs and traces, as JSON or in their binary form) to canonical events.

Values nest to any depth, which no fixed schema states, so requests are read by Arrow batches in
Python; everything after that is columns.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlog.functions.text import nanos_to_micros
from loamlog.sources.otlp_wire import decode

EVENTS = "timestamp_ns long, host string, source string, sourcetype string, index string, raw string, attributes string"
# Attributes that become columns, and names of numbered kinds.
CORE_RESOURCE = ("host.name", "service.name")
CORE_RECORD = ("sourcetype", "index")
SPAN_KINDS = ["unspecified", "internal", "server", "client", "producer", "consumer"]
STATUS_CODES = ["unset", "ok", "error"]


def _get(o, camel: str, default=None):
    """A member in either spelling."""
    if not isinstance(o, dict):
        return default
    if camel in o:
        return o[camel]
    snake = "".join("_" + c.lower() if c.isupper() else c for c in camel)
    return o.get(snake, default)


def _list(o, name: str) -> list:
    found = _get(o, name)
    return [x for x in found if x is not None] if isinstance(found, list) else []


def _int(x) -> int:
    try:
        return int(x)
    except (TypeError, ValueError):
        return 0


def value_of(v):
    """An attribute value as plain JSON; None if it states none."""
    if not isinstance(v, dict):
        return None
    for name, cast in (("stringValue", str), ("boolValue", bool), ("intValue", _int), ("doubleValue", float), ("bytesValue", str)):
        found = _get(v, name)
        if found is not None:
            try:
                return cast(found)
            except (TypeError, ValueError):
                return found
    array, pairs = _get(v, "arrayValue"), _get(v, "kvlistValue")
    if array is not None:
        return [value_of(x) for x in _list(array, "values")]
    if pairs is not None:
        return {str(p.get("key", "")): value_of(p.get("value")) for p in _list(pairs, "values") if isinstance(p, dict)}
    return None


def _pairs(o) -> list[tuple[str, object]]:
    return [(str(a.get("key", "")), a["value"]) for a in _list(o, "attributes") if isinstance(a, dict) and a.get("value") is not None]


def _string(pairs: list, key: str) -> str | None:
    for k, v in pairs:
        if k == key:
            found = _get(v, "stringValue")
            if isinstance(found, str):
                return found
    return None


def _dump(o) -> str:
    return json.dumps(o, ensure_ascii=False, separators=(",", ":"))


def _context(record, resource_logs, scope_logs) -> dict:
    """What the standard states of a record beside its attributes."""
    out: dict = {}
    for name, key in (("severityNumber", "severity_number"), ("flags", "flags"), ("observedTimeUnixNano", "observed_time_unix_nano"), ("droppedAttributesCount", "dropped_attributes_count")):
        if n := _int(_get(record, name)):
            out[key] = n
    for name, key in (("severityText", "severity_text"), ("traceId", "trace_id"), ("spanId", "span_id"), ("eventName", "event_name")):
        if text := _get(record, name):
            out[key] = str(text).lower() if key.endswith("_id") else str(text)
    scope = _get(scope_logs, "scope")
    about = {k: v for k, v in (("name", _get(scope, "name")), ("version", _get(scope, "version")), ("attributes", {k: value_of(v) for k, v in _pairs(scope)})) if v}
    if set(about) - {"name"}:
        out["scope"] = about
    for o, key in ((resource_logs, "resource_schema_url"), (scope_logs, "scope_schema_url")):
        if url := _get(o, "schemaUrl"):
            out[key] = url
    return out


def log_rows(request) -> Iterator[tuple]:
    for resource_logs in _list(request, "resourceLogs"):
        resource = _pairs(_get(resource_logs, "resource"))
        host, service = _string(resource, "host.name") or "unknown", _string(resource, "service.name")
        rest = {k: value_of(v) for k, v in resource if k not in CORE_RESOURCE}
        for scope_logs in _list(resource_logs, "scopeLogs"):
            source = service or _get(_get(scope_logs, "scope"), "name") or "otel"
            for record in _list(scope_logs, "logRecords"):
                pairs = _pairs(record)
                core = {k: _get(v, "stringValue") for k, v in pairs if k in CORE_RECORD and isinstance(_get(v, "stringValue"), str)}
                attributes = dict(rest)
                if context := _context(record, resource_logs, scope_logs):
                    attributes = {"otel": context, **attributes}
                attributes |= {k: value_of(v) for k, v in pairs if not (k in core and isinstance(_get(v, "stringValue"), str))}
                body = _get(record, "body")
                text = _get(body, "stringValue")
                raw = text if isinstance(text, str) else "" if body is None else _dump(body)
                time = _int(_get(record, "timeUnixNano")) or _int(_get(record, "observedTimeUnixNano")) or None
                yield time, host, source, core.get("sourcetype", "otel:logs"), core.get("index", "main"), raw, _dump(attributes) if attributes else None


def _named(names: list[str], n) -> str:
    if isinstance(n, str) and not n.lstrip("-").isdigit():
        return n.rsplit("_", 1)[-1].lower()
    return names[_int(n)] if 0 <= _int(n) < len(names) else names[0]


def span_rows(request) -> Iterator[tuple]:
    for resource_spans in _list(request, "resourceSpans"):
        resource = _pairs(_get(resource_spans, "resource"))
        host, service = _string(resource, "host.name") or "unknown", _string(resource, "service.name") or "unknown"
        for scope_spans in _list(resource_spans, "scopeSpans"):
            for span in _list(scope_spans, "spans"):
                attributes = {k: value_of(v) for k, v in _pairs(span)} | {f"resource.{k}": value_of(v) for k, v in resource}
                for key in ("events", "links"):
                    if found := _list(span, key):
                        attributes[key] = found
                start, end = _int(_get(span, "startTimeUnixNano")), _int(_get(span, "endTimeUnixNano"))
                name = str(_get(span, "name") or "")
                attributes |= {
                    "trace_id": str(_get(span, "traceId") or "").lower(), "span_id": str(_get(span, "spanId") or "").lower(), "parent_span_id": str(_get(span, "parentSpanId") or "").lower(),
                    "kind": _named(SPAN_KINDS, _get(span, "kind")), "status_code": _named(STATUS_CODES, _get(_get(span, "status"), "code")),
                    "duration_nanos": min(max(0, end - start), (1 << 63) - 1), "service": service, "name": name,
                }
                yield start or None, host, service, "otel:span", "main", name, _dump(attributes)


def _read(rows: Callable, message: str):
    """Bodies of text are JSON; those of bytes the binary form."""

    def request_of(body):
        try:
            if isinstance(body, bytes):
                return decode(message, body)
            found = json.loads(body) if body else None
            return found if isinstance(found, dict) else None
        except (ValueError, RecursionError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in EVENTS.split(", ")]
        for batch in batches:
            out = []
            for body in batch.column(0).to_pylist():
                request = request_of(body)
                if request is not None:
                    out += rows(request)
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(c, pa.string()) for c in columns[1:]]], names=names)

    return run


def _events(rows: DataFrame) -> DataFrame:
    ns = F.coalesce("timestamp_ns", F.unix_micros(F.current_timestamp()) * 1000)
    return rows.withColumn("timestamp_ns", ns).select(F.timestamp_micros(nanos_to_micros(F.col("timestamp_ns"))).alias("timestamp"), "host", "source", "sourcetype", "index", "raw", "timestamp_ns", "attributes")


def read_logs(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Canonical events of log export requests, JSON in a column of text or messages in one of bytes. A null or unreadable request gives no event; a
    record without a time gets the time of reading."""
    return _events(bodies.select(body).mapInArrow(_read(log_rows, "LogsRequest"), EVENTS))


def read_traces(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Canonical events of trace export requests, one a span, in either form."""
    return _events(bodies.select(body).mapInArrow(_read(span_rows, "TracesRequest"), EVENTS))
