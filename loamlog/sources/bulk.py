"""Bulk requests: action lines and source lines in pairs.

Lines are numbered within their request. An action that takes a source (index, create, update)
makes the line after it a source, whatever it holds; so lines are paired in one pass over each
request, by Arrow batches of whole requests.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "request_id long, item_no int, action string, index string, error string, timestamp_us long, host string, source string, sourcetype string, raw string, attributes string"


class BadRequest(ValueError):
    """The request as a whole is refused."""


def epoch_us(n: int) -> int:
    """Micros of a whole number of nanoseconds, milliseconds or seconds, by its size."""
    if abs(n) >= 10**15:
        return n // 1000
    return n * 1000 if abs(n) >= 10**11 else n * 1_000_000


def _iso_us(text: str) -> int | None:
    try:
        t = datetime.fromisoformat(text)
    except ValueError:
        return None
    if t.tzinfo is None:
        return None
    return int((t - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000 + 0.5)


def _time(doc: dict) -> int | None:
    stated = doc.get("@timestamp")
    if isinstance(stated, str):
        del doc["@timestamp"]
        if (us := _iso_us(stated)) is not None:
            return us
    other = doc.pop("timestamp", None)
    if isinstance(other, str):
        us = _iso_us(other)
        if us is None and other.lstrip("-").isdigit():
            us = epoch_us(int(other))
        return us
    return epoch_us(other) if isinstance(other, int) and not isinstance(other, bool) else None


def _nested(doc: dict, outer: str, inner: str) -> str | None:
    """A string member of a member, taken out of the document."""
    found = doc.get(outer)
    if isinstance(found, dict) and isinstance(found.get(inner), str):
        text = found.pop(inner)
        if not found:
            del doc[outer]
        return text
    return None


def _string(doc: dict, key: str) -> str | None:
    return doc.pop(key) if isinstance(doc.get(key), str) else None


def event_of(doc: dict) -> tuple:
    """(timestamp_us, host, source, sourcetype, raw, attributes) of a source document."""
    whole = json.dumps(doc, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    doc = json.loads(whole)
    time = _time(doc)
    host = _nested(doc, "host", "name") or _string(doc, "host") or "unknown"
    source = _nested(doc, "service", "name") or _string(doc, "source") or "es-bulk"
    kind = _string(doc, "sourcetype") or "es:doc"
    message = _string(doc, "message")
    rest = json.dumps(doc, ensure_ascii=False, sort_keys=True, separators=(",", ":")) if doc else None
    return time, host, source, kind, whole if message is None else message, rest


def items(text: str, path_index: str | None = None) -> list[tuple]:
    """(action, index, error, *event) of each action; raises BadRequest for a malformed request."""
    lines, out = iter(text.split("\n")), []
    for line in lines:
        line = line.strip()
        if not line:
            continue
        try:
            action = json.loads(line)
        except ValueError as e:
            raise BadRequest(f"invalid action line: {e}") from None
        if not isinstance(action, dict) or len(action) != 1:
            raise BadRequest("an action line must be an object of exactly one action")
        (name, about), = action.items()
        if not isinstance(about, dict):
            raise BadRequest(f"the action {name} must state an object")
        index = about["_index"] if isinstance(about.get("_index"), str) else path_index
        error = None if index and index.strip() else "no index"
        if name in ("index", "create"):
            source = next(lines, "").strip()
            if not source:
                raise BadRequest(f"the action {name} lacks its source line")
            try:
                doc = json.loads(source)
            except ValueError as e:
                raise BadRequest(f"invalid source line: {e}") from None
            if not isinstance(doc, dict):
                raise BadRequest("a source line must be an object")
            out.append((name, index, error, *(event_of(doc) if not error else [None] * 6)))
        elif name in ("update", "delete"):
            if name == "update" and next(lines, None) is None:
                raise BadRequest("the action update lacks its source line")
            out.append((name, index, error or f"{name} is not supported", *[None] * 6))
        else:
            raise BadRequest(f"unsupported action {name}")
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), *[pa.string()] * 5]
    names = [c.split()[0] for c in ROWS.split(", ")]
    for batch in batches:
        out = []
        for request, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            try:
                found = items(text or "")
            except BadRequest as e:
                found = [(None, None, str(e), *[None] * 6)]
            out += [(request, i, *item) for i, item in enumerate(found)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def read_bulk(requests: DataFrame) -> DataFrame:
    """Items of bulk requests (request_id, text): one row each action, with ``error`` null for an
    accepted document, which then has an event's columns. A malformed request is one row with its
    error and no action; null and empty requests have no items."""
    return requests.select("request_id", "text").mapInArrow(_read, ROWS)


def accepted(found: DataFrame) -> DataFrame:
    us = F.coalesce("timestamp_us", F.unix_micros(F.current_timestamp()))
    return found.where("error is null").select(F.timestamp_micros(us).alias("timestamp"), "host", "source", "sourcetype", "index", "raw", (us * 1000).alias("timestamp_ns"), "attributes")
