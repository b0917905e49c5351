"""Trace search over a table of spans."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlog.functions.text import attr_get

REQUIRED = ("timestamp", "trace_id", "span_id", "parent_span_id", "service", "name", "kind", "status_code", "duration_nanos")
# Units of durations, longest spelling first; a bare number is of microseconds.
UNITS = [("ns", 1), ("us", 1_000), ("µs", 1_000), ("μs", 1_000), ("ms", 1_000_000), ("s", 1_000_000_000), ("m", 60_000_000_000), ("h", 3_600_000_000_000)]


def check_schema(spans: DataFrame) -> DataFrame:
    missing = [c for c in REQUIRED if c not in spans.columns]
    if missing:
        raise ValueError(f"not a table of spans: it lacks {', '.join(missing)}")
    return spans


def duration_nanos(text: str) -> int:
    """Nanoseconds of a duration such as 1.5ms; ValueError if it is none."""
    text = text.strip()
    number, factor = next(((text[: -len(u)], f) for u, f in UNITS if text.endswith(u)), (text, 1_000))
    try:
        n = float(number) * factor
    except ValueError:
        raise ValueError(f"invalid duration {text!r}") from None
    if not 0 <= n < 1 << 63:
        raise ValueError(f"invalid duration {text!r}")
    return round(n)


def tag_filters(tags: str) -> dict[str, str]:
    """Filters stated as a JSON object of keys and values."""
    found = json.loads(tags)
    if not isinstance(found, dict):
        raise ValueError("tags must be a JSON object")
    return {k: v if isinstance(v, str) else json.dumps(v, separators=(",", ":")) for k, v in found.items()}


def services(spans: DataFrame) -> DataFrame:
    """The services' names, in order."""
    return spans.where("service <> ''").select("service").distinct().orderBy("service")


def operations(spans: DataFrame, service: str | None = None) -> DataFrame:
    rows = spans.where("name <> ''")
    if service:
        rows = rows.where(F.col("service") == service)
    return rows.select("name").distinct().orderBy("name")


def _matching(spans: DataFrame, service: str | None, operation: str | None, start_us: int | None, end_us: int | None, min_duration: str | None, max_duration: str | None, tags: str | None) -> DataFrame:
    tests: list[Column] = [F.col("trace_id") != ""]
    if service:
        tests.append(F.col("service") == service)
    if operation:
        tests.append(F.col("name") == operation)
    if start_us is not None:
        tests.append(F.col("timestamp") >= F.timestamp_micros(F.lit(start_us)))
    if end_us is not None:  # the end itself is within
        tests.append(F.col("timestamp") <= F.timestamp_micros(F.lit(end_us)))
    if min_duration:
        tests.append(F.col("duration_nanos") >= duration_nanos(min_duration))
    if max_duration:
        tests.append(F.col("duration_nanos") <= duration_nanos(max_duration))
    for key, value in (tag_filters(tags) if tags else {}).items():
        tests.append(attr_get(F.col("attributes"), key) == value)
    for test in tests:
        spans = spans.where(test)
    return spans


def find(spans: DataFrame, service: str | None = None, operation: str | None = None, start_us: int | None = None, end_us: int | None = None, min_duration: str | None = None, max_duration: str | None = None, tags: str | None = None, limit: int = 20) -> DataFrame:
    """(trace_id, newest): the traces with a span that fits, newest first, equal times by id."""
    rows = _matching(check_schema(spans), service, operation, start_us, end_us, min_duration, max_duration, tags)
    return rows.groupBy("trace_id").agg(F.max("timestamp").alias("newest")).orderBy(F.desc("newest"), "trace_id").limit(max(1, limit))


def assemble(spans: DataFrame, ids: DataFrame) -> DataFrame:
    """The spans of the traces: a semi-join, one job with the search that found the ids."""
    return spans.join(ids.select("trace_id"), "trace_id", "left_semi").select(*REQUIRED, "attributes")


def rendered(spans: DataFrame) -> DataFrame:
    """One row a trace: its spans in order of time and id, with process ids by service, references
    to parents, string tags by key, and events as logs.

    A trace's spans come together in one row: the caller chose them by a limit on traces."""
    tags = F.from_json("attributes", "map<string,variant>")
    texts = F.map_filter(tags, lambda k, v: ~k.isin("events", "links") & (F.schema_of_variant(v) == "STRING"))
    entries = F.transform(F.array_sort(F.map_keys(texts)), lambda k: F.struct(k.alias("key"), F.lit("string").alias("type"), F.try_variant_get(texts[k], "$", "string").alias("value")))
    events = F.from_json(F.get_json_object("attributes", "$.events"), "array<struct<timeUnixNano:string,name:string>>")
    logs = F.transform(events, lambda e: F.struct(F.floor(e["timeUnixNano"].try_cast("decimal(38,0)") / 1000).cast("long").alias("timestamp"), e["name"].alias("event")))
    parent = F.struct(F.lit("CHILD_OF").alias("refType"), F.col("trace_id").alias("traceID"), F.col("parent_span_id").alias("spanID"))
    service = F.when(F.col("service") != "", F.col("service")).otherwise("unknown")
    one = F.struct(
        F.unix_micros("timestamp").alias("startTime"), F.col("span_id").alias("spanID"), F.col("name").alias("operationName"), service.alias("service"), F.expr("coalesce(duration_nanos, 0) div 1000").alias("duration"),
        F.when(F.col("parent_span_id") != "", F.array(parent)).otherwise(F.array().cast("array<struct<refType:string,traceID:string,spanID:string>>")).alias("references"), F.coalesce(entries, F.array().cast("array<struct<key:string,type:string,value:string>>")).alias("tags"), F.coalesce(logs, F.array().cast("array<struct<timestamp:bigint,event:string>>")).alias("logs"),
    )
    rows = spans.groupBy("trace_id").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    names = F.array_distinct(F.transform("spans", lambda s: s["service"]))
    processes = F.transform(names, lambda n: F.struct(F.concat(F.lit("p"), F.array_position(names, n).cast("string")).alias("id"), n.alias("serviceName")))
    numbered = F.transform("spans", lambda s: s.withField("processID", F.concat(F.lit("p"), F.array_position(names, s["service"]).cast("string"))))
    return rows.select(F.col("trace_id").alias("traceID"), numbered.alias("spans"), processes.alias("processes"))
