"""Queries of the log and trace operators: search, attributes, table functions, histograms, sketches,
traces, mapping, ingest, the table layer and streams."""

from __future__ import annotations

import itertools
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlog.functions import text
from loamlog.operators import mapping, nested, sketch, spans, tables
from loamlog.plans import scratch
from loamlog.plans.adapter import logs, table, traces
from loamlog.queries.problems import _P2, _P2_RECORDS

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_TOKENS = "list_transform(list_slice(regexp_extract_all({0}, '[A-Za-z0-9]{{3,}}'), 1, 64), lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"
_RAW = _TOKENS.format("raw")
_LOGS = """logs as (select ts as timestamp, epoch_us(ts) * 1000 as timestamp_ns, 'host-' || (user_id % 16) as host, 'svc-' || (user_id % 5) as source, event_type as sourcetype, 'main' as index,
  'user=' || user_id || ' type=' || event_type || ' path="/e/' || event_id || '"' as raw, props as attributes, event_id from events)"""
_SPANS = """spans as (select ts as timestamp, lpad(lower(to_hex(user_id)), 32, '0') as trace_id, lpad(lower(to_hex(event_id)), 16, '0') as span_id, 'svc-' || (user_id % 5) as service, event_type as name,
  cast(round(value * 1000000) as bigint) as duration_nanos, props as attributes from events)"""


def _search(name: str, function, words: str, sql: str) -> None:
    def run(spark, sf, f=function):
        return table(spark, sf, "log_events").where(f(F.col("raw"), words)).select("event_id")

    run.__name__ = name
    run.__doc__ = f"Rows where {function.__name__} finds {words!r}."
    query(f"select event_id from log_events where coalesce({sql}, false)")(run)


_search("match_terms_rows", text.match_terms, "Lease LOST after", f"len(list_filter(['lease', 'lost', 'after'], lambda q: not list_contains({_RAW}, q))) = 0")
_search("match_alias", text.match, "snapshot committed", f"list_contains({_RAW}, 'snapshot') and list_contains({_RAW}, 'committed')")
_search("match_any_rows", text.match_any, "rebalanced backpressure", f"list_has_any({_RAW}, ['rebalanced', 'backpressure'])")
_search("match_phrase_rows", text.match_phrase, "poll returned", f"len(list_filter(range(1, len({_RAW})), lambda i: list_slice({_RAW}, i, i + 1) = ['poll', 'returned'])) > 0")
_search("match_prefix_rows", text.match_prefix, "rebal compac", f"len(list_filter({_RAW}, lambda t: starts_with(t, 'rebal') or starts_with(t, 'compac'))) > 0")


@query(f"""select count(*) filter (where lower(raw) like '%lag%') as by_like, count(*) filter (where coalesce(list_contains({_RAW}, 'lag'), false)) as by_token from log_events""")
def match_vs_like_gap(spark, sf):
    raw = F.col("raw")
    return table(spark, sf, "log_events").agg(F.count_if(F.lower(raw).contains("lag")).alias("by_like"), F.count_if(text.match_terms(raw, "lag")).alias("by_token"))


@query(f"select event_id from log_events where coalesce(list_contains({_RAW}, 'upload'), false)")
def search_sugar(spark, sf):
    """search('...') in SQL, over the table's default search fields."""
    from loamlog.engine import Engine

    engine = Engine(spark, {"log_events": table(spark, sf, "log_events")}, {"log_events": "event_time"}, {"log_events": ["raw"]})
    return engine.frame("select event_id from log_events where search('upload')")


@query(f"""select token, count(*) as n from (select unnest({_RAW}) as token from log_events) group by 1 having count(*) >= 20""")
def token_counts(spark, sf):
    return token_counts_all(spark, sf).where("n >= 20")


@query(f"select token, count(*) as n from (select unnest({_RAW}) as token from log_events) group by 1")
def token_counts_all(spark, sf):
    return table(spark, sf, "log_events").select(F.explode(text.tokens(F.col("raw"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


_STEM = """case when ends_with(t, 'ing') and length(t) >= 7 and regexp_matches(t[:-4], '[aeiou]') then t[:-4] when ends_with(t, 'ed') and length(t) >= 5 and regexp_matches(t[:-3], '[aeiou]') then t[:-3]
  when ends_with(t, 'es') and length(t) >= 5 then t[:-3] when ends_with(t, 's') and not ends_with(t, 'ss') and length(t) >= 4 then t[:-2] else t end"""


@query(f"select stem, count(*) as n from (select {_STEM} as stem from (select unnest({_RAW}) as t from log_events)) where length(stem) >= 3 group by 1 having count(*) >= 20")
def stem_counts(spark, sf):
    return stem_counts_all(spark, sf).where("n >= 20")


@query(f"select stem, count(*) as n from (select {_STEM} as stem from (select unnest({_RAW}) as t from log_events)) where length(stem) >= 3 group by 1")
def stem_counts_all(spark, sf):
    return table(spark, sf, "log_events").select(F.explode(text.stem_tokens(F.col("raw"))).alias("stem")).groupBy("stem").agg(F.count("*").alias("n"))


@query(f"with {_LOGS} select coalesce(nullif(regexp_extract(raw, '(?:^|[^A-Za-z0-9_])type=(?:\"([^\"]*)\"|([^\\s,]+))', 2), ''), '') as kind, regexp_extract(raw, 'path=\"([^\"]*)\"', 1) as path, count(*) as n from logs group by 1, 2")
def kv_extract_group(spark, sf):
    raw = F.col("raw")
    rows = logs(table(spark, sf, "events"))
    return rows.groupBy(text.kv_extract(raw, "type").alias("kind"), text.kv_extract(raw, "path").alias("path")).agg(F.count("*").alias("n"))


@query("select json_extract_string(props, '$.k') as k, count(*) as n from events group by 1")
def attr_get_group(spark, sf):
    return table(spark, sf, "events").groupBy(text.attr_get(F.col("props"), "k").alias("k")).agg(F.count("*").alias("n"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k from events where try_cast(json_extract_string(props, '$.k') as bigint) > 60")
def attr_get_cast_filter(spark, sf):
    k = text.attr_get(F.col("props"), "k").try_cast("long")
    return table(spark, sf, "events").select("event_id", k.alias("k")).where("k > 60")


@query("""select event_id, coalesce(json_extract_string(attributes, '$."k8s.pod"'), json_extract_string(attributes, '$.k8s.pod')) as pod from log_events""")
def attr_get_dotted(spark, sf):
    """A dotted key: the literal member wins, else the nested one."""
    return table(spark, sf, "log_events").select("event_id", text.attr_get(F.col("attributes"), "k8s.pod").alias("pod"))


# Time


@query("select epoch_us(time_bucket(interval 1 hour, event_time)) as bucket_us, count(*) as n from log_events group by 1")
def hist_hour(spark, sf):
    return tables.date_histogram(table(spark, sf, "log_events"), "event_time", 3_600_000_000)


@query("select cast(epoch_us(event_time) - epoch_us(event_time) % 86400000000 as bigint) as bucket_us, count(*) as n from log_events group by 1")
def hist_day(spark, sf):
    return tables.date_histogram(table(spark, sf, "log_events"), "event_time", 86_400_000_000)


@query("select cast(v - ((v % 1000) + 1000) % 1000 as bigint) as bucket_us, count(*) as n from (values (-2500), (-1001), (-1000), (-1), (0), (1), (999), (1000), (1999)) t(v) group by 1")
def hist_before_epoch(spark, sf):
    """Bins of instants around 1970."""
    rows = spark.createDataFrame([(v,) for v in (-2500, -1001, -1000, -1, 0, 1, 999, 1000, 1999)], "v long").select(F.timestamp_micros("v").alias("t"))
    return tables.date_histogram(rows, "t", 1000)


_START, _END = 1772409600000000, 1774000000000000


@query(f"select count(*) as n from log_events where epoch_us(event_time) >= {_START} and epoch_us(event_time) < {_END}")
def windowed_count(spark, sf):
    return table(spark, sf, "log_events").where(tables.within(F.col("event_time"), _START, _END)).agg(F.count("*").alias("n"))


@query(f"select sourcetype, count(*) as n from log_events where epoch_us(event_time) >= {_START} and epoch_us(event_time) < {_END} group by 1")
def windowed_group_count(spark, sf):
    return table(spark, sf, "log_events").where(tables.within(F.col("event_time"), _START, _END)).groupBy("sourcetype").agg(F.count("*").alias("n"))


@query("select count(*) as n, count(*) filter (where lang <> 'en') as other, count(*) filter (where lang not in ('en', 'de')) as others from documents")
def negation_count(spark, sf):
    c = F.col("lang")
    return table(spark, sf, "documents").agg(F.count("*").alias("n"), F.count_if(c != "en").alias("other"), F.count_if(~c.isin("en", "de")).alias("others"))


@query("select n, case when abs(n) >= 1000000000000000 then n // 1000 when abs(n) >= 100000000000 then n * 1000 else n * 1000000 end as us from (select event_id as n from events union all select event_id * 1000000000 + 1000000000000 from events union all select timestamp_ns from log_events)")
def epoch_heuristic(spark, sf):
    n = table(spark, sf, "events").select(F.col("event_id").alias("n"))
    n = n.unionAll(table(spark, sf, "events").select(F.col("event_id") * 1000000000 + 1000000000000)).unionAll(table(spark, sf, "log_events").select("timestamp_ns"))
    return n.select("n", text.epoch_micros(F.col("n")).alias("us"))


# Table functions and sketches


@query(f"""with {_LOGS} select host, source, sourcetype, index, epoch_us(max(timestamp)) as us, arg_max(raw, (timestamp_ns, raw)) as raw from logs group by 1, 2, 3, 4""")
def last_values(spark, sf):
    return tables.last_values(logs(table(spark, sf, "events"))).select("host", "source", "sourcetype", "index", F.unix_micros("timestamp").alias("us"), "raw")


@query(f"with {_LOGS} select distinct source as value from logs")
def distinct_values(spark, sf):
    return tables.distinct_values(logs(table(spark, sf, "events")), "source")


@query(f"with {_LOGS} select count(*) as n_series, (select count(distinct host) from logs) as n_hosts from (select distinct host, source, sourcetype, index from logs)")
def table_functions_sql(spark, sf):
    """last_values() and distinct_values() called in SQL."""
    from loamlog.engine import Engine

    engine = Engine(spark, {"events": logs(table(spark, sf, "events"))}, {"events": "timestamp"})
    return engine.frame("select (select count(*) from last_values()) as n_series, (select count(*) from distinct_values('host')) as n_hosts")


@query("select host as value, count(*) as count, 0 as error_upper_bound, (select count(*) from log_events) - (select sum(n) from (select count(*) as n from log_events group by host order by n desc, host limit 5)) as not_counted from log_events group by 1 order by count desc, host limit 5")
def approx_topk(spark, sf):
    """With more counters than hosts the sketch is exact."""
    return sketch.top_groups(table(spark, sf, "log_events"), "host", 5, 10_000)


@query()
def approx_topk_bounded(spark, sf):
    """With fewer counters than values: counts come with their error bound."""
    return sketch.top_groups(table(spark, sf, "log_events"), "source", 10, 100)


@query("select count(*) as n, count(distinct event_id) as ids from log_events")
def sharded_scan(spark, sf):
    """The shards of a scan together are the table."""
    df = table(spark, sf, "log_events")
    parts = [tables.shard(df, i, 3).select("event_id") for i in range(3)]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("select 1000 as n, 16 as hosts")
def corpus_counts(spark, sf):
    return tables.corpus(spark, 1000).agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts"))


# Traces


@query(f"with {_SPANS} select distinct service from spans where service <> ''")
def traces_services(spark, sf):
    return spans.services(traces(table(spark, sf, "events")))


@query(f"with {_SPANS} select distinct name from spans where service = 'svc-1' and name <> ''")
def traces_operations(spark, sf):
    return spans.operations(traces(table(spark, sf, "events")), "svc-1")


_FIND = f"with {_SPANS}, found as (select trace_id, epoch_us(max(timestamp)) as newest_us from spans where trace_id <> '' and service = 'svc-1' and duration_nanos >= 20000000 and json_extract_string(attributes, '$.k') = '7' group by 1 order by 2 desc, 1 limit 20)"


def _found(spark, sf) -> DataFrame:
    return spans.find(traces(table(spark, sf, "events")), service="svc-1", min_duration="20ms", tags='{"k": 7}')


@query(_FIND + " select trace_id, newest_us from found")
def traces_find(spark, sf):
    return _found(spark, sf).select("trace_id", F.unix_micros("newest").alias("newest_us"))


@query(_FIND + " select trace_id, span_id, service, name, duration_nanos from spans where trace_id in (select trace_id from found)")
def traces_spans(spark, sf):
    return spans.assemble(traces(table(spark, sf, "events")), _found(spark, sf)).select("trace_id", "span_id", "service", "name", "duration_nanos")


@query(_FIND + " select trace_id as traceID, count(*) as n_spans, count(distinct service) as n_processes from spans where trace_id in (select trace_id from found) group by 1")
def traces_rendered(spark, sf):
    whole = spans.rendered(spans.assemble(traces(table(spark, sf, "events")), _found(spark, sf)))
    return whole.select("traceID", F.size("spans").cast("long").alias("n_spans"), F.size("processes").cast("long").alias("n_processes"))


# Mapping and promotion


@query("select event_id, try_cast(json_extract_string(props, '$.k') as bigint) as k_long, cast(json_extract_string(props, '$.k') as varchar) as k_text, try_cast(json_extract_string(props, '$.k') as double) as k_double from events")
def promote_typed(spark, sf):
    rows = table(spark, sf, "events").withColumn("attributes", F.col("props"))
    return mapping.promote(rows, {"k_long": ("k", "long"), "k_text": ("k", "text"), "k_double": ("k", "double")}).select("event_id", "k_long", "k_text", "k_double")


def _config(mode: str) -> mapping.IndexConfig:
    f = mapping.Field
    return mapping.IndexConfig("typed-events", [f("timestamp", "datetime", True), f("host", "text", True, "raw"), f("k", "long"), f("raw", "text")], mode=mode, default_search_fields=["raw"])


@query(f"with {_LOGS} select epoch_us(timestamp) as us, host, raw, try_cast(json_extract_string(attributes, '$.k') as bigint) as k, cast(null as varchar) as attributes, false as violation from logs")
def mapping_dynamic(spark, sf):
    return mapping.map_events(logs(table(spark, sf, "events")), _config("dynamic")).select(F.unix_micros("timestamp").alias("us"), "host", "raw", "k", "attributes", "violation")


@query("select event_id, attributes is not null and attributes <> '{}' as violation from log_events")
def mapping_strict(spark, sf):
    """Rows that carry undeclared attributes."""
    rows = table(spark, sf, "log_events").select(F.col("event_time").alias("timestamp"), "host", "source", "sourcetype", F.col("index_id").alias("index"), "raw", "timestamp_ns", "attributes", F.col("event_id").cast("string").alias("id"))
    f = mapping.Field
    config = mapping.IndexConfig("strict-events", [f("timestamp", "datetime", True), f("raw", "text")], mode="strict")
    return mapping.map_events(rows.withColumn("raw", F.col("id")), config).select(F.col("raw").cast("long").alias("event_id"), "violation")


# Ingest


@query()
def otlp_logs(spark, sf):
    from loamlog.sources import otlp

    return otlp.read_logs(table(spark, sf, "otlp_exports")).select("host", "source", "sourcetype", "index", "raw", "attributes", "timestamp_ns")


def _attribute(of: str, key: str) -> str:
    value = "coalesce(json_extract_string({0}, '$.value.stringValue'), json_extract_string({0}, '$.value.string_value'))"
    return value.format(f"list_filter(try_cast(json_extract(j, '{of}') as json[]), lambda x: json_extract_string(x, '$.key') = '{key}' and {value.format('x')} is not null)[1]")


_CORE = _P2 + f""", r as (select export_id, node_path, {_attribute('$.resource.attributes', 'host.name')} as host, {_attribute('$.resource.attributes', 'service.name')} as service from n where role = 'R'),
  s as (select export_id, node_path, regexp_replace(node_path, '/[^/]*$', '') as parent, nullif(json_extract_string(j, '$.scope.name'), '') as scope from n where role = 'S'),
  l as (select export_id, regexp_replace(node_path, '/[^/]*$', '') as parent, j, coalesce(json_extract(j, '$.body'), 'null') as b from n where role = 'L' and json_type(j) = 'OBJECT')
  select coalesce(nullif(r.host, ''), 'unknown') as host, coalesce(nullif(r.service, ''), s.scope, 'otel') as source, coalesce({_attribute('$.attributes', 'sourcetype')}, 'otel:logs') as sourcetype, coalesce({_attribute('$.attributes', 'index')}, 'main') as index,
    case when json_type(b) = 'NULL' then '' else coalesce(json_extract_string(b, '$.stringValue'), json_extract_string(b, '$.string_value'), cast(b as varchar)) end as raw
  from l join s on s.export_id = l.export_id and s.node_path = l.parent join r on r.export_id = s.export_id and r.node_path = s.parent"""


@query(_CORE)
def otlp_logs_core(spark, sf):
    """The columns every event has, of each request's records."""
    from loamlog.sources import otlp

    return otlp.read_logs(table(spark, sf, "otlp_exports")).select("host", "source", "sourcetype", "index", "raw")


@query("select event_id, raw, timestamp_ns, host, source from log_events where timestamp_ns <> 0")
def otlp_logs_binary(spark, sf):
    """Each log event as a request in its binary form, and read back."""
    from loamlog.sources import otlp, otlp_wire

    def to_wire(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                text = lambda key, value: {"key": key, "value": {"stringValue": value}}
                record = {"timeUnixNano": row["timestamp_ns"], "body": None if row["raw"] is None else {"stringValue": row["raw"]}, "attributes": [{"key": "event_id", "value": {"intValue": row["event_id"]}}]}
                resource = {"attributes": [text("host.name", row["host"]), text("service.name", row["source"])]}
                out.append(otlp_wire.encode("LogsRequest", {"resourceLogs": [{"resource": resource, "scopeLogs": [{"logRecords": [record]}]}]}))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["body"])

    rows = table(spark, sf, "log_events").where("timestamp_ns <> 0").select("event_id", "timestamp_ns", "raw", "host", "source")
    got = otlp.read_logs(rows.mapInArrow(to_wire, "body binary"))
    return got.select(text.attr_get(F.col("attributes"), "event_id").cast("long").alias("event_id"), "raw", "timestamp_ns", "host", "source")


@query(_P2_RECORDS)
def otlp_logs_explode(spark, sf):
    return nested.records(nested.flatten_exports(table(spark, sf, "otlp_exports")))


def _requests(spark, sf) -> DataFrame:
    """Bulk requests of the log lines of each host, an action and a source line for each."""
    line = F.concat_ws("\n", F.to_json(F.struct(F.struct(F.col("index_id").alias("_index")).alias("index"))), F.to_json(F.struct(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("@timestamp"), F.struct(F.col("host").alias("name")).alias("host"), F.col("raw").alias("message"), "line_no")))
    return table(spark, sf, "log_events").select(F.col("event_id").alias("request_id"), line.alias("text"))


@query("select event_id as request_id, index_id as index, host, raw, epoch_us(event_time) as us, '{\"line_no\":' || line_no || '}' as attributes from log_events")
def bulk_ingest(spark, sf):
    from loamlog.sources import bulk

    return bulk.read_bulk(_requests(spark, sf)).where("error is null").select("request_id", "index", "host", "raw", F.col("timestamp_us").alias("us"), "attributes")


# The table layer


def _lake(spark, sf, parts: int = 3):
    from loamlog.sources.lake import Lake

    lake = Lake(spark, scratch.new_path(spark, "lake"))
    rows = logs(table(spark, sf, "events"))
    for i in range(parts):
        lake.append(rows.where(F.pmod(F.xxhash64("raw"), F.lit(parts)) == i))
    return lake


@query(f"with {_LOGS} select raw, host from logs")
def lake_round_trip(spark, sf):
    return _lake(spark, sf).read().select("raw", "host")


@query(f"with {_LOGS} select raw from logs where (host = 'host-3' and sourcetype = 'error') is not true")
def delete_survivors(spark, sf):
    lake = _lake(spark, sf)
    lake.delete("host = 'host-3' and sourcetype = 'error'")
    return lake.read().select("raw")


@query(f"with {_LOGS} select count(*) as n from logs where epoch_us(timestamp) >= 1705276800000000")
def retention_survivors(spark, sf):
    """Files of days wholly past are dropped; the cut lies between two days, so none straddles."""
    lake = _lake(spark, sf)
    lake.retain(1705276800000000)
    return lake.read().agg(F.count("*").alias("n"))


@query(f"with {_LOGS} select count(*) as n, count(distinct raw) as n_raw, true as fewer from logs")
def compact_conserves(spark, sf):
    lake = _lake(spark, sf)
    before = len(lake.files())
    lake.compact()
    return lake.read().agg(F.count("*").alias("n"), F.countDistinct("raw").alias("n_raw")).withColumn("fewer", F.lit(len(lake.files()) < before))


@query("select event_id as id from events where event_id % 2 = 1")
def subscribe_increment(spark, sf):
    """Appends after the cursor come out, the compaction in between doesn't."""
    from loamlog.sources.lake import Cursor, Lake

    lake = Lake(spark, scratch.new_path(spark, "lake"))
    rows = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("timestamp"))
    lake.append(rows.where("event_id % 2 = 0"))
    _, cursor = lake.poll(Cursor())
    lake.append(rows.where("event_id % 4 = 1"))
    lake.compact()
    lake.append(rows.where("event_id % 4 = 3"))
    return lake.poll(cursor)[0].select(F.col("event_id").alias("id"))


@query("select event_id as id from events where event_id % 3 = 0")
def time_travel(spark, sf):
    from loamlog.sources.lake import Lake

    lake = Lake(spark, scratch.new_path(spark, "lake"))
    rows = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("timestamp"))
    first = lake.append(rows.where("event_id % 3 = 0"))
    lake.append(rows.where("event_id % 3 > 0"))
    return lake.read(first).select(F.col("event_id").alias("id"))


@query(f"with {_LOGS} select raw from logs order by timestamp_ns desc, raw desc limit 25")
def lake_newest(spark, sf):
    """The newest rows from as few files as can hold them."""
    lake = _lake(spark, sf)
    return lake.newest(200).orderBy(F.desc("timestamp_ns"), F.desc("raw")).limit(25).select("raw")


@query(f"with {_LOGS} select sourcetype as value, count(*) as n from logs group by 1")
def lake_summary(spark, sf):
    """Exact group counts from the files' summaries."""
    return _lake(spark, sf).summary(["sourcetype"]).groupBy("value").agg(F.sum("n").alias("n"))


@query("select event_id, 'new' as extra from events where event_id % 2 = 1 union all select event_id, null from events where event_id % 2 = 0")
def schema_widening(spark, sf):
    """Older files read with a newer schema: the added column is null in them."""
    from loamlog.sources.lake import Lake

    lake = Lake(spark, scratch.new_path(spark, "lake"))
    rows = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("timestamp"))
    lake.append(rows.where("event_id % 2 = 0"))
    lake.append(rows.where("event_id % 2 = 1").withColumn("extra", F.lit("new")))
    return lake.read().select("event_id", "extra")


@query("select event_id as id from events")
def buffer_union(spark, sf):
    """Committed rows and uncommitted segments, those consumed already left out."""
    from loamlog.sources.lake import Lake

    lake = Lake(spark, scratch.new_path(spark, "lake"))
    rows = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("timestamp"), F.concat(F.lit("seg-"), (F.col("event_id") % 4).cast("string")).alias("segment"))
    lake.append(rows.where("segment in ('seg-0', 'seg-1')").drop("segment"), consumed=["seg-0", "seg-1"])
    return lake.with_buffer(rows.where("segment in ('seg-1', 'seg-2', 'seg-3')")).select(F.col("event_id").alias("id"))


# Streams


def _stream(spark, sf, parts: int = 1) -> DataFrame:
    path = scratch.new_path(spark, "landing")
    rows = logs(table(spark, sf, "events"))
    (rows if parts == 1 else rows.repartition(parts)).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(path)


def _run(spark, stream: DataFrame, mode: str) -> DataFrame:
    name = "loamlog_" + scratch.uuid.uuid4().hex
    query_ = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", scratch.new_path(spark, "checkpoint")).trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.table(name)


@query("select epoch_us(time_bucket(interval 1 hour, ts)) as start_us, 'svc-' || (user_id % 5) as source, count(*) as n from events group by 1, 2")
def stream_tumbling(spark, sf):
    """A stream's hourly counts; in complete mode no row is late."""
    rows = _stream(spark, sf).groupBy(F.window("timestamp", "1 hour").alias("w"), "source").agg(F.count("*").alias("n"))
    return _run(spark, rows.select(F.unix_micros("w.start").alias("start_us"), "source", "n"), "complete")


@query("select b + o * 1800000000 as start_us, count(*) as n from (select epoch_us(ts) - epoch_us(ts) % 1800000000 as b from events), (values (0), (-1)) t(o) group by 1")
def sliding_window_extra(spark, sf):
    rows = _stream(spark, sf).groupBy(F.window("timestamp", "1 hour", "30 minutes").alias("w")).agg(F.count("*").alias("n"))
    return _run(spark, rows.select(F.unix_micros("w.start").alias("start_us"), "n"), "complete")


@query("""with g as (select user_id % 16 as h, ts, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id % 16 order by ts)) < 1800000000 then 0 else 1 end as fresh from events),
  s as (select h, ts, sum(fresh) over (partition by h order by ts rows unbounded preceding) as k from g)
  select 'host-' || h as host, epoch_us(min(ts)) as start_us, count(*) as n from s group by h, k""")
def session_window_extra(spark, sf):
    rows = logs(table(spark, sf, "events")).groupBy(F.session_window("timestamp", "30 minutes").alias("w"), "host").agg(F.count("*").alias("n"))
    return rows.select("host", F.unix_micros("w.start").alias("start_us"), "n")


@query(f"with {_LOGS} select raw from logs")
def stream_drain(spark, sf):
    """A stream of segments into a lake, drained twice: nothing is added the second time."""
    from loamlog.sources.lake import Lake
    from loamlog.streaming import ingest

    path = scratch.new_path(spark, "landing")
    logs(table(spark, sf, "events")).repartition(4).write.parquet(path)
    lake = Lake(spark, scratch.new_path(spark, "lake"))
    for _ in range(2):
        ingest.drain(ingest.landed(spark, path), lake, scratch.new_path(spark, "checkpoint")).awaitTermination()
    return lake.read().select("raw")


@query(f"with {_LOGS} select host, source, sourcetype, index, arg_max(raw, (timestamp_ns, raw)) as raw from logs group by 1, 2, 3, 4")
def stream_latest(spark, sf):
    from loamlog.streaming import ingest

    latest = ingest.Latest(spark, scratch.new_path(spark, "latest"))
    for _ in range(2):  # read again from the start, as after a lost checkpoint: nothing changes
        latest.follow(_stream(spark, sf, parts=4), scratch.new_path(spark, "checkpoint")).awaitTermination()
    return latest.read().select("host", "source", "sourcetype", "index", "raw")


def _closed_stream(spark, sf) -> DataFrame:
    """The rows as a stream that ends with one of a far later time, so that every window closes."""
    path = scratch.new_path(spark, "landing")
    rows = logs(table(spark, sf, "events")).coalesce(1)
    rows.write.parquet(path)
    last = rows.limit(1).withColumns({"timestamp": F.timestamp_seconds(F.lit(4102444800)), "source": F.lit("end"), "host": F.lit("end")})
    time.sleep(1.1)  # files are taken by their time of change
    last.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query("select epoch_us(time_bucket(interval 1 hour, ts)) as start_us, 'svc-' || (user_id % 5) as source, count(*) as n from events group by 1, 2")
def stream_windows_appended(spark, sf):
    """Hourly counts of a stream, written once their window is closed."""
    from loamlog.streaming import ingest

    out = scratch.new_path(spark, "windows")
    ingest.to_files(ingest.windowed(_closed_stream(spark, sf), "1 hour"), out, scratch.new_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).where("source <> 'end'").select(F.unix_micros("start").alias("start_us"), "source", "n")


@query("""with g as (select user_id % 16 as h, ts, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id % 16 order by ts)) < 1800000000 then 0 else 1 end as fresh from events),
  s as (select h, ts, sum(fresh) over (partition by h order by ts rows unbounded preceding) as k from g)
  select 'host-' || h as host, epoch_us(min(ts)) as start_us, count(*) as n from s group by h, k""")
def stream_sessions_appended(spark, sf):
    """Sessions of a stream's hosts, written once they are over."""
    from loamlog.streaming import ingest

    out = scratch.new_path(spark, "sessions")
    ingest.to_files(ingest.sessions(_closed_stream(spark, sf), "30 minutes"), out, scratch.new_path(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(out).where("host <> 'end'").select("host", F.unix_micros("start").alias("start_us"), "n")


# The façade


def _engine(spark, sf):
    from loamlog.engine import Engine

    return Engine(spark, {"events": logs(table(spark, sf, "events"))}, {"events": "timestamp"}, {"events": ["raw"]})


@query(f"with {_LOGS} select raw from logs where sourcetype = 'error'")
def facade_rows(spark, sf):
    """Rows as the façade renders them."""
    rows = _engine(spark, sf).sql("select raw from events where sourcetype = 'error'")["rows"]
    return spark.createDataFrame([(r["raw"],) for r in rows], "raw string")


@query("select 'small' as class, 1 as n_warnings")
def facade_cost(spark, sf):
    answer = _engine(spark, sf).sql("select count(*) as n from events", dry_run=True)
    return spark.createDataFrame([(answer["cost"]["class"], len(answer["warnings"]))], "class string, n_warnings int")



@query("select (select count(*) from events where event_type = 'error') as n_lines, true as complete")
def facade_ndjson(spark, sf):
    """Rows as lines of JSON with a trailer."""
    import json

    *lines, trailer = _engine(spark, sf).stream("select raw from events where sourcetype = 'error'")
    return spark.createDataFrame([(len(lines), json.loads(trailer)["_meta"]["complete"])], "n_lines long, complete boolean")


@query("select statement, true as refused from (values ('insert'), ('create'), ('drop'), ('set'), ('delete'), ('merge')) t(statement)")
def facade_refuses_writes(spark, sf):
    from loamlog.engine import Refused

    engine, out = _engine(spark, sf), []
    for sql in ("insert into events select * from events", "create table t as select 1", "drop view events", "set a=b", "delete from events", "merge into events using events e on true when matched then delete"):
        try:
            engine.frame(sql)
            out.append((sql.split()[0], False))
        except Refused:
            out.append((sql.split()[0], True))
    return spark.createDataFrame(out, "statement string, refused boolean")


@query("select count(*) as n, 'succeeded' as state from events")
def facade_job(spark, sf):
    """A query as a job: submitted, waited for, fetched."""
    engine = _engine(spark, sf)
    job = engine.submit("select count(*) as n from events")
    n = engine.result(job, 300)["rows"][0]["n"]
    return spark.createDataFrame([(n, engine.status(job))], "n long, state string")


@query(f"with {_LOGS} select host as value, count(*) as count from logs group by 1 order by 2 desc, 1 limit 4")
def facade_top_exact(spark, sf):
    rows = _engine(spark, sf).top("events", "host", 4, exact=True)["rows"]
    return spark.createDataFrame([(r["value"], r["count"]) for r in rows], "value string, count long")


@query("select status, priority from (values ('succeeded', 'interactive'), ('dry_run', 'batch'), ('refused', 'interactive')) t(status, priority)")
def audit_rows(spark, sf):
    """Every query leaves a row in the audit table."""
    from loamlog.engine import Engine, Refused
    from loamlog.sources.lake import Lake

    audit = Lake(spark, scratch.new_path(spark, "audit"))
    engine = Engine(spark, {"events": logs(table(spark, sf, "events"))}, audit=audit)
    engine.sql("select 1 as one")
    engine.sql("select 1 as one", priority="batch", dry_run=True)
    try:
        engine.sql("select count(*) as n from events", {"max_bytes_scanned": 1})
    except Refused:
        pass
    engine.flush_audit()
    return audit.read().select("status", "priority")


@query(f"with {_LOGS} select raw from logs where sourcetype = 'error' and host = 'host-2'")
def lake_index_search(spark, sf):
    """A term search that opens only files listed with the terms."""
    lake = _lake(spark, sf)
    lake.build_index("raw")
    return lake.search("raw", "type error").where("host = 'host-2'").select("raw")


@query(f"with {_LOGS} select raw from logs where contains(raw, 'type=pur')")
def lake_index_containing(spark, sf):
    """A substring search that opens only files with all its runs of three characters."""
    lake = _lake(spark, sf)
    lake.build_index("raw", "trigrams")
    return lake.containing("raw", "type=pur").select("raw")


@query(f"with {_LOGS} select raw from logs where timestamp >= timestamp '2024-01-05 00:00:00' and timestamp < timestamp '2024-01-08 00:00:00'")
def lake_window_sql(spark, sf):
    """SQL over a lake: the files outside the query's time window aren't opened."""
    from loamlog.engine import Engine

    engine = Engine(spark, {}, lakes={"lake_events": _lake(spark, sf)})
    return engine.frame("select raw from lake_events where timestamp >= '2024-01-05' and timestamp < '2024-01-08'")


@query("""select lpad(lower(to_hex(user_id)), 32, '0') as trace_id, lpad(lower(to_hex(event_id)), 16, '0') as span_id, 'svc-' || (user_id % 5) as source, event_type as raw, epoch_us(ts) * 1000 as timestamp_ns, event_id * 1000 as duration_nanos from events""")
def otlp_traces(spark, sf):
    """Spans of trace export requests, one request an event."""
    from loamlog.sources import otlp

    text_value = lambda c: F.struct(c.alias("stringValue"))
    spans_ = traces(table(spark, sf, "events")).join(table(spark, sf, "events").select(F.lpad(F.lower(F.hex("event_id")), 16, "0").alias("span_id"), "event_id"), "span_id")
    span = F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), "name", F.lit(2).alias("kind"), F.col("timestamp_ns").cast("string").alias("startTimeUnixNano"), (F.col("timestamp_ns") + F.col("event_id") * 1000).cast("string").alias("endTimeUnixNano"))
    resource = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), text_value(F.col("service")).alias("value"))).alias("attributes"))
    body = F.to_json(F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))
    got = otlp.read_traces(spans_.select(body.alias("body")))
    about = F.col("attributes")
    return got.select(text.attr_get(about, "trace_id").alias("trace_id"), text.attr_get(about, "span_id").alias("span_id"), "source", "raw", "timestamp_ns", text.attr_get(about, "duration_nanos").cast("long").alias("duration_nanos"))


@query("select epoch_us(time_bucket(interval 6 hours, ts)) as bucket_us, count(*) as n from events group by 1")
def date_bin_sql(spark, sf):
    """date_bin as a SQL function."""
    return _engine(spark, sf).frame("select unix_micros(date_bin(interval 6 hours, timestamp)) as bucket_us, count(*) as n from events group by 1")


@query("select id, fields from (values ('logs-web', 2), ('logs-api', 2), ('traces-x', 1)) t(id, fields)")
def index_templates(spark, sf):
    """Index ids resolved by the template of the highest priority that matches."""
    f = mapping.Field
    one, two = [f("timestamp", "datetime", True)], [f("timestamp", "datetime", True), f("raw", "text")]
    templates = [mapping.Template("any", ["*"], 0, one), mapping.Template("logs", ["logs-*"], 10, two), mapping.Template("later", ["logs-*"], 10, one)][::-1]
    templates[0].template_id = "z-later"
    rows = [(i, len(mapping.resolve(templates, i).fields)) for i in ("logs-web", "logs-api", "traces-x")]
    return spark.createDataFrame(rows, "id string, fields long")


@query(f"with {_LOGS} select raw from logs")
def live_tail(spark, sf):
    """The rows of a stream as they arrive."""
    from loamlog.streaming import ingest

    stream = _stream(spark, sf)
    live = ingest.Tail(spark, scratch.new_path(spark, "tail"), stream.schema)
    live.follow(stream, scratch.new_path(spark, "checkpoint")).awaitTermination()
    return live.read().select("raw")


@query("select user_id, cast(sum(cast(value as decimal(18, 4))) as double) / count(value) as mean, count(*) as n from events group by 1")
def grouped_avg(spark, sf):
    """A mean from sums and counts of parts: what each file's partial result merges to."""
    rows = table(spark, sf, "events")
    parts = rows.groupBy("user_id", F.spark_partition_id().alias("part")).agg(F.sum(F.col("value").cast("decimal(18,4)")).alias("s"), F.count("value").alias("k"), F.count("*").alias("n"))
    whole = parts.groupBy("user_id").agg(F.sum("s").alias("s"), F.sum("k").alias("k"), F.sum("n").alias("n"))
    return whole.select("user_id", (F.col("s").cast("double") / F.nullif(F.col("k"), F.lit(0))).alias("mean"), "n")


# Folders, segments and registries


@query("select l_returnflag, l_shipmode, count(*) as n from (select l_returnflag, case when l_orderkey % 2 = 0 then 'even' end as l_shipmode from lineitem) group by all")
def folder_table(spark, sf):
    """Files of differing columns at differing depths below one folder."""
    from loamlog.sources import folder

    path = scratch.new_path(spark, "folder")
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag")
    rows.where("l_orderkey % 2 = 0").withColumn("l_shipmode", F.lit("even")).write.parquet(f"{path}/a/b/c")
    rows.where("l_orderkey % 2 = 1").write.parquet(f"{path}/d")
    return folder.parquet_folder(spark, path).groupBy("l_returnflag", "l_shipmode").agg(F.count("*").alias("n"))


@query("select count(*) as n, count(*) as n_distinct, 3 as n_shards from events")
def sharded_files(spark, sf):
    """The shards of a table of many files: each file in one of them, none without a file."""
    from loamlog.sources import folder

    path = scratch.new_path(spark, "folder")
    rows = table(spark, sf, "events")
    rows.repartition(40, "user_id").write.parquet(path)
    paths = [r["path"] for r in folder.listing(spark, path).collect()]
    parts = [folder.shard(spark, paths, i, 3, rows.schema).select("event_id", F.lit(i).alias("shard")) for i in range(3)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_distinct"), F.countDistinct("shard").alias("n_shards"))


@query("select count(*) as n, count(*) as n_distinct, true as even from events")
def file_packing(spark, sf):
    """The files of a table in four parts of about equal size: each file in one of them."""
    from loamlog.sources import folder

    path = scratch.new_path(spark, "folder")
    table(spark, sf, "events").repartition(23, "user_id").write.parquet(path)
    sizes = {r["path"]: r["n_bytes"] for r in folder.listing(spark, path).collect()}
    parts = folder.packed(sizes.items(), 4)
    weights = [sum(sizes[f] for f in p) for p in parts]
    rows = spark.read.parquet(*parts[0])
    for p in parts[1:]:
        rows = rows.unionByName(spark.read.parquet(*p))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_distinct")).withColumn("even", F.lit(max(weights) - min(weights) <= max(sizes.values())))


@query("select event_id, event_type, 1 as n_times from events")
def wal_segments_consumed(spark, sf):
    """Rows through producers' sealed segments and consumers that die between reading and their commit."""
    from loamlog.plans.store import TaskStore
    from loamlog.streaming import ingest

    rows = table(spark, sf, "events").select("event_id", "event_type")
    folders = ingest.produce(rows, scratch.new_path(spark, "wal"), segment_rows=1000, append_rows=5000)
    path = scratch.new_path(spark, "read")

    def read(segments):
        out, producer, crashed = TaskStore(path), segments.folder.rpartition("/")[2], False
        while names := segments.open("reader").poll(3):
            ingest.keep(out, f"{producer}-{names[0]}.parquet", segments.rows(names))
            if not crashed:
                crashed = True  # kept, but not committed: polled again
                continue
            segments.open("reader").commit(names[-1])

    ingest.consume(spark, folders, read)
    whole = spark.read.schema(rows.schema).parquet(path) if folders else rows.limit(0)
    return whole.groupBy("event_id", "event_type").agg(F.count("*").alias("n_times"))


@query("select name, state from (values ('s-0', 'committed'), ('s-1', 'sealed'), ('s-2', 'claimed'), ('s-3', 'sealed')) t(name, state)")
def wal_lifecycle(spark, sf):
    """Claimed by one, finished, released, and a claim that ran out."""
    import pyarrow as pa

    from loamlog.streaming import ingest

    segments = ingest.Segments(scratch.new_path(spark, "wal"), spark)
    for i in range(4):
        segments.seal(f"s-{i}", pa.table({"id": [i]}))
    assert segments.claim("a", 2, now=0) == ["s-0", "s-1"] and segments.claim("b", 2, now=0) == ["s-2", "s-3"]
    segments.finish("s-0", "a")
    segments.release("s-1", "a")
    assert segments.claim("c", 1, now=400) == ["s-1"]  # b's claims ran out, s-1 comes first
    segments.release("s-1", "c")
    assert segments.claim("c", 2, now=400) == ["s-1", "s-2"]
    segments.release("s-1", "c")
    return spark.createDataFrame([(n, segments.state(n, now=450)) for n in segments.names()], "name string, state string")


@query("select * from (values ('by rows', 4096), ('by rows', 4096), ('by age', 100), ('by flush', 7)) t(why, n_rows)")
def wal_seal_thresholds(spark, sf):
    """Segments are sealed at 4096 rows or after five seconds."""
    import pyarrow as pa

    from loamlog.streaming import ingest

    segments = ingest.Segments(scratch.new_path(spark, "wal"), spark)
    producer = ingest.Producer(segments, "p")
    rows = lambda n: pa.table({"id": list(range(n))})
    out = [("by rows", n) for n in producer.append(rows(8292), now=0.0)]
    out += [("by age", n) for n in producer.tick(4.9) + producer.tick(5.0)]
    producer.append(rows(7), now=6.0)
    out += [("by flush", n) for n in producer.flush()]
    return spark.createDataFrame([(why, segments.read(n).num_rows) for why, n in out], "why string, n_rows long")


@query("select * from (values ('create', 'ok'), ('create again', 'refused'), ('stale update', 'refused'), ('update', 'ok'), ('reopened', '3 fields'), ('stale writer', 'refused'), ('from template', '2 fields'), ('delete', 'ok'), ('after delete', 'none')) t(step, outcome)")
def index_registry(spark, sf):
    """Index configurations changed by who knows their tag, kept in files."""
    from loamlog.plans.store import Store

    f, store = mapping.Field, Store(spark, scratch.new_path(spark, "registry"))
    one = mapping.IndexConfig("logs", [f("timestamp", "datetime", True), f("raw", "text")])
    two = mapping.IndexConfig("logs", [*one.fields, f("status", "long")])
    registry, stale = mapping.Registry(store), mapping.Registry(store)
    out = []

    def step(name, work, outcome="ok"):
        try:
            got = work()
            out.append((name, outcome(got) if callable(outcome) else outcome))
        except mapping.MappingError:
            out.append((name, "refused"))

    step("create", lambda: registry.create(one))
    step("create again", lambda: registry.create(one))
    stale.configs["logs"] = one
    step("stale update", lambda: registry.update(two, '"old"'))
    step("update", lambda: registry.update(two, one.etag()))
    step("reopened", lambda: mapping.Registry(store).configs["logs"].fields, lambda x: f"{len(x)} fields")
    step("stale writer", lambda: stale.update(two, one.etag()))
    step("from template", lambda: registry.get_or_create("logs-web", [mapping.Template("t", ["logs-*"], 1, one.fields)]).fields, lambda x: f"{len(x)} fields")
    step("delete", lambda: registry.delete("logs", two.etag()))
    step("after delete", lambda: mapping.Registry(store).configs.get("logs"), lambda x: "none" if x is None else "there")
    return spark.createDataFrame(out, "step string, outcome string")


# Summaries, promotion and the life of a lake


def _summed(spark, sf):
    from loamlog.sources.lake import Lake

    lake = Lake(spark, scratch.new_path(spark, "lake"), dimensions=("host", "sourcetype"), measures=("number", "value"))
    rows = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("timestamp"), F.concat(F.lit("host-"), (F.col("user_id") % 16).cast("string")).alias("host"), F.col("event_type").alias("sourcetype"), F.col("event_id").alias("number"), "value", F.col("props").alias("attributes"))
    for i in range(3):
        lake.append(rows.where(F.pmod(F.xxhash64("number"), F.lit(3)) == i))
    lake.delete("sourcetype = 'error' and host = 'host-3'")
    return lake


_KEPT = "from (select *, 'host-' || (user_id % 16) as host from events) where not (event_type = 'error' and host = 'host-3')"


@query(f"select host as value, count(*) as n {_KEPT} group by 1")
def lake_group_counts(spark, sf):
    """Counts from the summaries written with the files, a deletion in between."""
    return _summed(spark, sf).group_counts("host")


@query(f"select epoch_us(time_bucket(interval 6 hours, ts)) as bucket_us, count(*) as n {_KEPT} group by 1")
def lake_histogram(spark, sf):
    return _summed(spark, sf).histogram(6 * 3_600_000_000)


@query(f"select event_type as value, count(*) as n, count(event_id) as non_null, cast(sum(event_id) as double) as total {_KEPT} group by 1")
def lake_grouped_numeric(spark, sf):
    return _summed(spark, sf).grouped_numeric("sourcetype", "number").drop("mean")


@query(f"select event_id as number {_KEPT} order by event_id desc limit 100")
def lake_top_numeric(spark, sf):
    """The largest values from the files whose bounds allow them."""
    return _summed(spark, sf).top_numeric("number", 100).select("number")


@query(f"select cast(props->>'k' as bigint) as k, count(*) as n {_KEPT} group by 1")
def lake_backfill(spark, sf):
    """An attribute that most rows have becomes a column, also of rows written before."""
    lake = _summed(spark, sf)
    lake.backfill({key: (key, "long") for key in lake.hot_keys()})
    return lake.read().groupBy("k").agg(F.count("*").alias("n"))


@query("select count(*) as n, true as gap_refused, true as orphans_found, 0 as orphans_left, 1 as n_versions from events")
def lake_expiry(spark, sf):
    """Versions are forgotten, a cursor behind them is refused, files no version names are collected."""
    from loamlog.sources.lake import Cursor, HistoryGap

    lake = _lake(spark, sf)
    lake.compact()
    lake.expire(1)
    try:
        lake.poll(Cursor(version=1))
        refused = False
    except HistoryGap:
        refused = True
    found = lake.collect_garbage(1 << 62, dry_run=True)
    lake.collect_garbage(1 << 62, dry_run=False)
    return lake.read().agg(F.count("*").alias("n")).select("n", F.lit(refused).alias("gap_refused"), F.lit(bool(found)).alias("orphans_found"), F.lit(len(lake.orphans(1 << 62))).alias("orphans_left"), F.lit(len(lake.versions())).alias("n_versions"))


@query("select event_type, cast(sum(event_id) as double) / count(event_id) as mean, count(event_id) as n, sum(abs(event_id)) <= 9007199254740992 as exact from events group by 1 union all select 'wide', cast(sum(cast(event_id as hugeint) * 1000000000000) as double) / count(event_id), count(event_id), sum(cast(event_id as hugeint) * 1000000000000) <= 9007199254740992 from events")
def integer_average(spark, sf):
    rows = table(spark, sf, "events")
    wide = rows.select(F.lit("wide").alias("event_type"), (F.col("event_id") * 1000000000000).alias("event_id"))
    return tables.integer_average(rows, ["event_type"], "event_id").unionByName(tables.integer_average(wide, ["event_type"], "event_id"))


# What the façade tells and refuses


@query(f"with {_LOGS} select raw, host from logs")
def facade_arrow(spark, sf):
    return spark.createDataFrame(_engine(spark, sf).arrow("select raw, host from events"))


@query(f"with {_LOGS} select epoch_us(timestamp) as us from logs order by timestamp desc limit 40")
def facade_newest_first(spark, sf):
    """Rows without a stated order come newest first."""
    rows = _engine(spark, sf).sql("select timestamp, raw from events", {"max_rows_returned": 40})["rows"]
    return spark.createDataFrame([(r["timestamp"],) for r in rows], "t string").select(F.unix_micros(F.col("t").cast("timestamp")).alias("us"))


@query("select * from (values ('unknown limit', 'refused'), ('bytes', 'refused'), ('bytes, row-limited', 'scan'), ('rows scanned', 'refused'), ('rows returned', 'truncated'), ('again', 'result_cache'), ('after an append', 'scan'), ('function', 'refused'), ('file', 'refused'), ('foreign view', 'refused'), ('too many', 'refused'), ('explained', 'plan')) t(case_, outcome)")
def facade_limits(spark, sf):
    """What is refused, cut off, kept or served again."""
    from loamlog.engine import Admission, Engine, Refused
    from loamlog.sources.lake import Lake

    lake = Lake(spark, scratch.new_path(spark, "lake"))
    lake.append(logs(table(spark, sf, "events")))
    engine = Engine(spark, {}, search_fields={"events": ["raw"]}, lakes={"events": lake})
    spark.range(1).createOrReplaceTempView("foreign_view")
    out = []

    def case(name, sql, limits=None, outcome=None):
        try:
            got = engine.sql(sql, limits)
            out.append((name, outcome(got) if outcome else got["served_by"]))
        except Refused:
            out.append((name, "refused"))

    count = "select count(*) as n from events where raw <> ''"
    case("unknown limit", count, {"max_rows": 1})
    case("bytes", count, {"max_bytes_scanned": 1})
    case("bytes, row-limited", "select raw from events limit 3", {"max_bytes_scanned": 1})
    case("rows scanned", "select count(*) as m from events where raw <> 'x'", {"max_rows_scanned": 10})
    case("rows returned", "select raw from events", {"max_rows_returned": 5}, lambda a: "truncated" if a["truncated"] and len(a["rows"]) == 5 else "whole")
    engine.sql(count)
    case("again", count)
    lake.append(logs(table(spark, sf, "events")).limit(3))
    case("after an append", count)
    case("function", "select reflect('java.lang.System', 'getProperty', 'user.dir') from events")
    case("file", "select * from csv.`/etc/hostname`")
    case("foreign view", "select * from foreign_view")
    engine.admission = Admission(0)
    case("too many", "select 1 as other", {"timeout_seconds": 0.05})
    out.append(("explained", "plan" if "Scan" in engine.explain(count) else "none"))
    return spark.createDataFrame(out, "case_ string, outcome string")


@query("select event_type as value, count(*) as n from events group by 1")
def facade_typed_counts(spark, sf):
    """Counts of a dimension's values in their own type."""
    rows = _engine(spark, sf).sql("select sourcetype as value, count(*) as n from events group by sourcetype")["rows"]
    return spark.createDataFrame([(r["value"], r["n"]) for r in rows], "value string, n long")


@query("select n_rows, 10 as n_returned from (select count(*) as n_rows from events)")
def limit_any(spark, sf):
    """Any ten rows: which ones is not defined, that they are ten different rows of the table is."""
    rows = table(spark, sf, "events")
    ten = scratch.materialise(rows.select("event_id").limit(10), "ten")
    return rows.agg(F.count("*").alias("n_rows")).crossJoin(ten.join(rows, "event_id").agg(F.countDistinct("event_id").cast("int").alias("n_returned")))


@query(f"with {_LOGS} select distinct source, true as within from (select source, count(*) as n from (select source from log_events) group by 1 order by n desc, source limit 1)")
def approx_topk_within(spark, sf):
    """The largest group by few counters, and whether its count keeps the stated error bound."""
    rows = table(spark, sf, "log_events")
    top = sketch.top_groups(rows, "source", 1, 100)
    exact = rows.groupBy("source").agg(F.count("*").alias("n"))
    return top.join(exact, top["value"] == exact["source"]).select("source", ((F.col("count") <= F.col("n")) & (F.col("count") + F.col("error_upper_bound") >= F.col("n"))).alias("within"))


@query("select * from (values ('kind missing', 'refused'), ('whole', 'found')) t(case_, outcome)")
def traces_guard(spark, sf):
    """A table that lacks a span's columns is refused."""
    whole, out = traces(table(spark, sf, "events")), []
    for name, rows in (("kind missing", whole.drop("kind")), ("whole", whole)):
        try:
            out.append((name, "found" if spans.find(rows).limit(1).count() else "none"))
        except ValueError:
            out.append((name, "refused"))
    return spark.createDataFrame(out, "case_ string, outcome string")


@query("""with w as (select n_nationkey, epoch_us(timestamp '2024-01-01 00:00:00') + n_nationkey * 86400000000 as lo, epoch_us(timestamp '2024-01-01 00:00:00') + n_nationkey * 86400000000 + 130000000000 as hi from nation)
  select n_nationkey, count(*) as n from events e join w on epoch_us(e.ts) >= w.lo and epoch_us(e.ts) < w.hi group by 1""")
def join_range_bucketed(spark, sf):
    """Events in overlapping windows of a day and a half, met by buckets."""
    first = 1704067200000000
    windows = table(spark, sf, "nation").select("n_nationkey", (F.lit(first) + F.col("n_nationkey") * 86_400_000_000).alias("lo"), (F.lit(first + 130_000_000_000) + F.col("n_nationkey") * 86_400_000_000).alias("hi"))
    points = table(spark, sf, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return tables.range_join(points, windows, "us", "lo", "hi", 86_400_000_000).groupBy("n_nationkey").agg(F.count("*").alias("n"))


@query("select count(*) as n, count(*) filter (where id % 997 = 5) as n_needles, count(*) filter (where id % 1009 = 9) as n_phrases, 48 as n_attributes from range(20000) t(id)")
def corpus_rich(spark, sf):
    """The generated corpus of many attributes, and what was planted in it, found by search."""
    rows = tables.corpus(spark, 20000, rich=True)
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("raw").rlike(" needle[0-9]+")).alias("n_needles"), F.count_if(text.match_terms(F.col("raw"), "quiet harbour lights")).alias("n_phrases"), F.max(F.array_size(F.json_object_keys("attributes"))).alias("n_attributes"))
