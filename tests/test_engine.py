"""Search functions, ingest, mapping, the table log, streams and the façade."""

import json
import threading
import time

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamlog import engine as facade
from loamlog.functions import text
from loamlog.operators import mapping, sketch, spans, tables
from loamlog.plans.adapter import logs, table
from loamlog.sources import bulk, otlp
from loamlog.sources.lake import Conflict, Cursor, HistoryGap, Lake
from loamlog.streaming import ingest

# Search


def rows(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def hits(df, test):
    return [r["i"] for r in df.where(test).orderBy("i").collect()]


CELLS = ["Slow MERGE of the index", "merge-slow", "no match", None, "", "ab merge cd slow", "x " * 70 + "late words", "emerge slower", "ſlow merge", "a" * 100_000]


def test_token_and_stem_counts_keep_rare_ones(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from loamlog.queries import logs as queries

    path = f"{tmp_path}/log_events.parquet"
    rows(spark, [*["leases lost"] * 20, "once merged", None]).withColumnRenamed("v", "raw").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view log_events as select * from '{path}/*.parquet'")
    for name, rare in (("token_counts_all", {"once": 1, "merged": 1}), ("stem_counts_all", {"once": 1, "merg": 1})):
        got = {tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()}
        assert rare.items() <= got and got == set(con.execute(queries.ORACLES[name]).fetchall())
        few = queries.QUERIES[name.removesuffix("_all")](spark, str(tmp_path)).collect()
        assert {r["n"] for r in few} == {20}


def test_search_functions(spark):
    df, v = rows(spark, CELLS), F.col("v")
    assert hits(df, text.match_terms(v, "slow merge")) == [0, 1, 5]
    assert hits(df, text.match(v, "MERGE")) == [0, 1, 5, 8]
    assert hits(df, text.match_any(v, "merge words")) == [0, 1, 5, 6, 8]
    assert hits(df, text.match_phrase(v, "merge slow")) == [1, 5] == hits(df, text.match_phrase(v, "x merge y slow"))
    assert hits(df, text.match_phrase(v, "slow merge")) == [0]
    assert hits(df, text.match_prefix(v, "emer slo")) == [0, 1, 5, 7]
    assert hits(df, ~text.match_terms(v, "merge")) == [2, 3, 4, 6, 7, 9]
    many = rows(spark, [" ".join(f"tok{i:03d}" for i in range(70))])
    assert hits(many, text.match_terms(F.col("v"), "tok063")) == [0] and hits(many, text.match_terms(F.col("v"), "tok064")) == []
    for bad in (None, "", "a b", "--"):
        with pytest.raises(ValueError):
            text.match_terms(v, bad)


def test_sql_functions_agree(spark):
    text.register(spark)
    df, v = rows(spark, CELLS), F.col("v")
    df.createOrReplaceTempView("cells")
    for name, f in (("match_terms", text.match_terms), ("match_any", text.match_any), ("match_phrase", text.match_phrase), ("match_prefix", text.match_prefix)):
        assert [r[0] for r in spark.sql(f"select i from cells where {name}(v, 'merge slow') order by i").collect()] == hits(df, f(v, "merge slow"))
    assert spark.sql("select date_bin(interval 1 hour, timestamp '1969-12-31 23:30:00') as t").first()["t"].hour == 23
    assert "PythonUDF" not in df.select(text.match_terms(v, "merge"))._jdf.queryExecution().optimizedPlan().toString()


def test_key_values(spark):
    got = rows(spark, ['a=1 key="two words", b=3', "nokey=4", "key=", 'key=""', "x,key=5,y", None, "key=6 key=7", 'the.key="q"']).select("i", text.kv_extract(F.col("v"), "key").alias("k")).orderBy("i").collect()
    assert [r["k"] for r in got] == ["two words", None, None, "", "5", None, "6", "q"]


ATTRIBUTES = [('{"a.b":1,"a":{"b":2}}', "a.b", "1"), ('{"a":{"b.c":"x","b":{"c":3}}}', "a.b.c", "x"), ('{"a":{"b":{"c":3}}}', "a.b.c", "3"), ('{"a":1,"a.b":null}', "a.b", None), ('{"a":{"x":1},"b":2}', "a.b", None), ('{"k":null}', "k", None), ('{"k":{"z":1,"y":[2]}}', "k", '{"z":1,"y":[2]}'), ('{"k":true}', "k", "true"), ("[1]", "k", None), ('{"a":{"b":{"c":{"d":{"e":"x"}}}}}', "a.b.c.d.e", "x"), ('{"a":{"b.c":{"d":{"e.f":{"g":1}}}}}', "a.b.c.d.e.f.g", None), ('{"a":{"b":{"c":{"d":{"e.f.g":1}}}}}', "a.b.c.d.e.f.g", "1"), ("{", "k", None), (None, "k", None), ('{"it\'s":"q"}', "it's", "q")]


def test_attributes(spark):
    text.register(spark)
    for doc, key, want in ATTRIBUTES:
        df = spark.createDataFrame([(doc, key)], "j string, k string")
        assert df.select(text.attr_get(F.col("j"), key)).first()[0] == want, (doc, key)
        assert df.selectExpr("attr_get(j, k)").first()[0] == want, (doc, key)


# Sketches


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), max_size=300), st.integers(1, 12))
def test_counters_never_overcount(values, m):
    counts, error = {}, 0
    for i in range(0, len(values), 20):
        for v in values[i : i + 20]:
            counts[v] = counts.get(v, 0) + 1
        counts, off = sketch.reduce_counters(counts, m)
        error += off
    assert len(counts) <= m and error * (m + 1) <= len(values)
    for v in set(values):
        assert values.count(v) - error <= counts.get(v, 0) <= values.count(v)


def test_top_groups(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("v")).repartition(9)
    exact = sketch.top_groups(df, "v", 2, 10_000).collect()
    assert [(r["value"], r["count"], r["error_upper_bound"]) for r in exact] == [("hot", 3334, 0), (None, 133, 0)]
    few = sketch.top_groups(df, "v", 1, 20).first()
    assert few["value"] == "hot" and 3334 - few["error_upper_bound"] <= few["count"] <= 3334
    assert sketch.top_groups(df.limit(0), "v", 2).count() == 0


# Ingest


def test_log_requests(spark):
    body = {
        "resourceLogs": [{"resource": {"attributes": [{"key": "host.name", "value": {"stringValue": "h"}}, {"key": "zone", "value": {"kvlistValue": {"values": [{"key": "a", "value": {"intValue": "5"}}]}}}]}, "scopeLogs": [{"scope": {"name": "sc"}, "logRecords": [
            {"timeUnixNano": "-1500", "body": {"stringValue": "text"}, "severityNumber": 9, "attributes": [{"key": "sourcetype", "value": {"stringValue": "st"}}, {"key": "n", "value": {"doubleValue": 1.5}}, {"key": "none", "value": None}]},
            {"observed_time_unix_nano": 7, "body": {"intValue": "3"}}]}]}]}
    got = otlp.read_logs(spark.createDataFrame([(json.dumps(body),), (None,), ("{",), ("[]",)], "body string")).orderBy("timestamp_ns").collect()
    first = got[0].asDict()
    assert F and (first["host"], first["source"], first["sourcetype"], first["index"], first["raw"], first["timestamp_ns"]) == ("h", "sc", "st", "main", "text", -1500)
    assert json.loads(first["attributes"]) == {"otel": {"severity_number": 9}, "zone": {"a": 5}, "n": 1.5}
    assert got[1]["raw"] == '{"intValue":"3"}' and got[1]["timestamp_ns"] == 7 and len(got) == 2


def test_trace_requests(spark):
    body = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "svc"}}]}, "scopeSpans": [{"spans": [{"traceId": "AB", "spanId": "cd", "name": "op", "kind": 2, "startTimeUnixNano": "1000", "endTimeUnixNano": "4500", "status": {"code": "STATUS_CODE_ERROR"}, "events": [{"name": "e"}]}]}]}]}
    got = otlp.read_traces(spark.createDataFrame([(json.dumps(body),)], "body string")).first()
    about = json.loads(got["attributes"])
    assert (got["source"], got["raw"], about["duration_nanos"], about["kind"], about["status_code"], about["trace_id"], about["resource.service.name"], about["events"]) == ("svc", "op", 3500, "server", "error", "ab", "svc", [{"name": "e"}])


def test_bulk_requests(spark):
    good = '{"index":{"_index":"logs"}}\n{"@timestamp":"2026-03-01T00:00:00Z","host":{"name":"h","ip":1},"message":"m","x":2}\n\n{"delete":{"_id":1}}\n{"create":{}}\n{"timestamp":1772323200,"host":"p"}\n{"update":{"_index":"logs"}}\nanything\n'
    requests = [(1, good), (2, '{"index":{}}'), (3, "{}"), (4, None), (5, ""), (6, '{"index":{"_index":"i"}}\n{"timestamp":1772323200000}')]
    found = {(r["request_id"], r["item_no"]): r for r in bulk.read_bulk(spark.createDataFrame(requests, "request_id long, text string")).collect()}
    first = found[1, 0]
    assert (first["host"], first["raw"], first["timestamp_us"], json.loads(first["attributes"])) == ("h", "m", 1772323200000000, {"host": {"ip": 1}, "x": 2})
    assert [found[1, i]["error"] is None for i in range(4)] == [True, False, False, False]
    assert found[2, 0]["error"] and found[3, 0]["error"] and found[6, 0]["timestamp_us"] == 1772323200000000 and not {4, 5} & {k[0] for k in found}


# Mapping


def config(**more):
    f = mapping.Field
    return mapping.IndexConfig("idx", [f("timestamp", "datetime", True), f("status", "long"), f("ratio", "double"), f("ok", "bool"), f("name", "text"), f("doc", "json"), f("when", "datetime")], **more)


def carrier(spark, attributes):
    return spark.createDataFrame([(a,) for a in attributes], "attributes string").select(F.current_timestamp().alias("timestamp"), *[F.lit(c).alias(c) for c in mapping.CARRIER], "attributes")


def test_mapping_modes(spark):
    docs = ['{"status":3.9,"ratio":"0.5","ok":"true","name":{"a":1},"doc":[1],"left":1}', '{"status":"12","ok":1,"when":"2026"}', None, "{"]
    got = mapping.map_events(carrier(spark, docs), config()).collect()
    assert [(r["status"], r["ratio"], r["ok"], r["name"], r["doc"]) for r in got] == [(3, 0.5, True, None, "[1]"), (12, None, None, None, None), (None,) * 5, (None,) * 5]
    assert json.loads(got[0]["attributes"]) == {"name": {"a": 1}, "left": 1} and json.loads(got[1]["attributes"]) == {"ok": 1, "when": "2026"} and got[3]["attributes"] == "{"
    assert {r["attributes"] for r in mapping.map_events(carrier(spark, docs), config(mode="lenient")).collect()} == {None}
    assert [r["violation"] for r in mapping.map_events(carrier(spark, docs), config(mode="strict")).collect()] == [True, True, False, True]


def test_configs_are_checked():
    f = mapping.Field
    for bad in (
        mapping.IndexConfig("_x", config().fields), mapping.IndexConfig("x", [f("timestamp", "datetime")]), mapping.IndexConfig("x", []), config(tag_fields=["no"]), config(default_search_fields=["status"]), config(retention_secs=0),
        mapping.IndexConfig("x", [f("timestamp", "datetime", True), f("a", "text", tokenizer="odd")]), mapping.IndexConfig("x", [f("timestamp", "datetime", True)] * 2), mapping.IndexConfig("x", [f("timestamp", "datetime", True), f("attributes", "text")]),
    ):
        with pytest.raises(mapping.MappingError):
            bad.validate()
    registry = mapping.Registry()
    tag = registry.create(config())
    wider = mapping.IndexConfig("idx", [*config().fields, f("more", "text")])
    with pytest.raises(mapping.MappingError):
        registry.update(wider, '"stale"')
    assert registry.update(wider, tag) != tag
    with pytest.raises(mapping.MappingError):
        wider.evolve(config())
    t = mapping.Template
    best = mapping.resolve([t("b", ["logs-*"], 5, config().fields), t("a", ["logs-*"], 5, [f("timestamp", "datetime", True)]), t("c", ["*"], 1, config().fields)], "logs-x")
    assert len(best.fields) == 1 and mapping.resolve([], "x") is None


# The table log


def lake_of(spark, tmp_path, sf="/root/testdata/sf0.001"):
    lake = Lake(spark, f"file://{tmp_path}/lake")
    return lake, logs(table(spark, sf, "events"))


def test_lake_life_cycle(spark, tmp_path):
    lake, df = lake_of(spark, tmp_path)
    lake.append(df.where("host = 'host-1'"), consumed=["s1"])
    with pytest.raises(Conflict):
        lake.append(df.where("host = 'host-1'"), consumed=["s1"])
    lake.append(df.where("host <> 'host-1'"))
    n = df.count()
    assert lake.read().count() == n and lake.read(1).count() == df.where("host = 'host-1'").count()
    start = 1705276800000000
    window = lake.read(start_us=start, end_us=start + 86_400_000_000)
    assert window.count() == df.where(tables.within(F.col("timestamp"), start, start + 86_400_000_000)).count() and len(window.inputFiles()) < len(lake.files())
    gone = df.where("sourcetype = 'error'").count()
    lake.delete("case when sourcetype = 'error' then true end")
    assert lake.read().count() == n - gone and lake.delete("sourcetype = 'error'") is None
    _, cursor = lake.poll(Cursor())
    before = len(lake.files())
    lake.compact()
    assert len(lake.files()) < before and lake.read().count() == n - gone
    assert lake.poll(cursor)[0].count() == 0
    assert lake.consumed() == {"s1"}
    assert [r["timestamp_ns"] for r in lake.newest(7).collect()] == [r["timestamp_ns"] for r in lake.read().orderBy(F.desc("timestamp_ns")).limit(7).collect()]
    assert lake.expire(1) and lake.read().count() == n - gone and lake.consumed() == {"s1"}
    with pytest.raises(HistoryGap):
        lake.poll(Cursor(version=1))
    old = lake.orphans(1 << 62)
    assert old and lake.collect_garbage(1 << 62) == old and lake.orphans(0) == []
    lake.collect_garbage(1 << 62, dry_run=False)
    assert lake.orphans(1 << 62) == [] and lake.read().count() == n - gone


def test_side_index_opens_fewer_files(spark, tmp_path):
    lake, df = lake_of(spark, tmp_path)
    for kind in ("click", "error"):
        lake.append(df.where(F.col("sourcetype") == kind))
    assert lake.build_index("raw") == len(lake.files()) and lake.build_index("raw") == 0
    lake.build_index("raw", "trigrams")
    n = df.where("sourcetype = 'error'").count()
    found = lake.search("raw", "type ERROR")
    assert found.count() == n and len(found.inputFiles()) < len(lake.files())
    part = lake.containing("raw", "type=err")
    assert part.count() == n and len(part.inputFiles()) < len(lake.files())
    assert lake.containing("raw", "=e").count() == n and lake.containing("raw", "type=errx").count() == 0
    lake.append(df.where("sourcetype = 'view'"))  # not indexed: always a candidate
    assert lake.search("raw", "type view").count() == df.where("sourcetype = 'view'").count()


def test_the_facade_prunes_a_lake_by_time(spark, tmp_path):
    lake, df = lake_of(spark, tmp_path)
    lake.append(df)
    e = facade.Engine(spark, {}, lakes={"logs": lake})
    sql = "select raw from logs where timestamp >= '2024-01-10' and timestamp < timestamp '2024-01-12' + interval 1 day and host <> 'x'"
    got = e.frame(sql)
    assert len(got.inputFiles()) < len(lake.files()) and e.windows == {"logs": (1704844800000000, 1705104000000000)}
    assert got.count() == df.where("timestamp >= '2024-01-10' and timestamp < '2024-01-13'").count()
    for open_ in ("select * from logs where timestamp >= '2024-01-10' or host = 'x'", "select * from logs a join (select * from logs where timestamp > '2024-01-10') b on a.raw = b.raw", "select count(*) from logs"):
        assert len(e.frame(open_).inputFiles()) == len(lake.files()) and e.windows == {}
    assert e.frame("select * from logs where timestamp < now()").count() == df.count()
    cost = e.sql(sql, dry_run=True)["cost"]
    assert got.count() <= cost["estimated_rows"] < df.count()
    before = e.sql("select count(*) as n from logs")["rows"][0]["n"]
    lake.append(df.limit(5))
    assert e.sql("select count(*) as n from logs")["rows"][0]["n"] == before + 5


def test_retention_keeps_straddling_files(spark, tmp_path):
    lake, df = lake_of(spark, tmp_path)
    lake.append(df)
    middle = 1705276800000000 + 43_200_000_000
    lake.retain(middle)
    low = lake.read().agg(F.min(F.unix_micros("timestamp"))).first()[0]
    assert low < middle and low >= 1705276800000000
    assert lake.retain(0) is None


def test_writers_at_the_same_time(spark, tmp_path):
    lake, df = lake_of(spark, tmp_path)
    parts = [df.where(F.pmod(F.xxhash64("raw"), F.lit(4)) == i) for i in range(4)]
    threads = [threading.Thread(target=lambda p=p: Lake(spark, f"file://{tmp_path}/lake").append(p)) for p in parts]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert lake.version == 4 and lake.read().count() == df.count()


def test_deletes_keep_what_is_null(spark, tmp_path):
    lake = Lake(spark, f"file://{tmp_path}/lake")
    lake.append(spark.createDataFrame([(1, None), (2, "x"), (3, "y")], "id int, v string").withColumn("timestamp", F.timestamp_seconds(F.lit(0))))
    lake.delete("v = 'x'")
    assert sorted(r["id"] for r in lake.read().collect()) == [1, 3]
    with pytest.raises(ValueError):
        lake.append(spark.createDataFrame([("a",)], "id string").withColumn("timestamp", F.timestamp_seconds(F.lit(0))))


def test_a_dead_writers_claim_expires(spark, tmp_path):
    lake, df = lake_of(spark, tmp_path)
    lake.store.claim_seconds = 2
    lake.store._write("_log/000000000001.json.claim", "a writer that died")
    lake.append(df)
    assert lake.version == 1 and lake.read().count() == df.count()
    lake.append(df)
    assert lake.version == 2


def test_checkpoints_and_expiry_remember_consumed_segments(spark, tmp_path, monkeypatch):
    from loamlog.sources import lake as module

    monkeypatch.setattr(module, "CHECKPOINT_EVERY", 3)
    lake, df = lake_of(spark, tmp_path)
    for i in range(7):
        lake.append(df.limit(1), consumed=[f"s{i}"])
        if i in (3, 5):
            lake.expire(2)
    assert lake.consumed() == {f"s{i}" for i in range(7)} == {r[0] for r in lake.consumed_names().collect()}
    for i in range(7):
        with pytest.raises(Conflict):
            lake.append(df.limit(1), consumed=[f"s{i}"])
    delete = lake.store.delete
    monkeypatch.setattr(lake.store, "delete", lambda _: (_ for _ in ()).throw(OSError("died")))
    with pytest.raises(OSError):
        lake.expire(1)
    assert lake.read().count() == 7
    monkeypatch.setattr(lake.store, "delete", delete)
    assert lake.expire(1) and lake.read().count() == 7 and len(lake.consumed()) == 7 and lake.versions() == [7]
    lake.append(df.limit(1), consumed=["s7"])
    assert lake.read().count() == 8 and len(lake.consumed()) == 8


# Streams


def test_segments_and_consumers(spark, tmp_path):
    store = ingest.Segments(str(tmp_path / "wal"))
    for i in range(3):
        store.seal(f"s{i}", pa.table({"id": [i, i + 10]}))
    one = store.open("c")
    assert one.poll(2) == ["s0", "s1"] and one.poll(2) == ["s0", "s1"]
    assert sorted(r["id"] for r in one.read(spark, ["s0", "s1"]).collect()) == [0, 1, 10, 11]
    one.commit("s1")
    assert store.open("c").poll() == ["s2"] and store.open("d").poll() == ["s0", "s1", "s2"]
    with pytest.raises(ValueError):
        one.commit("s0")
    damaged = tmp_path / "wal" / "sealed" / "s2"
    damaged.write_bytes(damaged.read_bytes()[:-6] + b"xxxxxx")
    with pytest.raises(ValueError):
        store.read("s2")


def test_a_stream_drained_again_adds_nothing(spark, tmp_path):
    lake, df = lake_of(spark, tmp_path)
    df.limit(100).repartition(3).write.parquet(f"file://{tmp_path}/landing")
    for i in range(2):
        ingest.drain(ingest.landed(spark, f"file://{tmp_path}/landing"), lake, f"file://{tmp_path}/check{i}").awaitTermination()
    assert lake.read().count() == 100 and lake.version == 1


# Traces


def test_trace_search(spark):
    data = [("2026-03-01 00:00:00", "t1", "s1", "", "svc", "op", 5_000_000, '{"a":"x","n":1,"events":[{"timeUnixNano":"1500","name":"ev"}]}'), ("2026-03-01 00:00:01", "t1", "s2", "s1", "", "op2", 7, None), ("2026-03-02 00:00:00", "t2", "s3", None, "svc", "op", 9, "{}"), ("2026-03-03 00:00:00", "", "s4", None, "svc", "op", 9, "{}")]
    df = spark.createDataFrame(data, "at string, trace_id string, span_id string, parent_span_id string, service string, name string, duration_nanos long, attributes string").select(F.col("at").cast("timestamp").alias("timestamp"), "*", F.lit("k").alias("kind"), F.lit("c").alias("status_code")).drop("at")
    assert [r[0] for r in spans.services(df).collect()] == ["svc"]
    assert [r["trace_id"] for r in spans.find(df).collect()] == ["t2", "t1"]
    assert [r["trace_id"] for r in spans.find(df, tags='{"a":"x"}', min_duration="5ms").collect()] == ["t1"]
    assert [r["trace_id"] for r in spans.find(df, end_us=1772323200000000).collect()] == ["t1"]
    whole = spans.rendered(spans.assemble(df, spans.find(df))).where("traceID = 't1'").first()
    assert [(s["spanID"], s["processID"], s["duration"], len(s["references"])) for s in whole["spans"]] == [("s1", "p1", 5000, 0), ("s2", "p2", 0, 1)]
    assert [(t["key"], t["value"]) for t in whole["spans"][0]["tags"]] == [("a", "x")] and whole["spans"][0]["logs"][0]["timestamp"] == 1
    assert [p["serviceName"] for p in whole["processes"]] == ["svc", "unknown"]
    with pytest.raises(ValueError):
        spans.find(df.drop("kind"))


def test_durations():
    assert [spans.duration_nanos(t) for t in ("5", "1.5ms", "2s", "3ns", "1h", "4µs", "2m", "7us")] == [5000, 1_500_000, 2 * 10**9, 3, 3600 * 10**9, 4000, 120 * 10**9, 7000]
    for bad in ("", "x", "-1s", "nan", "1d"):
        with pytest.raises(ValueError):
            spans.duration_nanos(bad)


# The façade


@pytest.fixture
def engine(spark, sf):
    return facade.Engine(spark, {"events": logs(table(spark, sf, "events")), "nation": table(spark, sf, "nation")}, {"events": "timestamp"}, {"events": ["raw"]})


WRITES = ["insert into events select * from events", "drop view events", "create table x as select 1", "set a=b", "select 1; drop view events", "with x as (select 1) insert into events select * from events", "delete from events", "update events set raw = ''", "merge into events using nation on true when matched then delete", "refresh table events", "alter view events rename to e2", "truncate table events", "cache table events"]


@pytest.mark.parametrize("sql", WRITES)
def test_only_reading_is_allowed(engine, sql):
    with pytest.raises(Exception):  # noqa: B017, PT011 - a refusal or, for several statements, a parse error
        engine.sql(sql)
    assert engine.views["events"].count() > 0


@pytest.mark.parametrize("sql", ["select count(*) c from events", "with a as (select 1 x) select * from a", "select * from events where host in (select host from events) limit 3", "(select 1) union all (select 2)", "select host, count(*) from events group by 1 having count(*) > 1", "values (1), (2)", "select * from range(5)", "select sourcetype, row_number() over (order by raw) from events limit 2"])
def test_reading_works(engine, sql):
    assert engine.sql(sql)["rows"]


def test_newest_first_only_where_it_may(engine):
    newest = [r["timestamp"] for r in engine.sql("select * from events", {"max_rows_returned": 5})["rows"]]
    assert newest == sorted(newest, reverse=True) and len(newest) == 5
    for sql in ("select host from events", "select host as timestamp from events", "select * from events order by raw", "select count(*) from events"):
        df = engine.frame(sql)
        assert engine.ordered(df, 5) is df


def test_search_sugar_is_rewritten_outside_of_strings():
    f = facade.rewrite_search
    assert f("select 'search(''x'')' from t where search('a b')", ["raw"]) == "select 'search(''x'')' from t where (match_terms(`raw`, 'a b'))"
    assert f("select research('x'), t.search('y') -- search('z')", ["raw"]) == "select research('x'), t.search('y') -- search('z')"


def test_limits_cost_and_envelope(engine):
    with pytest.raises(facade.Refused):
        engine.sql("select 1", {"max_rows": 5})
    assert facade.Limits.of({"timeout_seconds": 10**9}).within(facade.TIERS["interactive"]).timeout_seconds == 300
    answer = engine.sql("select host from events", {"max_rows_returned": 3})
    assert answer["truncated"] and len(answer["rows"]) == 3 and answer["columns"] == [{"name": "host", "type": "string"}]
    with pytest.raises(facade.Refused):
        engine.sql("select count(*) from events", {"max_bytes_scanned": 1})
    assert engine.sql("select host from events limit 2", {"max_bytes_scanned": 1})["rows"]
    assert engine.sql("select * from events where timestamp > '2024-01-05'", dry_run=True)["warnings"] == []
    assert len(engine.sql("select * from events e cross join nation n", dry_run=True)["warnings"]) == 2
    assert [facade.classify(b, r) for b, r in ((1, 1), (1, 2 * 10**6), (11 * facade.GB, 1), (1, 10**10))] == ["small", "medium", "large", "huge"]
    assert engine.sql("select host from events", {"max_rows_returned": 3})["served_by"] == "result_cache"
    assert engine.sql("select host from events where false")["columns"] and "Scan" in engine.explain("select host from events")
    lines = list(engine.stream("select host from events", 4))
    assert len(lines) == 5 and json.loads(lines[-1])["_meta"]["rows"] == 4
    assert engine.arrow("select 1 as x").num_rows == 1
    assert {a["status"] for a in engine.audited} >= {"succeeded", "refused", "dry_run"}
    assert engine.top("events", "host", 3, exact=True)["rows"] == [{k: r[k] for k in ("value", "count")} for r in engine.top("events", "host", 3)["rows"]]


def test_time_limit_and_jobs(engine):
    slow = "select count(*) from range(30000000000) where hash(id) = 7 and hash(id + 1) = 8"
    with pytest.raises(facade.Refused):
        engine.sql(slow, {"timeout_seconds": 1})
    job = engine.submit("select count(*) as n from events")
    assert engine.result(job, 60)["rows"][0]["n"] > 0 and engine.status(job) == "succeeded"
    job = engine.submit(slow)
    time.sleep(1)
    engine.cancel(job)
    with pytest.raises(facade.Refused):
        engine.result(job, 60)
    assert engine.status(job) == "cancelled"


def test_admission_gives_batch_a_quarter():
    admission = facade.Admission(4)
    with admission("batch", 1), pytest.raises(facade.Refused), admission("batch", 0.05):
        pass
    with admission("interactive", 1), admission("interactive", 1), admission("interactive", 1), admission("interactive", 1), pytest.raises(facade.Refused), admission("interactive", 0.05):
        pass
    assert admission.running == {"interactive": 0, "batch": 0}


def test_audit_is_appended(spark, sf, tmp_path):
    audit = Lake(spark, f"file://{tmp_path}/audit")
    e = facade.Engine(spark, {"events": logs(table(spark, sf, "events"))}, audit=audit)
    e.sql("select 1")
    e.flush_audit()
    assert audit.read().first()["status"] == "succeeded"


HOLES = [
    "select reflect('java.lang.System', 'getProperty', 'user.dir') from events", "select java_method('java.lang.System', 'getProperty', 'user.dir')", "select * from csv.`/etc/hostname`", "select * from `/etc/hostname`", "select * from text.`/etc/hostname` where 1 = 1",
    "with x as (select * from csv.`/etc/hostname`) select * from x", "select 1 where exists (select 1 from csv.`/etc/hostname`)", "select (select max(_c0) from csv.`/etc/hostname`)", "select * from events where raw in (select _c0 from csv.`/etc/hostname`)", "select * from foreign_view", "with foreign_view as (select * from foreign_view) select * from foreign_view",
    "select * from events e join lateral (select try_reflect('java.lang.System', 'getProperty', 'x'))", "explain select * from csv.`/etc/hostname`", "select * from default.events", "select (with foreign_view as (select 1) select 1) from foreign_view", "select * from python_worker_logs()", "select max(reflect('a', 'b')) over (partition by host) from events", "from csv.`/etc/hostname` |> where true", "select input_file_name() from events",
]


@pytest.mark.parametrize("sql", HOLES)
def test_only_the_sessions_own_tables_and_values_are_reached(spark, engine, sql):
    spark.range(3).createOrReplaceTempView("foreign_view")
    for run in (engine.sql, engine.frame, engine.arrow, engine.explain, lambda q: list(engine.stream(q))):
        with pytest.raises(facade.Refused):
            run(sql)


def test_series_and_schema_are_tables(engine):
    assert [r["value"] for r in engine.sql("select value from generate_series(1, 7, 3) order by value")["rows"]] == [1, 4, 7]
    assert engine.sql("select count(*) as n from generate_series(3, 1)")["rows"] == [{"n": 0}]
    assert {r["column_name"] for r in engine.sql("select column_name from information_schema.columns where table_name = 'nation'")["rows"]} >= {"n_name"}
    assert engine.sql("select table_name from Information_Schema . tables where 'information_schema.tables' <> ''")["rows"]
    assert engine.sql("with recursive t(n) as (select 1 union all select n + 1 from t where n < 4) select sum(n) as s from t")["rows"] == [{"s": 10}]


def test_results_are_kept_while_tables_stay(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    e = facade.Engine(spark, {"t": spark.read.parquet(path)})
    count = lambda: e.sql("select count(*) as n from t")
    assert count()["rows"] == [{"n": 3}] and count()["served_by"] == "result_cache"
    spark.range(2).write.mode("append").parquet(path)
    spark.read.parquet(path).createOrReplaceTempView("t")
    assert count()["rows"] == [{"n": 5}] and count()["served_by"] == "result_cache"
    for sql in ("select now() as x from t", "select rand() as x from t", "select current_date as x from t", "select uuid() as x"):
        assert [e.sql(sql)["served_by"] for _ in range(2)] == ["scan", "scan"]
    assert [e.sql("select 'now()' as x")["served_by"] for _ in range(2)] == ["scan", "result_cache"]


def test_rows_scanned_break_a_query(engine):
    with pytest.raises(facade.Refused, match="scanned"):
        engine.sql("select count(*) from range(30000000000) where hash(id) = 7 and hash(id + 1) = 8", {"max_rows_scanned": 10_000_000})
    assert engine.sql("select count(*) as n from events where raw <> 'x'")["stats"]["rows_scanned"] > 0
    with pytest.raises(facade.Refused, match="scanned"):
        engine.sql("select count(*) as m from events where raw <> 'y'", {"max_rows_scanned": 10})


def test_streams_and_tables_tell_how_they_end(engine):
    meta = lambda *a, **k: json.loads(list(engine.stream(*a, **k))[-1])["_meta"]
    assert meta("select host from events", limits={"max_rows_returned": 4}) == {"rows": 4, "complete": False, "why": "truncated"}
    assert meta("select host from events limit 3") == {"rows": 3, "complete": True}
    assert meta("select raise_error('no') from events")["why"] == "error"
    assert meta("select host from events", limits={"max_rows_scanned": 10})["why"] == "midflight_rows_scanned_exceeded"
    with pytest.raises(facade.Refused):
        next(engine.stream("select host from events", limits={"max_bytes_scanned": 1}))
    with pytest.raises(facade.Refused):
        engine.arrow("select host from events", {"max_bytes_scanned": 1})
    assert engine.arrow("select host from events", {"max_rows_returned": 2}).num_rows == 2
    assert {(a["endpoint"], a["status"]) for a in engine.audited} >= {("stream", "succeeded"), ("stream", "truncated"), ("stream", "refused"), ("arrow", "refused"), ("arrow", "truncated")}
    assert list(engine.audited[0]) == [c.split()[0] for c in facade.AUDIT.split(", ")]


def test_windows_belong_to_their_query(spark, tmp_path, sf):
    lake, df = lake_of(spark, tmp_path)
    lake.append(df)
    e = facade.Engine(spark, {}, lakes={"logs": lake})
    narrow, wide = "select count(*) as n from logs where timestamp >= '2024-01-10' and timestamp < '2024-01-11'", "select count(*) as n from logs"
    alone = {q: e.sql(q, dry_run=True)["cost"]["estimated_rows"] for q in (narrow, wide)}
    assert alone[narrow] < alone[wide]
    found: dict = {narrow: set(), wide: set()}
    threads = [threading.Thread(target=lambda q=q: found[q].add(e.sql(q, dry_run=True)["cost"]["estimated_rows"])) for q in (narrow, wide) * 6]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert found == {q: {n} for q, n in alone.items()}


def test_admission_counts_bytes():
    admission = facade.Admission(16, budget_bytes=100)
    with admission("interactive", 1, 10**9), admission("interactive", 1, 50), pytest.raises(facade.Refused), admission("interactive", 0.05, 1):
        pass
    with admission("batch", 1, 10**9), pytest.raises(facade.Refused), admission("batch", 0.05, 5):
        pass
    assert admission.reserved == {"interactive": 0, "batch": 0}


def test_requests_in_their_binary_form(spark):
    from loamlog.sources import otlp_wire as wire

    record = {"timeUnixNano": "1500", "severityNumber": 9, "severityText": "INFO", "body": {"kvlistValue": {"values": [{"key": "a", "value": {"intValue": "-3"}}, {"key": "b", "value": {"arrayValue": {"values": [{"doubleValue": 1.5}, {"boolValue": True}, {"bytesValue": "AAE="}, {}]}}}]}}, "attributes": [{"key": "k", "value": {"stringValue": "ü"}}], "traceId": "0af7651916cd43dd8448eb211c80319c", "spanId": "b7ad6b7169203331", "observedTimeUnixNano": "7", "eventName": "e", "flags": 1, "droppedAttributesCount": 2}
    logs_ = {"resourceLogs": [{"resource": {"attributes": [{"key": "host.name", "value": {"stringValue": "h"}}]}, "scopeLogs": [{"scope": {"name": "sc", "version": "1"}, "logRecords": [record, {}], "schemaUrl": "u"}]}]}
    spans_ = {"resourceSpans": [{"resource": {"attributes": []}, "scopeSpans": [{"spans": [{"traceId": "ab" * 16, "spanId": "cd" * 8, "name": "op", "kind": 2, "startTimeUnixNano": "1000", "endTimeUnixNano": "4500", "status": {"code": 2}, "events": [{"timeUnixNano": "5", "name": "e"}]}]}]}]}
    for read, message, request in ((otlp.read_logs, "LogsRequest", logs_), (otlp.read_traces, "TracesRequest", spans_)):
        data = wire.encode(message, request)
        bodies = spark.createDataFrame([(bytearray(data),), (None,), (bytearray(data[:-3]),), (bytearray(b"\xff\xff"),)], "body binary")
        plain = spark.createDataFrame([(json.dumps(request),)], "body string")
        got, want = ([r.asDict() for r in read(x).where("timestamp_ns < 10000").collect()] for x in (bodies, plain))
        assert got == want and len(got) == 1
    assert wire.decode("LogRecord", wire.encode("LogRecord", record)) == record
    assert wire.decode("LogRecord", bytes([15 << 3, 1]) + wire.encode("LogRecord", {"flags": 3})) == {"flags": 3}  # a field it doesn't know
    deep = {"stringValue": "x"}
    for _ in range(60):
        deep = {"arrayValue": {"values": [deep]}}
    with pytest.raises(wire.Malformed):
        wire.decode("AnyValue", wire.encode("AnyValue", deep))


def test_folders_shards_and_packing(spark, tmp_path):
    from loamlog.sources import folder

    assert [folder.fnv1a(t) for t in ("", "a", "foobar")] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    assert folder.packed([("a", 5), ("b", 3), ("c", 3), ("d", 2), ("e", 0)], 2) == [["a", "d"], ["b", "c", "e"]]
    spark.range(5).write.parquet(f"file://{tmp_path}/x/y")
    spark.range(5, 9).withColumn("more", F.lit(1)).write.parquet(f"file://{tmp_path}/z")
    got = folder.parquet_folder(spark, f"file://{tmp_path}")
    assert sorted((r["id"], r["more"]) for r in got.collect()) == [(i, 1 if i > 4 else None) for i in range(9)]
    assert folder.listing(spark, f"file://{tmp_path}").where("n_bytes > 0").count() >= 2
    with pytest.raises(ValueError):
        folder.shard(spark, [], 3, 3, "id long")
    assert folder.shard(spark, [], 0, 1, "id long").count() == 0


def test_summaries_answer_like_scans(spark, tmp_path, sf):
    df = logs(table(spark, sf, "events")).withColumn("number", F.col("timestamp_ns") % 1000)
    lake = Lake(spark, f"file://{tmp_path}/lake", dimensions=("host", "missing"), measures=("number",))
    lake.append(df.where("sourcetype <> 'view'"))
    Lake(spark, f"file://{tmp_path}/lake").append(df.where("sourcetype = 'view'").withColumn("host", F.lit(None).cast("string")))  # a writer without summaries
    lake.delete("sourcetype = 'error'")
    lake.compact()
    rows = lake.read()
    pairs = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    assert pairs(lake.group_counts("host")) == pairs(rows.groupBy("host").count())
    assert pairs(lake.histogram(3_600_000_000)) == pairs(tables.date_histogram(rows, "timestamp", 3_600_000_000))
    assert pairs(lake.grouped_numeric("host", "number").select("value", "n", "non_null", F.col("total").cast("long"))) == pairs(rows.groupBy("host").agg(F.count("*"), F.count("number"), F.sum("number")))
    for down in (True, False):
        best = F.desc("number") if down else F.asc("number")
        assert [r["number"] for r in lake.top_numeric("number", 9, down).collect()] == [r["number"] for r in rows.orderBy(best).limit(9).collect()]
    assert lake.top_numeric("number", 10**6).count() == rows.count()
    for bad in (lambda: lake.group_counts("raw"), lambda: lake.histogram(90_000_001)):
        with pytest.raises(ValueError):
            bad()
    _, cursor = lake.poll(Cursor())
    lake.backfill({"k": ("k", "long")})
    assert lake.read().where("k is not null").count() == rows.count() and lake.poll(cursor)[0].count() == 0
    assert lake.hot_keys() == ["k"]


def test_segments_are_claimed_once_and_sealed_in_time(spark, tmp_path):
    store = ingest.Segments(str(tmp_path / "wal"), spark)
    producer = ingest.Producer(store, "p", rows=10, seconds=5)
    rows = lambda n: pa.table({"id": list(range(n))})
    assert producer.append(rows(0), now=0) == [] and producer.tick(100) == []
    assert producer.append(rows(4), now=1) == [] and len(producer.append(rows(17), now=2)) == 2
    assert producer.tick(6.9) == [] and producer.tick(7) == ["p-000000000002"]
    assert [store.read(n).num_rows for n in store.names()] == [10, 10, 1]
    assert ingest.Producer(store, "p").n == 3  # a producer that starts again goes on behind
    got: list = []
    threads = [threading.Thread(target=lambda c=c: got.extend((n, c) for n in store.claim(c, now=0, seconds=10))) for c in "abcd"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(n for n, _ in got) == store.names()
    name, claimer = got[0]
    with pytest.raises(ValueError):
        store.finish(name, "x")
    assert store.claim("z", now=11) == store.names()
    with pytest.raises(ValueError):
        store.finish(name, claimer)
    store.finish(name, "z")
    assert store.state(name) == "committed" and store.claim("y", now=10**9) == store.names()[: store.names().index(name)] + store.names()[store.names().index(name) + 1 :]


def test_latest_rows_fold_once(spark, tmp_path):
    latest = ingest.Latest(spark, f"file://{tmp_path}/latest", ["host"])
    frame = lambda rows: spark.createDataFrame(rows, "host string, timestamp_ns long, raw string")
    latest.fold(frame([("a", 1, "x"), ("a", 2, "y"), (None, 5, "z")]), 0)
    latest.fold(frame([("a", 1, "late"), ("b", 7, None)]), 1)
    latest.fold(frame([("b", 9, "again")]), 1)  # a batch that is repeated
    assert sorted((tuple(r) for r in latest.read().collect()), key=str) == [("a", 2, "y"), ("b", 7, None), (None, 5, "z")]


def test_claims_taken_between_look_and_step(spark, tmp_path):
    one, two = (ingest.Segments(str(tmp_path / "wal"), spark) for _ in "ab")
    one.seal("s", pa.table({"id": [1]}))
    look = one.store.names

    def overtaken(now):
        """The other claims the segment right after the first look at its state."""

        def names(folder):
            found = look(folder)
            if folder == "state/s":
                one.store.names = look
                assert two.claim("b", now=now, seconds=10) == ["s"]
            return found

        one.store.names = names

    overtaken(0)
    assert one.claim("a", now=0) == []
    assert one.claim("a", now=20, seconds=10) == ["s"]  # b's claim ran out
    overtaken(40)
    with pytest.raises(ValueError):
        one.finish("s", "a")
    assert one.claim("a", now=60, seconds=10) == ["s"]
    overtaken(80)
    one.release("s", "a")
    assert one.state("s", now=81) == "claimed"
    two.finish("s", "b")
    assert one.state("s", now=10**9) == "committed"


def test_segments_are_made_and_read_in_tasks(spark, tmp_path):
    from loamlog.plans.store import Store, TaskStore
    from loamlog.queries import logs as queries

    def consumed(rows, group):
        rows.write.parquet(f"file://{tmp_path}/{group}/events.parquet")
        spark.sparkContext.setJobGroup(group, group)
        got = queries.wal_segments_consumed(spark, f"file://{tmp_path}/{group}")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        return sorted((tuple(r) for r in got.collect()), key=lambda r: r[0]), jobs

    some = spark.range(0, 23001, 1, 2).select(F.col("id").alias("event_id"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), F.col("id") % 5)).alias("event_type"))
    got, jobs = consumed(some, "some")
    assert got == [(i, f"t{i % 5}" if i % 7 else None, 1) for i in range(23001)]
    assert jobs < 5  # not one for each batch of a consumer
    assert consumed(some.limit(0), "none")[0] == []

    folders = ingest.produce(some.limit(9000).coalesce(1), f"file://{tmp_path}/wal", segment_rows=10)
    assert [len(ingest.Segments(f, spark).names()) for f in folders] == [900]  # one append
    folders = ingest.produce(some.limit(9001).coalesce(1), f"file://{tmp_path}/wal", segment_rows=10, append_rows=100)
    stores = [ingest.Segments(f, spark) for f in folders]
    assert [len(x.names()) for x in stores] == [520, 381]
    assert sum(x.rows(x.names()).num_rows for x in stores[:1]) == 5200

    # files put by a task and by the driver replace each other
    a, b = Store(spark, f"file://{tmp_path}/both"), TaskStore(f"file://{tmp_path}/both")
    assert not b.exists("x/y") and b.names("x") == []
    for writer, text_ in ((a, "one"), (b, "other"), (a, "third"), (b, "é")):
        writer.put("x/y", text_)
        assert a.read("x/y") == b.read("x/y") == text_ and [n for n, _, _ in b.names("x") if n[0] != "."] == ["y"] == [n for n, _, _ in a.names("x")]
    assert b.exists("x/y")


def test_live_tail_is_files_of_whole_batches(spark, sf, tmp_path):
    from loamlog.queries import logs as queries

    rows = queries.live_tail(spark, sf)
    assert rows.inputFiles() and rows.count() == spark.read.parquet(f"{sf}/events.parquet").count()  # not a table in the driver's memory
    frame = lambda values: spark.createDataFrame([(v,) for v in values], "raw string").coalesce(1)
    live = ingest.Tail(spark, f"file://{tmp_path}/tail", frame([]).schema)
    assert live.read().count() == 0
    for number, values in enumerate([["b", None, "a"], ["c"], [], ["b", "b"]]):
        live.add(frame(values), number)
    live.add(frame(["late"]), 1)  # a batch that is repeated
    frame(["half"]).withColumn("place", F.lit(0).cast("long")).write.parquet(f"file://{tmp_path}/tail/rows/batch=4")  # and one that died before its mark
    assert [r["raw"] for r in live.read().orderBy("batch", "place").collect()] == ["b", None, "a", "c", "b", "b"]
    assert [r["raw"] for r in live.read(after=1).collect()] == ["b", "b"]
    live.add(frame(["whole"]), 4)
    assert [r["raw"] for r in live.read(after=3).collect()] == ["whole"]


def test_ranges_meet_by_buckets(spark):
    import random

    r = random.Random(2)
    points = [(i, r.choice([None, *range(-30, 60)])) for i in range(200)]
    spans_ = [(100, 0, 10), (101, -25, 50), (102, 5, 5), (103, None, 9), (104, 9, None), (105, 7, 3), (106, -1, 0)] + [(200 + i, a, a + r.randint(1, 15)) for i, a in enumerate(r.choices(range(-30, 60), k=30))]
    p, s = spark.createDataFrame(points, "i int, x long"), spark.createDataFrame(spans_, "j int, a long, b long")
    want = sorted((i, j) for i, x in points for j, a, b in spans_ if None not in (x, a, b) and a <= x < b)
    for width in (1, 7, 1000):
        assert sorted((q["i"], q["j"]) for q in tables.range_join(p, s, "x", "a", "b", width).collect()) == want
    assert tables.range_join(p.limit(0), s, "x", "a", "b", 5).count() == 0


def test_answers_in_the_form_asked_for(engine):
    sql = "select host from events limit 3"
    assert len(engine.query(sql)["rows"]) == 3 and engine.query(sql, dry_run=True)["columns"]
    assert len(list(engine.query(sql, "ndjson"))) == 4 and engine.query(sql, "arrow").num_rows == 3
    for bad in ({"format": "xml"}, {"format": "arrow", "dry_run": True}):
        with pytest.raises(facade.Refused):
            engine.query(sql, **bad)
