"""The general problems against plain Python, and their edge cases."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

import brute
from loamlog.operators import compaction, dedup, drift, incremental, loglines, nested, templates
from loamlog.plans import ordered
from loamlog.queries import problems
from loamlog.queries.problems import table

T0 = datetime(2026, 3, 1, 12, tzinfo=timezone.utc)
at = lambda s: T0 + timedelta(seconds=s)

DELIVERIES = "delivery_id long, consumer_id string, name string, path string, delivered_at timestamp, row_count long, bucket string"


def deliveries(spark, rows):
    return spark.createDataFrame(rows, DELIVERIES)


def test_repeated_deliveries_keep_the_earliest(spark):
    rows = [
        (1, "a", "s1", "/x/s1", at(5), 1, "clash"), (2, "a", None, "/y/s1", at(3), None, None), (3, "a", "s1", None, at(3), 1, None),
        (4, "b", "s1", "/x/s1", at(1), 1, None), (5, None, "s1", "/x/s1", at(1), 1, None), (6, None, "s1", None, at(2), 1, None),
        (7, "a", None, None, at(1), 1, None), (8, "a", None, None, at(1), 1, None), (9, "a", "s1", "/x", None, 1, None),
    ]
    got = dedup.deliveries(spark, deliveries(spark, rows).repartition(3))
    assert sorted(r[0] for r in got.where("dropped").select("delivery_id").collect()) == [1, 3, 6, 9]
    assert got.count() == len(rows)


def test_a_hot_segment_and_an_empty_table(spark):
    rows = [(i, "a", "hot" if i % 3 else f"s{i}", "/p", at(i), 1, None) for i in range(3000)]
    got = dedup.deliveries(spark, deliveries(spark, rows).repartition(8))
    assert got.where("not dropped").count() == 1001
    assert dedup.deliveries(spark, deliveries(spark, [])).count() == 0


def test_upserting_a_batch_again_changes_nothing(spark, tmp_path):
    store = dedup.BucketStore(spark, f"file://{tmp_path}/store", ["k"], ["t"], buckets=4)
    batch = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1)], "k string, t int")
    store.upsert(batch, "one")
    store.upsert(batch, "one")
    store.upsert(spark.createDataFrame([("a", 0), ("c", 9)], "k string, t int"), "two")
    assert sorted(tuple(r) for r in store.compact().select("k", "t").collect()) == [("a", 0), ("b", 1), ("c", 9)]


def test_compacted_storage_is_merged_with_later_batches(spark, tmp_path, monkeypatch):
    store = dedup.BucketStore(spark, f"file://{tmp_path}/store", ["k"], ["t"], buckets=4)
    frame = lambda rows: spark.createDataFrame(rows, "k string, t int")
    read = lambda df: sorted((tuple(r) for r in df.select("k", "t").collect()), key=str)
    store.upsert(frame([("a", 2), ("a", 1), (None, 5)]), "one")
    assert read(store.compact()) == [("a", 1), (None, 5)]
    assert len(list((tmp_path / "store" / "compacted").rglob("bucket=*"))) == 2 and not list((tmp_path / "store" / "runs").iterdir())
    store.upsert(frame([("a", 0), ("b", 3), ("b", 3)]), "two")
    create = store.store.create
    monkeypatch.setattr(store.store, "create", lambda *_: False)  # dies before the mark
    with pytest.raises(RuntimeError):
        store.compact()
    monkeypatch.setattr(store.store, "create", create)
    store.upsert(frame([("a", 2), ("a", 1), (None, 5)]), "one")  # delivered again
    assert read(store.compact()) == [("a", 0), ("b", 3), (None, 5)] == read(store.compact())


def walk(text):
    """Plain recursion over a request."""
    try:
        o = json.loads(text)
    except (TypeError, ValueError):
        return []
    out = []

    def get(o, *names):
        return next((o[n] for n in names if n in o), None) if isinstance(o, dict) else None

    def each(x):
        return list(enumerate(x)) if isinstance(x, list) else []

    def value(v, p):
        for i, x in each(get(get(v, "arrayValue", "array_value"), "values")):
            out.append(f"{p}/v{i}")
            value(x, f"{p}/v{i}")
        for i, x in each(get(get(v, "kvlistValue", "kvlist_value"), "values")):
            out.append(f"{p}/k{i}")
            value(get(x, "value"), f"{p}/k{i}")

    def attributes(o, p):
        for i, x in each(get(o, "attributes")):
            out.append(f"{p}/a{i}")
            value(get(x, "value"), f"{p}/a{i}")

    for i, r in each(get(o, "resourceLogs", "resource_logs")):
        out.append(f"r{i}")
        attributes(get(r, "resource"), f"r{i}")
        for j, s in each(get(r, "scopeLogs", "scope_logs")):
            out.append(f"r{i}/s{j}")
            attributes(get(s, "scope"), f"r{i}/s{j}")
            for k, rec in each(get(s, "logRecords", "log_records")):
                out.append(f"r{i}/s{j}/l{k}")
                attributes(rec, f"r{i}/s{j}/l{k}")
    return sorted(out)


def test_exports_flatten_like_plain_recursion(spark, sf):
    got = {}
    for r in problems.p2_found(spark, sf).collect():
        got.setdefault(r[0], []).append(r[1])
    want = {r["export_id"]: w for r in table(spark, sf, "otlp_exports").collect() if (w := walk(r["body"]))}
    assert {k: sorted(v) for k, v in got.items()} == want


HARD_BODIES = [
    None, "", "   ", "{}", "[]", "null", '"x"', "{", '{"resourceLogs":[{}]', '{"resourceLogs":[{}]} x', '{"resourceLogs":[{}]}{}', '{"resourceLogs":[{},]}', '{"resourceLogs":[{} {}]}', '{"resourceLogs":[tru]}',
    '{"resourceLogs":[{"a" 1}]}', '{"resourceLogs":null}', '{"resourceLogs":{}}', '{"resourceLogs":[null,1,{"resource":{"attributes":[1,{"key":"k"}]}}]}', '{"a\\\\":"}","resourceLogs":[{}]}', ' {"resource_logs" : [ {"scope_logs":[{"log_records":[{}]}]} ] }\n',
    '{"resourceLogs":[{"resource":{"attributes":[{"value":{"kvlistValue":{"values":[{"value":{"arrayValue":{"values":[{},{"kvlist_value":{"values":[{}]}}]}}}]}}}]}}]}', '{"x":"\\"{[","resourceLogs":[{"scopeLogs":[{"scope":{"attributes":[{}]}}]}]}', "{\"resourceLogs\":[{}]", "}{", '{"resourceLogs":[01]}', '{"resourceLogs":[1.5e3]}',
]


def test_hard_bodies(spark):
    rows = [(i, b) for i, b in enumerate(HARD_BODIES)] + [(100, '{"resourceLogs":[' + ",".join(["{}"] * 70000) + "]}")]
    df = spark.createDataFrame(rows, "export_id long, body string").withColumn("node_path", F.lit("clash")).coalesce(1)
    got = {}
    for r in nested.flatten_exports(df).collect():
        got.setdefault(r["export_id"], []).append(r["node_path"])
    assert {k: sorted(v) for k, v in got.items()} == {i: w for i, b in rows if (w := walk(b))}
    assert nested.flatten_exports(df.limit(0)).count() == 0


def test_flat_tables_keep_their_links(spark):
    body = '{"resourceLogs":[{"resource":{"attributes":[{"key":"host","value":{"stringValue":"h"}}]},"scopeLogs":[{"scope":{"name":"n"},"logRecords":[{"timeUnixNano":"5","severity_number":9,"body":{"stringValue":"b"},"attributes":[{"key":"l","value":{"arrayValue":{"values":[{"intValue":"3"}]}}}]}]}]}]}'
    nodes = nested.flatten_exports(spark.createDataFrame([(1, body)], "export_id long, body string"))
    record = nested.records(nodes).first()
    assert (record["node_path"], record["parent_path"], record["time_ns"], record["severity_number"], record["body_text"]) == ("r0/s0/l0", "r0/s0", 5, 9, "b")
    values = {r["node_path"]: (r["parent_path"], r["attr_key"], r["value_kind"], r["value_text"]) for r in nested.attributes(nodes).collect()}
    assert values == {"r0/a0": ("r0", "host", "string", "h"), "r0/s0/l0/a0": ("r0/s0/l0", "l", "array", None), "r0/s0/l0/a0/v0": ("r0/s0/l0/a0", None, "int", "3")}


SNAPSHOTS = "snapshot_id long, parent_snapshot_id long, table_name string, is_current boolean"
ROWS = "row_no long, record_id long, table_name string, snapshot_id long, event_time timestamp, payload string"
RUNS = "run_id long, subscription_id long, table_name string, run_no int, run_status string, cursor_time timestamp, cursor_snapshot_id long"


def pending_plain(snapshots, rows, runs):
    parent = {s[0]: s[1] for s in snapshots}

    def state(at):
        out = {}
        while at is not None and at in parent:
            for r in sorted((r for r in rows if r[3] == at), key=lambda r: -r[0]):
                out.setdefault(r[1], r)
            at = parent[at]
        return out

    found = set()
    for sub in {r[1] for r in runs}:
        mine = [r for r in runs if r[1] == sub]
        current = next((s[0] for s in snapshots if s[2] == mine[0][2] and s[3]), None)
        good = [r for r in mine if r[4] == "succeeded"]
        last = max(good, key=lambda r: r[3]) if good else None
        seen = state(last[6]) if last and last[6] is not None else {}
        for record, r in state(current).items():
            value = lambda x: json.loads(x[5]) if x[5] and x[5][0] == "{" else x[5]
            if last is None or (last[6] is None and r[4] > last[5]) or (last[6] is not None and (record not in seen or value(seen[record]) != value(r))):
                found.add((sub, record))
    return found


def test_pending_records_with_rollbacks(spark):
    # 1-2-3-4 is the main line, 5 hangs off 2 and 6 off 5 (rolled back); table u has one commit
    snapshots = [(1, None, "t", False), (2, 1, "t", False), (3, 2, "t", False), (4, 3, "t", True), (5, 2, "t", False), (6, 5, "t", False), (9, None, "u", True)]
    rows = [
        (1, 10, "t", 1, at(0), '{"a":1,"b":2}'), (2, 11, "t", 1, at(1), '{"a":1}'), (3, 12, "t", 2, at(2), '{"a":1}'), (4, 10, "t", 3, at(9), '{"b": 2, "a": 1}'), (5, 11, "t", 3, at(9), '{"a":2}'),
        (6, 13, "t", 4, at(3), None), (7, 12, "t", 5, at(4), '{"a":5}'), (8, 14, "t", 6, at(4), '{"a":5}'), (9, 11, "t", 6, at(4), '{"a":2}'), (10, 90, "u", 9, at(50), "not json"), (11, 10, "t", 3, at(9), '{"a":1,"b":2}'), (12, 99, "t", 777, at(1), "{}"),
    ]
    runs = [
        (1, 1, "t", 1, "succeeded", at(0), 1), (2, 1, "t", 2, "failed", at(0), 4), (3, 2, "t", 1, "failed", at(0), 2), (4, 3, "t", 1, "succeeded", at(2), None), (5, 4, "t", 3, "succeeded", at(0), 6), (5, 4, "t", 3, "succeeded", at(0), 6),
        (6, 5, "u", 1, "succeeded", at(99), None), (7, 6, "u", 1, "succeeded", at(0), 9), (8, 7, "t", 1, "succeeded", at(0), 4), (9, 8, "t", 1, "succeeded", at(0), 5), (10, 9, "t", 1, "succeeded", at(0), 424242), (11, 10, "none", 1, "running", None, None),
    ]
    frames = [spark.createDataFrame(x, s) for x, s in ((snapshots, SNAPSHOTS), (rows, ROWS), (runs, RUNS))]
    got = {(r[0], r[1]) for r in incremental.pending(*frames).select("subscription_id", "record_id").collect()}
    known = [r for r in rows if r[3] != 777]
    assert got == pending_plain(snapshots, known, runs)
    assert incremental.pending(*[f.limit(0) for f in frames]).count() == 0


@pytest.mark.parametrize("block", [3, 16384])
def test_ancestry_over_blocks(spark, monkeypatch, block):
    import random

    monkeypatch.setattr(incremental, "COMMITS_A_BLOCK", block)
    r, rows = random.Random(11), []
    ids = r.sample(range(10**6), 60)
    for i, c in enumerate(ids):  # two tables whose commits hang off any earlier one, mostly the last
        t = i % 2
        earlier = [ids[j] for j in range(t, i, 2)]
        rows.append((c, None if not earlier or r.random() < 0.03 else earlier[-1] if r.random() < 0.7 else r.choice(earlier), f"t{t}", False, i))
    rows[-2:] = [(*x[:3], True, x[4]) for x in rows[-2:]]
    rows.append((10**7, ids[0], "other", False, 99))  # a parent in another table is none
    parent = {x[0]: x[1] if x[0] < 10**7 else None for x in rows}
    line = lambda c: [] if c is None else [c, *line(parent[c])]
    main = {c for x in rows if x[3] for c in line(x[0])}
    got = {x["snapshot_id"]: (x["depth"], x["main"], x["fork"]) for x in incremental.commit_tree(spark.createDataFrame(rows, SNAPSHOTS + ", sequence_no int")).collect()}
    assert got == {c: (len(line(c)) - 1, c in main, next((a for a in line(c) if a in main), None)) for c in parent}


def test_commits_in_a_circle_are_refused(spark, monkeypatch):
    with pytest.raises(ValueError):
        incremental.commit_tree(spark.createDataFrame([(1, 2, "t", True), (2, 1, "t", False)], SNAPSHOTS))
    monkeypatch.setattr(incremental, "COMMITS_A_BLOCK", 1)
    with pytest.raises(ValueError):
        incremental.commit_tree(spark.createDataFrame([(i, (i + 1) % 6, "t", i == 0) for i in range(6)], SNAPSHOTS))


def test_a_failed_batch_is_repeated_without_gaps(spark, tmp_path):
    folder, sink = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for i in range(3):
        (folder / f"f{i}.txt").write_text(f"line {i}\n")
    manifest = incremental.FileManifest(spark, f"file://{tmp_path}/manifest")
    read = lambda todo: spark.read.text([r["path"] for r in todo.select("path").collect()])
    with pytest.raises(RuntimeError):
        manifest.run_batch(f"file://{folder}", read, f"file://{sink}", fail_before_commit=True)
    assert manifest.run_batch(f"file://{folder}", read, f"file://{sink}")
    assert manifest.run_batch(f"file://{folder}", read, f"file://{sink}") is None
    (folder / "f1.txt").write_text("changed\n")
    (folder / "f3.txt").write_text("line 3\n")
    assert manifest.run_batch(f"file://{folder}", read, f"file://{sink}")
    assert sorted(r["value"] for r in spark.read.parquet(f"file://{sink}").collect()) == ["changed", "line 0", "line 1", "line 2", "line 3"]


@pytest.mark.parametrize("step", incremental.Ledger.STEPS)
def test_a_run_that_died_anywhere_repeats_nothing(spark, tmp_path, step):
    folder, sink = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    for i in range(3):
        (folder / f"f{i}.txt").write_text(f"line {i}\n")
    manifest = incremental.FileManifest(spark, f"file://{tmp_path}/manifest")
    read = lambda todo: spark.read.text([r["path"] for r in todo.select("path").collect()])
    values = lambda: sorted(r["value"] for r in manifest.output("value string", sink).collect())
    with pytest.raises(RuntimeError):
        manifest.run_batch(f"file://{folder}", read, sink, stop_after=step)
    assert values() == [] and manifest.entries().count() == 0
    (folder / "f3.txt").write_text("line 3\n")  # what is outstanding is another set now
    assert manifest.run_batch(f"file://{folder}", read, sink) == "000000001"
    assert values() == [f"line {i}" for i in range(4)] == sorted(r["value"] for r in spark.read.parquet(sink).collect())
    with pytest.raises(RuntimeError):
        (folder / "f4.txt").write_text("line 4\n")
        manifest.run_batch(f"file://{folder}", read, sink, stop_after=step)
    (folder / "f4.txt").unlink()
    assert manifest.run_batch(f"file://{folder}", read, sink) is None
    assert values() == [f"line {i}" for i in range(4)] == sorted(r["value"] for r in spark.read.parquet(sink).collect())


def test_a_file_replaced_within_the_clock_is_found_by_checksum(spark, tmp_path):
    import os

    folder, sink = tmp_path / "in", f"file://{tmp_path}/out"
    folder.mkdir()
    (folder / "f").write_text("one")
    read = lambda todo: todo.select("path")
    manifest = incremental.FileManifest(spark, f"file://{tmp_path}/manifest", trust_times=False)
    manifest.run_batch(f"file://{folder}", read, sink)
    times = (folder / "f").stat()
    (folder / "f").write_text("two")
    os.utime(folder / "f", ns=(times.st_atime_ns, times.st_mtime_ns))
    assert manifest.outstanding(f"file://{folder}").count() == 1
    assert incremental.FileManifest(spark, f"file://{tmp_path}/manifest").outstanding(f"file://{folder}").count() == 0


def test_records_are_handed_over_once_and_again_when_they_change(spark, tmp_path):
    snapshots = [(1, None, "t", False), (2, 1, "t", True)]
    rows = [(1, 10, "t", 1, at(0), '{"a":1}'), (2, 11, "t", 1, at(1), '{"a":1}'), (3, 10, "t", 2, at(2), '{"a":2}'), (4, 12, "t", 2, at(2), None)]
    runs = [(1, 1, "t", 1, "succeeded", at(0), 1), (2, 2, "t", 1, "failed", at(0), 1)]
    frames = lambda: [spark.createDataFrame(x, s) for x, s in ((snapshots, SNAPSHOTS), (rows, ROWS), (runs, RUNS))]
    manifest = incremental.RecordManifest(spark, f"file://{tmp_path}/manifest")
    handed = lambda: sorted((r["batch"][-1], r["subscription_id"], r["record_id"]) for r in manifest.processed().collect())
    for step in incremental.Ledger.STEPS:
        with pytest.raises(RuntimeError):
            manifest.run_batch(*frames(), stop_after=step)
        assert handed() == []
    assert manifest.run_batch(*frames()) and manifest.run_batch(*frames()) is None
    first = [("1", 1, 10), ("1", 1, 12), ("1", 2, 10), ("1", 2, 11), ("1", 2, 12)]
    assert handed() == first
    # back to what the first cursor saw: changed since the batch, though not since the cursor
    snapshots[1] = (2, 1, "t", False)
    snapshots.append((3, 2, "t", True))
    rows.append((5, 10, "t", 3, at(3), '{"a": 1}'))
    assert manifest.run_batch(*frames())
    assert handed() == first + [("2", 1, 10), ("2", 2, 10)]
    runs.append((3, 1, "t", 2, "succeeded", at(9), 3))  # the cursor moves: batches before it don't count
    assert manifest.run_batch(*frames()) is None


def test_log_entries_like_plain_python(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "log_events").select("event_id", "event_time", "host", "source", "line_no", "raw").collect()]
    got = sorted(tuple(r) for r in problems.p4_found(spark, sf).select("event_id", "ts_us", "level", "component", "n_rows").collect())
    assert got == brute.entries(rows)


def test_log_lines_at_the_edges(spark):
    lines = [
        (1, "before any entry"), (2, "2026-03-01T00:00:00.1234567+01:00 WARN a::b: first"), (3, None), (4, ""), (5, "   2026-03-01T00:00:00Z INFO x: not at the start"), (6, "2026-13-41T00:00:00Z INFO x: no such day"),
        (7, "\x1b[31m2026-03-01T00:00:00Z\x1b[0m ERROR c: coloured"), (8, '{"level":"CRIT","ctx":{"ts":1},"time":"2026-03-01T00:00:00Z","message":"m"}'), (9, '{"level":"info"}'), (10, "<165>1 2026-03-01T00:00:00Z h app - - - text"), (11, "x" * 200_000),
        (12, "Feb 29 10:00:00 h prog: the year has no such day"), (13, 'msg="a ts=1" level=err ts=1772323200'), (13, "a line shipped again"),
    ]
    rows = [(i, at(0), None, "s", n, raw, "extra") for i, (n, raw) in enumerate(lines)]
    df = spark.createDataFrame(rows, "event_id long, event_time timestamp, host string, source string, line_no long, raw string, head string")
    got = {r["event_id"]: r for r in loglines.entries(df).collect()}
    base = 1772323200000000
    assert {k: (r["ts_us"], r["level"], r["component"], r["n_rows"]) for k, r in got.items()} == {
        1: (base - 3_600_000_000 + 123456, "WARN", "a::b", 5), 6: (base, "ERROR", "c", 1), 7: (base, "FATAL", "", 2), 9: (base, "INFO", "app", 3), 12: (base, "ERROR", "", 1),
    }
    assert got[1]["message"].startswith("first\n\n\n   2026") and got[7]["message"].startswith("m\n") and got[12]["message"] == "a ts=1"
    assert loglines.entries(df.limit(0)).count() == 0
    assert loglines.entries(df.limit(0), message=False).count() == 0


def test_templates_find_constants_and_slots(spark):
    rows = [(i, f"lease on host{chr(97 + i % 9)} lost after {i * 7} ms") for i in range(200)] + [(1000 + i, f"2026-03-01T00:00:0{i}Z user {'ABCDEFG'[i]}x logged in") for i in range(5)] + [(2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "event_id long, raw string").repartition(4)
    placed, summary = templates.mine(df)
    assert placed.count() == len(rows)
    found = {r["template"]: (r["n_entries"], r["slots"]) for r in summary.collect()}
    assert found["lease on <*> lost after <number> ms"] == (200, "text,number")
    assert found["<time> user <*> logged in"] == (5, "time,text")
    assert found[""] == (2, "")
    assert templates.mine(df.limit(0))[0].count() == 0


def test_templates_are_mined_of_every_line(spark, tmp_path):
    from loamlog.queries import problems

    lines = ["2026-03-01T10:00:00Z  INFO a: poll done", "    at lake.Wal.run(Wal.java:12)", "    at lake.Wal.stop(Wal.java:7)", "@@ 7 unknown layout of red", "@@ 8 unknown layout of blue", ""]
    rows = [(i, at(0), "h", "s", i, raw) for i, raw in enumerate(lines)] + [(90, at(0), "h", "s", 1, lines[1]), (91, at(0), "h", "s", None, None)]
    df = spark.createDataFrame(rows, "event_id long, event_time timestamp, host string, source string, line_no long, raw string")
    df.coalesce(1).write.parquet(f"{tmp_path}/log_events.parquet")
    got = {r["event_id"]: r["template"] for r in problems.p4_method(spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5, 91]  # each line once, and the copy of line 1 not again
    assert got[1] == got[2] and got[1].startswith("at ") and got[3] == got[4] and "unknown layout of" in got[3]
    assert sum(r["n_entries"] for r in problems.p4_templates(spark, str(tmp_path)).collect()) == 7


def test_slots_are_classified_by_their_values(spark):
    levels, paths, tails = ["INFO", "WARN", "ERROR"], ["lake.wal.io", "lake/planner/x", "a::b"], ["done", "lake.core", "at once"]
    rows = [(i, f"start of run {levels[i % 3]} from {paths[i // 3 % 3]} by user {'abcdef'[i % 6]}q ended {tails[i % 3]}") for i in range(60)] + [(100 + i, f"{i} rows") for i in range(3)]
    _, summary = templates.mine(spark.createDataFrame(rows, "event_id long, raw string").repartition(3))
    found = {r["template"]: r for r in summary.collect()}
    one = found["start of run <*> from <*> by user <*> ended <*>"]
    assert (one["n_entries"], one["slots"]) == (60, "level,path,text,text")
    assert one["kinds"] == "level:60,path:60,word:60,path:20|text:20|word:20"
    assert (found["<number> rows"]["slots"], found["<number> rows"]["kinds"]) == ("number", "number:3")


def test_templates_join_whatever_token_comes_first(spark):
    months = ["Jan", "Feb", "Mar", "Apr"]
    rows = [(i, f"{months[i % 4]} {i % 9 + 1} 10:00:0{i % 10} host walsync[{i}]: lease lost after {i} ms") for i in range(40)]
    rows += [(100 + i, ["ts={0} lvl=info msg=\"cache warmed\" dur={0}ms", "lvl=info msg=\"cache warmed\" dur={0}ms ts={0}"][i % 2].format(i)) for i in range(10)] + [(200, ""), (201, None), (202, "")]
    df = spark.createDataFrame(rows, "event_id long, raw string").repartition("event_id")
    for parts in (df.coalesce(1), df.repartition(40, "event_id")):  # within a task, and between tasks
        got = {r["event_id"]: r["template"] for r in templates.mine(parts)[0].collect()}
        assert len(got) == len(rows)
        assert {got[i] for i in range(40)} == {"<*> <number> <time> host walsync [ <number> ] : lease lost after <number> ms"}
        assert len({got[100 + i] for i in range(10)}) == 1 and {got[i] for i in (200, 201, 202)} == {""}


def test_templates_are_chosen_by_the_longest_common_subsequence():
    import random

    clusters = templates.Clusters()
    clusters._put(0, ["x", "a", templates.SLOT])
    clusters._put(1, "x a b c d e".split())
    assert clusters.add("x a b c".split()) == 1 and clusters.name(1) == "x a b c <*>"
    r, clusters, n_covered = random.Random(7), templates.Clusters(), 0
    for _ in range(3000):
        tokens = r.choices("abcdefghijkl", k=r.randint(1, 9)) + r.choices(["p", "q", f"w{r.random()}"], k=r.randint(0, 3))
        plain, most = -1, (0, False)  # every template is compared
        for n, t in enumerate(clusters.templates):
            length = len(templates.common(t.tokens, tokens))
            found = length, templates.covers(t.blocks, tokens)
            if length >= templates.SHARE * max(len(tokens), t.size) and found > most:
                plain, most = n, found
        before = [t.tokens for t in clusters.templates]
        assert clusters.add(tokens) == (plain if plain >= 0 else len(before))
        assert not most[1] or before == [t.tokens for t in clusters.templates]
        n_covered += most[1]
    assert n_covered > 300 and any(templates.SLOT in t.tokens for t in clusters.templates)


def test_templates_do_not_depend_on_how_entries_are_spread(spark, sf):
    lines = table(spark, sf, "log_events").select("event_id", "raw").union(spark.createDataFrame([(10**9 + i, f"job j{i % 7} on 10.0.0.{i % 5} took {i} ms as {['INFO', 'WARN', 'ERROR'][i % 3]} by {'abc'[i % 3]}x") for i in range(90)], "event_id long, raw string"))
    seen = []
    for n in (1, 8, 64):
        placed, summary = templates.mine(lines.repartition(n), shard=300)
        seen.append((sorted(tuple(r) for r in placed.collect()), sorted(tuple(r) for r in summary.collect())))
    assert seen[0] == seen[1] == seen[2]
    assert len(seen[0][0]) == lines.count() == sum(r[1] for r in seen[0][1])
    assert [r[1:3] for r in seen[0][1] if r[0].startswith("job ")] == [(90, "text,address,number,level,text")]


def test_templates_like_one_plain_pass(spark):
    """In a single shard the rounds are one pass over the patterns, the frequent ones first."""
    import random
    from collections import Counter

    r = random.Random(3)
    texts = [" ".join(["start", r.choice("abc"), "of", r.choice(["x", "y"]), r.choice(["run", "walk"]), str(r.randint(1, 9))][: r.randint(2, 6)]) for _ in range(300)]
    placed, _ = templates.mine(spark.createDataFrame(list(enumerate(texts)), "event_id long, raw string").repartition(5))
    found, plain = {}, []
    counts = Counter(" ".join(templates.tokens_of(t)) for t in texts)
    for p in sorted(counts, key=lambda p: (-counts[p], p)):
        tokens = p.split(" ")
        best, at = (0, False), -1
        for i, t in enumerate(plain):
            length = len(templates.common(t, tokens))
            size = sum(x != templates.SLOT for x in t)
            one = length, templates.covers(templates.Template(t).blocks, tokens)
            if length >= templates.SHARE * max(len(tokens), size) and one > best:
                best, at = one, i
        if at < 0:
            at = len(plain)
            plain.append(tokens)
        elif not best[1]:
            plain[at] = templates.merge(plain[at], tokens)
        found[p] = at
    assert {row["event_id"]: row["template"] for row in placed.collect()} == {i: " ".join(plain[found[" ".join(templates.tokens_of(t))]]) for i, t in enumerate(texts)}


def test_templates_are_the_same_however_many_patterns_there_are(spark, sf):
    import random

    r = random.Random(5)
    lines = table(spark, sf, "log_events").select("event_id", "raw")
    few = {row["event_id"]: row["template"] for row in templates.mine(lines)[0].collect()}
    for shard in (100, 7):  # fewer than there are patterns
        assert {row["event_id"]: row["template"] for row in templates.mine(lines, shard=shard)[0].collect()} == few
    word = lambda: "q" + "".join(r.choices("abcdefgh", k=14))
    others = [(10**9 + i, f"{word()} {word()}") for i in range(templates.SHARD + 100)]  # share no word with any line
    placed = {row["event_id"]: row["template"] for row in templates.mine(lines.union(spark.createDataFrame(others, "event_id long, raw string")))[0].collect()}
    assert {i: t for i, t in placed.items() if i < 10**9} == few
    assert all(placed[i] == text for i, text in others)


def test_templates_compared_at_once_are_chosen_like_one_by_one(monkeypatch):
    import random

    r = random.Random(11)
    words = [f"w{i}" for i in range(30)]
    texts = [r.sample(words, r.randint(1, 12)) + r.choices(["x", "y"], k=r.randint(0, 3)) for _ in range(1500)] + [r.choices(words, k=r.randint(60, 90)) for _ in range(40)]
    r.shuffle(texts)
    seen = []
    for many in (0, 16, 10**9):
        monkeypatch.setattr(templates, "MANY", many)
        clusters = templates.Clusters()
        seen.append(([clusters.add(t) for t in texts], [t.tokens for t in clusters.templates]))
        assert max(t.size for t in clusters.templates) > 64 and len(clusters.templates) > 100
    assert seen[0] == seen[1] == seen[2]


def test_common_subsequence_and_merge():
    assert templates.common(list("abcd"), list("axcyd")) == list("acd")
    assert templates.merge("a b c".split(), "a x c d".split()) == ["a", templates.SLOT, "c", templates.SLOT]


def test_covered_bytes_and_groups(spark):
    m = 1 << 20
    tasks = [("t", "d/f1", 0, 10, 1), ("t", "d/f1", 5, 10, 1), ("t", "d/f1", 0, 10, 1), ("t", "d/f2", 0, 0, 0), ("t", "d/f3", 0, None, 1), ("t", "d/f4", 0, 20 * m, 5), ("t", "d/f5", 3 * m, m, 1), ("t", "d/f5", m, 4 * m, 1), ("t", "e/f6", 0, 16 * m, 1), (None, "x", 0, 1, 1)]
    segments = [("wal-mirror/a/1", 5, "sealed", 2), ("s3://b//wal-mirror//a/1", 9, "claimed", 3), ("wal-mirror/a/2", 5, "sealed", 1), ("/wal-mirror/a/2", None, "committed", 1), ("wal-mirror/a/3", None, "sealed", 1), (None, 4, "sealed", 1), ("elsewhere/4", 4, "sealed", 1)]
    t = spark.createDataFrame(tasks, "table_name string, object_key string, start_offset long, byte_length long, row_count long")
    s = spark.createDataFrame(segments, "segment_url string, n_bytes long, status string, row_count long")
    files = compaction.manifest(t, s)
    assert {r["location"]: r["n_bytes"] for r in files.collect()} == {"t/d/f1": 15, "t/d/f2": 0, "t/d/f4": 20 * m, "t/d/f5": 4 * m, "t/e/f6": 16 * m, "wal-mirror/a/1": 9, "wal-mirror/a/3": None}
    got = {r["location"]: r["group_no"] for r in compaction.plan(files, target=10).collect()}
    assert set(got) == {"t/d/f1", "t/d/f2", "t/d/f5", "wal-mirror/a/1"} and got["t/d/f1"] == 0 and got["t/d/f2"] == 1
    assert compaction.plan(compaction.manifest(t.limit(0), s.limit(0))).count() == 0


def test_a_rewrite_conserves_rows(spark, tmp_path):
    root = tmp_path / "lake"
    for i in range(12):
        spark.range(i * 10, i * 10 + 10).withColumn("location", F.lit("clash")).coalesce(1).write.parquet(f"file://{root}/tab/data/d={i % 2}/p{i}")
    found = [str(p.relative_to(root)) for p in root.rglob("*.parquet")]
    files = spark.createDataFrame([("lake", p.split("/p")[0], p, 100, 10) for p in found], "origin string, bin string, location string, n_bytes long, n_rows long")
    report = compaction.rewrite(spark, compaction.plan(files, target=350), str(root), f"file://{tmp_path}/out", files_a_batch=5)
    assert {(r["rows_in"], r["rows_out"]) for r in report.collect()} == {(40, 40), (20, 20)}
    assert len(list((tmp_path / "out").rglob("*.parquet"))) == report.count() == 4
    assert sorted(r["id"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == list(range(120))


def test_a_rewrite_run_again_doubles_and_loses_nothing(spark, tmp_path, monkeypatch):
    root, out = tmp_path / "lake", f"file://{tmp_path}/out"
    spark.range(60).repartition(6).write.parquet(f"file://{root}/tab/data")
    found = [str(p.relative_to(root)) for p in root.rglob("*.parquet")]
    files = spark.createDataFrame([("lake", "tab/data/", p, 100, 10) for p in found], "origin string, bin string, location string, n_bytes long, n_rows long")
    planned = compaction.plan(files, target=250)
    ids = lambda: sorted(r["id"] for r in spark.read.parquet(out).collect())
    rename, done = compaction.Store.rename, []

    def dies(self, name, to):
        if done:
            raise OSError("the driver died")
        done.append(to)
        return rename(self, name, to)

    monkeypatch.setattr(compaction.Store, "rename", dies)
    with pytest.raises(OSError):
        compaction.rewrite(spark, planned, str(root), out)
    monkeypatch.setattr(compaction.Store, "rename", rename)
    assert 0 < len(ids()) < 60
    for _ in range(2):
        assert {r["rows_in"] == r["rows_out"] for r in compaction.rewrite(spark, planned, str(root), out).collect()} == {True}
        assert ids() == list(range(60))
    # another plan's groups have names of their own
    names = lambda p: {r["target_file"] for r in compaction.targets(p).select("target_file").distinct().collect()}
    assert not names(planned) & names(compaction.plan(files.withColumn("n_bytes", F.lit(101)), target=250))


def test_hot_series_of_one_second_is_split(spark):
    rows = [(i, "hot", at(0), json.dumps({"a": i % 3, f"k{i % 2}": 1})) for i in range(500)] + [(900 + i, f"s{i}", at(i), '{"a":1}') for i in range(20)]
    df = spark.createDataFrame(rows, "file_id long, series string, written_at timestamp, body string").repartition(7)
    pairs = drift.consecutive(df)
    assert pairs.where("series = 'hot'").select("block").distinct().count() > 3
    assert sorted(tuple(r) for r in drift.changes(df).collect()) == brute.changes(rows)


def test_nulls_keep_types_over_blocks_and_absences(spark):
    import random

    r, rows = random.Random(5), []
    for i in range(300):
        o = {k: r.choice([None, None, 1, "s", {"x": r.choice([None, 1, "t"])}, 1.5]) for k in "ab" if r.random() < 0.9}
        rows.append((i, f"s{i % 2}", at(i), json.dumps(o)))
    df = spark.createDataFrame(rows, "file_id long, series string, written_at timestamp, body string")
    assert sorted(tuple(r) for r in drift.changes(df).collect()) == brute.changes(rows)


def test_changes_like_plain_python(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "evidence_files").select("file_id", "series", "written_at", "body").collect()]
    assert sorted(tuple(r) for r in problems.p6_found(spark, sf).collect()) == brute.changes(rows)


def test_changes_at_the_edges(spark):
    bodies = [
        '{"a":1,"b":{"x":1,"y":null},"d":{}}', '{"a":null,"b":{"x":1,"z":null},"e":{}}', "cut off {", '{"a":"s","b":{"x":1.0,"z":2},"e":[]}', '{"a":"s","b":null,"e":{"k":1}}', '{"a":true,"c":"s","e":{"k":2,"k2":2}}', None, "{}",
    ]
    rows = [(i, None if i % 2 else None, at(i), b, "extra") for i, b in enumerate(bodies)] + [(50, "other", at(0), '{"q":1}', None), (50, "other", at(0), '{"q":1}', None), (51, "other", None, '{"q":2}', None)]
    df = spark.createDataFrame(rows, "file_id long, series string, written_at timestamp, body string, kind string")
    plain = [(r[0], r[1], r[2] or at(-(10**6)), r[3]) for r in {x[0]: x for x in rows}.values() if r[3] and r[3].startswith("{") and r[3] != "cut off {"]
    assert sorted(tuple(r) for r in drift.changes(df).collect()) == brute.changes(plain)
    assert drift.changes(df.limit(0)).count() == 0


def test_rescue_promote_and_replay(spark):
    bodies = ['{"n":1,"s":"x","u":{"v":3},"w":[1]}', '{"n":"7","s":5}', '{"n":"no","u":{"v":"x"}}', "broken", None, "{}"]
    df = spark.createDataFrame(list(enumerate(bodies)), "file_id int, body string")
    got = {r["file_id"]: r for r in drift.ingest(df, {"n": "bigint", "s": "string"}).collect()}
    assert [(got[i]["n"], got[i]["s"]) for i in range(6)] == [(1, "x"), (7, "5"), (None, None), (None, None), (None, None), (None, None)]
    assert json.loads(got[0]["_rescued"]) == {"u/v": 3, "w": [1]} and json.loads(got[2]["_rescued"]) == {"n": "no", "u/v": "x"} and json.loads(got[3]["_rescued"]) == {"": "broken"}
    assert got[1]["_rescued"] is None and got[4]["_rescued"] is None
    more = {r["file_id"]: r for r in drift.promote(drift.ingest(df, {"n": "bigint", "s": "string"}), {"u/v": "bigint"}).collect()}
    assert more[0]["u__v"] == 3 and json.loads(more[0]["_rescued"]) == {"w": [1]} and more[2]["u__v"] is None and "u/v" in more[2]["_rescued"]


def test_rescue_keeps_empty_objects_and_keys_with_slashes(spark):
    bodies = ['{"n":1,"e":{},"u":{"v":{},"w":1}}', '{"a/b":1,"a":{"b":2},"c~1d":3,"c/d":4,"":{"k":5},"k":6}', '{"u":{"x/y":{"z":[1]},"w":null}}', '{"u":{}}', '{"u":3}']
    df = spark.createDataFrame(list(enumerate(bodies)), "file_id int, body string")
    table = drift.ingest(df, {"n": "bigint"})
    got = {r["file_id"]: json.loads(r["_rescued"]) for r in table.collect()}
    assert got[0] == {"e": {}, "u/v": {}, "u/w": 1}
    assert got[1] == {"a~1b": 1, "a/b": 2, "c~01d": 3, "c~1d": 4, "~2/k": 5, "k": 6}
    more = {r["file_id"]: r for r in drift.promote(table, {"u": "string"}).collect()}
    assert [more[i]["u"] for i in range(5)] == ['{"v":{},"w":1}', None, '{"w":null,"x/y":{"z":[1]}}', "{}", "3"]
    assert json.loads(more[0]["_rescued"]) == {"e": {}} and more[2]["_rescued"] is None
    split = {r["file_id"]: r for r in drift.promote(drift.promote(table, {"u/w": "bigint"}), {"u": "string"}).collect()}
    assert split[0]["u__w"] == 1 and split[0]["u"] is None and json.loads(split[0]["_rescued"]) == {"e": {}, "u/v": {}}
    with pytest.raises(ValueError):
        drift.promote(table, {"u": "string", "u/w": "bigint"})


def test_running_values_over_blocks(spark):
    rows = [(k, i, i // 7, (i * 5 % 11) if i % 3 else None) for k in ("a", None) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, i int, b int, v int").repartition(5)
    got = {(r["k"], r["i"]): (r["last"], r["total"]) for r in ordered.running_sum(ordered.last_before(df, ["k"], ["i"], "b", "v", "last"), ["k"], ["i"], "b", F.coalesce("v", F.lit(0)), "total").collect()}
    for k in ("a", None):
        last, total = None, 0
        for _, i, _, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            last = v if v is not None else last
            assert got[k, i] == (last, total)
            total += v or 0
