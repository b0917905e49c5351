"""Queries of the general problems, 1 to 6, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlog.operators import compaction, dedup, drift, incremental, loglines, nested, templates
from loamlog.plans import scratch


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark, sf):
    return dedup.deliveries(spark, table(spark, sf, "segment_deliveries")).where("dropped").select("delivery_id")


def p1_kept(spark, sf):
    rows = dedup.deliveries(spark, table(spark, sf, "segment_deliveries"), carry=("row_count",))
    return rows.where("not dropped").select("delivery_id", "consumer_id", "segment", "row_count")


def p1_copies(spark, sf):
    rows = dedup.deliveries(spark, table(spark, sf, "segment_deliveries"))
    return rows.groupBy("consumer_id").agg(F.count("*").alias("n_deliveries"), F.count_if(~F.col("dropped")).alias("n_segments"))


def p1_upserted(spark, sf):
    """The same after three batches, the second of them delivered twice, each compacted into storage."""
    rows = table(spark, sf, "segment_deliveries")
    part = [rows.where(F.pmod(F.coalesce("batch_no", F.lit(0)), F.lit(3)) == i) for i in range(3)]
    kept = dedup.survivors(spark, [("0", part[0]), ("1", part[1]), ("1", part[1]), ("2", part[2])], carry=("row_count",))
    return kept.select("delivery_id", "consumer_id", "segment", "row_count")


def p2_found(spark, sf):
    return nested.flatten_exports(table(spark, sf, "otlp_exports"), spans=False)


def p2_resources(spark, sf):
    return nested.flat_tables(table(spark, sf, "otlp_exports"))["resources"]


def p2_scopes(spark, sf):
    return nested.flat_tables(table(spark, sf, "otlp_exports"))["scopes"]


def p2_records(spark, sf):
    return nested.flat_tables(table(spark, sf, "otlp_exports"))["records"]


def p2_attributes(spark, sf):
    return nested.flat_tables(table(spark, sf, "otlp_exports"))["attributes"]


def _changes(spark, sf):
    return [table(spark, sf, t) for t in ("snapshots", "lake_rows", "subscription_runs")]


def p3_found(spark, sf):
    """What each subscription has to process, as one committed batch."""
    manifest = incremental.RecordManifest(spark, scratch.new_path(spark, "manifest"))
    manifest.run_batch(*_changes(spark, sf))
    return manifest.processed().select("subscription_id", "record_id")


def p3_backlog(spark, sf):
    return incremental.pending(*_changes(spark, sf)).groupBy("subscription_id", "table_name").agg(F.count("*").alias("n_records"))


def p3_recovered(spark, sf):
    """The same through a run that dies before its commit, the next one, and one that finds nothing
    left: how often each record was handed to each subscription."""
    manifest, tables = incremental.RecordManifest(spark, scratch.new_path(spark, "manifest")), _changes(spark, sf)
    try:
        manifest.run_batch(*tables, stop_after="output")
    except RuntimeError:
        pass
    manifest.run_batch(*tables)
    manifest.run_batch(*tables)
    return manifest.processed().groupBy("subscription_id", "record_id").agg(F.count("*").alias("n_times"))


def p4_method(spark, sf):
    """Every line's template, mined over the whole table: of any layout or none, continuation lines too."""
    return templates.mine(loglines.once(table(spark, sf, "log_events")))[0]


def p4_found(spark, sf):
    return loglines.entries(table(spark, sf, "log_events"), message=False)


def p4_entries(spark, sf):
    return loglines.entries(table(spark, sf, "log_events"))


def p4_templates(spark, sf):
    return templates.mine(loglines.once(table(spark, sf, "log_events")))[1]


def _files(spark, sf):
    return compaction.manifest(table(spark, sf, "file_tasks"), table(spark, sf, "wal_segments"))


def p5_found(spark, sf):
    return compaction.plan(_files(spark, sf)).select("origin", "location")


def p5_groups(spark, sf):
    return compaction.groups(compaction.plan(_files(spark, sf)))


def p5_rewritten(spark, sf):
    """The rows of lake_rows, written as small files and rewritten twice by one plan, as after a run
    that died: rows of each table in the small files and in what they became."""
    root, out = scratch.new_path(spark, "small"), scratch.new_path(spark, "whole")
    table(spark, sf, "lake_rows").repartition(4, "snapshot_id").write.partitionBy("table_name").parquet(root)
    scan = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(root)
    location = F.regexp_extract("path", "(table_name=.*)$", 1)
    files = scan.select(F.lit("lake").alias("origin"), F.regexp_extract(location, "^(.*/)", 1).alias("bin"), location.alias("location"), F.col("length").alias("n_bytes"), F.lit(None).cast("long").alias("n_rows"))
    planned = scratch.materialise(compaction.plan(files, target=1 << 20), "plan")
    for _ in range(2):
        report = compaction.rewrite(spark, planned, root, out)
    named = compaction.targets(planned).select("target_file", F.regexp_extract("bin", "table_name=([^/]*)/", 1).alias("table_name")).distinct()
    whole = spark.read.parquet(out).groupBy("target_file").agg(F.count("*").alias("n"))
    return report.join(named, "target_file").join(whole, "target_file").groupBy("table_name").agg(F.sum("rows_in").alias("rows_in"), F.sum("n").alias("rows_out"))


def p5_sizes(spark, sf):
    return compaction.covered_bytes(table(spark, sf, "file_tasks")).select("table_name", "object_key", F.col("n_bytes").cast("long").alias("n_bytes"))


def p6_found(spark, sf):
    return drift.changes(table(spark, sf, "evidence_files"))


#: The consistent table's columns, and fields approved for promotion.
TARGET = {"generated_at": "timestamp", "verdict": "string", "schema_version": "double"}
APPROVED = {"revisions/repository_commit": "string", "totals/row_total": "bigint", "totals/elapsed_s": "double"}


def p6_table(spark, sf):
    files = table(spark, sf, "evidence_files").select("file_id", "series", "body")
    return drift.promote(drift.ingest(files, TARGET), APPROVED)


def p6_columns(spark, sf):
    """The typed columns of the consistent table, and how many values stayed rescued."""
    rescued = F.coalesce(F.array_size(F.json_object_keys("_rescued")), F.lit(0)).alias("n_rescued")
    return p6_table(spark, sf).select("file_id", F.unix_micros("generated_at").alias("generated_us"), "verdict", "schema_version", "revisions__repository_commit", "totals__row_total", "totals__elapsed_s", rescued)


def p6_report(spark, sf):
    return drift.changes(table(spark, sf, "evidence_files")).groupBy("change", "old_path", "new_path").agg(F.count("*").alias("n_files"))


QUERIES = {f.__name__: f for f in (p1_found, p1_kept, p1_copies, p1_upserted, p2_found, p2_resources, p2_scopes, p2_records, p2_attributes, p3_found, p3_backlog, p3_recovered, p4_method, p4_found, p4_entries, p4_templates, p5_found, p5_groups, p5_rewritten, p5_sizes, p6_found, p6_table, p6_columns, p6_report)}

_P1 = """with d as (select *, coalesce(name, regexp_extract(path, '[^/]*$')) as segment from segment_deliveries),
  r as (select *, row_number() over (partition by consumer_id, segment order by delivered_at nulls last, delivery_id) as n from d)"""

_P3 = """with recursive up(target, node, dist) as (
    select snapshot_id, snapshot_id, 0 from snapshots
    union all
    select up.target, s.parent_snapshot_id, dist + 1 from up join snapshots s on s.snapshot_id = up.node where s.parent_snapshot_id is not null),
  flat as (select r.*, (select string_agg(k || '=' || cast(json_extract(payload, '$."' || k || '"') as varchar), chr(1) order by k) from unnest(json_keys(payload)) t(k)) as content from lake_rows r),
  one as (select record_id, snapshot_id, arg_max(content, row_no) as content, arg_max(event_time, row_no) as event_time from flat group by all),
  best as (select subscription_id, max(table_name) as table_name, max(run_no) filter (where run_status = 'succeeded') as run_no from subscription_runs group by 1),
  subs as (select distinct b.subscription_id, b.table_name, b.run_no, r.cursor_snapshot_id, r.cursor_time from best b
    left join subscription_runs r on r.subscription_id = b.subscription_id and r.run_no = b.run_no and r.run_status = 'succeeded'),
  needed as (select snapshot_id as target from snapshots where is_current union select cursor_snapshot_id from subs where cursor_snapshot_id is not null),
  state as (select target, record_id, arg_min(content, dist) as content, arg_min(event_time, dist) as event_time from up semi join needed using (target) join one on one.snapshot_id = up.node group by all),
  found as (select s.subscription_id, s.table_name, cur.record_id from subs s
    join snapshots c on c.table_name = s.table_name and c.is_current join state cur on cur.target = c.snapshot_id
    left join state old on old.target = s.cursor_snapshot_id and old.record_id = cur.record_id
    where case when s.run_no is null then true when s.cursor_snapshot_id is null then cur.event_time > s.cursor_time else old.content is null or old.content <> cur.content end)"""

_COVER = """with t as (select table_name, object_key, start_offset as s, start_offset + byte_length as e from file_tasks where byte_length is not null),
  m as (select *, max(e) over (partition by table_name, object_key order by s, e rows between unbounded preceding and 1 preceding) as before from t),
  sizes as (select table_name, object_key, cast(sum(greatest(0, e - greatest(s, coalesce(before, 0)))) as bigint) as n_bytes from m group by all)"""
_SMALL = _COVER + """, w as (select regexp_extract(regexp_replace(segment_url, '/+', '/', 'g'), 'wal-mirror/.*') as location, * from wal_segments),
  small as (select 'lake' as origin, table_name || '/' || object_key as location, table_name || '/' || regexp_extract(object_key, '^(.*/)?') as bin, n_bytes from sizes where n_bytes < 16777216
    union all select 'wal', location, regexp_extract(location, '^(.*/)?'), max(n_bytes) from w group by location having count(*) filter (where status = 'committed') = 0 and max(n_bytes) < 16777216)"""  # fmt: skip

_P2 = """with recursive
  n(export_id, node_path, role, j) as (
    select export_id, '', 'root', cast(body as json) from otlp_exports where body is not null and json_valid(body)
    union all
    select export_id, case when node_path = '' then '' else node_path || '/' end || letter || i, role, json_extract(items, '$[' || i || ']')
    from (select export_id, node_path, letter, role, items, unnest(range(cast(json_array_length(items) as bigint))) as i from (
      select export_id, node_path, unnest(c, recursive := true) from (
        select export_id, node_path, unnest(case role
          when 'root' then [{'letter': 'r', 'role': 'R', 'items': coalesce(json_extract(j, '$.resourceLogs'), json_extract(j, '$.resource_logs'))}]
          when 'R' then [{'letter': 'a', 'role': 'K', 'items': json_extract(j, '$.resource.attributes')}, {'letter': 's', 'role': 'S', 'items': coalesce(json_extract(j, '$.scopeLogs'), json_extract(j, '$.scope_logs'))}]
          when 'S' then [{'letter': 'a', 'role': 'K', 'items': json_extract(j, '$.scope.attributes')}, {'letter': 'l', 'role': 'L', 'items': coalesce(json_extract(j, '$.logRecords'), json_extract(j, '$.log_records'))}]
          when 'L' then [{'letter': 'a', 'role': 'K', 'items': json_extract(j, '$.attributes')}]
          when 'K' then [{'letter': 'v', 'role': 'V', 'items': coalesce(json_extract(j, '$.value.arrayValue.values'), json_extract(j, '$.value.array_value.values'))}, {'letter': 'k', 'role': 'K', 'items': coalesce(json_extract(j, '$.value.kvlistValue.values'), json_extract(j, '$.value.kvlist_value.values'))}]
          else [{'letter': 'v', 'role': 'V', 'items': coalesce(json_extract(j, '$.arrayValue.values'), json_extract(j, '$.array_value.values'))}, {'letter': 'k', 'role': 'K', 'items': coalesce(json_extract(j, '$.kvlistValue.values'), json_extract(j, '$.kvlist_value.values'))}]
          end) as c from n)) where json_type(items) = 'ARRAY'))"""

_P6 = """with recursive numbered as (select file_id, series, body, row_number() over (partition by series order by written_at, file_id) as n from (select distinct file_id, series, written_at, body from evidence_files) where json_valid(body) and json_type(body) = 'OBJECT'),
  f(file_id, series, n, path, parent, j) as (
    select file_id, series, n, cast('' as varchar), cast(null as varchar), cast(body as json) from numbered
    union all
    select file_id, series, n, case when path = '' then k else path || '/' || k end, path, json_extract(j, '$."' || k || '"') from (select *, unnest(json_keys(j)) as k from f where json_type(j) = 'OBJECT')),
  typed as (select *, case json_type(j) when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'DOUBLE' then 'number' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' when 'OBJECT' then 'object' else 'null' end as kind from f),
  runs as (select *, n - row_number() over (partition by series, path order by n) as run from typed),
  kept as (select *, coalesce(last_value(case when kind <> 'null' then kind end ignore nulls) over (partition by series, path, run order by n rows between unbounded preceding and current row), 'null') as had from runs),
  met as (select coalesce(a.series, b.series) as series, coalesce(a.n, b.n + 1) as n, coalesce(a.path, b.path) as path, coalesce(a.parent, b.parent) as parent, a.kind, b.had, b.kind as was, a.path is not null as here, b.path is not null as there, coalesce(a.j, b.j) as j
    from kept a full join kept b on a.series = b.series and a.n = b.n + 1 and a.path = b.path),
  stable as (select series, n, path from met where here and there and kind = 'object' and was = 'object'),
  found as (select m.* from met m semi join stable s on s.series = m.series and s.n = m.n and s.path = m.parent where m.path <> ''),
  sides as (select *, row_number() over (partition by series, n, parent, cast(j as varchar), here order by path) as k from found where here <> there),
  moved as (select coalesce(g.series, c.series) as series, coalesce(g.n, c.n) as n, coalesce(g.path, '') as old_path, coalesce(c.path, '') as new_path
    from (select * from sides where there) g full join (select * from sides where here) c on g.series = c.series and g.n = c.n and g.parent = c.parent and cast(g.j as varchar) = cast(c.j as varchar) and g.k = c.k),
  every as (select series, n, old_path, new_path, case when old_path = '' then 'added' when new_path = '' then 'removed' else 'renamed' end as change from moved
    union all select series, n, path, path, 'type_changed' from found where here and there and kind <> 'null' and had <> 'null' and kind <> had),
  changes as (select d.file_id, e.old_path, e.new_path, e.change from every e join numbered d on d.series = e.series and d.n = e.n)"""  # fmt: skip

_LEVEL = "case upper({0}) when 'TRACE' then 'TRACE' when 'DEBUG' then 'DEBUG' when 'INFO' then 'INFO' when 'LOG' then 'INFO' when 'NOTICE' then 'INFO' when 'WARN' then 'WARN' when 'WARNING' then 'WARN' when 'W' then 'WARN' when 'I' then 'INFO' when 'ERROR' then 'ERROR' when 'ERR' then 'ERROR' when 'E' then 'ERROR' when '' then '' else 'FATAL' end"


def _p4_case(pattern: str, time: str, level: str = "''", component: str = "''") -> str:
    """A layout of the SQL: groups are named by their numbers."""
    group = lambda x: f"regexp_extract(s, '{pattern}', {x})" if x.isdigit() else x
    at = time.replace("#", ")").replace("$", "regexp_extract(s, '" + pattern + "', ")
    return f"when regexp_matches(s, '{pattern}') then {{'us': epoch_us({at}), 'level': {level if not level.isdigit() else _LEVEL.format(group(level))}, 'component': {group(component)}}}"


_ISO = r"try_cast(regexp_replace(replace($1#, \',\', \'.\'), \'([.][0-9]{{6}})[0-9]+\', \'\1\') || {0} as timestamptz)".replace("\\'", "'")
_D, _C, _LV = "[0-9]{4}-[0-9]{2}-[0-9]{2}", "[0-9]{2}:[0-9]{2}:[0-9]{2}", "(?i:(?:trace|debug|info|log|notice|warn|warning|error|err|fatal|critical|crit|panic|alert|emerg|emergency))"
_KV = '[A-Za-z_][A-Za-z0-9_.-]*=(?:"(?:[^"\\\\]|\\\\.)*"|[^ "]*)'
_P4 = (
    r"""with l as (select host, source, line_no, min(event_id) as event_id, arg_min(raw, event_id) as raw, arg_min(event_time, event_id) as et from log_events group by 1, 2, 3),
  t as (select *, regexp_replace(coalesce(raw, ''), '\x1b\[[0-9;]*m', '', 'g') as s, year(et) as y from l),
  u as (select *, regexp_replace(s, '(^| )(msg|message)="(?:[^"\\]|\\.)*"', '\1\2=', 'g') as bare, case when s[1] = '{' and json_valid(s) then s end as doc from t),
  h as (select *, case """
    + " ".join([
        _p4_case(rf"^({_D}T{_C}(?:[.][0-9]+)?Z) +({_LV}) ([A-Za-z0-9_:.-]+): ", _ISO.format("''"), "2", "3"),
        _p4_case(rf"^[0-9.]+ [^ ]+ [^ ]+ \[([0-9]{{2}}/[A-Z][a-z]{{2}}/[0-9]{{4}}:{_C} [+-][0-9]{{4}})\] \"", "strptime($1#, '%d/%b/%Y:%H:%M:%S %z')"),
        _p4_case(rf"^\[({_D} {_C}(?:[.][0-9]+)?)\] \[({_LV})\] \[([^\]]+)\] ", _ISO.format("'+00'"), "2", "3"),
        _p4_case(rf"^({_D} {_C}(?:[.][0-9]+)?) UTC \[[0-9]+\] ({_LV}):  ", _ISO.format("'+00'"), "2"),
        _p4_case(rf"^({_D} {_C},[0-9]{{3}}) ({_LV}) +\[[^\]]*\] ([^ ]+) - ", _ISO.format("'+00'"), "2", "3"),
        _p4_case(rf"^({_D} {_C},[0-9]{{3}}) - ([^ ]+) - ({_LV}) - ", _ISO.format("'+00'"), "3", "2"),
        _p4_case(rf"^<[0-9]{{1,3}}>1 ({_D}T{_C}(?:[.][0-9]+)?(?:Z|[+-][0-9]{{2}}:[0-9]{{2}})) [^ ]+ ([^ ]+) [^ ]+ [^ ]+ (?:-|\[)", _ISO.format("''"), "['FATAL', 'FATAL', 'FATAL', 'ERROR', 'WARN', 'INFO', 'INFO', 'DEBUG'][cast(regexp_extract(s, '^<([0-9]+)>', 1) as int) % 8 + 1]", "2"),
        _p4_case(rf"^([A-Z][a-z]{{2}} [ 0-9][0-9] {_C}) [^ ]+ ([A-Za-z0-9_.-]+)(?:\[[0-9]+\])?: ", "try_strptime(y || ' ' || regexp_replace($1#, ' +', ' ', 'g'), '%Y %b %-d %H:%M:%S')", "''", "2"),
        _p4_case(rf"^([0-9]{{4}}/[0-9]{{2}}/[0-9]{{2}} {_C}) \[({_LV})\] [0-9]+#[0-9]+: ", "try_strptime($1#, '%Y/%m/%d %H:%M:%S')", "2"),
        _p4_case(rf"^[IWEF]([0-9]{{4}} {_C}[.][0-9]+) +[0-9]+ ([^ :\]]+):[0-9]+\] ", "try_cast(y || '-' || $1#[1:2] || '-' || $1#[3:4] || $1#[5:] || '+00' as timestamptz)", _LEVEL.format("s[1]"), "2"),
    ])
    + r""" when doc is not null and coalesce(json_extract_string(doc, '$.time'), json_extract_string(doc, '$.timestamp')) is not null
      then {'us': epoch_us(try_cast(coalesce(json_extract_string(doc, '$.time'), json_extract_string(doc, '$.timestamp')) as timestamptz)), 'level': """
    + _LEVEL.format("coalesce(json_extract_string(doc, '$.level'), json_extract_string(doc, '$.severity'), '')")
    + r""", 'component': coalesce(json_extract_string(doc, '$.component'), json_extract_string(doc, '$.logger'), '')}
    when doc is not null and json_extract_string(doc, '$.ts') is not null
      then {'us': cast(floor(case when cast(json_extract_string(doc, '$.ts') as decimal(24, 6)) > 100000000000 then cast(json_extract_string(doc, '$.ts') as decimal(24, 6)) * 1000 else cast(json_extract_string(doc, '$.ts') as decimal(24, 6)) * 1000000 end) as bigint), 'level': """
    + _LEVEL.format("coalesce(json_extract_string(doc, '$.level'), json_extract_string(doc, '$.severity'), '')")
    + r""", 'component': coalesce(json_extract_string(doc, '$.component'), json_extract_string(doc, '$.logger'), '')}
    when regexp_full_match(s, '"""
    + _KV
    + "(?: +"
    + _KV
    + r""")* *') and regexp_matches(bare, '(?:^| )(?:time|ts)=')
      then {'us': epoch_us(try_cast(regexp_extract(bare, '(?:^| )(?:time|ts)=([^ ]*)', 1) as timestamptz)), 'level': """
    + _LEVEL.format("regexp_extract(bare, '(?:^| )(?:level|lvl)=([^ ]*)', 1)")
    + r""", 'component': regexp_extract(bare, '(?:^| )(?:component|logger)=([^ ]*)', 1)} end as head from u),
  e as (select *, last_value(case when head.us is not null then line_no end ignore nulls) over (partition by host, source order by line_no rows between unbounded preceding and current row) as first_line from h),
  n as (select host, source, first_line, count(*) as n_rows from e where first_line is not null group by all)
  select h.event_id, h.head.us as ts_us, h.head.level as level, h.head.component as component, n.n_rows from n join h on h.host is not distinct from n.host and h.source is not distinct from n.source and h.line_no = n.first_line"""
)


def _member(*paths: str) -> str:
    return "coalesce(" + ", ".join(f"json_extract_string(j, '$.{p}')" for p in paths) + ")"


_PARENT = "regexp_replace(node_path, '/[^/]*$', '') as parent_path"
_P2_RECORDS = _P2 + f""" select export_id, node_path, {_PARENT}, try_cast({_member("timeUnixNano", "time_unix_nano")} as bigint) as time_ns, try_cast({_member("severityNumber", "severity_number")} as int) as severity_number,
  {_member("severityText", "severity_text")} as severity_text, coalesce({_member("body.stringValue", "body.string_value")}, json_extract_string(j, '$.body')) as body_text, {_member("traceId", "trace_id")} as trace_id, {_member("spanId", "span_id")} as span_id from n where role = 'L'"""
_KINDS = [("string", "stringValue", "string_value"), ("int", "intValue", "int_value"), ("double", "doubleValue", "double_value"), ("bool", "boolValue", "bool_value"), ("bytes", "bytesValue", "bytes_value")]
_P2_ATTRIBUTES = _P2 + f""", a as (select *, case when role = 'K' then json_extract(j, '$.value') else j end as v from n where role in ('K', 'V'))
  select export_id, node_path, {_PARENT}, cast(regexp_extract(node_path, '[0-9]+$') as int) as element_no, case when role = 'K' then json_extract_string(j, '$.key') end as attr_key,
  coalesce({", ".join(f"case when {_member(c, k).replace('(j,', '(v,')} is not null then '{n}' end" for n, c, k in _KINDS)}, case when {_member("arrayValue", "array_value").replace('(j,', '(v,')} is not null then 'array' when {_member("kvlistValue", "kvlist_value").replace('(j,', '(v,')} is not null then 'kvlist' end, 'empty') as value_kind,
  coalesce({", ".join(_member(c, k).replace('(j,', '(v,') for _, c, k in _KINDS)}) as value_text from a"""

ORACLES = {
    "p2_resources": _P2 + f" select export_id, node_path, coalesce(try_cast({_member('resource.droppedAttributesCount', 'resource.dropped_attributes_count')} as bigint), 0) as dropped_attributes from n where role = 'R'",
    "p2_scopes": _P2 + f" select export_id, node_path, {_PARENT}, json_extract_string(j, '$.scope.name') as scope_name, json_extract_string(j, '$.scope.version') as scope_version, {_member('schemaUrl', 'schema_url')} as schema_url from n where role = 'S'",
    "p2_records": _P2_RECORDS,
    "p2_attributes": _P2_ATTRIBUTES,
    "p4_found": _P4,
    "p2_found": _P2 + " select export_id, node_path from n where node_path <> ''",
    "p6_found": _P6 + " select * from changes",
    "p6_columns": """with recursive b as (select file_id, body, body is not null and json_valid(body) and json_type(case when json_valid(body) then body end) = 'OBJECT' as whole from evidence_files),
      f(file_id, path, j) as (select file_id, '', cast(body as json) from b where whole
        union all select file_id, case when path = '' then k else path || '/' || k end, json_extract(j, '$."' || k || '"') from (select *, unnest(json_keys(j)) as k from f where json_type(j) = 'OBJECT')),
      v as (select file_id, path, j, json_type(j) as t, j->>'$' as s from f where path <> ''),
      c as (select file_id, path, t, case path when 'generated_at' then cast(try_cast(s as timestamptz) as varchar) when 'verdict' then s when 'revisions/repository_commit' then s
        when 'schema_version' then cast(try_cast(s as double) as varchar) when 'totals/elapsed_s' then cast(try_cast(s as double) as varchar) when 'totals/row_total' then case when try_cast(s as double) = floor(try_cast(s as double)) then cast(try_cast(s as bigint) as varchar) end end as x,
        path in ('generated_at', 'verdict', 'revisions/repository_commit', 'schema_version', 'totals/elapsed_s', 'totals/row_total') as wanted, s from v),
      leaves as (select file_id, count(*) as n from c where case when wanted and not (t = 'OBJECT' and starts_with(path, 'totals/')) then x is null and t <> 'NULL' else t <> 'OBJECT' or s = '{}' end and not exists (select 1 from (values ('generated_at/'), ('verdict/'), ('schema_version/'), ('revisions/repository_commit/')) w(p) where starts_with(path, p)) group by 1),
      cols as (select file_id, max(x) filter (where path = 'generated_at') as generated_at, max(x) filter (where path = 'verdict') as verdict, max(x) filter (where path = 'schema_version') as schema_version, max(x) filter (where path = 'revisions/repository_commit') as revisions__repository_commit, max(x) filter (where path = 'totals/row_total') as totals__row_total, max(x) filter (where path = 'totals/elapsed_s') as totals__elapsed_s from c group by 1)
      select b.file_id, epoch_us(cast(cols.generated_at as timestamptz)) as generated_us, cols.verdict, cast(cols.schema_version as double) as schema_version, cols.revisions__repository_commit, cast(cols.totals__row_total as bigint) as totals__row_total, cast(cols.totals__elapsed_s as double) as totals__elapsed_s,
        coalesce(leaves.n, case when body is not null and not whole then 1 else 0 end) as n_rescued from b left join cols using (file_id) left join leaves using (file_id)""",
    "p6_report": _P6 + " select change, old_path, new_path, count(*) as n_files from changes group by all",
    "p1_found": _P1 + " select delivery_id from r where n > 1 and segment is not null",
    "p1_kept": _P1 + " select delivery_id, consumer_id, segment, row_count from r where n = 1 or segment is null",
    "p1_upserted": _P1 + " select delivery_id, consumer_id, segment, row_count from r where n = 1 or segment is null",
    "p1_copies": _P1 + " select consumer_id, count(*) as n_deliveries, count(*) filter (where n = 1 or segment is null) as n_segments from r group by 1",
    "p3_found": _P3 + " select subscription_id, record_id from found",
    "p3_recovered": _P3 + " select subscription_id, record_id, 1 as n_times from found",
    "p3_backlog": _P3 + " select subscription_id, table_name, count(*) as n_records from found group by all",
    "p5_found": _SMALL + " select origin, location from small",
    "p5_groups": _SMALL
    + """, c as (select *, sum(n_bytes) over (partition by origin, bin order by location rows between unbounded preceding and 1 preceding) as before from small),
      n as (select table_name || '/' || object_key as location, sum(r) as n_rows from (select table_name, object_key, start_offset, byte_length, max(row_count) as r from file_tasks where byte_length is not null group by all) group by all
        union all select location, max(row_count) from w group by location)
      select origin, bin, cast(floor(coalesce(before, 0) / 134217728) as bigint) as group_no, count(*) as n_files, cast(sum(n_bytes) as bigint) as n_bytes, cast(sum(coalesce(n_rows, 0)) as bigint) as n_rows
      from c left join n using (location) group by 1, 2, 3""",
    "p5_rewritten": "select table_name, count(*) as rows_in, count(*) as rows_out from lake_rows where table_name is not null group by all",
    "p5_sizes": _COVER + " select * from sizes",
}
