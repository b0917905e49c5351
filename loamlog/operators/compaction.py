"""Many small files into fewer well-sized ones.

The plan is SQL over a frozen manifest: the files in their order with a running sum of bytes;
each target-sized interval of the running sum is a group. The manifest is range-sorted once and
written with its block number, so that the running sum is one within blocks plus one over the
blocks' totals, and no table, however large, is summed in one task.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlog.plans import ordered, scratch
from loamlog.plans.store import Store

TARGET = 128 << 20
SMALL = 16 << 20
FILES_A_BATCH = 20_000
STARTS_A_BLOCK = 20  # bits: a block of starts holds at most 2^20 of them


def _view(df: DataFrame) -> str:
    name = "loamlog_" + scratch.uuid.uuid4().hex
    df.createOrReplaceTempView(name)
    return name


def covered_bytes(tasks: DataFrame) -> DataFrame:
    """(table_name, object_key, n_bytes, n_rows): distinct bytes the tasks of each file cover.

    A task without length or start says nothing; a file of which nothing is known has n_bytes
    null, one whose tasks are all empty has 0. Row counts are those of distinct pieces.
    """
    spark = tasks.sparkSession
    t = _view(tasks)
    return spark.sql(f"""
      with pieces as (
        select table_name, object_key, start_offset as s, max(start_offset + byte_length) as e
        from {t}
        where table_name is not null and object_key is not null and start_offset is not null and byte_length >= 0
        group by all),
      blocked as (select *, shiftright(s, {STARTS_A_BLOCK}) as block from pieces),
      tops as (
        select table_name, object_key, block, max(max(e)) over (partition by table_name, object_key order by block rows between unbounded preceding and 1 preceding) as before
        from blocked group by table_name, object_key, block),
      within as (
        select table_name, object_key, block, s, e, max(e) over (partition by table_name, object_key, block order by s rows between unbounded preceding and 1 preceding) as before_in
        from blocked),
      sized as (
        select w.table_name, w.object_key, sum(greatest(0, w.e - greatest(w.s, coalesce(w.before_in, 0), coalesce(t.before, 0)))) as n_bytes
        from within w join tops t on w.table_name = t.table_name and w.object_key = t.object_key and w.block = t.block
        group by w.table_name, w.object_key),
      rows_of as (
        select table_name, object_key, sum(r) as n_rows from (
          select table_name, object_key, start_offset, byte_length, max(row_count) as r from {t}
          where table_name is not null and object_key is not null and byte_length is not null group by all)
        group by table_name, object_key)
      select sized.*, coalesce(n_rows, 0) as n_rows from sized left join rows_of using (table_name, object_key)""")


def manifest(tasks: DataFrame, segments: DataFrame) -> DataFrame:
    """Every file with origin, bin (what may be put together), location, n_bytes and n_rows.

    A segment registered several times, under any spelling of its place, is one file with the
    largest of its sizes; one that has a committed registration is not listed.
    """
    spark = tasks.sparkSession
    sizes, w = _view(covered_bytes(tasks)), _view(segments)
    return spark.sql(f"""
      select 'lake' as origin, concat(table_name, '/', regexp_extract(object_key, '^(.*/)?', 0)) as bin,
        concat(table_name, '/', object_key) as location, cast(n_bytes as bigint) as n_bytes, cast(n_rows as bigint) as n_rows
      from {sizes}
      union all
      select 'wal', regexp_extract(location, '^(.*/)?', 0), location, max(n_bytes), coalesce(max(row_count), 0)
      from (select regexp_extract(regexp_replace(segment_url, '/+', '/'), '(?s)wal-mirror/.*', 0) as location, n_bytes, row_count, status from {w})
      where location <> ''
      group by location having count_if(status = 'committed') = 0""")


def freeze(files: DataFrame, partitions: int | None = None) -> DataFrame:
    """The manifest in order, written with ``block``, the number of the range each file lies in."""
    return ordered.frozen(files, ["origin", "bin", "location"], "manifest", partitions)


def plan(files: DataFrame, small: int = SMALL, target: int = TARGET, partitions: int | None = None) -> DataFrame:
    """Small files with ``group_no``: within a bin, the target-sized interval each one starts in.

    Files of unknown size or of ``small`` bytes and more are left as they are.
    """
    frozen = _view(freeze(files.where(F.col("n_bytes") < small), partitions))
    return files.sparkSession.sql(f"""
      with totals as (
        select origin, bin, block, sum(sum(n_bytes)) over (partition by origin, bin order by block rows between unbounded preceding and 1 preceding) as before
        from {frozen} group by origin, bin, block),
      summed as (
        select *, sum(n_bytes) over (partition by origin, bin, block order by location rows between unbounded preceding and 1 preceding) as before_in from {frozen})
      select s.origin, s.bin, s.location, s.n_bytes, s.n_rows,
        cast(floor((coalesce(s.before_in, 0) + coalesce(t.before, 0)) / {target}) as bigint) as group_no
      from summed s join totals t on s.origin = t.origin and s.bin = t.bin and s.block = t.block""")


def groups(planned: DataFrame) -> DataFrame:
    """One row for each file to be written."""
    return planned.groupBy("origin", "bin", "group_no").agg(F.count("*").alias("n_files"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_rows").alias("n_rows"))


def targets(planned: DataFrame) -> DataFrame:
    """The plan with ``target_file``: a name made of the group and of the files in it, so that two
    plans never give the same name to different contents."""
    group = ["origin", "bin", "group_no"]
    marks = planned.groupBy(*group).agg(F.hex(F.expr("bit_xor(xxhash64(location, n_bytes))")).alias("mark"))
    name = F.concat_ws("-", F.lit("g"), F.sha2(F.concat_ws("\x1f", "origin", "bin"), 256).substr(1, 12), F.col("group_no").cast("string"), F.lower("mark"))
    return planned.join(marks, group).withColumn("target_file", name)


def rewrite(spark: SparkSession, planned: DataFrame, root: str, out: str, files_a_batch: int = FILES_A_BATCH) -> DataFrame:
    """Rewrites the Parquet files under ``root`` that ``planned`` names, one file a group, and
    returns (target_file, rows_in, rows_out); raises ValueError if counts differ.

    Groups are taken in batches of about ``files_a_batch`` files, so that the driver never holds
    more names (a group of more, which only empty files can be, is written in parts); a batch is one
    scan, in which each row finds its group by the file it came from. A batch is written and
    reconciled in a staging folder below ``out`` that readers don't see, and its groups are then
    renamed into place. Running the same plan again, after a run that died or one that didn't, finds
    groups in their place and leaves them: nothing is lost or doubled. A batch whose counts differ is
    removed with its staging folder alone.
    """
    listed = targets(planned).select("location", "target_file").orderBy("target_file", "location")
    reports: list[DataFrame] = []
    batch: list[tuple[str, str]] = []
    last, part, n = "", 0, 0
    for row in listed.toLocalIterator(prefetchPartitions=True):
        if row["target_file"] != last:
            if len(batch) >= files_a_batch:
                reports.append(_rewrite_batch(spark, batch, root, out))
                batch = []
            last, part, n = row["target_file"], 0, 0
        elif n >= files_a_batch:
            reports.append(_rewrite_batch(spark, batch, root, out))
            batch, part, n = [], part + 1, 0
        batch.append((row["location"], f"{last}-p{part}" if part else last))
        n += 1
    if batch:
        reports.append(_rewrite_batch(spark, batch, root, out))
    if not reports:
        return spark.createDataFrame([], "target_file string, rows_in long, rows_out long")
    whole = reports[0]
    for r in reports[1:]:
        whole = whole.unionByName(r)
    return whole


def _rows_of(spark: SparkSession, batch: list[tuple[str, str]], root: str) -> DataFrame:
    """The rows of the batch's files with ``target_file``, null if a row's file isn't found again."""
    data = spark.read.option("mergeSchema", "true").parquet(*[f"{root}/{location}" for location, _ in batch])
    place = spark.createDataFrame(batch, "__location string, target_file string")
    tagged = data.withColumn("__location", F.substring(F.col("_metadata.file_path"), F.lit(len(_qualified(spark, root)) + 2), F.lit(1 << 30)))
    return tagged.join(place, "__location", "left").drop("__location")


def _counted(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(target_file, rows_out) of written groups."""
    if not folders:  # nothing but empty files
        return spark.createDataFrame([], "target_file string, rows_out long")
    return spark.read.parquet(*folders).groupBy(F.regexp_extract(F.col("_metadata.file_path"), "target_file=([^/]+)/", 1).alias("target_file")).agg(F.count("*").alias("rows_out"))


def _rewrite_batch(spark: SparkSession, batch: list[tuple[str, str]], root: str, out: str) -> DataFrame:
    store = Store(spark, out)
    staging = "_staging/" + hashlib.sha256(json.dumps(batch).encode()).hexdigest()[:24]
    store.delete(staging)  # what a run that died left of the same batch
    names = sorted({t for _, t in batch})
    placed = set(store.folders(""))
    missing = [t for t in names if f"target_file={t}" not in placed]
    # from the footers: no column is read
    counted_in = scratch.materialise(_rows_of(spark, batch, root).groupBy("target_file").agg(F.count("*").alias("rows_in")), "counted")
    differ = lambda report: report.where("target_file is null or not (rows_in <=> rows_out)").limit(1).count()
    if missing:
        todo = set(missing)
        part = [x for x in batch if x[1] in todo]
        _rows_of(spark, part, root).repartition(len(missing), "target_file").write.partitionBy("target_file").option("compression", "zstd").parquet(f"{out}/{staging}")
        written = sorted(store.folders(staging))
        staged = _counted(spark, [f"{out}/{staging}/{t}" for t in written])
        if differ(counted_in.where(F.col("target_file").isNull() | F.col("target_file").isin(missing)).join(staged, "target_file", "full")):
            store.delete(staging)
            raise ValueError("rows in and out differ; nothing of the batch was kept")
        for t in written:
            if not store.rename(f"{staging}/{t}", t):
                raise OSError(f"{t} could not be put in its place")
        store.delete(staging)
        placed |= set(written)
    report = scratch.materialise(counted_in.join(_counted(spark, [f"{out}/target_file={t}" for t in names if f"target_file={t}" in placed]), "target_file", "full"), "reconciled")
    if differ(report):
        raise ValueError("rows in and those that are in place differ")
    return report


def _qualified(spark: SparkSession, root: str) -> str:
    """The folder as the scan spells it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
