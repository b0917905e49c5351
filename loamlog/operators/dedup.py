"""Exactly one copy of messages delivered at least once.

Deliveries are upserted into storage that is hash-bucketed and sorted by identifier. Each input
task writes one sorted run and marks, while it writes, every copy that is not the first of its
identifier in the run: a hot identifier shrinks to one candidate a run before anything is
shuffled. Compaction then merges the candidates of all runs, and of what was compacted before, by
bucket; equal identifiers collapse to the earliest, and the outcome is written back, one sorted file
a bucket, in place of the runs it was made of.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlog.plans import scratch
from loamlog.plans.store import Store


def segment_name(name: Column, path: Column) -> Column:
    """The segment's name, or else the last element of its path; null if both are null."""
    return F.coalesce(name, F.element_at(F.split(path, "/"), -1))


def _mark_repeats(keys: list[str], flag: str):
    """Flags rows whose keys equal those of the row before. Input must be sorted by the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            same = np.ones(batch.num_rows, dtype=bool)
            for i, k in enumerate(keys):
                col = batch.column(k)
                head = pa.array([None if last is None else last[i]], type=col.type)
                before = pa.concat_arrays([head, col.slice(0, batch.num_rows - 1)])
                equal = pc.fill_null(pc.equal(col, before), False)
                both_null = pc.and_(pc.is_null(col), pc.is_null(before))
                same &= np.asarray(pc.or_(equal, both_null))
            if last is None:
                same[0] = False
            last = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
            yield batch.append_column(flag, pa.array(same))

    return run


class BucketStore:
    """Under ``path``: ``runs``, a folder a batch, and ``compacted``, a folder a generation with one
    below it for each bucket. A generation counts once its mark is there; the mark lists the batches
    it holds, whose runs are then removed.

    ``keys``: the identifier's columns (compared null-safely). ``order``: which copy is kept, the
    smallest first, nulls last; it should tell all deliveries apart. Other columns are carried along.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path, keys, order, buckets
        self.store = Store(spark, path)

    def _sorted(self, df: DataFrame) -> DataFrame:
        return df.sortWithinPartitions("bucket", *self.keys, *[F.col(c).asc_nulls_last() for c in self.order])

    def _marked(self, df: DataFrame, flag: str) -> DataFrame:
        schema = df.schema.add(flag, "boolean", False)
        return self._sorted(df).mapInArrow(_mark_repeats(self.keys, flag), schema)

    def _generation(self) -> tuple[int, set[str]]:
        """The newest generation's number, 0 for none, and the batches it holds."""
        marks = sorted(n for n, _, _ in self.store.names("marks") if n.isdigit())
        return (int(marks[-1]), set(json.loads(self.store.read(f"marks/{marks[-1]}")))) if marks else (0, set())

    def upsert(self, batch: DataFrame, batch_id: str) -> None:
        """Writes the batch's runs. Running it again with the same ``batch_id`` changes nothing: the
        runs are replaced or, once they are compacted, left out."""
        name = re.sub(r"[^A-Za-z0-9_-]", "_", batch_id) + "-" + hashlib.sha1(batch_id.encode()).hexdigest()[:10]
        if name in self._generation()[1]:
            return
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))
        self._marked(rows, "in_run").write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/runs/batch={name}")

    def _stored(self) -> tuple[DataFrame | None, list[str]]:
        """Every stored row with ``bucket`` and ``in_run``, and the batches not compacted yet."""
        number, held = self._generation()
        fresh = sorted(f for f in self.store.folders("runs") if f.removeprefix("batch=") not in held)
        rows = self.spark.read.parquet(*[f"{self.path}/runs/{f}" for f in fresh]) if fresh else None
        if number:
            old = self._compacted(number)
            if rows is not None:
                old = self.spark.read.schema(rows.drop("in_run").schema).option("basePath", f"{self.path}/compacted/{number:09d}").parquet(f"{self.path}/compacted/{number:09d}")
            old = old.withColumn("in_run", F.lit(False))
            rows = old if rows is None else rows.unionByName(old)
        return rows, [f.removeprefix("batch=") for f in fresh]

    def _compacted(self, number: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/compacted/{number:09d}")

    def merged(self) -> DataFrame:
        """Every stored delivery with ``dropped``: whether an earlier copy of its identifier exists.

        A copy dropped within its run is not looked at again; the firsts of all runs, and what was
        compacted before, are brought together by bucket and merged.
        """
        rows, _ = self._stored()
        if rows is None:
            raise ValueError("nothing was upserted")
        firsts = self._marked(rows.where(~F.col("in_run")).repartition(F.col("bucket"), *self.keys), "dropped")
        return rows.where("in_run").withColumn("dropped", F.lit(True)).unionByName(firsts).drop("in_run", "bucket")

    def compact(self) -> DataFrame:
        """Merges the runs into a new generation, and returns the surviving copies. A compaction that
        dies before its mark changes nothing."""
        number, held = self._generation()
        rows, fresh = self._stored()
        if fresh:
            firsts = self._marked(rows.where(~F.col("in_run")).drop("in_run").repartition(F.col("bucket"), *self.keys), "dropped")
            # identifiers are distinct by now, so buckets are even
            kept = firsts.where(~F.col("dropped")).drop("dropped").repartition(self.buckets, "bucket").sortWithinPartitions("bucket", *self.keys)
            number += 1
            kept.write.mode("overwrite").partitionBy("bucket").option("compression", "zstd").parquet(f"{self.path}/compacted/{number:09d}")
            if not self.store.create(f"marks/{number:09d}", json.dumps(sorted(held | set(fresh)))):
                raise RuntimeError("another compaction was faster")
            for name in fresh:
                self.store.delete(f"runs/batch={name}")
            if number > 1:
                self.store.delete(f"compacted/{number - 1:09d}")
        elif not number:
            raise ValueError("nothing was upserted")
        return self._compacted(number).drop("bucket")


def _identified(df: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    rows = df.select(
        "delivery_id", "consumer_id", F.col("delivered_at"), *carry,
        segment_name(F.col("name"), F.col("path")).alias("segment"),
    )
    return rows.withColumn("alone", F.when(F.col("segment").isNull(), F.col("delivery_id")))


def delivery_store(spark: SparkSession, path: str | None = None) -> BucketStore:
    return BucketStore(spark, path or scratch.new_path(spark, "deliveries"), ["consumer_id", "segment", "alone"], ["delivered_at", "delivery_id"])


def deliveries(spark: SparkSession, df: DataFrame, carry: tuple[str, ...] = (), path: str | None = None, batch_id: str = "all") -> DataFrame:
    """Deliveries of segments with ``dropped``; one consumer's copies of one segment collapse.

    A delivery with neither name nor path has no identifier and is never dropped; a null consumer
    is a consumer of its own; a null ``delivered_at`` comes after all others; ties go to the
    smallest ``delivery_id``. An empty table gives an empty result.
    """
    store = delivery_store(spark, path)
    store.upsert(_identified(df, carry), batch_id)
    return store.merged().drop("alone")


def survivors(spark: SparkSession, batches: list[tuple[str, DataFrame]], carry: tuple[str, ...] = (), path: str | None = None, compact_every: int = 1) -> DataFrame:
    """The copies that stay after the batches, (identifier, deliveries) each, are upserted in order
    and compacted after every ``compact_every`` of them. A batch listed again adds nothing."""
    store = delivery_store(spark, path)
    for n, (batch_id, df) in enumerate(batches, 1):
        store.upsert(_identified(df, carry), batch_id)
        if n % compact_every == 0:
            store.compact()
    return store.compact().drop("alone")
