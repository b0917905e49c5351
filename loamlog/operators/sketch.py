"""Labelled approximate top groups: Misra-Gries summaries.

Each task keeps at most ``m`` counters of its own rows. Summaries merge by adding counters and
taking the (m+1)-th largest off all of them, in rounds of a bounded number of summaries, so no task
sees more than ``FAN_IN * m`` counters. A count is never more than the true one, and less by at
most ``error_upper_bound``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlog.plans import scratch

FAN_IN = 64
COUNTERS = "part long, value string, counted long, error long, total long"


def reduce_counters(counts: dict, m: int) -> tuple[dict, int]:
    """At most ``m`` counters and what was taken off each."""
    if len(counts) <= m:
        return counts, 0
    off = sorted(counts.values(), reverse=True)[m]
    return {k: v - off for k, v in counts.items() if v > off}, off


def _summarise(m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        error = total = part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(1)[0].as_py()
            seen = pc.value_counts(batch.column(0))
            total += batch.num_rows
            for value, n in zip(seen.field(0).to_pylist(), seen.field(1).to_pylist()):
                counts[value] = counts.get(value, 0) + n
            counts, off = reduce_counters(counts, m)
            error += off
        if total:
            rows = list(counts.items()) or [(None, 0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), pa.int64()), pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.int64()), pa.array([error] * len(rows), pa.int64()), pa.array([total] * len(rows), pa.int64())],
                names=["part", "value", "counted", "error", "total"],
            )

    return run


def _merge(m: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        heads = pdf.drop_duplicates("part")
        counts = pdf.groupby("value", dropna=False)["counted"].sum()
        kept, off = reduce_counters({None if pd.isna(k) else k: int(v) for k, v in counts.items() if v}, m)
        rows = list(kept.items()) or [(None, 0)]
        return pd.DataFrame({"part": int(pdf["part"].min()) // FAN_IN, "value": [k for k, _ in rows], "counted": [v for _, v in rows], "error": int(heads["error"].sum()) + off, "total": int(heads["total"].sum())})

    return run


def top_groups(df: DataFrame, column: str, k: int, m: int = 10_000) -> DataFrame:
    """(value, count, error_upper_bound, not_counted): the ``k`` largest groups of the column.

    Exact if the column has at most ``m`` values (then both labels are 0). ``not_counted`` is the
    number of rows in no listed group's count. Nulls are a group like others. An empty table gives
    no row.
    """
    if k < 1 or m < k:
        raise ValueError("k must be positive and at most m")
    parts = df.select(F.col(column).cast("string").alias("value"), F.spark_partition_id().cast("long").alias("part"))
    now = scratch.materialise(parts.mapInArrow(_summarise(m), COUNTERS), "sketch")
    n = now.agg(F.max("part")).first()[0]
    while n is not None and n > 0:
        now = scratch.materialise(now.groupBy(F.floor(F.col("part") / FAN_IN).alias("to")).applyInPandas(lambda pdf: _merge(m)(pdf), COUNTERS), "sketch")
        n = now.agg(F.max("part")).first()[0]
    top = now.where("counted > 0").orderBy(F.desc("counted"), F.asc_nulls_last("value")).limit(k)
    listed = top.agg(F.coalesce(F.sum("counted"), F.lit(0)).alias("listed"))
    return top.join(F.broadcast(listed)).select("value", F.col("counted").alias("count"), F.col("error").alias("error_upper_bound"), (F.col("total") - F.col("listed")).alias("not_counted"))
