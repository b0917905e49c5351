"""Running values along an order, for groups too large for one task.

A plain window puts each group into one task. Here a group is cut into blocks that follow its
order; windows run within blocks, and a second, far smaller one over the blocks' totals gives each
block what came before it. ``block`` must not fall along ``order``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamlog.plans import scratch


def _join_carry(rows: DataFrame, carry: DataFrame, on: list[str]) -> DataFrame:
    """Left join on keys that may be null."""
    condition = None
    for k in on:
        test = rows[k].eqNullSafe(carry[f"__{k}"])
        condition = test if condition is None else condition & test
    return rows.join(carry, condition, "left").drop(*[f"__{k}" for k in on])


def frozen(df: DataFrame, order: list[str], tag: str = "ordered", partitions: int | None = None) -> DataFrame:
    """The rows range-sorted and written with ``block``, the number of the range each lies in. Blocks
    are of about equal size whatever the values; rows that are equal in ``order`` share one."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.materialise(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("block", F.spark_partition_id()), tag)


def last_before(df: DataFrame, keys: list[str], order: list[str], block: str, value: str, name: str, include_self: bool = True) -> DataFrame:
    """Adds the last ``value`` that is not null at or before each row (``include_self=False``: before it)."""
    on = [*keys, block]
    frame = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include_self else -1)
    rows = df.withColumn("__in", F.last(value, ignorenulls=True).over(frame))
    tails = df.where(F.col(value).isNotNull()).groupBy(*on).agg(F.max_by(value, F.struct(*order)).alias("__tail"))
    # blocks without a value of their own still need what came before
    blocks = df.select(*on).distinct().join(tails.select(*[F.col(k).alias(f"t_{k}") for k in on], "__tail"), _null_safe(on), "left").drop(*[f"t_{k}" for k in on])
    over = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carry = blocks.select(*[F.col(k).alias(f"__{k}") for k in on], F.last("__tail", ignorenulls=True).over(over).alias("__carry"))
    return _join_carry(rows, carry, on).withColumn(name, F.coalesce("__in", "__carry")).drop("__in", "__carry")


def _null_safe(on: list[str]) -> Column:
    condition = F.lit(True)
    for k in on:
        condition = condition & F.col(k).eqNullSafe(F.col(f"t_{k}"))
    return condition


def running_sum(df: DataFrame, keys: list[str], order: list[str], block: str, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each row (itself not counted)."""
    on = [*keys, block]
    frame = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__in", F.coalesce(F.sum(value).over(frame), F.lit(0)))
    over = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*on).agg(F.sum(value).alias("__total"))
    carry = totals.select(*[F.col(k).alias(f"__{k}") for k in on], F.coalesce(F.sum("__total").over(over), F.lit(0)).alias("__carry"))
    return _join_carry(rows, carry, on).withColumn(name, (F.col("__in") + F.coalesce("__carry", F.lit(0))).cast("long")).drop("__in", "__carry")
