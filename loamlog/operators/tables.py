"""Table functions over logs, histograms and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamlog.functions.text import date_bin

DIMENSIONS = ("host", "source", "sourcetype", "index")


def last_values(logs: DataFrame) -> DataFrame:
    """The newest row of each (host, source, sourcetype, index); of equal times the greatest raw."""
    newest = F.max_by(F.struct("timestamp", "timestamp_ns", "raw"), F.struct("timestamp_ns", "raw"))
    return logs.groupBy(*DIMENSIONS).agg(newest.alias("x")).select(*DIMENSIONS, "x.*")


def distinct_values(logs: DataFrame, dimension: str) -> DataFrame:
    """The values of one of the four dimensions, as the column ``value``."""
    if dimension not in DIMENSIONS:
        raise ValueError(f"distinct_values takes one of {', '.join(DIMENSIONS)}")
    return logs.select(F.col(dimension).alias("value")).distinct()


def register(spark: SparkSession, view: str) -> None:
    """The same as SQL table functions over the view."""
    keys = ", ".join(f"`{d}`" for d in DIMENSIONS)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION last_values() RETURNS TABLE (host STRING, source STRING, sourcetype STRING, `index` STRING, `timestamp` TIMESTAMP, raw STRING)
      RETURN SELECT host, source, sourcetype, `index`, x.`timestamp`, x.raw FROM (SELECT {keys}, max_by(struct(`timestamp`, raw), struct(timestamp_ns, raw)) AS x FROM {view} GROUP BY {keys})""")
    cases = " ".join(f"WHEN '{d}' THEN `{d}`" for d in DIMENSIONS)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION distinct_values(dim STRING) RETURNS TABLE (value STRING)
      RETURN SELECT DISTINCT CASE dim {cases} ELSE raise_error(concat('no dimension ', dim)) END FROM {view}""")


def integer_average(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The mean of whole numbers from their exact sum and non-null count, with ``exact``: whether the
    sum of absolute values stays within 2^53, so that summing doubles in any order gives the same."""
    whole = F.sum(F.col(column).cast("decimal(38,0)"))
    parts = df.groupBy(*keys).agg(whole.alias("__s"), F.count(column).alias("__n"), F.sum(F.abs(F.col(column).cast("decimal(38,0)"))).alias("__a"))
    return parts.select(*keys, (F.col("__s").cast("double") / F.nullif(F.col("__n"), F.lit(0))).alias("mean"), F.col("__n").alias("n"), F.coalesce(F.col("__a") <= F.lit(2**53), F.lit(True)).alias("exact"))


def date_histogram(df: DataFrame, time: str, interval_us: int) -> DataFrame:
    """Rows of each bin of time: (bucket_us, n). Bins lie around 1970, also before it."""
    return df.groupBy(F.unix_micros(date_bin(interval_us, F.col(time))).alias("bucket_us")).agg(F.count("*").alias("n"))


def within(time: Column, start_us: int | None, end_us: int | None) -> Column:
    """A half-open window: from ``start_us`` on, before ``end_us``."""
    micros = F.unix_micros(time.cast("timestamp"))
    test = F.lit(True)
    if start_us is not None:
        test = test & (micros >= start_us)
    if end_us is not None:
        test = test & (micros < end_us)
    return test


def range_join(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, width: int, on: tuple[str, ...] = ()) -> DataFrame:
    """Points with the intervals they lie in: start <= point < end, all whole numbers, and equal ``on``.

    Both sides meet by buckets of ``width``: an interval is listed in each bucket it touches, a point in
    its own, so no pair is tried whose buckets differ and none is found twice. A width near the
    intervals' usual length lists each about twice. Null bounds or points, and empty intervals, meet
    nothing. Columns of one name beside ``on`` must not be on both sides.
    """
    if width <= 0:
        raise ValueError("a bucket must be wider than nothing")
    bucket = lambda c: F.floor(c / F.lit(width))
    listed = intervals.where(F.col(start) < F.col(end)).withColumn("__bucket", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end) - 1))))
    placed = points.where(F.col(point).isNotNull()).withColumn("__bucket", bucket(F.col(point)))
    return placed.join(listed, [*on, "__bucket"]).where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("__bucket")


def shard(df: DataFrame, index: int, count: int) -> DataFrame:
    """The rows of the files a shard owns; the shards together are the table."""
    if not 0 <= index < count:
        raise ValueError("a shard's index must be below the count")
    return df.where(F.pmod(F.xxhash64(F.col("_metadata.file_path")), F.lit(count)) == index)


NEEDLE_EVERY, PHRASE_EVERY = 997, 1009


def corpus(spark: SparkSession, n: int, seed: int = 7, start_us: int = 1_760_000_000_000_000, step_us: int = 250_000, rich: bool = False) -> DataFrame:
    """Generated log events; each is a function of its number and the seed alone.

    With ``rich``, an event has 48 attributes, every ``NEEDLE_EVERY``th one a rare token of its own
    (needle and its number) and every ``PHRASE_EVERY``th one the words "quiet harbour lights"."""
    pick = lambda salt, k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(k))
    slot = pick("kind", 100)
    status = F.element_at(F.array(*[F.lit(s) for s in ("200", "204", "301", "404", "500")]), (pick("status", 5) + 1).cast("int"))
    web = F.concat(F.lit("GET /item/"), pick("item", 1000).cast("string"), F.lit(" status="), status, F.lit(" ms="), pick("ms", 900).cast("string"))
    api = F.concat(F.lit("api call=list_"), pick("call", 20).cast("string"), F.lit(" tenant=t"), pick("tenant", 8).cast("string"), F.lit(' note="ok then"'))
    auth = F.concat(F.lit("login user=u"), pick("user", 500).cast("string"), F.lit(" result="), F.when(pick("ok", 10) > 0, "ok").otherwise("denied"))
    micros = F.lit(start_us) + F.col("id") * step_us
    members = [pick("code", 600).alias("code"), F.concat(F.lit("r"), pick("region", 4).cast("string")).alias("region")]
    if rich:
        members += [(pick(f"m{i}", 10 ** (i % 5 + 1)) if i % 3 else F.concat(F.lit(f"v{i}-"), pick(f"m{i}", 50).cast("string"))).alias(f"attr_{i:02d}") for i in range(46)]
    attributes = F.to_json(F.struct(*members))
    tail = F.concat(F.when(F.col("id") % NEEDLE_EVERY == 5, F.concat(F.lit(" needle"), F.col("id").cast("string"))).otherwise(""), F.when(F.col("id") % PHRASE_EVERY == 9, " quiet harbour lights").otherwise("")) if rich else F.lit("")
    return spark.range(n).select(
        F.timestamp_micros(micros).alias("timestamp"), F.concat(F.lit("host-"), pick("host", 16).cast("string")).alias("host"),
        F.when(slot < 60, "web").when(slot < 95, "api").otherwise("auth").alias("source"), F.when(slot < 60, "access").when(slot < 95, "service").otherwise("security").alias("sourcetype"),
        F.lit("main").alias("index"), F.concat(F.when(slot < 60, web).when(slot < 95, api).otherwise(auth), tail).alias("raw"), (micros * 1000).alias("timestamp_ns"), attributes.alias("attributes"),
    )
