"""Log and trace views over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _hex(n: Column, width: int) -> Column:
    return F.lpad(F.lower(F.hex(n)), width, "0")


def logs(events: DataFrame) -> DataFrame:
    """Canonical log events: timestamp, host, source, sourcetype, index, raw, timestamp_ns, attributes."""
    time = F.col("ts").cast("timestamp")
    user = F.col("user_id").cast("string")
    return events.select(
        time.alias("timestamp"),
        F.concat(F.lit("host-"), (F.col("user_id") % 16).cast("string")).alias("host"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("source"),
        F.col("event_type").alias("sourcetype"),
        F.lit("main").alias("index"),
        F.concat(F.lit("user="), user, F.lit(" type="), "event_type", F.lit(' path="/e/'), F.col("event_id").cast("string"), F.lit('"')).alias("raw"),
        (F.unix_micros(time) * 1000).alias("timestamp_ns"),
        F.col("props").alias("attributes"),
    )


def traces(events: DataFrame) -> DataFrame:
    """Spans: a user's events are one trace, an event is a span under the user's first one."""
    time = F.col("ts").cast("timestamp")
    return events.select(
        time.alias("timestamp"),
        _hex(F.col("user_id"), 32).alias("trace_id"),
        _hex(F.col("event_id"), 16).alias("span_id"),
        F.lit(None).cast("string").alias("parent_span_id"),
        F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("service"),
        F.col("event_type").alias("name"),
        F.lit("SPAN_KIND_SERVER").alias("kind"),
        F.when(F.col("event_type") == "error", "STATUS_CODE_ERROR").otherwise("STATUS_CODE_UNSET").alias("status_code"),
        F.round(F.col("value") * 1000000).cast("long").alias("duration_nanos"),
        (F.unix_micros(time) * 1000).alias("timestamp_ns"),
        F.col("props").alias("attributes"),
    )
