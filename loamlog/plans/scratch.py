"""Tables written once and read again, in the folder all executors share.

They cut lineage and freeze values that must not change between two reads. A lost executor costs
a task, never the table: the files are in the folder of ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []
_own_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only in local mode with none set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="loamlog-"))
        atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
    return f"file://{_own_root[0]}"


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_root(spark)}/loamlog-{uuid.uuid4().hex}/{tag}"
    _made.append((spark, path))
    return path


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def drop_scratch() -> None:
    """Deletes every table made here. Call it when no result that reads one is needed any more."""
    while _made:
        spark, path = _made.pop()
        try:
            drop_path(spark, path.rsplit("/", 1)[0])
        except Exception:  # the session may be gone
            pass


atexit.register(drop_scratch)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, tag: str, **tests: Column) -> tuple[DataFrame, dict[str, int]]:
    """The same, with the number of rows for which each of the tests holds, counted on the way."""
    seen = Observation()
    out = materialise(df.observe(seen, *[F.count_if(t).alias(name) for name, t in tests.items()]), tag)
    return out, seen.get


def forget(old: DataFrame) -> None:
    """Deletes a table made by :func:`materialise` that nothing reads any more."""
    for path in {p.rsplit("/", 1)[0] for p in old.inputFiles()}:
        if "/loamlog-" in path:
            drop_path(old.sparkSession, path)


def replaced(old: DataFrame, new: DataFrame, tag: str) -> DataFrame:
    """Writes ``new`` and deletes ``old``, a table made by :func:`materialise` that nothing else
    reads: what a loop leaves behind doesn't pile up."""
    out = materialise(new, tag)
    forget(old)
    return out
