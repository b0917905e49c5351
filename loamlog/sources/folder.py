"""Folders of Parquet files as tables."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def listing(spark: SparkSession, folder: str, glob: str = "*.parquet") -> DataFrame:
    """(path, n_bytes, modified) of the files below a folder, at any depth. Nothing is read of them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"))


def parquet_folder(spark: SparkSession, folder: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The rows of all Parquet files below a folder, at any depth. Columns that a file lacks are null;
    without a schema it is merged from the files' own. A folder without files needs a schema."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return reader.schema(schema).parquet(folder) if schema is not None else reader.option("mergeSchema", "true").parquet(folder)


def packed(files: Iterable[tuple[str, int]], n: int) -> list[list[str]]:
    """Files in at most ``n`` parts of about equal size: the heaviest first, each to the lightest part,
    ties by name and by the part's number."""
    parts: list[list[str]] = [[] for _ in range(n)]
    heap = [(0, i) for i in range(n)]
    for name, size in sorted(files, key=lambda f: (-f[1], f[0])):
        weight, i = heapq.heappop(heap)
        parts[i].append(name)
        heapq.heappush(heap, (weight + size, i))
    return [p for p in parts if p]


def fnv1a(text: str) -> int:
    """The 64-bit hash that says which shard a path belongs to. Its offset and prime."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def shard(spark: SparkSession, paths: Iterable[str], index: int, count: int, schema: T.StructType | str) -> DataFrame:
    """The rows of the files a shard owns, by the hash of their paths; the shards together are all
    rows, each once. Only owned files are opened; a shard may own none."""
    if not 0 <= index < count:
        raise ValueError("a shard's index must be below the count")
    mine = [p for p in paths if fnv1a(p) % count == index]
    return spark.read.schema(schema).parquet(*mine) if mine else spark.createDataFrame([], schema)
