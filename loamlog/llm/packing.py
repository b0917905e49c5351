"""Texts into containers of fixed capacity, by best fit in bulk.

Documents are range-sorted by size. Sizes are whole tokens, so documents of one size are
interchangeable: they are a class with a count, and containers with equal gaps are a run. The classes
of a capacity are spread over lanes, a task each, of at most about ``CLASSES_A_LANE`` classes. A lane
is swept from its largest class down: a class looks up its successor among the gaps (the smallest one
it fits in), fills as many containers of that run as it can at once, the gaps are updated, and so on
until the class is placed; what fits no gap opens containers. Larger documents come first, so they
win conflicts over a gap, and of equal ones the smaller rank. Documents meet their class's places by
their rank in it. What a lane holds has a bound that doesn't grow with the corpus, and a sweep's
steps are in proportion to the lane's classes (and their logarithm).
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamlog.plans import ordered, scratch

RANKS_A_BLOCK = 65536
CLASSES_A_LANE = 65536
MAX_CAPACITIES = 1000


def token_count(text: Column, tokenizer: str | None = None) -> Column:
    """Tokens of a text: bytes of UTF-8 (a byte-level tokenizer's alphabet), or those of the
    tokenizer file at ``tokenizer`` (path of a `tokenizers` JSON file, without special tokens)."""
    if tokenizer is None:
        return F.octet_length(text).cast("long")

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(tokenizer)
        t.encode_special_tokens = True
        known = texts.dropna()
        return pd.Series([len(e.ids) for e in t.encode_batch(known.tolist(), add_special_tokens=False)], index=known.index, dtype="float").reindex(texts.index)

    return count(text)


def pack_classes(capacity: int, sizes, counts) -> list[tuple[int, int, int, int, int]]:
    """Places classes of equal documents: (size, first rank, documents, first container, documents
    a container). Containers are numbered from 0."""
    keys: list[int] = []  # the gaps there are, in order
    runs: dict[int, list[tuple[int, int]]] = {}
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in runs:
                insort(keys, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    for size, left in sorted(zip(sizes, counts), reverse=True):
        rank = 0
        while left:
            at = bisect_left(keys, size)
            if at < len(keys):
                gap = keys[at]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del keys[at], runs[gap]
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // size))
                opened += n
            each = gap // size
            full = min(n, left // each)
            if full:
                out.append((size, rank, full * each, first, each))
                leave(gap - each * size, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # fewer than fill a container
                out.append((size, rank, left, first + full, left))
                leave(gap - left * size, first + full, 1)
                full, left = full + 1, 0
            leave(gap, first + full, n - full)
    return out


def _place(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity = int(pdf["capacity_tokens"].iloc[0])
    rows = pack_classes(capacity, pdf["size"].tolist(), pdf["n"].tolist())
    out = pd.DataFrame(rows, columns=["size", "first_rank", "n", "first_container", "each"]).astype("int64")
    out.insert(0, "capacity_id", pdf["capacity_id"].iloc[0])
    out.insert(1, "lane", pdf["lane"].iloc[0])
    return out


def pack(documents: DataFrame, capacities: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(capacity_id, doc_id, piece_no, n_pieces, n_tokens, container): every text whole in one
    container of each capacity, or, if it exceeds the capacity, in pieces.

    A longer text is cut at multiples of the capacity; its full pieces fill containers of their
    own, the rest is packed like a text. A text that fills a capacity exactly is one piece. Null
    and empty texts take no place and give no row; capacities that are null or below 1 are left
    out; equal sizes are ranked by doc_id; rows of a repeated doc_id are packed each. ``capacities``
    is a settings table of at most ``MAX_CAPACITIES`` rows.
    """
    settings = capacities.select("capacity_id", "capacity_tokens").where("capacity_tokens >= 1").distinct().limit(MAX_CAPACITIES + 1).collect()
    if len(settings) > MAX_CAPACITIES:
        raise ValueError(f"more than {MAX_CAPACITIES} capacities")
    spark = documents.sparkSession
    if not settings:
        return spark.createDataFrame([], "capacity_id int, doc_id long, piece_no int, n_pieces int, n_tokens long, container string")
    sized = scratch.materialise(documents.select("doc_id", token_count(F.col("text"), tokenizer).alias("n")).where("n > 0"), "sizes")
    options = F.array(*[F.struct(F.lit(r["capacity_id"]).alias("capacity_id"), F.lit(r["capacity_tokens"]).cast("long").alias("capacity_tokens")) for r in settings])
    each = sized.select("doc_id", "n", F.explode(options).alias("c")).select("doc_id", "n", "c.*")
    each = each.withColumn("full", F.when(F.col("n") > F.col("capacity_tokens"), F.floor(F.col("n") / F.col("capacity_tokens"))).otherwise(0).cast("int"))
    each = each.withColumn("size", F.col("n") - F.col("full") * F.col("capacity_tokens"))
    each = each.withColumn("n_pieces", (F.col("full") + F.when(F.col("size") > 0, 1).otherwise(0)).cast("int"))

    classes = scratch.materialise(each.where("size > 0").groupBy("capacity_id", "capacity_tokens", "size").agg(F.count("*").alias("n")), "classes")
    lanes = classes.groupBy("capacity_id", "capacity_tokens").agg(F.ceil(F.count("*") / CLASSES_A_LANE).alias("n_lanes"))  # as many rows as capacities
    laned = classes.join(lanes, ["capacity_id", "capacity_tokens"]).withColumn("lane", F.pmod(F.xxhash64("size"), F.col("n_lanes")))
    kind = dict(each.dtypes)["capacity_id"]
    places = scratch.materialise(laned.groupBy("capacity_id", "lane").applyInPandas(_place, f"capacity_id {kind}, lane long, size long, first_rank long, n long, first_container long, each long"), "places")
    # blocks are ranges of the order itself, however ids are spread
    items = ordered.frozen(each.where("size > 0").select("capacity_id", "size", "doc_id", "full", "n_pieces"), ["capacity_id", "size", "doc_id"], "items")
    ranked = ordered.running_sum(items, ["capacity_id", "size"], ["doc_id"], "block", F.lit(1), "rank").drop("block")
    # each document's place is the last one that begins at or before its rank
    here = places.select("capacity_id", "size", F.col("first_rank").alias("rank"), F.lit(0).alias("kind"), F.struct("lane", "first_rank", "first_container", "each").alias("place"))
    blank = F.lit(None)
    here = here.select("*", blank.cast("long").alias("doc_id"), blank.cast("int").alias("full"), blank.cast("int").alias("n_pieces"))
    both = here.unionByName(ranked.select("capacity_id", "size", "rank", F.lit(1).alias("kind"), blank.cast(here.schema["place"].dataType).alias("place"), "doc_id", "full", "n_pieces"))
    met = ordered.last_before(both.withColumn("block", F.floor(F.col("rank") / RANKS_A_BLOCK)), ["capacity_id", "size"], ["rank", "kind"], "block", "place", "at").where("kind = 1")
    number = F.col("at.first_container") + F.floor((F.col("rank") - F.col("at.first_rank")) / F.col("at.each"))
    shared = met.select("capacity_id", "doc_id", F.col("full").alias("piece_no"), "n_pieces", F.col("size").alias("n_tokens"), F.concat_ws("-", F.lit("s"), F.col("at.lane").cast("string"), number.cast("string")).alias("container"))
    whole = each.where("full > 0").select("capacity_id", "doc_id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece_no"), "n_pieces", F.col("capacity_tokens").alias("n_tokens"))
    own = whole.withColumn("container", F.concat_ws("-", F.lit("o"), F.col("doc_id").cast("string"), F.col("piece_no").cast("string")))
    return shared.unionByName(own)


def containers(packed: DataFrame) -> DataFrame:
    """One row a container: pieces and tokens in it."""
    return packed.groupBy("capacity_id", "container").agg(F.count("*").alias("n_pieces"), F.sum("n_tokens").alias("n_tokens"))
