"""Queries of the problems on texts, 7 to 9, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loamlog.llm import langid, leakage, packing
from loamlog.plans import scratch


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _packed(spark, sf):
    return packing.pack(_table(spark, sf, "documents"), _table(spark, sf, "pack_capacities"))


def p7_found(spark, sf):
    return _packed(spark, sf).where("n_pieces > 1").select("capacity_id", "doc_id").distinct()


def p7_placed(spark, sf):
    return _packed(spark, sf)


def p7_fill(spark, sf):
    """How full the containers of each capacity are."""
    full = packing.containers(_packed(spark, sf)).join(_table(spark, sf, "pack_capacities").select("capacity_id", "capacity_tokens"), "capacity_id")
    return full.groupBy("capacity_id").agg(F.count("*").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.sum(F.col("capacity_tokens").cast("long")).alias("n_capacity"))


def p7_whole(spark, sf):
    """For each capacity: texts placed and their tokens, how many came out whole (of a text that fits one
    piece, of a longer one all its pieces), and containers that hold more than their capacity."""
    capacities = _table(spark, sf, "pack_capacities").select("capacity_id", F.col("capacity_tokens").cast("long").alias("capacity_tokens"))
    placed = scratch.materialise(_packed(spark, sf), "placed")
    texts = placed.groupBy("capacity_id", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n"), F.max("n_pieces").alias("n_pieces"))
    sizes = _table(spark, sf, "documents").select("doc_id", packing.token_count(F.col("text")).alias("size"))
    whole = F.count_if((F.col("n_tokens") == F.col("size")) & (F.col("n") == F.col("n_pieces")) & (F.col("n") == F.ceil(F.col("size") / F.col("capacity_tokens"))))
    told = texts.join(sizes, "doc_id").join(capacities, "capacity_id").groupBy("capacity_id").agg(F.count("*").alias("n_texts"), F.sum("n_tokens").alias("n_tokens"), whole.alias("n_whole"))
    over = packing.containers(placed).join(capacities, "capacity_id").groupBy("capacity_id").agg(F.count_if(F.col("n_tokens") > F.col("capacity_tokens")).alias("n_over"), (F.count("*") <= F.ceil(F.sum("n_tokens") / F.max("capacity_tokens") * 1.03) + 1).alias("within_3_percent"))
    return told.join(over, "capacity_id")


def _leaked(spark, sf):
    return leakage.leaked(_table(spark, sf, "documents"), _table(spark, sf, "eval_items"))


def p8_found(spark, sf):
    return leakage.leaked_pairs(_table(spark, sf, "documents"), _table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p8_matches(spark, sf):
    return _leaked(spark, sf)


def p8_clean(spark, sf):
    items, _ = leakage.classes(_table(spark, sf, "eval_items"))
    return leakage.without(_table(spark, sf, "documents").select("doc_id"), leakage.leaked_classes(_table(spark, sf, "documents"), items))


def _segments(spark, sf):
    return langid.segments(_table(spark, sf, "documents"))


def p9_found(spark, sf):
    return langid.mislabelled(_segments(spark, sf)).select("doc_id", "segment_no", "lang")


def p9_segments(spark, sf):
    return _segments(spark, sf)


QUERIES = {f.__name__: f for f in (p7_found, p7_placed, p7_whole, p7_fill, p8_found, p8_matches, p8_clean, p9_found, p9_segments)}

_WORDS = """with e as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from eval_items),
  d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
  eg as (select distinct item_id, array_to_string(w[i:i + 12], ' ') as g from e, unnest(range(1, len(w) - 11)) t(i)),
  found as (select distinct doc_id, item_id from (select doc_id, array_to_string(w[i:i + 12], ' ') as g from d, unnest(range(1, len(w) - 11)) t(i)) join eg using (g))"""

ORACLES = {
    "p7_found": "select capacity_id, doc_id from documents, pack_capacities where octet_length(encode(text)) > capacity_tokens",
    "p7_whole": "select capacity_id, count(*) as n_texts, cast(sum(octet_length(encode(text))) as bigint) as n_tokens, count(*) as n_whole, 0 as n_over, true as within_3_percent from documents, pack_capacities where octet_length(encode(text)) > 0 group by 1",
    "p8_found": _WORDS + " select doc_id, item_id from found",
    "p8_clean": _WORDS + " select doc_id from documents where doc_id not in (select doc_id from found)",
}
