"""Passages of evaluation items in a corpus, by suffix arrays of the corpus.

Each task builds the suffix array of its shard of documents, in words: suffixes are sorted by
prefix doubling. Every suffix of every item is then binary-searched in it; a match of at least
``MIN_WORDS`` words is followed to its end in both directions, which gives the longest verbatim
matches and where they lie. Only suffixes whose first ``MIN_WORDS`` words all occur in some item
are sorted: no other can match. Documents never leave their task.

Items of equal texts are a class of which one is searched for, and documents of equal texts in one
shard are searched once: their members are told when matches are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 13
SHARD_CHARS = 16 << 20
ITEMS_BLOCK_CHARS = 8 << 20  # of items searched for at once
ITEMS_PASS_CHARS = 256 << 20  # of items sent to the executors for one pass over the corpus
HITS_AT_ONCE = 2_000_000
WORD = re.compile(r"[^\W_]+")
NAMES = ["doc_id", "item_id", "doc_word", "item_word", "n_words"]
COLUMNS = "doc_id long, item_id long, doc_word long, item_word long, n_words long"


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return WORD.findall(text.lower())


class Items:
    """Evaluation items as word numbers, each item followed by a separator."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        sequence, item, place = [], [], []
        for i, (_, text) in enumerate(rows):
            w = words(text or "")
            sequence += [self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w]
            item += [i] * (len(w) + 1)
            place += range(len(w) + 1)
            sequence.append(-2)
        self.ids = np.array([r[0] for r in rows], dtype=np.int64)
        self.sequence = np.array(sequence, dtype=np.int64)
        self.item, self.place = np.array(item, dtype=np.int64), np.array(place, dtype=np.int64)


def _starts(sequence: np.ndarray, n: int) -> np.ndarray:
    """Where a run of ``n`` known words begins."""
    if len(sequence) < n:
        return np.zeros(0, dtype=np.int64)
    known = np.concatenate([[0], np.cumsum(sequence >= 0)])
    return np.flatnonzero(known[n:] - known[:-n] == n)


def _ranks(sequence: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the ``n``-word prefixes of the suffixes at ``at``, equal for equal prefixes and in
    their order, by prefix doubling."""
    rank, done = sequence.copy(), 1
    live = np.zeros(len(sequence), dtype=bool)
    for k in range(n):
        live[at + k] = True
    spots = np.flatnonzero(live)
    while done < n:
        step = min(done, n - done)
        ahead = np.minimum(spots + step, len(sequence) - 1)
        key = rank[spots] * (np.int64(rank.max()) + 2) + (rank[ahead] + 1).clip(0)
        fresh = np.full(len(sequence), -1, dtype=np.int64)
        fresh[spots] = np.unique(key, return_inverse=True)[1]
        rank, done = fresh, done + step
    return rank[at]


def matches(documents: list[tuple[int, np.ndarray]], items: Items, n: int = MIN_WORDS) -> list[tuple[int, int, int, int, int]]:
    """Maximal common runs of a shard and the items: (doc_id, item_id, place in the document, place
    in the item, words)."""
    if not documents or not len(items.sequence):
        return []
    lengths = np.array([len(d[1]) + 1 for d in documents])
    shard = np.concatenate([x for d in documents for x in (d[1], [-1])]).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    mine, theirs = _starts(shard, n), _starts(items.sequence, n)
    if not len(mine) or not len(theirs):
        return []
    # the suffixes that count, and what follows them, side by side with the items
    joint = np.concatenate([shard, items.sequence])
    rank = _ranks(joint, np.concatenate([mine, theirs + len(shard)]), n)
    suffixes = np.argsort(rank[: len(mine)], kind="stable")
    array = rank[: len(mine)][suffixes]
    asked = rank[len(mine) :]
    low, high = np.searchsorted(array, asked), np.searchsorted(array, asked, "right")
    hits = high - low
    some = np.flatnonzero(hits)
    out: list[tuple[int, int, int, int, int]] = []
    ids = np.array([d[0] for d in documents])
    # item suffixes in parts whose matches are held at once
    for part in np.split(some, np.flatnonzero(np.diff(np.cumsum(hits[some]) // HITS_AT_ONCE)) + 1):
        if not len(part):
            continue
        k = hits[part]
        q = np.repeat(theirs[part], k)
        offset = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        p = mine[suffixes[np.repeat(low[part], k) + offset]]
        # a match that goes on to the left is part of another one
        before_p = np.where(p > 0, shard[np.maximum(p - 1, 0)], -1)
        before_q = np.where(q > 0, items.sequence[np.maximum(q - 1, 0)], -2)
        first = before_p != before_q
        p, q = p[first], q[first]
        length = np.full(len(p), n)
        going = np.arange(len(p))
        while len(going):
            a, b = p[going] + length[going], q[going] + length[going]
            inside = (a < len(shard)) & (b < len(items.sequence))
            going, a, b = going[inside], a[inside], b[inside]
            equal = (shard[a] == items.sequence[b]) & (shard[a] >= 0)
            going = going[equal]
            length[going] += 1
        doc = np.searchsorted(starts, p, "right") - 1
        out += zip(ids[doc].tolist(), items.ids[items.item[q]].tolist(), (p - starts[doc]).tolist(), items.place[q].tolist(), length.tolist())
    return out


def _search(blocks: list, n: int):
    """``blocks``: broadcast :class:`Items`. A shard is searched for one after the other."""

    def flush(shard: dict[str, list[int]]) -> Iterator[pa.RecordBatch]:
        texts = list(shard)
        split = [words(t) for t in texts]
        for block in blocks:
            items: Items = block.value
            get = items.vocabulary.get
            rows = matches([(i, np.array([get(w, -1) for w in ws], dtype=np.int64)) for i, ws in enumerate(split)], items, n)
            members = [(d, *r[1:]) for r in rows for d in shard[texts[r[0]]]]
            for i in range(0, len(members), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*members[i : i + 100_000])], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: dict[str, list[int]] = {}
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text or doc_id is None:
                    continue
                if text in shard:
                    shard[text].append(doc_id)
                    continue
                shard[text] = [doc_id]
                size += len(text)
                if size >= SHARD_CHARS:
                    yield from flush(shard)
                    shard, size = {}, 0
        yield from flush(shard)

    return run


def classes(eval_items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id, text) of one item of each text, the smallest; and (item_id, member) of all rows."""
    held = eval_items.select("item_id", "text").where("item_id is not null and text is not null")
    first = held.groupBy("text").agg(F.min("item_id").alias("item_id"))
    members = held.join(first.withColumnRenamed("item_id", "first_id"), "text").select(F.col("first_id").alias("item_id"), F.col("item_id").alias("member"))
    return first.select("item_id", "text"), members


def leaked_classes(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words) of items with distinct texts.

    The items are a stated set of queries: they are sent to the executors in blocks of
    ``ITEMS_BLOCK_CHARS`` characters, up to ``ITEMS_PASS_CHARS`` of them for one pass over the corpus.
    """
    spark = documents.sparkSession
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n_blocks = -(-total // ITEMS_BLOCK_CHARS)
    a_pass = max(1, ITEMS_PASS_CHARS // ITEMS_BLOCK_CHARS)
    out = None
    for at in range(0, n_blocks, a_pass):
        sent = []
        for b in range(at, min(at + a_pass, n_blocks)):
            rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == b).collect()
            sent.append(spark.sparkContext.broadcast(Items([(r["item_id"], r["text"]) for r in rows])))
        found = documents.select("doc_id", "text").mapInArrow(_search(sent, min_words), COLUMNS)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], COLUMNS)


def leaked(documents: DataFrame, eval_items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id, doc_word, item_word, n_words): every maximal run of at least ``min_words``
    consecutive words that a document and an item share, with its places counted in words from 0.

    Null and empty texts share nothing, rows without an id are left out; equal items are reported
    each, repeated rows each.
    """
    items, members = classes(eval_items)
    return _of_members(leaked_classes(documents, items, min_words), members)


def _of_members(found: DataFrame, members: DataFrame) -> DataFrame:
    rest = [c for c in found.columns if c not in ("doc_id", "item_id")]
    return found.join(members, "item_id").select("doc_id", F.col("member").alias("item_id"), *rest)


def leaked_pairs(documents: DataFrame, eval_items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The same as :func:`pairs` of :func:`leaked`; classes are paired before their members are told."""
    items, members = classes(eval_items)
    return _of_members(pairs(leaked_classes(documents, items, min_words)), members.distinct())


def pairs(found: DataFrame) -> DataFrame:
    """Each document and item once, with the longest run they share."""
    return found.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("longest"), F.count("*").alias("n_runs"))


def without(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that share no passage."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
