"""The problems on texts: packing, leaked passages, languages."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loamlog.llm import langid, leakage, packing, queries


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Packing


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60), st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=20))
def test_classes_fit_and_none_is_lost(capacity, classes):
    classes = {s: n for s, n in classes.items() if s <= capacity}
    rows = packing.pack_classes(capacity, list(classes), list(classes.values()))
    used, ranks = {}, {}
    for size, rank, n, first, each in rows:
        for i in range(n):
            used[first + i // each] = used.get(first + i // each, 0) + size
            ranks.setdefault(size, []).append(rank + i)
    assert all(v <= capacity for v in used.values())
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in classes.items()}
    # containers are numbered without gaps, and no two of them could be one
    assert set(used) == set(range(len(used)))
    assert sum(sorted(used.values())[:2]) > capacity or len(used) < 2


def test_packing_places_every_text_whole(spark, sf):
    docs = {r["doc_id"]: len((r["text"] or "").encode()) for r in table(spark, sf, "documents").collect()}
    caps = {r["capacity_id"]: r["capacity_tokens"] for r in table(spark, sf, "pack_capacities").collect()}
    rows = queries.p7_placed(spark, sf).collect()
    pieces, used = {}, {}
    for r in rows:
        pieces.setdefault((r["capacity_id"], r["doc_id"]), []).append((r["piece_no"], r["n_tokens"]))
        used.setdefault((r["capacity_id"], r["container"]), []).append(r["n_tokens"])
    assert set(pieces) == {(c, d) for c in caps for d, n in docs.items() if n}
    for (c, d), got in pieces.items():
        assert sum(n for _, n in got) == docs[d] and [p for p, _ in sorted(got)] == list(range(len(got)))
        assert len(got) == -(-docs[d] // caps[c])
    assert all(sum(n) <= caps[c] for (c, _), n in used.items())
    for c, cap in caps.items():
        least = -(-sum(docs.values()) // cap)
        assert sum(k[0] == c for k in used) <= 1.03 * least + 1


def test_packing_at_the_edges(spark):
    docs = spark.createDataFrame([(1, "a" * 10, "x"), (2, "b" * 10, "x"), (3, None, "x"), (4, "", "x"), (5, "é" * 10, None), (6, "c" * 25, "x"), (6, "c" * 25, "x"), (7, "d", "x")], "doc_id long, text string, container string")
    caps = spark.createDataFrame([(1, 10), (2, None), (3, 0), (4, 1000), (1, 10)], "capacity_id int, capacity_tokens int")
    rows = packing.pack(docs, caps).collect()
    ten = sorted((r["doc_id"], r["piece_no"], r["n_pieces"], r["n_tokens"]) for r in rows if r["capacity_id"] == 1)
    assert ten == [(1, 0, 1, 10), (2, 0, 1, 10), (5, 0, 2, 10), (5, 1, 2, 10), *[(6, 0, 3, 10)] * 2, *[(6, 1, 3, 10)] * 2, *[(6, 2, 3, 5)] * 2, (7, 0, 1, 1)]
    assert {r["capacity_id"] for r in rows} == {1, 4}
    assert packing.pack(docs.limit(0), caps).count() == 0 and packing.pack(docs, caps.limit(0)).count() == 0


def test_equal_sizes_share_containers(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), 7).alias("text"))
    caps = spark.createDataFrame([(1, 100)], "capacity_id int, capacity_tokens int")
    full = packing.containers(packing.pack(docs, caps))
    assert full.count() == -(-30_000 // 14) and full.agg(F.max("n_tokens")).first()[0] == 98


def test_a_sweep_is_linear_in_its_classes():
    import time

    took = {}
    for capacity in (50_000, 100_000, 200_000):
        began = time.perf_counter()
        rows = packing.pack_classes(capacity, range(1, capacity + 1), [1] * capacity)
        took[capacity] = time.perf_counter() - began
        containers = max(first + -(-n // each) for _, _, n, first, each in rows)
        assert containers <= 1.03 * (capacity + 1) / 2
    assert took[200_000] < 8 * took[50_000] + 2


def test_lanes_and_sparse_ids(spark, monkeypatch):
    docs = spark.range(6000).select(F.xxhash64("id").alias("doc_id"), F.repeat(F.lit("a"), (F.col("id") % 2000 + 1).cast("int")).alias("text"))
    caps = spark.createDataFrame([(1, 3000), (2, 1500)], "capacity_id int, capacity_tokens int")
    monkeypatch.setattr(packing, "CLASSES_A_LANE", 300)
    rows = packing.pack(docs, caps).collect()
    used, tokens = {}, {}
    for r in rows:
        used[r["capacity_id"], r["container"]] = used.get((r["capacity_id"], r["container"]), 0) + r["n_tokens"]
        tokens[r["capacity_id"], r["doc_id"]] = tokens.get((r["capacity_id"], r["doc_id"]), 0) + r["n_tokens"]
    assert len({c.split("-")[1] for k, c in used if k == 1}) == 7
    assert len(tokens) == 12_000 and sum(used.values()) == 2 * 3 * sum(range(1, 2001))
    for c, capacity in ((1, 3000), (2, 1500)):
        mine = [n for (k, _), n in used.items() if k == c]
        assert max(mine) <= capacity and len(mine) <= 1.03 * sum(mine) / capacity + 1


def test_a_tokenizer_by_path(spark):
    tokenizer = "/opt/tokenizers/byte_bpe_50k.json"
    got = spark.createDataFrame([("hello world",), (None,), ("",)], "t string").select(packing.token_count(F.col("t"), tokenizer).alias("n")).collect()
    assert [r["n"] for r in got] == [2, None, 0]


# Leaked passages


def runs_plain(docs, items, n):
    """The longest common runs by comparing all places."""
    out = set()
    for d, dt in docs:
        a = re.findall(r"[^\W_]+", (dt or "").lower())
        for e, et in items:
            b = re.findall(r"[^\W_]+", (et or "").lower())
            for i in range(len(a)):
                for j in range(len(b)):
                    if a[i] != b[j] or (i and j and a[i - 1] == b[j - 1]):
                        continue
                    k = 0
                    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                        k += 1
                    if k >= n:
                        out.add((d, e, i, j, k))
    return out


letters = st.lists(st.sampled_from("abc"), max_size=14).map(" ".join)


@settings(max_examples=80, deadline=None)
@given(st.lists(letters, max_size=4), st.lists(letters, max_size=3), st.integers(2, 5))
def test_matches_like_plain_comparison(docs, items, n):
    docs, items = list(enumerate(docs)), [(100 + i, t) for i, t in enumerate(items)]
    known = leakage.Items(items)
    shard = [(d, np.array([known.vocabulary.get(w, -1) for w in leakage.words(t)], dtype=np.int64)) for d, t in docs if t]
    got = leakage.matches(shard, known, n)
    assert len(got) == len(set(got)) and set(got) == runs_plain(docs, items, n)


def test_leaks_at_the_edges(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    docs = [(1, f"x {passage.upper().replace(' ', '_-')} y", "c"), (2, " ".join(passage.split()[:12]), "c"), (3, None, "c"), (4, "", "c"), (5, passage + " cut " + passage, "c"), (6, "z " * 50_000 + " ".join(passage.split()[3:17]), "c"), (None, passage, "c"), (5, passage + " cut " + passage, "c")]
    items = [(1, passage), (2, passage + " tail"), (3, None), (4, ""), (5, "short"), (None, passage)]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    e = spark.createDataFrame(items, "item_id long, text string")
    found = leakage.leaked(d, e)
    assert {(r["doc_id"], r["item_id"]): (r["longest"], r["n_runs"]) for r in leakage.pairs(found).collect()} == {(1, 1): (20, 1), (1, 2): (20, 1), (5, 1): (20, 4), (5, 2): (20, 4), (6, 1): (14, 1), (6, 2): (14, 1)}
    assert sorted(r["doc_id"] for r in leakage.without(d.where("doc_id is not null"), found).select("doc_id").collect()) == [2, 3, 4]
    assert leakage.leaked(d, e.limit(0)).count() == 0 and leakage.leaked(d.limit(0), e).count() == 0


def test_leaks_in_blocks_of_items(spark, sf, monkeypatch):
    whole = {tuple(r) for r in queries.p8_matches(spark, sf).collect()}
    monkeypatch.setattr(leakage, "ITEMS_BLOCK_CHARS", 100_000)
    monkeypatch.setattr(leakage, "SHARD_CHARS", 10_000)
    assert {tuple(r) for r in queries.p8_matches(spark, sf).collect()} == whole and whole


def test_copies_are_searched_once_and_told_each(spark, monkeypatch):
    passage = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(i, f"x {passage} y") for i in range(300)] + [(1000, passage)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(i, passage) for i in range(50)] + [(90, passage + " z"), (91, "other")], "item_id long, text string")
    first, members = leakage.classes(items)
    assert leakage.leaked_classes(docs, first).count() == 602 and members.count() == 52
    found = leakage.leaked_pairs(docs, items)
    assert found.count() == 301 * 51 == leakage.leaked(docs, items).count()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, leakage.pairs(leakage.leaked(docs, items)).select(*found.columns).collect()))
    whole = sorted(map(tuple, leakage.leaked(docs, items).collect()))
    for name, n in (("HITS_AT_ONCE", 10), ("ITEMS_BLOCK_CHARS", 60), ("ITEMS_PASS_CHARS", 60)):
        monkeypatch.setattr(leakage, name, n)
        assert sorted(map(tuple, leakage.leaked(docs, items).collect())) == whole


# Languages

SAMPLES = {
    "en": ["the server reads every sealed segment before the cursor moves", "nothing was lost during the night"],
    "de": ["der Knoten verzögert die gemerkte Liste bevor der Zeiger über alle hinausgeht", "es ging nichts verloren in der Nacht"],
    "fr": ["le serveur lit chaque segment scellé avant que le curseur ne dépasse la fin", "rien n'a été perdu pendant la nuit"],
}


def test_sentences_keep_what_has_a_language():
    text = "# Title-1\n\nThe ingester Foo-12 reads more than 55 files. Ask the team that owns Bar.\n\n```\ncode = here\nmore code\n```\n$ lakectl run --now\n- second point is\n  wrapped here; THIS IS ALL LOUD.\n> quoted words follow\nName."
    assert langid.sentences([text, "", "Only", "x y"]) == [
        ["the ingester reads more than files", "ask the team that owns", "second point is wrapped here", "this is all loud", "quoted words follow"], [], [], ["x y"],
    ]


def test_prose_behind_code_is_read():
    prose = "Der Knoten hält die gemerkte Liste fest und verwirft sie erst nach dem nächsten Lauf"
    read = "der hält die gemerkte fest und verwirft sie erst nach dem nächsten"
    for lead in ("$ lakectl run --shard 62 ", "    5f25bd610f7285da 0xaf77b42d 19/19 ", "```\ncode = 1\n``` ", "% tool -v --level=3 "):
        assert langid.sentences([f"One more of them.\n{lead}{prose}."])[0] == ["one more of them", read], lead
    for line in ("$ lakectl run the compactor over all of the shards again", "    if x == y: return f(x) or g(y) and h(z)", "    result = call(one, two, three, four, five, six)", "# Notes on Segments", "```\nall of this is code here and it is long enough\n```"):
        assert langid.sentences([f"One more of them.\n\n{line}"])[0] == ["one more of them"], line


def test_every_text_gets_a_language(spark):
    rows = [(k * 100 + i, ". ".join([*texts, f"{texts[i % 2]} {texts[i // 2 % 2]}"]) + ".", lang) for k, (lang, texts) in enumerate(SAMPLES.items()) for i in range(40)]
    odd = {900: "\tder Knoten verzögert die Liste\n\tbevor der Zeiger", 901: "Zeiger", 902: "# Der Knoten\n# Die Liste", 903: "12345 0x7f a_b", 904: "```\nrien n'a été perdu\n```", 905: " \n\t"}
    docs = spark.createDataFrame([*rows, *[(k, v, None) for k, v in odd.items()]], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["lang"], r["confidence"]) for r in langid.segments(docs).where("doc_id >= 900").collect()}
    assert set(got) == {900, 901, 902, 903, 904} and got[903] == ("und", 0.0)
    assert got[900][0] == "de" and got[904][0] == "fr" and all(0 < got[k][1] <= 1 for k in got if k != 903)
    assert {r["doc_id"] for r in langid.mislabelled(langid.segments(docs)).collect()} >= {900, 904} and 903 not in {r["doc_id"] for r in langid.mislabelled(langid.segments(docs)).collect()}


def test_segments_follow_the_evidence():
    en, de = np.log([0.98, 0.02]), np.log([0.02, 0.98])
    unsure = np.log([0.4, 0.6])
    path = lambda rows: [(a, n) for a, _, n in langid.segments_of(np.array(rows))]
    assert path([en, en, unsure, en]) == [(0, 4)]
    assert path([en, en, de, de, en]) == [(0, 2), (1, 2), (0, 1)]


def test_held_out_accuracy(spark, sf):
    """Documents the training never saw, whose label the whole text's function words confirm."""
    docs = table(spark, sf.replace("sf0.001", "sf0.01"), "documents")
    held = docs.where("doc_id % 3 = 0")
    prepared = langid.Prepared(docs.where("doc_id % 3 <> 0"))
    model = langid.fit(prepared, 60)
    rows = langid.segments(held, model).where("label is not null and n_segments = 1").collect()
    right = sum(r["label"] == r["lang"] for r in rows) / len(rows)
    # about one label in fifteen is wrong by design
    assert len(rows) > 200 and right > 0.9
    assert min(r["confidence"] for r in rows) > 0.3 and all(r["confidence"] <= 1 for r in rows)


def test_wrong_and_mixed_labels_are_found(spark):
    rows, n = [], 0
    for lang, texts in SAMPLES.items():
        for i in range(40):
            n += 1
            rows.append((n, ". ".join([texts[0], texts[1], f"{texts[i % 2]} {texts[(i + 1) % 2]}"]) + ".", lang, "clash"))
    join = lambda *langs: ".\n\n".join(". ".join(SAMPLES[x]) for x in langs) + "."
    rows += [(900, join("de"), "english", None), (901, join("fr"), None, None), (902, join("en", "de", "en"), "en", None), (903, None, None, None), (904, "  \n ", "", None), (905, "12345 0x7f", "und", None), (906, join("en"), "n/a", None), (907, join("fr"), "fr-CA", None), (908, join("de") * 3000, "xx", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, label string")
    got = {}
    for r in langid.mislabelled(langid.segments(docs)).collect():
        got.setdefault(r["doc_id"], {})[r["segment_no"]] = r["lang"]
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {900: ["de"], 901: ["fr"], 902: ["en", "de", "en"], 906: ["en"], 908: ["de"]}
    assert langid.segments(docs.limit(0)).count() == 0
    assert langid.segments(docs.where("doc_id = 901")).count() == 0  # nothing to learn from


@pytest.mark.parametrize(("label", "code"), [("EN", "en"), ("de-AT", "de"), ("Spanish", "es"), ("pt_BR", "pt"), (" nld ", "nl"), ("und", None), ("", None), (None, None), ("sv", None)])
def test_labels(spark, label, code):
    assert spark.createDataFrame([(label,)], "x string").select(langid.language(F.col("x"))).first()[0] == code
