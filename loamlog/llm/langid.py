"""The language of each text and of each segment of a mixed one.

Sentences are classified by sparse multinomial logistic regression on TF-IDF of hashed character
n-grams, trained by follow-the-regularised-leader with elastic-net penalties on a bounded sample of
labelled documents; a temperature fitted on held-out sentences calibrates the confidence. Document
frequencies are counted over all documents. A text's sentences are then read in order: staying in a
language is free, changing it costs ``SWITCH``, so that a sentence with little evidence goes with
its neighbours.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamlog.plans import scratch

# The languages, and how labels spell them.
LABELS = {
    "en": ["en", "eng", "english"], "de": ["de", "deu", "ger", "german", "deutsch"], "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"], "pt": ["pt", "por", "portuguese", "português", "portugues"], "it": ["it", "ita", "italian", "italiano"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands"], "ru": ["ru", "rus", "russian", "русский"],
}
LANGUAGES = list(LABELS)
UNDETERMINED = "und"  # of a text without a word

DOCS_A_LANGUAGE = 250  # the bound of the training sample: labelled documents of each language ...
SENTENCES_A_LANGUAGE = 1000  # ... and of their distinct sentences, those repeated first, the others by hash
BITS = 15
BUCKETS = 1 << BITS
SCALE = 20.0  # brings the features' length near 1
ORDERS = (1, 2, 3, 4)
SWITCH = 2.5
DOUBT = float(np.log(0.5))  # up to here a judge's verdict on a single sentence isn't sure
CACHE = 200_000
CHUNK = 2000  # sentences scored at once
CHARS = 1 << 20  # characters split at once
REPEATS = 8

_FENCE = re.compile(r"^[ \t]*(?:```|~~~)[^\n]*\n.*?(?:^[ \t]*(?:```|~~~)|\Z)", re.S | re.M)
_NOT_PROSE = re.compile(r"^(?:[ \t]*[$%] .*|[ \t]*#{1,6} .*|[ \t]*=+ .* =+[ \t]*|(?:    |\t).*|[ \t]*[\w.\-]+ ?= ?\S+[ \t]*|\[[^\]\n]*\][ \t]*)$", re.M)
_LEAD = re.compile(r"[ \t]*(?:[$%](?: [^\s\-]\S*)*?(?: --?[\w\-]+(?:[ =][^\s\-]\S*)?)+|#{1,6}(?= )|(?:[^\w\s]*\w*[\d_/\\@=<>{}|`]\S*[ \t]*)+)?")
_PLAIN_WORD = re.compile(r"(?<!\S)[\"'(\[«„]*[^\W\d_]+(?:['’\-][^\W\d_]+)*[\"')\]»“,;:.!?…]*(?!\S)")
_CODE = re.compile(r"\w\(|[=!<>+]=|[-=]>|[{}]|;\s*$")
LEAST_WORDS = 6  # of a line that looks like code or a heading, to be read as prose behind its first part
# Classes of characters.
OTHER, BLANK, NEWLINE, LOWER, UPPER, IDENTIFIER, END, JOINT = range(8)
_tables: list[np.ndarray] = []


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point its class, and its lower case (itself where that isn't one character)."""
    if not _tables:
        kind, lower = np.zeros(0x110000, dtype=np.uint8), np.arange(0x110000, dtype=np.uint32)
        kind[0x20000:0x40000] = LOWER  # ideographs
        for code in range(0x20000):
            c = chr(code)
            if c.isalpha():
                kind[code] = UPPER if c.isupper() or c.istitle() else LOWER
                low = c.lower()
                if len(low) == 1:
                    lower[code] = ord(low)
            elif c.isdigit() or c in "_/\\@=<>{}|`":
                kind[code] = IDENTIFIER
            elif c == "\n":
                kind[code] = NEWLINE
            elif c.isspace():
                kind[code] = BLANK
            elif c in ".!?;…":
                kind[code] = END
            elif c in "'’-":
                kind[code] = JOINT
        _tables.extend((kind, lower))
    return _tables[0], _tables[1]


def language(label: Column) -> Column:
    """The two-letter code a label denotes; null for a missing, unknown or foreign one."""
    plain = F.lower(F.trim(label))
    head = F.regexp_extract(plain, r"^([a-z]{2,3})[-_]", 1)
    word = F.when(head != "", head).otherwise(plain)
    out = None
    for code, names in LABELS.items():
        test = word.isin(names)
        out = F.when(test, code) if out is None else out.when(test, code)
    return out


def _salvaged(line: str) -> str:
    """What is prose in a line that begins like a command, code or a heading: the rest behind that
    beginning, if most of it is words."""
    lead = _LEAD.match(line)
    rest = line[lead.end() :]
    if line.lstrip()[:2] in ("$ ", "% ") and "-" not in lead[0]:
        return "\n"  # a command without options: it ends nowhere
    words = 0 if _CODE.search(rest) else len(_PLAIN_WORD.findall(rest))
    return f"\n\n{rest}" if words >= LEAST_WORDS and 2 * words >= len(rest.split()) else "\n"


def _not_prose(found: re.Match) -> str:
    line = found[0]
    return "\n" if len(line) < 40 else _salvaged(line)


def lone(text: str) -> str:
    """The words of a text that has no sentence: of code, headings and names too, but no identifiers."""
    kinds, _ = _characters()
    out = []
    for token in text.split():
        kind = kinds[np.frombuffer(token.encode("utf-32-le", "replace"), dtype=np.uint32)]
        if (kind != IDENTIFIER).all() and ((kind == LOWER) | (kind == UPPER)).any():
            out.append("".join(c if c.isalpha() or c in "'’-" else " " for c in token).strip().lower())
    return " ".join(" ".join(out).split())


def reduce_(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sentences of many texts, reduced to what has a language: code, commands, headings, names
    (capitalised words but the first: which of them are nouns isn't known before the language is),
    numbers and identifiers are left out, and so is a sentence of which one word is left; one in
    capitals is read in lower case. Of a command, a line of code or a heading what follows it on the
    same line is read if it is prose.

    Returns code points in lower case, words parted and sentences enclosed by blanks; the number of
    each code point's sentence; and each sentence's text. All at once, on arrays of characters.
    """
    kinds, lowers = _characters()
    parts = []
    for text in texts:
        if "```" in text or "~~~" in text:
            text = _FENCE.sub("\n\n", text)
        parts.append(_NOT_PROSE.sub(_not_prose, text))
    codes = np.frombuffer(("\n\n" + "\n\n".join(parts) + "\n\n").encode("utf-32-le", "replace"), dtype=np.uint32)
    text_start = np.cumsum([2, *(len(p) + 2 for p in parts)])[:-1]
    kind = kinds[codes]
    space = (kind == BLANK) | (kind == NEWLINE)
    edge = np.diff(space.astype(np.int8))
    start, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1  # of tokens; there is space at both ends
    none = np.zeros(0, dtype=np.int64)
    if not len(start):
        return np.zeros(0, dtype=np.uint32), none, none
    letter = (kind == LOWER) | (kind == UPPER)
    place = np.arange(len(codes))
    far = len(codes)
    # reduceat from a token's start runs on to the next one's; the space between adds nothing
    first = np.minimum.reduceat(np.where(letter, place, far), start)
    last = np.maximum.reduceat(np.where(letter, place, -1), start)
    identifier = np.maximum.reduceat(kind == IDENTIFIER, start)
    any_lower = np.maximum.reduceat(kind == LOWER, start)
    word = (first < far) & ~identifier
    name = word & (kind[np.minimum(first, far - 1)] == UPPER)
    # a sentence begins after an end mark, an empty line, or with a text
    lines = np.cumsum(kind == NEWLINE)
    begins = np.ones(len(start), dtype=bool)
    begins[1:] = (kind[end[:-1] - 1] == END) | (lines[start[1:]] - lines[end[:-1] - 1] >= 2)
    sentence = np.cumsum(begins) - 1
    capitals = np.maximum.reduceat(any_lower, np.flatnonzero(begins)) == 0
    kept = word & (~name | begins | capitals[sentence])
    words = np.bincount(sentence[kept], minlength=sentence[-1] + 1)
    kept &= words[sentence] > 1
    if not kept.any():
        return np.zeros(0, dtype=np.uint32), none, none
    renumber = np.cumsum(words > 1) - 1
    a, b, of = first[kept], last[kept] + 1, renumber[sentence[kept]]
    final = np.append(of[1:] != of[:-1], True)
    # each word with a blank before it, and one after a sentence's last
    size = b - a + 1 + final
    offset = np.cumsum(size) - size
    source = np.repeat(a - 1 - offset, size) + np.arange(size.sum())
    owner = np.repeat(of, size)
    out = lowers[codes[source]]
    out[~(letter | (kind == JOINT))[source]] = 32
    out[offset] = 32
    out[offset[final] + size[final] - 1] = 32
    whose = np.searchsorted(text_start, start[kept][np.flatnonzero(np.append(True, of[1:] != of[:-1]))], "right") - 1
    return out, owner, whose


def sentences(texts: list[str]) -> list[list[str]]:
    """The reduced sentences of each text."""
    codes, owner, whose = reduce_(texts)
    out: list[list[str]] = [[] for _ in texts]
    edges = np.flatnonzero(np.diff(owner)) + 1
    for i, (a, b) in enumerate(zip([0, *edges.tolist()], [*edges.tolist(), len(codes)])):
        if b > a:
            out[whose[i]].append(codes[a + 1 : b - 1].tobytes().decode("utf-32-le"))
    return out


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of sentences enclosed by blanks, and the number of each one's sentence."""
    codes = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), dtype=np.uint32)
    return codes, np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])


def grams(codes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every character n-gram, and the number of its sentence."""
    buckets, owners = [], []
    h = np.zeros(len(codes), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] + codes[n - 1 :]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if n in ORDERS:
            own = owner[: len(h)]
            b = ((h + np.uint32(n)) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
            if n > 1:
                whole = own == owner[n - 1 :]
                b, own = b[whole], own[whole]
            buckets.append(b)
            owners.append(own)
    return np.concatenate(buckets), np.concatenate(owners)


@dataclass
class Model:
    """Weights of n-gram buckets by language, inverse document frequencies and the temperature.

    A text's features are its n-grams' counts times their inverse document frequencies, divided by
    the sum of all of them (and times ``SCALE``), so that scores add up over n-grams."""

    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, n = np.unique(grams(*coded([text]))[0], return_counts=True)
        x = n * self.idf[at]
        return at, x * (SCALE / x.sum())

    def log_probabilities(self, texts: list[str]) -> np.ndarray:
        """A row for each text."""
        codes, owner = coded(texts)
        # a sentence's n-grams of one order lie together: sums over runs
        rows = np.hstack([self.weights * self.idf[:, None], self.idf[:, None]]).astype(np.float32)
        at, owner = grams(codes, owner)
        edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sums = np.zeros((len(texts), rows.shape[1]))
        np.add.at(sums, owner[edges], np.add.reduceat(rows[at], edges, axis=0))
        z = (sums[:, :-1] * (SCALE / sums[:, -1:]) + self.bias) / self.temperature
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _pick(documents: list[tuple[int, list[str]]], most: int) -> list[tuple[str, int, float]]:
    """Distinct sentences with the language they stand under most often, ``most`` of each, and
    their weight: a sentence seen often counts up to ``REPEATS`` times."""
    counts: dict[str, Counter] = {}
    for y, texts in documents:
        for s in texts:
            counts.setdefault(s, Counter())[y] += 1
    out, taken = [], Counter()
    for s, c in sorted(counts.items(), key=lambda x: (x[1].total() < 5, hashlib.md5(x[0].encode()).digest())):
        y = min(c, key=lambda x: (-c[x], x))
        taken[y] += 1
        if taken[y] <= most:
            out.append((s, y, float(min(REPEATS, c.total()))))
    return out


def train(documents: list[tuple[int, list[str]]], idf: np.ndarray) -> Model:
    """A model of documents (language number, sentences) of which some are labelled wrongly or
    mixed.

    Each half of the documents is judged by a model of the other half, held back by its penalties:
    documents it takes for another language are left out, and so are sentences that it surely does.
    """
    kept = []
    for half in (0, 1):
        judge = _ftrl(_pick(documents[half::2], SENTENCES_A_LANGUAGE // 2), idf, epochs=2, alpha=1.0, l2=0.02)
        others = documents[1 - half :: 2]
        distinct = list(dict.fromkeys(s for _, texts in others for s in texts))
        if not distinct:
            continue
        seen = dict(zip(distinct, judge.log_probabilities(distinct)))
        for y, texts in others:
            rows = [seen[s] for s in texts]
            if sum(rows).argmax() == y:
                kept.append((y, [s for s, r in zip(texts, rows) if r.max() < DOUBT or r.argmax() == y]))
    chosen = _pick(kept, SENTENCES_A_LANGUAGE)
    temperature = _ftrl(chosen, idf, epochs=3, alpha=2.0, l2=0.001, held=0.2).temperature
    model = _ftrl(chosen, idf, epochs=3, alpha=2.0, l2=0.001)
    model.temperature = temperature
    return model


def _ftrl(samples: list[tuple[str, int, float]], idf: np.ndarray, epochs: int, alpha: float, l2: float, l1: float = 0.02, beta: float = 1.0, held: float = 0.0) -> Model:
    """Follow-the-regularised-leader (proximal, a rate for each coordinate), elastic-net penalties.

    A share ``held`` of the sentences is kept out, to fit the temperature."""
    k = len(LANGUAGES)
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))
    model = Model(idf, np.zeros((BUCKETS, k)), np.zeros(k))
    rng = np.random.default_rng(7)
    order = rng.permutation(len(samples))
    cut = int(len(samples) * held)
    rows = [(*model.vector(s), y, m) for s, y, m in samples]

    def weights(at: np.ndarray) -> np.ndarray:
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        w[np.abs(z[at]) <= l1] = 0
        return w

    for _ in range(epochs):
        for i in order[cut:]:
            at, x, y, m = rows[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)  # the last coordinate is the bias
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = m * x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    everything = weights(np.arange(BUCKETS + 1))
    model.weights, model.bias = everything[:-1], everything[-1]
    if cut:
        scores = np.array([rows[i][1] @ model.weights[rows[i][0]] + model.bias for i in order[:cut]])
        truth = np.array([rows[i][2] for i in order[:cut]])

        def loss(t: float) -> float:
            s = scores / t
            s = s - s.max(axis=1, keepdims=True)
            return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(cut), truth]).mean())

        model.temperature = float(min(np.geomspace(0.5, 5, 40), key=loss))
    model.weights = model.weights.astype(np.float32)
    return model


PREPARED = "doc_id long, label string, sentences array<string>, bucket array<int>, n array<long>"


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's sentences, of a text without any its :func:`lone` words; at the end of the task one
    row of how many sentences had each bucket."""
    df = np.zeros(BUCKETS + 1, dtype=np.int64)
    names = [c.split()[0] for c in PREPARED.split(", ")]
    none = [pa.list_(pa.int32()), pa.list_(pa.int64())]
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.utf8_length(batch.column(2)), 0))
        chunk = np.cumsum(lengths) // CHARS
        for part in np.split(np.arange(len(lengths)), np.flatnonzero(np.diff(chunk)) + 1):
            part = part[lengths[part] > 0]
            if not len(part):
                continue
            texts = batch.column(2).take(pa.array(part)).to_pylist()
            codes, owner, whose = reduce_(texts)
            counts = np.bincount(whose, minlength=len(texts))
            if len(whose):
                at, own = grams(codes, owner)
                kind = np.uint32 if len(whose) < 1 << (32 - BITS) else np.uint64
                key = np.sort((own.astype(kind) << kind(BITS)) | at.astype(kind))
                df[:BUCKETS] += np.bincount(key[np.append(True, key[1:] != key[:-1])] & kind(BUCKETS - 1), minlength=BUCKETS)
                df[BUCKETS] += len(whose)
                # the sentences as they lie, without the blanks around them
                edges = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                sizes = np.diff(np.append(edges, len(codes)))
                joined = codes.tobytes().decode("utf-32-le")
                found = pa.array([joined[a + 1 : a + n - 1] for a, n in zip(edges.tolist(), sizes.tolist())], pa.string())
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), found)
                take = pa.array(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), lists, *[pa.nulls(len(part), k) for k in none]], names=names).filter(pa.array(counts > 0))
            left = [i for i in np.flatnonzero(counts == 0).tolist() if texts[i].strip()]
            if left:
                take = pa.array(part[left])
                words = [lone(texts[i]) for i in left]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([[w] if w else [] for w in words], pa.list_(pa.string())), *[pa.nulls(len(left), k) for k in none]], names=names)
    at = np.flatnonzero(df)
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.string()), pa.array([None], pa.list_(pa.string())), pa.array([at.tolist()], none[0]), pa.array([df[at].tolist()], none[1])], names=names)


class Prepared:
    """``texts``: (doc_id, label, sentences) of the texts that have a sentence; ``frequencies``:
    how many sentences of the whole corpus have each bucket. Made in one pass and written once."""

    def __init__(self, documents: DataFrame):
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), language(F.col("lang")).alias("label"), "text")
        made = scratch.materialise(rows.mapInArrow(_prepare, PREPARED), "sentences")
        self.texts = made.where("sentences is not null").select("doc_id", "label", "sentences")
        self.frequencies = made.where("bucket is not null").select(F.explode(F.arrays_zip("bucket", "n")).alias("x")).groupBy(F.col("x.bucket").alias("bucket")).agg(F.sum("x.n").alias("n"))


def inverse_frequencies(prepared: Prepared) -> np.ndarray:
    """Of every bucket, over the sentences of all documents. At most ``BUCKETS`` rows come back."""
    df = np.zeros(BUCKETS + 1)
    for r in prepared.frequencies.collect():
        df[r["bucket"]] = r["n"]
    return (np.log((1 + df[BUCKETS]) / (1 + df[:-1])) + 1).astype(np.float32)


def sample(prepared: Prepared, docs_a_language: int = DOCS_A_LANGUAGE) -> list[tuple[int, list[str]]]:
    """(language number, sentences) of at most ``docs_a_language`` labelled documents of each
    language. Which ones is a matter of their ids' hash."""
    labelled = prepared.texts.select("doc_id", "label").where("label is not null and doc_id is not null and size(sentences) > 0")
    # few rows a language and task remain before they are brought together
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.withColumn("k", F.row_number().over(order)).where(F.col("k") <= docs_a_language).select("doc_id", "label").collect()
    ids: dict[int, str] = {r["doc_id"]: r["label"] for r in sorted(chosen, key=lambda r: (LANGUAGES.index(r["label"]), r["doc_id"]))}
    if not ids:
        return []
    found = {r["doc_id"]: r["sentences"] for r in prepared.texts.where(F.col("doc_id").isin(list(ids))).select("doc_id", "sentences").collect()}
    order = sorted(found, key=lambda i: hashlib.md5(str(i).encode()).digest())
    return [(LANGUAGES.index(ids[i]), found[i]) for i in order]


def fit(prepared: Prepared, docs_a_language: int = DOCS_A_LANGUAGE) -> Model | None:
    """None if no document has a label."""
    chosen = sample(prepared, docs_a_language)
    return train(chosen, inverse_frequencies(prepared)) if chosen else None


def segments_of(x: np.ndarray) -> list[tuple[int, float, int]]:
    """(language number, confidence, sentences) of each stretch of sentences, given their log
    probabilities in order."""
    best = x.argmax(axis=1)
    if (best == best[0]).all():
        path = best
    else:
        score, back = x[0].copy(), np.zeros(x.shape, dtype=np.int64)
        stay = np.arange(x.shape[1])
        for i in range(1, len(x)):
            top = int(score.argmax())
            change = score[top] - SWITCH > score
            back[i] = np.where(change, top, stay)
            score = np.where(change, score[top] - SWITCH, score) + x[i]
        path = np.zeros(len(x), dtype=np.int64)
        path[-1] = score.argmax()
        for i in range(len(x) - 1, 0, -1):
            path[i - 1] = back[i][path[i]]
    edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    p = np.exp(x[np.arange(len(x)), path])
    return [(int(path[a]), float(p[a:b].mean()), b - a) for a, b in zip(edges, edges[1:])]


class Scores:
    """Log probabilities of sentences seen before are kept, up to ``CACHE`` of them."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def of(self, texts: list[str]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        new = [t for t in texts if t not in self.known]
        for i in range(0, len(new), CHUNK):
            part = new[i : i + CHUNK]
            self.known.update(zip(part, self.model.log_probabilities(part)))
        return np.array([self.known[t] for t in texts])


def _classify(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scores(model)
        for batch in batches:
            n = pc.list_value_length(batch.column(2))
            bare = batch.filter(pc.equal(n, 0))
            if bare.num_rows:
                k = bare.num_rows
                yield pa.RecordBatch.from_arrays([bare.column(0), bare.column(1), pa.array([0] * k, pa.int32()), pa.array([UNDETERMINED] * k, pa.string()), pa.array([0.0] * k, pa.float64()), pa.array([1] * k, pa.int32())], names=["doc_id", "label", "segment_no", "lang", "confidence", "n_segments"])
                batch = batch.filter(pc.greater(n, 0))
            if not batch.num_rows:
                continue
            texts = batch.column(2)
            coded = texts.flatten().dictionary_encode()
            rows = scores.of(coded.dictionary.to_pylist())
            code = np.asarray(coded.indices)
            x = rows[code]
            ends = np.cumsum(np.asarray(pc.list_value_length(texts)))
            starts = np.append(0, ends[:-1])
            # what changes of language could gain at most in a text; if less than one costs, it has none
            whole = np.add.reduceat(x, starts, axis=0)
            one = whole.argmax(axis=1)
            plain = np.add.reduceat(x.max(axis=1), starts) - whole.max(axis=1) <= SWITCH
            sure = np.add.reduceat(np.exp(x[np.arange(len(x)), np.repeat(one, ends - starts)]), starts) / (ends - starts)
            out = ([], [], [], [], [])
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                found = [(int(one[i]), float(sure[i]), b - a)] if plain[i] else segments_of(x[a:b])
                for j, (lang, confidence, _) in enumerate(found):
                    for column, value in zip(out, (i, j, LANGUAGES[lang], confidence, len(found))):
                        column.append(value)
            take = pa.array(out[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.int32())], names=["doc_id", "label", "segment_no", "lang", "confidence", "n_segments"])

    return run


SEGMENTS = "doc_id long, label string, segment_no int, lang string, confidence double, n_segments int"


def segments(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, label, segment_no, lang, confidence, n_segments) of every text; ``label`` is the
    code the document's own label denotes.

    Null and blank texts give no row. A text that has words but no sentence (a single word, code,
    headings, names) is classified by these; one of numbers and identifiers alone has the language
    ``und`` with confidence 0. A text in a language that isn't one of :data:`LANGUAGES` gets the
    nearest of them. If no document has a label there is nothing to learn from, and the result is
    empty. A repeated row is classified each time.
    """
    prepared = Prepared(documents)
    if model is None:
        model = fit(prepared)
    if model is None:
        return documents.sparkSession.createDataFrame([], SEGMENTS)
    return prepared.texts.mapInArrow(_classify(model), SEGMENTS)


def mislabelled(found: DataFrame) -> DataFrame:
    """The segments of documents whose label is missing, denotes another language than the text,
    or whose text holds several. A text without a word has no language to be labelled with."""
    return found.where(F.col("lang") != UNDETERMINED).where(F.col("label").isNull() | (F.col("n_segments") > 1) | (F.col("label") != F.col("lang")))
