"""Templates of log entries by longest common subsequences.

Entries are tokenised, and entries of equal tokens are one pattern with a count. Patterns are
clustered in one pass, those of most entries first: a pattern joins the template it shares the longest
common subsequence with, if that is at least half of its tokens, and what isn't common becomes a
variable slot. The rule is the same for any number of patterns, and their order depends on them alone,
so templates don't depend on how entries are spread over tasks, nor on other entries that share
nothing with them. Each slot is classified by the kinds of the values that stood in it.
"""

from __future__ import annotations

import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamlog.operators.loglines import COLOUR
from loamlog.plans import scratch

SLOT = "<*>"
SHARE = 0.5
MANY = 16  # templates of a word from which on they are compared all at once
SHARD = 4000  # so many patterns are read and written at a time
# Kinds of tokens, the first that fits.
KINDS = [
    ("time", r"(?:\d{4}[-/]\d\d[-/]\d\d)?[T ]?\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?|\d\d/[A-Z][a-z]{2}/\d{4}(?::\d\d){3}"),
    ("date", r"\d{4}[-/]\d\d[-/]\d\d"),
    ("address", r"\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?"),
    ("number", r"[+-]?\d+(?:\.\d+)?"),
    ("level", r"(?i:trace|debug|info|notice|warn|warning|error|err|fatal|critical|crit|alert|emerg|panic|log)"),
    ("measure", r"\d+(?:\.\d+)?(?:ns|us|ms|s|m|h|kb|mb|gb|%)"),
    ("hex", r"(?:0x)?(?=[0-9a-f]*\d)[0-9a-f]{6,}"),
    ("path", r"(?:/?(?:[\w.\-]+/)+[\w.\-]*|[\w\-]+(?:\.[\w\-]+)+)(?::\d+)*|\w+(?:::\w+)+"),
    ("word", r"[^\W\d_]+"),
]
_DIGIT = re.compile(r"\d")
_KIND = re.compile("|".join(rf"(?P<{k}>(?:{p})\Z)" for k, p in KINDS))
_TYPED = re.compile(r"<(\w+)>\Z")
_TOKEN = re.compile(r"\d{4}[-/]\d\d[-/]\d\d[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?|\d\d/[A-Z][a-z]{2}/\d{4}(?::\d\d){3}|\d\d:\d\d:\d\d(?:[.,]\d+)?|[\w./:\-]*\w|\S")


def kind_of(token: str) -> str:
    found = _KIND.match(token)
    return found.lastgroup if found else "text"


def tokens_of(text: str) -> list[str]:
    """The text's tokens; those with a digit are values by their form alone, and slots already."""
    out = []
    for token in _TOKEN.findall(text):
        out.append(token if token.isalpha() or not _DIGIT.search(token) else f"<{kind_of(token)}>")
    return out


def common(a: list[str], b: list[str]) -> list[str]:
    """The longest common subsequence, slots not counted."""
    m, n = len(a), len(b)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m - 1, -1, -1):
        row, below, x = best[i], best[i + 1], a[i]
        for j in range(n - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == b[j] and x != SLOT else below[j] if below[j] >= row[j + 1] else row[j + 1]
    out, i, j = [], 0, 0
    while i < m and j < n:
        if a[i] == b[j] and a[i] != SLOT:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def merge(a: list[str], b: list[str]) -> list[str]:
    """The template of both: what is common, with a slot wherever either has more."""
    out: list[str] = []
    i = j = 0
    for token in [*common(a, b), None]:
        gap = False
        while i < len(a) and a[i] != token:
            i, gap = i + 1, True
        while j < len(b) and b[j] != token:
            j, gap = j + 1, True
        if gap and out[-1:] != [SLOT]:
            out.append(SLOT)
        if token is not None:
            out.append(token)
            i, j = i + 1, j + 1
    return out


def covers(blocks: list[list[str]], tokens: list[str]) -> bool:
    """Whether the template of these constant blocks, slots in between, already covers the text."""
    at, last = 0, len(blocks) - 1
    for n, block in enumerate(blocks):
        size = len(block)
        if n == 0:  # the text begins with the first block, which is empty if a slot comes first
            if tokens[:size] != block:
                return False
            at = size
            if n == last:
                return at == len(tokens)
        elif n == last:
            return len(tokens) - size >= at and tokens[len(tokens) - size :] == block
        else:
            while at + size <= len(tokens) and tokens[at : at + size] != block:
                at += 1
            if at + size > len(tokens):
                return False
            at += size
    return True


def values_of(blocks: list[list[str]], tokens: list[str]) -> list[list[str]]:
    """The tokens in each slot between the blocks of a template that covers the text."""
    out, at, last = [], len(blocks[0]), len(blocks) - 1
    for n, block in enumerate(blocks[1:], 1):
        end, size = at, len(block)
        if n == last:
            end = len(tokens) - size
        else:
            while tokens[end : end + size] != block:
                end += 1
                if end > len(tokens):
                    raise ValueError(f"no template of this text: {blocks}, {tokens}")
        out.append(tokens[at:end])
        at = end + size
    return out


class Template:
    def __init__(self, tokens: list[str]):
        self.tokens = tokens
        self.blocks: list[list[str]] = [[]]
        for t in tokens:
            if t == SLOT:
                self.blocks.append([])
            else:
                self.blocks[-1].append(t)
        constants = [t for t in tokens if t != SLOT]
        self.size, self.counts, self.all = len(constants), Counter(constants), (1 << len(constants)) - 1
        self.bits: dict[str, int] = {}
        for n, t in enumerate(constants):
            self.bits[t] = self.bits.get(t, 0) | 1 << n

    def shared(self, tokens: list[str]) -> int:
        """The length of the longest common subsequence, its rows held as bits."""
        row, get = self.all, self.bits.get
        for t in tokens:
            at = get(t)
            if at:
                hit = row & at
                row = ((row + hit) | (row - hit)) & self.all
        return self.size - row.bit_count()


class Clusters:
    """Templates found so far, with an index of all their constants: candidates are those that may
    share enough tokens with the text, wherever they stand, met by its rarest words first."""

    def __init__(self):
        self.templates: list[Template] = []
        self.index: dict[str, set[int]] = {}
        self.wide: set[int] = set()  # those of over 64 constants
        self.arrays: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.sizes, self.where = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.changed: list[int] = []
        self.seen: dict[tuple, tuple[int, int]] = {}
        self.empty: int | None = None

    def name(self, place: int) -> str:
        return " ".join(self.templates[place].tokens)

    def add(self, tokens: list[str]) -> int:
        """Where the text's template is kept."""
        # words that no template has can't be shared: texts that differ in these only go together
        key = tuple([t if t in self.index else None for t in tokens])
        place = self._known(key, tokens) if tokens else self.empty
        if place is None:
            place, covered = self._choose(tokens)
            if place < 0:
                place = len(self.templates)
                self._put(place, list(tokens))
                if not tokens:
                    self.empty = place
            elif not covered:
                self._put(place, merge(self.templates[place].tokens, tokens))
            else:
                if len(self.seen) > 200_000:  # a cache: forgetting it changes no template
                    self.seen.clear()
                self.seen[key] = place, len(self.changed)
        return place

    def _known(self, key: tuple, tokens: list[str]) -> int | None:
        """The choice made for the same key, unless a template changed since could be chosen now."""
        place, since = self.seen.get(key, (-1, 0))
        if place < 0 or len(self.changed) - since > 50:
            return None
        if since < len(self.changed):
            most = self.templates[place].size
            for n in set(self.changed[since:]):
                t = self.templates[n]
                if n == place or t.size >= most and t.shared(tokens) >= most:
                    return None
            self.seen[key] = place, len(self.changed)
        return place

    def _put(self, place: int, tokens: list[str]) -> None:
        if place == len(self.templates):
            self.templates.append(Template(tokens))
        else:
            for word in self.templates[place].counts:
                self.arrays.pop(word, None)
                self.index[word].remove(place)
                if not self.index[word]:
                    del self.index[word]
            self.templates[place] = Template(tokens)
        if place >= len(self.sizes):
            self.sizes, self.where = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sizes, self.where))
        self.sizes[place] = size = self.templates[place].size
        (self.wide.add if size > 64 else self.wide.discard)(place)
        for word in self.templates[place].counts:
            self.arrays.pop(word, None)
            self.index.setdefault(word, set()).add(place)
        self.changed.append(place)

    def _choose(self, tokens: list[str]) -> tuple[int, bool]:
        """The template with the longest common subsequence, and whether it covers the text already:
        among equals one that does, then the oldest. (-1, False): none shares enough."""
        chosen, best, least = -1, (0, False), SHARE * len(tokens)
        index, counts, met, left = self.index, Counter(tokens), set(), len(tokens)
        words = sorted(counts, key=lambda w: len(index.get(w, ())))
        for at, word in enumerate(words):
            if left < least:
                break  # templates with none of the words so far can't share enough
            places = index.get(word, ())
            many = len(places) > MANY
            if many:  # all that may share enough by this word or those after it, at once
                found_by = []
                for w in words[at:]:
                    if left < least:
                        break
                    found_by.append(w)
                    left -= counts[w]
                places = self._longest(found_by, tokens, least)
            for n in places:
                if n in met:
                    continue
                met.add(n)
                t = self.templates[n]
                if t.size < least:
                    continue
                length = t.shared(tokens)
                if length < max(least, SHARE * t.size):
                    continue
                found = length, length == t.size and covers(t.blocks, tokens)
                if found > best or found == best and n < chosen:
                    chosen, best, least = n, found, length
            if many:
                break
            left -= counts[word]
        return chosen, best[1]

    def _postings(self, word: str) -> tuple[np.ndarray, np.ndarray]:
        """The templates with the word, and the bits of its places in each."""
        found = self.arrays.get(word)
        if found is None:
            places = np.array([n for n in self.index.get(word, ()) if self.templates[n].size <= 64], np.int64)
            found = self.arrays[word] = places, np.array([self.templates[n].bits[word] for n in places], np.uint64)
        return found

    def _longest(self, words: list[str], tokens: list[str], least: float) -> list[int]:
        """Of the templates with any of the words, those that share the most tokens, if at least
        ``least`` and enough: ``shared`` of all at once. Templates of over 64 constants are all given."""
        wide = [n for n in self.wide if not self.templates[n].counts.keys().isdisjoint(words)]
        places = np.unique(np.concatenate([self._postings(w)[0] for w in words]))
        sizes = self.sizes[places]
        fits = (sizes >= least) & (SHARE * sizes <= len(tokens))
        places, sizes = places[fits], sizes[fits]
        if not len(places):
            return wide
        self.where[places] = np.arange(len(places))
        hits = {}
        for w in set(tokens):
            if w in self.index:
                of, bits = self._postings(w)
                at = self.where[of]
                known = places[at] == of
                hits[w] = np.zeros(len(places), np.uint64)
                hits[w][at[known]] = bits[known]
        self.where[places] = 0
        row = every = np.uint64(2**64 - 1) >> (64 - sizes).astype(np.uint64)
        for t in tokens:
            if t in hits:
                hit = row & hits[t]
                row = ((row + hit) | (row - hit)) & every
        lengths = sizes - np.bitwise_count(row)
        lengths[lengths < np.maximum(least, SHARE * sizes)] = -1
        most = lengths.max()
        return wide + (places[lengths == most].tolist() if most >= 0 else [])


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    colour = re.compile(COLOUR)
    for batch in batches:
        texts = [(colour.sub("", t) if "\x1b" in t else t) if t else "" for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(tokens_of(t)) for t in texts], pa.string())], names=["event_id", "pattern"])


def _placed(batches: Iterator[pa.RecordBatch], shard: int) -> Iterator[pa.RecordBatch]:
    """(pattern, place) of each pattern in the order given, then (place, template) of each template."""
    clusters, schema = Clusters(), pa.schema([("pattern", pa.string()), ("place", pa.int64()), ("template", pa.string())])

    def rows(patterns: list, places: list, names: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((patterns, places, names), schema)], schema=schema)

    for batch in batches:
        for start in range(0, batch.num_rows, shard):
            patterns = batch.column(0).slice(start, shard).to_pylist()
            places = [clusters.add([sys.intern(t) for t in p.split(" ")] if p else []) for p in patterns]
            yield rows(patterns, places, [None] * len(places))
    for start in range(0, len(clusters.templates), shard):
        places = list(range(start, min(start + shard, len(clusters.templates))))
        yield rows([None] * len(places), places, [clusters.name(n) for n in places])


def clustered(patterns: DataFrame, shard: int = SHARD) -> DataFrame:
    """(pattern, template) of (pattern, n).

    However many patterns there are, one pass takes them in their order, those of most entries first:
    which template a pattern joins depends on those before it, so the pass is one task's. It holds the
    templates, not the patterns, which come sorted and go on ``shard`` at a time; no template depends
    on ``shard``.
    """
    order = patterns.repartition(1).sortWithinPartitions(F.desc("n"), "pattern").select("pattern")
    found = scratch.materialise(order.mapInArrow(lambda batches: _placed(batches, shard), "pattern string, place long, template string"), "clustered")
    names = found.where("pattern is null").select("place", "template")
    return found.where("pattern is not null").select("pattern", "place").join(names, "place").select("pattern", "template")


def _kind_of_value(value: list[str]) -> str:
    """One token's kind; "text" if there are more, "empty" if there is none."""
    if len(value) != 1:
        return "text" if value else "empty"
    typed = _TYPED.match(value[0])
    return typed.group(1) if typed else kind_of(value[0])


def _count_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(template, slot, kind, n) of (template, pattern, n); slot -1 counts the entries."""
    counts: dict[str, Counter] = defaultdict(Counter)
    known: dict[str, Template] = {}

    def rows() -> pa.RecordBatch:
        out = []
        for name, found in counts.items():
            tokens = known[name].tokens
            slots = [n for n, t in enumerate(tokens) if t == SLOT or _TYPED.match(t)]
            mined = [k for k, n in enumerate(slots) if tokens[n] == SLOT]
            entries = found.pop((-1, ""))
            out.append((name, -1, "", entries))
            out += [(name, k, tokens[n][1:-1], entries) for k, n in enumerate(slots) if tokens[n] != SLOT]
            out += [(name, mined[k], kind, n) for (k, kind), n in found.items()]
        counts.clear()
        known.clear()
        columns = zip(*out) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["template", "slot", "kind", "n"])

    for batch in batches:
        for name, pattern, n in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            template = known.get(name)
            if template is None:
                if len(known) > 50_000:  # what is counted so far is added up later
                    yield rows()
                template = known[name] = Template(name.split(" ") if name else [])
            found = counts[name]
            found[-1, ""] += n
            if len(template.blocks) > 1:
                for k, value in enumerate(values_of(template.blocks, pattern.split(" ") if pattern else [])):
                    found[k, _kind_of_value(value)] += n
    yield rows()


def _summary(placed: DataFrame) -> DataFrame:
    """(template, n_entries, slots, kinds) of (template, pattern, n)."""
    counts = placed.mapInArrow(_count_kinds, "template string, slot int, kind string, n long").groupBy("template", "slot", "kind").agg(F.sum("n").alias("n"))
    found = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "kind", "n")))
    slots = counts.groupBy("template", "slot").agg(found.alias("found"), F.sum("n").alias("n"))
    kinds = F.filter(F.transform("found", lambda x: x["kind"]), lambda k: k != "empty")
    # a word is text like another: only the kinds with a form of their own name a slot
    kind = F.when(F.size(kinds) == 0, "empty").when((F.size(kinds) == 1) & (kinds[0] != "word"), kinds[0]).otherwise("text")
    listed = F.array_join(F.transform("found", lambda x: F.concat(x["kind"], F.lit(":"), x["n"].cast("string"))), "|")
    all_slots = F.array_sort(F.collect_list(F.when(F.col("slot") >= 0, F.struct("slot", kind.alias("kind"), listed.alias("listed")))))
    join = lambda field: F.array_join(F.transform("all", lambda x: x[field]), ",").alias(field)
    return slots.groupBy("template").agg(F.max(F.when(F.col("slot") < 0, F.col("n"))).alias("n_entries"), all_slots.alias("all")).select("template", "n_entries", join("kind").alias("slots"), join("listed").alias("kinds"))


def mine(entries: DataFrame, text: str = "raw", shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(event_id, template) of every entry, and (template, n_entries, slots, kinds) of every template.

    ``slots``: the kind all values of a slot have; "text" if they are words or differ. ``kinds``:
    what stood in each slot, as kind:entries, the most frequent first. A null or empty text has the
    empty template. A text's pattern is met by its value, so a pattern that many entries share is
    counted in its tasks first and its entries stay where they are where the patterns are few.
    """
    local = scratch.materialise(entries.select("event_id", text).mapInArrow(_patterns, "event_id long, pattern string"), "patterns")
    patterns = scratch.materialise(local.groupBy("pattern").agg(F.count("*").alias("n")), "distinct")
    merged = clustered(patterns, shard)
    return local.join(merged, "pattern").select("event_id", "template"), _summary(patterns.join(merged, "pattern").select("template", "pattern", "n"))
