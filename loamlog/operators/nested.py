"""Nested export requests into linked flat tables, by vectorised structural indexing.

A batch of bodies is one byte buffer. Bitmaps of quotes, brackets and delimiters give the
structural tokens outside strings; prefix sums of the brackets give each token's depth; sorting the
tokens by depth and position puts each container's members behind it. Levels are then walked from
the root, all bodies at once, and every element of a known array becomes a row that knows its
parent. Work is linear in the bytes but for one sort of the tokens; a task holds one chunk of
bodies at a time (``CHUNK`` bytes, or a single longer body).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamlog.plans import scratch

CHUNK = 4 << 20

# The message's array and object members, in both spellings, and what each leads to.
ROLES = ["root", "resources", "resource_entry", "resource", "scopes", "scope_entry", "scope", "records", "record", "body", "attributes", "pair", "value", "array", "array_values", "kvlist", "kvlist_values"]
MEMBERS = [
    ("root", "resourceLogs", "resources"), ("root", "resource_logs", "resources"),
    ("resource_entry", "resource", "resource"),
    ("resource_entry", "scopeLogs", "scopes"), ("resource_entry", "scope_logs", "scopes"),
    ("resource", "attributes", "attributes"),
    ("scope_entry", "scope", "scope"),
    ("scope_entry", "logRecords", "records"), ("scope_entry", "log_records", "records"),
    ("scope", "attributes", "attributes"),
    ("record", "attributes", "attributes"),
    ("record", "body", "body"),
    ("pair", "value", "value"),
    ("value", "arrayValue", "array"), ("value", "array_value", "array"),
    ("value", "kvlistValue", "kvlist"), ("value", "kvlist_value", "kvlist"),
    ("array", "values", "array_values"), ("kvlist", "values", "kvlist_values"),
]
ELEMENTS = {"resources": ("resource_entry", "r"), "scopes": ("scope_entry", "s"), "records": ("record", "l"), "attributes": ("pair", "a"), "array_values": ("value", "v"), "kvlist_values": ("pair", "k")}

_ID = {r: i for i, r in enumerate(ROLES)}
_ARRAYS = np.array([r in ELEMENTS for r in ROLES])
_ELEMENT = np.array([_ID[ELEMENTS[r][0]] if r in ELEMENTS else -1 for r in ROLES])
_LETTERS = pa.array([ELEMENTS[r][1] if r in ELEMENTS else "" for r in ROLES])
_KEYS = {k: i for i, k in enumerate(dict.fromkeys(k for _, k, _ in MEMBERS))}
_STEP = np.full((len(ROLES), len(_KEYS) + 1), -1)
for _p, _k, _c in MEMBERS:
    _STEP[_ID[_p], _KEYS[_k]] = _ID[_c]

# Scalar members that are kept with their element, and the column each goes to.
SCALARS = [
    ("resource", "droppedAttributesCount", "dropped_attributes"), ("resource", "dropped_attributes_count", "dropped_attributes"),
    ("scope", "name", "scope_name"), ("scope", "version", "scope_version"), ("scope_entry", "schemaUrl", "schemaUrl"), ("scope_entry", "schema_url", "schema_url"),
    ("record", "timeUnixNano", "timeUnixNano"), ("record", "time_unix_nano", "time_unix_nano"), ("record", "severityNumber", "severityNumber"), ("record", "severity_number", "severity_number"),
    ("record", "severityText", "severityText"), ("record", "severity_text", "severity_text"), ("record", "traceId", "traceId"), ("record", "trace_id", "trace_id"), ("record", "spanId", "spanId"), ("record", "span_id", "span_id"),
    ("record", "body", "body"), ("body", "stringValue", "body_string"), ("body", "string_value", "body_string"), ("pair", "key", "attr_key"),
    *[("value", spelled, f"{k}_value") for k in ("string", "int", "double", "bool", "bytes") for spelled in (f"{k}Value", f"{k}_value")],
    *[("value", spelled, f"has_{k}") for k in ("array", "kvlist") for spelled in (f"{k}Value", f"{k}_value")],
]
PRESENCE = ("has_array", "has_kvlist")  # only whether they are there

_BLANKS = re.compile(r'("(?:[^"\\]|\\.)*")|\s+')
_SCALAR = re.compile(rb"(?:-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)\Z")
_FIELD_KEYS = {k: i for i, k in enumerate(dict.fromkeys(k for _, k, _ in SCALARS))}
FIELDS = list(dict.fromkeys(f for _, _, f in SCALARS))
_FIELD = np.full((len(ROLES), len(_FIELD_KEYS) + 1), -1)
_FIELD_NAMES = [f for _, _, f in SCALARS]
for _i, (_p, _k, _) in enumerate(SCALARS):
    _FIELD[_ID[_p], _FIELD_KEYS[_k]] = _i
_PRESENCE = {i for i, f in enumerate(_FIELD_NAMES) if f in PRESENCE}
OPEN_O, CLOSE_O, OPEN_A, CLOSE_A, COLON, COMMA, STRING, SCALAR, START = range(9)


class Index:
    """The structural tokens of a chunk of bodies, and which bodies are complete."""

    def __init__(self, bodies: list[bytes]):
        self.data = b"\n".join(bodies) + b"\n"
        buf = self.buf = np.frombuffer(self.data, dtype=np.uint8)
        self.starts = np.cumsum([0, *(len(b) + 1 for b in bodies)])[:-1].astype(np.int64)
        ends = self.starts + np.array([len(b) for b in bodies], dtype=np.int64)
        n = len(buf)
        place = np.arange(n, dtype=np.int64)
        back = buf == 92
        quote = buf == 34
        if back.any():
            plain = np.maximum.accumulate(np.where(back, -1, place))
            at = np.flatnonzero(quote)
            run = np.where(at > 0, at - 1 - plain[np.maximum(at - 1, 0)], 0)
            quote[at[run % 2 == 1]] = False
        count = np.cumsum(quote)
        doc = np.zeros(n, dtype=np.int64)
        doc[self.starts[1:]] = 1
        doc = np.cumsum(doc)
        base = np.where(self.starts > 0, count[np.maximum(self.starts - 1, 0)], 0)
        inside = (count - base[doc]) & 1 == 1  # from an opening quote up to before its closing one
        opens = quote & inside
        closes = quote & ~inside
        kinds = np.full(256, -1, dtype=np.int8)
        for c, k in ((123, OPEN_O), (125, CLOSE_O), (91, OPEN_A), (93, CLOSE_A), (58, COLON), (44, COMMA)):
            kinds[c] = k
        kind = kinds[buf]
        kind[inside | closes] = -1
        kind[opens] = STRING
        blank = (buf == 32) | (buf == 9) | (buf == 10) | (buf == 13)
        other = (kind < 0) & ~inside & ~closes & ~blank
        kind[other & ~np.concatenate([[False], other[:-1]])] = SCALAR
        pos = np.flatnonzero(kind >= 0)
        kind = kind[pos].astype(np.int64)
        doc = doc[pos]
        end = pos + 1
        strings = kind == STRING
        close_at = np.flatnonzero(closes)
        if strings.any():
            at = np.searchsorted(close_at, pos[strings])
            end[strings] = np.where(at < len(close_at), close_at[np.minimum(at, len(close_at) - 1)] + 1, n) if len(close_at) else n
        scalars = kind == SCALAR
        stop = np.flatnonzero(~other)
        end[scalars] = stop[np.searchsorted(stop, pos[scalars])]
        quotes = np.bincount(np.searchsorted(self.starts, np.flatnonzero(quote), "right") - 1, minlength=len(bodies))
        good = (quotes % 2 == 0) & (ends > self.starts)

        step = np.where((kind == OPEN_O) | (kind == OPEN_A), 1, np.where((kind == CLOSE_O) | (kind == CLOSE_A), -1, 0))
        first = np.searchsorted(doc, np.arange(len(bodies)))
        after = np.searchsorted(doc, np.arange(len(bodies)), "right")
        total = np.concatenate([[0], np.cumsum(step)])
        depth = total[1:] - total[first][doc] if len(doc) else total[1:]
        some = after > first
        good &= some
        low = np.ones(len(bodies), dtype=np.int64)
        np.minimum.at(low, doc, np.where(np.arange(len(pos)) == after[doc] - 1, 1, depth))
        last = np.minimum(np.maximum(after - 1, 0), max(len(pos) - 1, 0))
        if len(pos):
            good &= (depth[last] == 0) & (low > 0) & (kind[np.minimum(first, len(pos) - 1)] == OPEN_O)
        keep = good[doc]
        self.pos, self.end, self.kind, self.doc = pos[keep], end[keep], kind[keep], doc[keep]
        self.level = depth[keep] - (step[keep] == 1)  # how many containers a token, or the container it closes, lies in
        self.good = good
        self.closing: tuple[np.ndarray, np.ndarray] | None = None
        self._members()
        self._grammar()

    def _members(self) -> None:
        """Puts members behind their containers and finds each one's container, index and key."""
        n = len(self.pos)
        opening = (self.kind == OPEN_O) | (self.kind == OPEN_A)
        closing = (self.kind == CLOSE_O) | (self.kind == CLOSE_A)
        heads = np.flatnonzero(opening)
        rest = np.flatnonzero(~closing)
        token = np.concatenate([rest, heads, np.flatnonzero(closing)])
        head = np.zeros(len(token), dtype=bool)
        head[len(rest) : len(rest) + len(heads)] = True
        closed = np.zeros(len(token), dtype=bool)
        closed[len(rest) + len(heads) :] = True
        # a container's head and its closing token stand one level deeper than the container does
        level = self.level[token] + head + closed
        order = np.argsort(level * np.int64(n + 1) + token, kind="stable")
        token, head, closed, level = token[order], head[order], closed[order], level[order]
        spot = np.arange(len(token))
        owner = np.maximum.accumulate(np.where(head | (level == 0), spot, 0))
        kind = np.where(head, START, self.kind[token])
        commas = np.cumsum(kind == COMMA)
        self.seq_token, self.seq_kind, self.seq_level, self.seq_head = token, kind, level, head
        self.seq_container = np.where(level == 0, -1, token[owner])
        self.seq_index = commas - commas[owner] if len(token) else commas
        self.seq_closed = closed

    def _grammar(self) -> None:
        """Finds bodies whose tokens don't follow one another as JSON wants."""
        kind, n = self.seq_kind, len(self.seq_kind)
        if not n:
            return
        before = np.concatenate([[START], kind[:-1]])
        before2 = np.concatenate([[START, START], kind[:-2]])
        value = (kind == OPEN_O) | (kind == OPEN_A) | (kind == STRING) | (kind == SCALAR)
        was_value = (before == OPEN_O) | (before == OPEN_A) | (before == STRING) | (before == SCALAR)
        in_object = self.kind[np.maximum(self.seq_container, 0)] == OPEN_O
        is_key = in_object & (kind == STRING) & ((before == START) | (before == COMMA))
        was_key = np.concatenate([[False], is_key[:-1]])
        ok = np.ones(n, dtype=bool)
        ok &= ~(value & in_object & ~is_key) | (before == COLON)
        ok &= ~(value & ~in_object) | (before == START) | (before == COMMA)
        ok &= ~(kind == COLON) | (in_object & was_key)
        ok &= ~(kind == COMMA) | (was_value & ~was_key)
        ok &= ~self.seq_closed | (before == START) | (was_value & ~was_key)
        ok &= ~self.seq_closed | np.where(in_object, kind == CLOSE_O, kind == CLOSE_A)
        ok |= self.seq_head
        ok[self.seq_level == 0] = True
        bad = set(np.unique(self.doc[self.seq_token[~ok]]))
        outer = np.bincount(self.doc[self.seq_token[(self.seq_level == 0)]], minlength=len(self.good))
        bad |= set(np.flatnonzero(outer > 1))
        scalars = np.flatnonzero(self.kind == SCALAR)
        # plain whole numbers are right; the others are looked at, each spelling once
        begin, end = self.pos[scalars], self.end[scalars]
        digit = np.concatenate([[0], np.cumsum((self.buf >= 48) & (self.buf <= 57))])
        whole = (digit[end] - digit[begin] == end - begin) & ((self.buf[begin] != 48) | (end - begin == 1))
        texts: dict[bytes, bool] = {}
        for t in scalars[~whole].tolist():
            s = self.data[self.pos[t] : self.end[t]]
            right = texts.get(s)
            if right is None:
                right = texts[s] = _SCALAR.match(s) is not None
            if not right:
                bad.add(int(self.doc[t]))
        self.good[list(bad)] = False
        self.value = value & ~self.seq_head & ~is_key & self.good[self.doc[self.seq_token]]
        self.key_of = np.where((before == COLON) & (before2 == STRING), np.concatenate([[0, 0], self.seq_token[:-2]]), -1)


def _keys(x: Index, tokens: np.ndarray, known: dict[str, int]) -> np.ndarray:
    """The number of each key token's name, ``len(known)`` for others and where there is no key (-1).
    Names are compared byte by byte, all tokens of one length at once."""
    out = np.full(len(tokens), len(known))
    has = np.flatnonzero(tokens >= 0)
    begin = x.pos[tokens[has]] + 1
    size = x.end[tokens[has]] - 1 - begin
    by_size: dict[int, list[tuple[bytes, int]]] = {}
    for name, number in known.items():
        by_size.setdefault(len(name), []).append((name.encode(), number))
    for n, names in by_size.items():
        at = np.flatnonzero(size == n)
        if not len(at):
            continue
        text = x.buf[begin[at][:, None] + np.arange(n)]
        for name, number in names:
            hit = (text == np.frombuffer(name, dtype=np.uint8)).all(axis=1)
            out[has[at[hit]]] = number
    return out


def _last_of_each(*columns: np.ndarray) -> np.ndarray:
    """Whether a row is the last one with its values."""
    order = np.lexsort((np.arange(len(columns[0])), *columns[::-1]))
    last = np.ones(len(order), dtype=bool)
    if len(order) > 1:
        same = np.ones(len(order) - 1, dtype=bool)
        for c in columns:
            same &= c[order[1:]] == c[order[:-1]]
        last[:-1] = ~same
    out = np.zeros(len(order), dtype=bool)
    out[order] = last
    return out


def _text(x: Index, t: int) -> str | None:
    """A value as text: strings without their quotes and escapes, null as none, containers as JSON
    without blanks."""
    if x.kind[t] in (OPEN_O, OPEN_A):
        end = int(_span_ends(x, np.array([t]))[0])
        return _BLANKS.sub(r"\1", x.data[x.pos[t] : end].decode("utf-8", "replace"))
    raw = x.data[x.pos[t] : x.end[t]]
    if x.kind[t] == STRING:
        if b"\\" not in raw:
            return raw[1:-1].decode("utf-8", "replace")
        try:
            return json.loads(raw, strict=False).encode("utf-8", "replace").decode()
        except ValueError:
            return None
    return None if raw == b"null" else raw.decode("utf-8", "replace")


def nodes(bodies: list[bytes], members: bool = True) -> tuple[np.ndarray, pa.Array, dict[str, list]]:
    """The chunk's rows: the number of each one's body, its path, and, with ``members``, parent path,
    step, index and scalar members."""
    x = Index(bodies)
    bodies_, paths_, parents_, steps_, indexes_ = [], [], [], [], []
    n_rows = 0
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (row, field, token) of scalar members
    at = np.flatnonzero(x.value) if len(x.pos) else np.zeros(0, dtype=np.int64)
    token, container, index, level = (x.seq_token[at], x.seq_container[at], x.seq_index[at], x.seq_level[at]) if len(at) else (at,) * 4
    key = _keys(x, x.key_of[at], _KEYS) if len(at) else at
    field = _keys(x, x.key_of[at], _FIELD_KEYS) if len(at) and members else key
    role = np.full(len(x.pos), -1)
    row = np.full(len(x.pos), -1)  # the row a container belongs to
    # rows in the order of their levels, so that a row's parent is there before it
    all_paths = pa.array([""], pa.string())  # path 0 is the root's
    for depth in range(int(level.max(initial=-1)) + 1):
        now = np.flatnonzero(level == depth)
        if depth == 0:
            role[token[now[x.kind[token[now]] == OPEN_O]]] = _ID["root"]
            continue
        parent = container[now]
        known = role[parent] >= 0
        now, parent = now[known], parent[known]
        if not len(now):
            break
        array = _ARRAYS[role[parent]]
        # members of objects: of those that lead to the same place the last one counts
        m, mp = now[~array], parent[~array]
        to = _STEP[role[mp], key[m]]
        named = np.flatnonzero(to >= 0)
        only = named[_last_of_each(mp[named], to[named])]
        only = only[x.kind[token[m[only]]] == np.where(_ARRAYS[to[only]], OPEN_A, OPEN_O)]
        role[token[m[only]]] = to[only]
        row[token[m[only]]] = row[mp[only]]
        if members:
            f = _FIELD[role[mp], field[m]]
            some = np.flatnonzero((f >= 0) & (row[mp] >= 0))
            some = some[_last_of_each(mp[some], f[some])]
            found.append((row[mp[some]], f[some], token[m[some]]))
        # elements of arrays
        e, ep = now[array], parent[array]
        if not len(e):
            continue
        kinds, t = role[ep], token[e]
        above = all_paths.take(pa.array(row[ep] + 1))
        step = pc.binary_join_element_wise(_LETTERS.take(pa.array(kinds)), pc.cast(pa.array(index[e]), pa.string()), "")
        paths = pc.if_else(pa.array(row[ep] < 0), step, pc.binary_join_element_wise(above, step, "/"))
        row[t] = n_rows + np.arange(len(e))
        n_rows += len(e)
        all_paths = pa.concat_arrays([all_paths, paths])
        objects = x.kind[t] == OPEN_O
        role[t[objects]] = _ELEMENT[kinds[objects]]
        bodies_.append(x.doc[t])
        paths_.append(paths)
        if members:
            parents_.append(pc.if_else(pa.array(row[ep] < 0), pa.scalar(None, pa.string()), above))
            steps_.append(_LETTERS.take(pa.array(kinds)))
            indexes_.append(index[e])
    more: dict[str, list] = {}
    whose = np.concatenate(bodies_) if bodies_ else np.zeros(0, dtype=np.int64)
    if members:
        columns = {name: [None] * n_rows for name in FIELDS}
        for rows, fields, tokens in found:
            for f in np.unique(fields)[::-1].tolist():  # of two spellings the first, unless it is null
                column, at = columns[_FIELD_NAMES[f]], fields == f
                for r, t in zip(rows[at].tolist(), tokens[at].tolist()):
                    value = (True if x.kind[t] != SCALAR else None) if f in _PRESENCE else _text(x, t)
                    if value is not None:
                        column[r] = value
        more = {"parent_path": parents_, "step": steps_, "element_no": indexes_, **columns}
    return whose, pa.concat_arrays(paths_) if paths_ else pa.array([], pa.string()), more


def _span_ends(x: Index, tokens: np.ndarray) -> np.ndarray:
    """Where each value ends: containers at their closing token."""
    end = x.end[tokens].copy()
    box = np.flatnonzero((x.kind[tokens] == OPEN_O) | (x.kind[tokens] == OPEN_A))
    if len(box):
        if x.closing is None:
            owner, close = x.seq_container[x.seq_closed], x.seq_token[x.seq_closed]
            order = np.argsort(owner)
            x.closing = owner[order], close[order]
        owner, close = x.closing
        end[box] = x.end[close[np.searchsorted(owner, tokens[box])]]
    return end


def _flatten(id_column: str, members: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = batch.column(0), [b if b is None else b.encode() for b in batch.column(1).to_pylist()]
            lo = 0
            while lo < len(bodies):
                hi, size = lo, 0
                while hi < len(bodies) and (hi == lo or size + len(bodies[hi] or b"") <= CHUNK):
                    size += len(bodies[hi] or b"")
                    hi += 1
                chosen = np.array([i for i in range(lo, hi) if bodies[i]], dtype=np.int64)
                lo = hi
                if not len(chosen):
                    continue
                whose, paths, more = nodes([bodies[i] for i in chosen.tolist()], members)
                if not len(whose):
                    continue
                columns, names = [ids.take(pa.array(chosen[whose])), paths], [id_column, "node_path"]
                if members:
                    columns += [pa.concat_arrays(more["parent_path"]), pa.concat_arrays(more["step"]), pa.array(np.concatenate(more["element_no"]), pa.int32())]
                    columns += [pa.array(more[f], pa.bool_() if f in PRESENCE else pa.string()) for f in FIELDS]
                    names += ["parent_path", "step", "element_no", *FIELDS]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def flatten_exports(df: DataFrame, id_column: str = "export_id", body: str = "body", spans: bool = True) -> DataFrame:
    """One row for each element of the request's arrays, with its path and its parent's.

    A null body, an empty one, or one that isn't complete JSON gives no row; null, empty or wrongly
    typed members are arrays without elements; a null element is a row; of a member stated twice
    the last counts. With ``spans`` also the parent's path, the step, the index and the element's own
    scalar members (:data:`FIELDS`); no element's text is repeated in the rows it lies in. Other
    columns of ``df`` are not read.
    """
    schema = T.StructType([T.StructField(id_column, df.schema[id_column].dataType), T.StructField("node_path", T.StringType())])
    if spans:
        schema = schema.add("parent_path", "string").add("step", "string").add("element_no", "integer")
        for f in FIELDS:
            schema = schema.add(f, "boolean" if f in PRESENCE else "string")
    return df.select(id_column, body).mapInArrow(_flatten(id_column, spans), schema)


def flat_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The four tables (resources, scopes, records, attributes), linked by export_id and path, of one
    pass over the requests: their rows are written once, a folder a step."""
    spark = df.sparkSession
    path = scratch.new_path(spark, "nodes")
    rows = flatten_exports(df)
    rows.write.partitionBy("step").option("compression", "zstd").parquet(path)
    back = spark.read.schema(rows.schema).parquet(path)
    return {"resources": resources(back), "scopes": scopes(back), "records": records(back), "attributes": attributes(back)}


def resources(nodes_: DataFrame) -> DataFrame:
    """Resource rows: their key is (export_id, node_path)."""
    return nodes_.where("step = 'r'").select("export_id", "node_path", F.coalesce(F.col("dropped_attributes").try_cast("long"), F.lit(0)).alias("dropped_attributes"))


def scopes(nodes_: DataFrame) -> DataFrame:
    return nodes_.where("step = 's'").select("export_id", "node_path", "parent_path", "scope_name", "scope_version", F.coalesce("schemaUrl", "schema_url").alias("schema_url"))


def records(nodes_: DataFrame) -> DataFrame:
    return nodes_.where("step = 'l'").select(
        "export_id", "node_path", "parent_path",
        F.coalesce("timeUnixNano", "time_unix_nano").try_cast("long").alias("time_ns"),
        F.coalesce("severityNumber", "severity_number").try_cast("int").alias("severity_number"),
        F.coalesce("severityText", "severity_text").alias("severity_text"),
        F.coalesce("body_string", "body").alias("body_text"),
        F.coalesce("traceId", "trace_id").alias("trace_id"),
        F.coalesce("spanId", "span_id").alias("span_id"),
    )


def attributes(nodes_: DataFrame) -> DataFrame:
    """Attribute and nested value rows: key, kind of value and its text (null for containers)."""
    kinds = ["string", "int", "double", "bool", "bytes"]
    kind = F.coalesce(*[F.when(F.col(f"{k}_value").isNotNull(), F.lit(k)) for k in kinds], F.when(F.col("has_array"), F.lit("array")), F.when(F.col("has_kvlist"), F.lit("kvlist")), F.lit("empty"))
    return nodes_.where("step in ('a', 'v', 'k')").select("export_id", "node_path", "parent_path", "element_no", F.when(F.col("step") != "v", F.col("attr_key")).alias("attr_key"), kind.alias("value_kind"), F.coalesce(*[f"{k}_value" for k in kinds]).alias("value_text"))
