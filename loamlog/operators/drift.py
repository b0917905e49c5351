"""Schemas that drift between files.

Ingestion enforces a target schema. A field the target lacks, or whose value can't be cast to the
target's type, is kept as JSON in a rescue column; approved fields are promoted to columns and the
values already rescued are replayed into them.

The report of changes is made of the rescue column of an ingestion whose target, for each file, is
the schema of the file before it in its series. What was rescued as unknown is a new field, unless
replaying it fills a column that went missing with the very value that one had: then that field was
renamed. What was rescued as uncastable changed its type, and columns that stay missing were removed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamlog.plans import ordered, scratch

def _kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "integer"
    if isinstance(v, float):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def _same(v):
    """Equal JSON values get equal forms: 1.0 is 1."""
    if isinstance(v, dict):
        return {k: _same(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_same(x) for x in v]
    if isinstance(v, float) and v.is_integer():
        return int(v)
    return v


def _write(v) -> str:
    return json.dumps(_same(v), sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def _escape(key: str) -> str:
    """A key as one part of a path: ~ is ~0, / is ~1, and an empty key ~2."""
    return key.replace("~", "~0").replace("/", "~1") or "~2"


def _unescape(part: str) -> str:
    return "" if part == "~2" else part.replace("~1", "/").replace("~0", "~")


def _fields(text: str, escape: bool = False) -> list[tuple[str, str, str, str]] | None:
    """(path, parent, kind, canonical value) of every object member; None if it's no JSON object.
    An object's value is its whole text, so that a renamed object is found as one field."""
    try:
        root = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(root, dict):
        return None
    out, stack = [], [("", root)]
    while stack:
        parent, members = stack.pop()
        for key, value in members.items():
            key = _escape(key) if escape else key
            path = f"{parent}/{key}" if parent else key
            out.append((path, parent, _kind(value), _write(value)))
            if isinstance(value, dict):
                stack.append((path, value))
    return out


def _strings(values: list) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # half of a surrogate pair
        return pa.array([v if v is None else v.encode("utf-8", "replace").decode() for v in values], pa.string())


def _join(parent: str, key: str) -> str:
    return f"{parent}/{_escape(key)}" if parent else _escape(key)


def _plain(path: str) -> str:
    """A path as it is reported: keys as they are."""
    return "/".join(_unescape(p) for p in path.split("/"))


def _nulls(parent: str, members: dict) -> Iterator[str]:
    """Paths of the nulls in an object, at any depth."""
    todo = [(parent, members)]
    while todo:
        parent, members = todo.pop()
        for key, value in members.items():
            if value is None:
                yield _join(parent, key)
            elif isinstance(value, dict):
                todo.append((_join(parent, key), value))


def _enforce(before: dict | None, now: dict) -> tuple[dict, dict, list[tuple[str, str | None]], list[tuple[str, str]]]:
    """Reads a file by the schema of the one before it. Returns what is rescued, by path, with the
    reason and the value; the columns that are missing, with the value they had; the fields that
    became null, with the type they had; and those that are null no more, with the type they have.

    Only fields inside objects that both files have are looked at.
    """
    rescued: dict[str, list] = {}
    missing: dict[str, object] = {}
    if before is None:
        return rescued, missing, [(p, None) for p in _nulls("", now)], []
    left, came, todo = [], [], [("", before, now)]
    while todo:
        parent, target, members = todo.pop()
        for key, value in members.items():
            path = _join(parent, key)
            if key not in target:
                rescued[path] = ["unknown", value]
                left += [(p, None) for p in _nulls(parent, {key: value})]
                continue
            had = target[key]
            kind, old = _kind(value), _kind(had)
            if isinstance(value, dict):
                if isinstance(had, dict):
                    todo.append((path, had, value))
                else:
                    left += [(p, None) for p in _nulls(path, value)]
            if kind == old:
                continue
            if value is None:
                left.append((path, old))
            elif had is None:
                came.append((path, kind))
            else:
                rescued[path] = ["uncastable", value]
        for key, had in target.items():
            if key not in members:
                missing[_join(parent, key)] = had
    return rescued, missing, left, came


ENFORCED = "what string, path string, kind string, rescued string, missing string"


def _enforce_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (..., before, body) one row 'file' with what was rescued and what is missing, and rows
    'left' and 'came' of fields that became null or are null no more."""
    dump = lambda x: json.dumps(x, sort_keys=True) if x else None
    names = [c.split()[0] for c in ENFORCED.split(", ")]
    for batch in batches:
        k = batch.num_columns - 2
        take, rows = [], []
        for i, (before, body) in enumerate(zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist())):
            try:
                rescued, missing, left, came = _enforce(None if before is None else json.loads(before), json.loads(body))
            except (ValueError, RecursionError, AttributeError):  # too deep: such a file has no fields to compare
                continue
            found = [("file", None, None, dump(rescued), dump(missing))] if rescued or missing else []
            found += [("left", p, t, None, None) for p, t in left] + [("came", p, t, None, None) for p, t in came]
            rows += found
            take += [i] * len(found)
        if take:
            at = pa.array(take)
            yield pa.RecordBatch.from_arrays([*[batch.column(j).take(at) for j in range(k)], *[_strings(list(c)) for c in zip(*rows)]], names=[*batch.schema.names[:k], *names])


def _replay(rescued: dict, missing: dict) -> list[tuple[str, str, str]]:
    """(old_path, new_path, change): rescued values are replayed into missing columns of the same
    object that had an equal value, the first by path into the first; what is left is new or gone."""
    open_: dict[tuple[str, str], list[str]] = {}
    for path, value in sorted(missing.items(), key=lambda x: _plain(x[0])):
        open_.setdefault((path.rpartition("/")[0], _write(value)), []).append(path)
    out = []
    for path, (reason, value) in sorted(rescued.items(), key=lambda x: _plain(x[0])):
        if reason == "uncastable":
            out.append((_plain(path), _plain(path), "type_changed"))
            continue
        column = open_.get((path.rpartition("/")[0], _write(value)))
        if column:
            out.append((_plain(column.pop(0)), _plain(path), "renamed"))
        else:
            out.append(("", _plain(path), "added"))
    return out + [(_plain(p), "", "removed") for paths in open_.values() for p in paths]


def _replay_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        take, rows = [], []
        for i, (rescued, missing) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            found = _replay(json.loads(rescued or "{}"), json.loads(missing or "{}"))
            rows += found
            take += [i] * len(found)
        if take:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), *[_strings(list(c)) for c in zip(*rows)]], names=["file_id", "old_path", "new_path", "change"])


def consecutive(files: DataFrame) -> DataFrame:
    """(file_id, series, at, block, before, body): each file with the body of the one before it in
    its series by written_at, null for the first.

    A file that is no JSON object isn't counted: the one after it follows the last readable one. Ties
    go by file_id; a repeated row counts once; a null series is a series of its own; a null time
    comes first. Series are cut into blocks of about equal size, so a hot one isn't one task's,
    however close its files lie in time.
    """
    at = F.coalesce(F.unix_micros(F.col("written_at").cast("timestamp")), F.lit(-(1 << 62)))
    rows = files.select("file_id", "series", at.alias("at"), "body").where(F.schema_of_variant(F.try_parse_json("body")).startswith("OBJECT"))
    rows = ordered.frozen(rows, ["series", "at", "file_id"], "files")
    twin = F.lag("file_id").over(Window.partitionBy("series", "block").orderBy("at", "file_id"))
    once = rows.withColumn("__twin", twin).where(~F.col("file_id").eqNullSafe(F.col("__twin")) | F.col("file_id").isNull()).drop("__twin")
    return ordered.last_before(once, ["series"], ["at", "file_id"], "block", "body", "before", include_self=False).select("file_id", "series", "at", "block", "before", "body")


def enforced(files: DataFrame) -> DataFrame:
    """Each file read by the schema of the one before it: (file_id, series, at, block, what, path,
    kind, rescued, missing), see :func:`_enforce_all`. Only what doesn't fit is in it."""
    pairs = consecutive(files)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields[:4])
    return scratch.materialise(pairs.mapInArrow(_enforce_all, f"{kept}, {ENFORCED}"), "enforced")


def changes(files: DataFrame) -> DataFrame:
    """(file_id, old_path, new_path, change) between each file and the one before it in its series.

    A null keeps the type its field had before it; a field that was never anything but null has no
    type, and its first value changes none. Of several equal candidates for a rename the first by
    path are paired. Fields inside an object that itself changed are not listed.
    """
    rows = enforced(files)
    drifted = rows.where("what = 'file'").select("file_id", "rescued", "missing")
    kind = drifted.schema["file_id"].dataType.simpleString()
    found = drifted.mapInArrow(_replay_all, f"file_id {kind}, old_path string, new_path string, change string")
    # a field that is null no more meets the type it had when it became null
    nulls = rows.where("what <> 'file'").select("file_id", "series", "at", "block", "path", "kind", F.when(F.col("what") == "left", F.struct("kind")).alias("had"))
    typed = ordered.last_before(nulls, ["series", "path"], ["at", "file_id"], "block", "had", "then").where("had is null and then.kind <> kind")
    spelled = F.array_join(F.transform(F.split("path", "/"), lambda p: F.when(p == "~2", "").otherwise(F.replace(F.replace(p, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))), "/")
    return found.unionByName(typed.select("file_id", spelled.alias("old_path"), spelled.alias("new_path"), F.lit("type_changed").alias("change")))


def ingest(files: DataFrame, target: dict[str, str], body: str = "body") -> DataFrame:
    """Reads bodies into the columns of ``target`` (path to Spark type) and a rescue column.

    A column is the field at its path cast to its type; ``_rescued`` is a JSON object of every
    top-level-or-nested leaf the target lacks, objects without members too, and of every value that
    couldn't be cast, by path (null if there is none). In paths, also those of ``target``, a key's
    ~ is written ~0, its / is ~1 and an empty key is ~2. A null or unreadable body gives nulls, and an unreadable one is
    rescued whole under ''.
    """
    spec = list(target.items())

    def rescue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                out.append(_rescue(text, spec))
            yield pa.RecordBatch.from_arrays([*[pa.array([o[i] for o in out], pa.string()) for i in range(len(spec))], pa.array([o[-1] for o in out], pa.string()), *[batch.column(j) for j in range(1, batch.num_columns)]], names=[*[f"__c{i}" for i in range(len(spec))], "_rescued", *batch.schema.names[1:]])

    others = [c for c in files.columns if c != body]
    schema = ", ".join([*[f"__c{i} string" for i in range(len(spec))], "_rescued string", *[f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != body]])
    rows = files.select(body, *others).mapInArrow(rescue, schema)
    return rows.select(*others, *[F.col(f"__c{i}").try_cast(t).alias(p.replace("/", "__")) for i, (p, t) in enumerate(spec)], "_rescued")


def _castable(v, kind: str) -> str | None:
    """The value's text if it can stand in a column of the type, else None."""
    if isinstance(v, (dict, list)):
        return _write(v) if kind == "string" else None
    if isinstance(v, bool):
        return ("true" if v else "false") if kind in ("string", "boolean") else None
    if kind == "string":
        return v if isinstance(v, str) else _write(v)
    try:
        if kind in ("int", "bigint", "long", "integer"):
            if isinstance(v, float) and not v.is_integer():
                return None
            return str(int(v)) if -(1 << 63) <= int(v) < 1 << 63 else None
        if kind == "double":
            return repr(float(v))
    except (ValueError, OverflowError):
        return None
    if kind == "boolean":
        return v if v in ("true", "false") else None
    return v if isinstance(v, str) else None


def _rescue(text: str | None, spec: list[tuple[str, str]]) -> list[str | None]:
    if text is None:
        return [None] * (len(spec) + 1)
    fields = _fields(text, escape=True)
    if fields is None:
        return [None] * len(spec) + [json.dumps({"": text}, ensure_ascii=False)]
    wanted = dict(spec)
    have: dict[str, str | None] = {}
    kept: dict[str, object] = {}
    whole = [p for p, _ in spec]
    for path, _, kind, value in fields:
        if path in wanted:
            v = json.loads(value)
            text_of = None if v is None else _castable(v, wanted[path])
            have[path] = text_of
            if v is not None and text_of is None:
                kept[path] = v
        elif (kind != "object" or value == "{}") and not any(path.startswith(p + "/") for p in whole):
            kept[path] = json.loads(value)
    return [have.get(p) for p, _ in spec] + [json.dumps(kept, sort_keys=True, ensure_ascii=False) if kept else None]


def _rebuilt(path: str, members: list[str], kept: dict[str, object]) -> dict:
    out: dict = {}
    for p in members:
        *parents, last = [_unescape(part) for part in p[len(path) + 1 :].split("/")]
        at = out
        for part in parents:
            at = at.setdefault(part, {})
        at[last] = kept[p]
    return out


def promote(table: DataFrame, approved: dict[str, str]) -> DataFrame:
    """Adds columns for approved fields and replays rescued values into them.

    A column that exists keeps its values and is filled where it is null; what was replayed leaves
    the rescue column, what still can't be cast stays there. A field that is an object is rebuilt
    from its rescued members, unless a column holds one of them: then the others stay rescued.
    """
    spec = list(approved.items())
    if nested := [p for p in approved if any(q.startswith(p + "/") for q in approved)]:
        raise ValueError(f"approved together with fields of their own: {nested}")
    split = {p for p in approved if any(c.startswith(p.replace("/", "__") + "__") for c in table.columns)}

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("_rescued").to_pylist():
                kept = json.loads(text) if text else {}
                row = []
                for path, kind in spec:
                    members = [p for p in kept if p.startswith(path + "/")] if path not in kept and path not in split else []
                    v = _rebuilt(path, members, kept) if members else kept.get(path)
                    got = None if v is None else _castable(v, kind)
                    if got is not None or (path in kept and v is None):
                        for p in members or [path]:
                            kept.pop(p)
                    row.append(got)
                out.append([*row, json.dumps(kept, sort_keys=True, ensure_ascii=False) if kept else None])
            rest = [n for n in batch.schema.names if n != "_rescued"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], *[pa.array([o[i] for o in out], pa.string()) for i in range(len(spec) + 1)]], names=[*rest, *[f"__c{i}" for i in range(len(spec))], "_rescued"])

    rest = [f for f in table.schema.fields if f.name != "_rescued"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rest], *[f"__c{i} string" for i in range(len(spec))], "_rescued string"])
    rows = table.mapInArrow(replay, schema)
    new: dict[str, Column] = {}
    for i, (path, kind) in enumerate(spec):
        name, value = path.replace("/", "__"), F.col(f"__c{i}").try_cast(kind)
        new[name] = F.coalesce(F.col(name), value) if name in table.columns else value
    return rows.select(*[new.pop(f.name).alias(f.name) if f.name in new else F.col(f.name) for f in rest], *[c.alias(n) for n, c in new.items()], "_rescued")
