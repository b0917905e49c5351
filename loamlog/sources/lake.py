"""A table as Parquet files and a log of commits.

Each commit is one JSON file, created only if no other writer created its number first: a writer
that loses the race plans its commit anew. An entry lists the files it added and removed, each with
rows, bytes and time bounds, so that a reader resolves a version to a list of files, drops those
outside its window, and gives Spark the rest. Entries hold files, not rows; they are read on the
driver, and a checkpoint entry every ``CHECKPOINT_EVERY`` commits holds the whole list, so that no
reader walks further back.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamlog.functions import text
from loamlog.plans.store import Store

CHECKPOINT_EVERY = 50
PLACE = r"data/[0-9a-f]{32}/.*"
MINUTE_US = 60_000_000
#: One row a file and group: of a dimension's value, of a minute of event time, of a measure, or of a measure by a dimension's value.
SUMMARY = "path string, dimension string, value string, minute long, measure string, n long, non_null long, total double, low double, high double"
MERGE_AT_MOST = 64
RETRIES = 50


def trigrams(column: Column) -> Column:
    """The distinct runs of three characters."""
    spots = F.sequence(F.lit(1), F.length(column) - 2)
    return F.array_distinct(F.transform(F.when(F.length(column) >= 3, spots), lambda i: F.substring(column, i, F.lit(3))))


class Conflict(RuntimeError):
    """Another writer removed a file this one wanted to replace."""


class HistoryGap(RuntimeError):
    """A commit between a cursor and the current version is gone."""


def _name(path: str) -> str:
    """A data file's path within the table's folder."""
    return re.search(PLACE, path)[0]


def _by_day(files: list[dict], day_of) -> dict[str, int]:
    out: dict[str, int] = {}
    for f in files:
        out[day_of(f)] = out.get(day_of(f), 0) + f["rows"]
    return out


@dataclass
class Cursor:
    """What a subscription has delivered: a version, or before the first poll a time."""

    since_us: int | None = None
    version: int | None = None


class Lake:
    """``time``: the event-time column. Partition folders are days of it. ``dimensions`` and
    ``measures``: columns whose values are summed up for each file as it is written, so that counts
    and sums are answered without the files (:meth:`group_counts` and what follows it)."""

    def __init__(self, spark: SparkSession, root: str, time: str = "timestamp", dimensions: tuple[str, ...] = (), measures: tuple[str, ...] = ()):
        self.spark, self.store, self.time = spark, Store(spark, root), time
        self.dimensions, self.measures = dimensions, measures

    # The log

    def _log(self, version: int) -> str:
        return f"_log/{version:012d}.json"

    def versions(self) -> list[int]:
        return sorted(int(n[:12]) for n, _, _ in self.store.names("_log") if re.fullmatch(r"\d{12}\.json", n))

    def entry(self, version: int) -> dict:
        if not self.store.exists(self._log(version)):
            raise HistoryGap(f"version {version} is gone")
        return json.loads(self.store.read(self._log(version)))

    def _checkpoint(self, version: int) -> str:
        return f"_log/{version:012d}.checkpoint.json"

    def _back(self, version: int) -> tuple[list[dict], dict]:
        """The entries down from a version, newest first, to the nearest checkpoint, and that one:
        ``all`` files and ``all_consumed`` names as of the version after which the entries follow."""
        steps = []
        while version > 0:
            e = self.entry(version)
            if "all_consumed" not in e and self.store.exists(self._checkpoint(version)):
                e |= json.loads(self.store.read(self._checkpoint(version)))
            if "all_consumed" in e:
                return steps, e
            steps.append(e)
            version -= 1
        return steps, {"all": [], "all_consumed": []}

    @property
    def version(self) -> int:
        found = self.versions()
        return found[-1] if found else 0

    def files(self, version: int | None = None) -> list[dict]:
        """The files of the table as of a version."""
        steps, whole = self._back(self.version if version is None else version)
        live = {f["path"]: f for f in whole["all"]}
        for e in reversed(steps):
            for p in e["removed"]:
                live.pop(p, None)
            live |= {f["path"]: f for f in e["added"]}
        return list(live.values())

    def schema(self, version: int | None = None) -> T.StructType | None:
        at = self.version if version is None else version
        return T.StructType.fromJson(self.entry(at)["schema"]) if at else None

    def commit(self, operation: str, added: list[dict], removed: list[str], schema: T.StructType, rewrite: bool = False, consumed: list[str] | None = None) -> int:
        for attempt in range(RETRIES):
            base = self.version
            now = self.files(base)
            live = {f["path"] for f in now}
            if gone := [p for p in removed if p not in live]:
                raise Conflict(f"{len(gone)} files are no longer there")
            done = self.consumed(base) if consumed or (base + 1) % CHECKPOINT_EVERY == 0 else set()
            if again := done & set(consumed or []):
                raise Conflict(f"segments were consumed already: {sorted(again)[:3]}")
            entry = {"version": base + 1, "parent": base, "operation": operation, "rewrite": rewrite, "added": added, "removed": removed, "consumed": consumed or [], "schema": schema.jsonValue()}
            if (base + 1) % CHECKPOINT_EVERY == 0:
                dropped = set(removed)
                entry["all"] = [f for f in now if f["path"] not in dropped] + added
                entry["all_consumed"] = sorted(done | set(consumed or []))
            if self.store.create(self._log(base + 1), json.dumps(entry)):
                return base + 1
            if self.version == base:  # a writer holds the claim: it commits, or its claim expires
                time.sleep(min(1.0, self.store.claim_seconds / 10, 0.02 * 1.5**attempt))
        raise Conflict("other writers were always faster")

    def consumed(self, version: int | None = None) -> set[str]:
        """Names of the segments whose rows the table holds."""
        steps, whole = self._back(self.version if version is None else version)
        return {s for e in (*steps, {"consumed": whole["all_consumed"]}) for s in e["consumed"]}

    def consumed_names(self, column: str = "segment") -> DataFrame:
        """The same as a table, read from the log by Spark."""
        if not self.version:
            return self.spark.createDataFrame([], f"{column} string")
        log = self.spark.read.schema("consumed array<string>, all_consumed array<string>").json(f"{self.store.root}/_log/*.json")
        names = F.explode(F.concat(F.coalesce("consumed", F.array()), F.coalesce("all_consumed", F.array())))
        return log.select(names.alias(column)).distinct()

    # Writing

    def _write(self, df: DataFrame, partitions: int | None = None, lead: str | None = None) -> list[dict]:
        """Sorted, day-partitioned files, and what the log says of each. ``lead``: a column, not
        written, whose values aren't spread over files more than they must be."""
        folder = f"data/{uuid.uuid4().hex}"
        rows = df.withColumn("__day", F.to_date(self.time))
        ranges = [lead] if lead else ["__day", self.time]
        rows = rows.repartitionByRange(partitions, *ranges) if partitions else rows.repartitionByRange(*ranges)
        rows = rows.drop(lead) if lead else rows
        exact = [c for c in ("timestamp_ns",) if c in df.columns]
        rows.sortWithinPartitions("__day", self.time, *exact).write.partitionBy("__day").option("compression", "zstd").parquet(f"{self.store.root}/{folder}")
        written = self.spark.read.parquet(f"{self.store.root}/{folder}")
        if "__day" not in written.columns:  # nothing was written
            return []
        stats = written.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"), F.first("_metadata.file_size").alias("bytes"), F.min(F.unix_micros(F.col(self.time).cast("timestamp"))).alias("low"), F.max(F.unix_micros(F.col(self.time).cast("timestamp"))).alias("high"))
        found = [r.asDict() for r in stats.toLocalIterator()]
        for f in found:
            f["path"] = _name(f["path"])
        if self.dimensions or self.measures:
            self._sum_up(written.withColumn("path", F.regexp_extract(F.col("_metadata.file_path"), PLACE, 0)))
        return found

    def append(self, df: DataFrame, consumed: list[str] | None = None) -> int:
        """Adds rows. With ``consumed``, names of the segments they come from, a second append of a
        segment raises Conflict and adds nothing. New columns are added to the schema as nullable;
        a column of another type is refused."""
        schema = self.merged_schema(df.schema)
        if consumed and self.consumed() & set(consumed):
            raise Conflict("segments were consumed already")
        return self.commit("append", self._write(df), [], schema, consumed=consumed)

    def merged_schema(self, new: T.StructType) -> T.StructType:
        now = self.schema()
        if now is None:
            return new
        have = {f.name: f for f in now.fields}
        for f in new.fields:
            if f.name in have and have[f.name].dataType != f.dataType:
                raise ValueError(f"the column {f.name} is {have[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        return T.StructType([*now.fields, *[T.StructField(f.name, f.dataType, True) for f in new.fields if f.name not in have]])

    # Reading

    def read(self, version: int | None = None, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
        """The table as of a version; files outside the half-open window are not opened. Columns
        newer than a file are null in it."""
        schema = self.schema(version)
        if schema is None:
            raise ValueError("the table has no version")
        paths = [f["path"] for f in self.files(version) if (start_us is None or f["high"] is None or f["high"] >= start_us) and (end_us is None or f["low"] is None or f["low"] < end_us)]
        return self._open(paths, schema, start_us, end_us)

    def _open(self, paths: list[str], schema: T.StructType, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(*[f"{self.store.root}/{p}" for p in paths])
        t = F.col(self.time)
        if start_us is not None:
            df = df.where(t >= F.timestamp_micros(F.lit(start_us)))
        if end_us is not None:
            df = df.where(t < F.timestamp_micros(F.lit(end_us)))
        return df

    def newest(self, k: int) -> DataFrame:
        """The ``k`` newest rows: only files that can hold one of them are opened."""
        schema, rows, paths, bound, opened = self.schema(), 0, [], None, []
        for f in sorted(self.files(), key=lambda f: (f["high"] is None, -(f["high"] or 0))):
            if bound is not None and f["high"] is not None and f["high"] < bound:
                break
            paths.append(f["path"])
            opened.append(f)
            rows += f["rows"]
            if rows >= k and bound is None:
                bound = min(-(1 << 63) if g["low"] is None else g["low"] for g in opened)
        exact = [F.desc(c) for c in ("timestamp_ns",) if c in schema.names]
        return self._open(paths, schema).orderBy(F.col(self.time).desc_nulls_last(), *exact).limit(k)

    def with_buffer(self, buffer: DataFrame, segment: str = "segment") -> DataFrame:
        """Committed rows and those of segments not consumed yet, each once."""
        fresh = buffer.join(self.consumed_names(segment), segment, "left_anti")
        return self.read().unionByName(fresh.drop(segment), allowMissingColumns=True)

    # Life cycle

    def retain(self, cutoff_us: int) -> int | None:
        """Drops files whose every row is older; a file that straddles stays whole."""
        old = [f["path"] for f in self.files() if f["high"] is not None and f["high"] < cutoff_us]
        return self.commit("delete", [], old, self.schema(), rewrite=True) if old else None

    def delete(self, predicate: Column | str) -> int | None:
        """Removes the rows for which the predicate is true; where it is null they stay. Only files
        with such a row are rewritten, and rows kept and removed must add up."""
        test = F.expr(predicate) if isinstance(predicate, str) else predicate
        hit = F.coalesce(test, F.lit(False))
        live, schema = {f["path"]: f for f in self.files()}, self.schema()
        df = self._open(list(live), schema)
        per_file = df.groupBy(F.col("_metadata.file_path").alias("p")).agg(F.count_if(hit).alias("n")).where("n > 0")
        touched = {_name(r["p"]): r["n"] for r in per_file.toLocalIterator()}
        if not touched:
            return None
        kept = self._write(self._open(list(touched), schema).where(~hit))
        if sum(f["rows"] for f in kept) + sum(touched.values()) != sum(live[p]["rows"] for p in touched):
            raise RuntimeError("rows kept and removed don't add up; nothing was committed")
        return self.commit("delete", kept, list(touched), schema, rewrite=True)

    def compact(self, target_bytes: int = 128 << 20) -> int | None:
        """Rewrites small files in groups of one day, at most ``MERGE_AT_MOST`` files and about
        ``target_bytes`` each, all groups in one job and one commit; each day's rows must be
        conserved."""
        day_of = lambda f: f["path"].split("__day=")[-1].split("/")[0]
        days: dict[str, list[dict]] = {}
        for f in self.files():
            if f["bytes"] < target_bytes:
                days.setdefault(day_of(f), []).append(f)
        groups: list[list[dict]] = []
        for _, files in sorted(days.items()):
            files.sort(key=lambda f: (f["low"] or 0, f["path"]))
            group: list[dict] = []
            for f in files:
                if group and (len(group) == MERGE_AT_MOST or sum(g["bytes"] for g in group) + f["bytes"] > target_bytes):
                    groups.append(group)
                    group = []
                group.append(f)
            groups.append(group)
        groups = [g for g in groups if len(g) > 1]
        if not groups:
            return None
        schema, old = self.schema(), [f for g in groups for f in g]
        place = self.spark.createDataFrame([(f["path"], n) for n, g in enumerate(groups) for f in g], "__path string, __group long")
        rows = self._open([f["path"] for f in old], schema).withColumn("__path", F.regexp_extract(F.col("_metadata.file_path"), PLACE, 0))
        new = self._write(rows.join(place, "__path").drop("__path"), len(groups), "__group")
        if _by_day(new, day_of) != _by_day(old, day_of):
            raise RuntimeError("rows were not conserved; nothing was committed")
        return self.commit("replace", new, [f["path"] for f in old], schema, rewrite=True)

    def evolve(self, fields: list[T.StructField]) -> int:
        """Adds nullable columns."""
        return self.commit("schema", [], [], self.merged_schema(T.StructType([*self.schema().fields, *fields])), rewrite=True)

    def expire(self, keep: int) -> list[int]:
        """Forgets all but the last ``keep`` versions. The oldest one kept gets a checkpoint beside it
        before anything is deleted."""
        found = self.versions()
        old, first = found[:-keep], found[-keep:][0] if found else None
        if not old:
            return []
        if "all_consumed" not in self.entry(first) and not self.store.exists(self._checkpoint(first)):
            whole = {"all": self.files(first), "all_consumed": sorted(self.consumed(first))}
            if not self.store.create(self._checkpoint(first), json.dumps(whole)) and not self.store.exists(self._checkpoint(first)):
                return []  # another run is at it
        for v in old:  # the oldest first: what a run that dies leaves is a log with a shorter past
            for name in (self._log(v), f"{self._log(v)}.claim", self._checkpoint(v), f"{self._checkpoint(v)}.claim"):
                self.store.delete(name)
        return old

    def orphans(self, older_than_ms: int) -> list[str]:
        """Data files no version names, changed before the time given."""
        known = {f["path"] for v in self.versions() for f in self.files(v)}
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{self.store.root}/data").select("path", F.unix_millis("modificationTime").alias("at"))
        names = [(_name(r["path"]), r["at"]) for r in found.toLocalIterator()]
        return sorted(p for p, at in names if p not in known and at < older_than_ms)

    def collect_garbage(self, older_than_ms: int, dry_run: bool = True) -> list[str]:
        found = self.orphans(older_than_ms)
        if not dry_run:
            for p in found:
                self.store.delete(p)
        return found

    # Subscriptions

    def poll(self, cursor: Cursor) -> tuple[DataFrame | None, Cursor]:
        """The rows added since the cursor, and the cursor to keep once they are processed.

        The first poll filters by time; later ones read the files of appends only: rewrites hold
        rows already delivered. A version that is gone raises HistoryGap and moves nothing."""
        now = self.version
        if not now or now == cursor.version:
            return None, cursor
        if cursor.version is None:
            rows = self.read(start_us=None if cursor.since_us is None else cursor.since_us + 1)
            return rows, Cursor(cursor.since_us, now)
        steps = [self.entry(v) for v in range(cursor.version + 1, now + 1)]
        paths = [f["path"] for e in steps if e["operation"] == "append" and not e["rewrite"] for f in e["added"]]
        return self._open(paths, self.schema(now)), Cursor(cursor.since_us, now)

    # Summaries

    def _sum_up(self, rows: DataFrame) -> None:
        """Writes the summary rows of data files, in one pass over the columns they need."""
        dimensions = [c for c in self.dimensions if c in rows.columns]
        measures = [c for c in self.measures if c in rows.columns]
        none, number = F.lit(None), F.lit(None).cast("double")

        def cell(dimension=none, value=none, minute=none, measure=none, x=number):
            return F.struct(dimension.cast("string").alias("dimension"), value.cast("string").alias("value"), minute.cast("long").alias("minute"), measure.cast("string").alias("measure"), x.cast("double").alias("x"))

        minute = F.floor(F.unix_micros(F.col(self.time).cast("timestamp")) / MINUTE_US)
        cells = [cell(F.lit(d), F.col(d)) for d in dimensions] + [cell(F.lit("<minute>"), minute=minute)]
        cells += [cell(measure=F.lit(m), x=F.col(m)) for m in measures] + [cell(F.lit(d), F.col(d), measure=F.lit(m), x=F.col(m)) for d in dimensions for m in measures]
        found = rows.select("path", F.explode(F.array(*cells)).alias("c")).select("path", "c.*")
        summed = found.groupBy("path", "dimension", "value", "minute", "measure").agg(F.count("*").alias("n"), F.count("x").alias("non_null"), F.sum("x").alias("total"), F.min("x").alias("low"), F.max("x").alias("high"))
        summed.write.option("compression", "zstd").parquet(f"{self.store.root}/summary/{uuid.uuid4().hex}")

    def _summaries(self) -> DataFrame:
        """Summary rows of the files of the current version. Files written without them are read now."""
        live = self.spark.createDataFrame([(f["path"],) for f in self.files()], "path string")
        if not self.store.exists("summary"):
            return self.spark.createDataFrame([], SUMMARY)
        return self.spark.read.schema(SUMMARY).option("recursiveFileLookup", "true").parquet(f"{self.store.root}/summary").join(live, "path", "left_semi")

    def _covered(self) -> DataFrame:
        """The summaries, after those that other writers left out are made."""
        have = {r["path"] for r in self._summaries().select("path").distinct().toLocalIterator()}
        if lacking := [f["path"] for f in self.files() if f["path"] not in have and f["rows"]]:
            self._sum_up(self._open(lacking, self.schema()).withColumn("path", F.regexp_extract(F.col("_metadata.file_path"), PLACE, 0)))
        return self._summaries()

    def group_counts(self, dimension: str) -> DataFrame:
        """(value, n): exact counts of a dimension's values, null as a value, from the summaries."""
        if dimension not in self.dimensions:
            raise ValueError(f"{dimension} isn't summed up")
        return self._covered().where((F.col("dimension") == dimension) & F.col("measure").isNull()).groupBy("value").agg(F.sum("n").alias("n"))

    def histogram(self, width_us: int) -> DataFrame:
        """(bucket_us, n) of whole minutes: rows of each bin of event time, from the summaries."""
        if width_us <= 0 or width_us % MINUTE_US:
            raise ValueError("bins are of whole minutes")
        minutes = F.lit(width_us // MINUTE_US)
        start = (F.col("minute") - F.pmod(F.col("minute"), minutes)) * MINUTE_US
        return self._covered().where("dimension = '<minute>'").groupBy(start.alias("bucket_us")).agg(F.sum("n").alias("n"))

    def grouped_numeric(self, dimension: str, measure: str) -> DataFrame:
        """(value, n, non_null, total, mean) of a measure by a dimension, from the summaries."""
        rows = self._covered().where((F.col("dimension") == dimension) & (F.col("measure") == measure))
        return rows.groupBy("value").agg(F.sum("n").alias("n"), F.sum("non_null").alias("non_null"), F.sum("total").alias("total")).withColumn("mean", F.col("total") / F.nullif(F.col("non_null"), F.lit(0)))

    def top_numeric(self, measure: str, k: int, descending: bool = True) -> DataFrame:
        """The ``k`` rows with the largest (smallest) values, those without a value last: only files
        whose bounds say that they can hold one are opened."""
        bounds = [r for r in self._covered().where((F.col("measure") == measure) & F.col("dimension").isNull()).select("path", "non_null", "low", "high").toLocalIterator()]
        sign = 1 if descending else -1
        worst, best = ("low", "high") if descending else ("high", "low")
        n, bound = 0, None
        for r in sorted((r for r in bounds if r["non_null"]), key=lambda r: -sign * r[worst]):
            n += r["non_null"]
            if n >= k:
                bound = r[worst]
                break
        # values are compared as doubles: equal ones are kept
        paths = [r["path"] for r in bounds if bound is None or r["non_null"] and sign * r[best] >= sign * bound]
        order = F.col(measure).desc_nulls_last() if descending else F.col(measure).asc_nulls_last()
        return self._open(paths, self.schema()).orderBy(order).limit(k)

    # Promotion

    def backfill(self, columns: dict[str, tuple[str, str]]) -> int:
        """Adds typed columns of attributes, (key, type) by name, and fills them in rows that are there
        already: files are rewritten in one commit that conserves rows; subscribers see nothing of it."""
        from loamlog.operators.mapping import promote

        old = self.files()
        now = self.read()
        named = {c: k for c, k in columns.items() if c not in now.columns}
        if not named:
            return self.version
        filled = promote(now, named)
        new = self._write(filled, max(1, len(old)))
        if sum(f["rows"] for f in new) != sum(f["rows"] for f in old):
            raise RuntimeError("rows were not conserved; nothing was committed")
        return self.commit("replace", new, [f["path"] for f in old], self.merged_schema(filled.schema), rewrite=True)

    def hot_keys(self, share: float = 0.5, attributes: str = "attributes", at_most: int = 32) -> list[str]:
        """Top-level attribute keys that at least that share of the rows have, the most frequent first:
        candidates for :meth:`backfill`."""
        rows = self.read()
        n = rows.count()
        keys = rows.select(F.explode(F.json_object_keys(attributes)).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
        return [r["k"] for r in keys.where(F.col("n") >= share * n).orderBy(F.desc("n"), "k").limit(at_most).collect()]

    # Side tables

    def summary(self, columns: list[str]) -> DataFrame:
        """(path, column, value, n) of each file: exact group counts, nulls as a group."""
        df = self._open([f["path"] for f in self.files()], self.schema())
        parts = [df.groupBy(F.col("_metadata.file_path").alias("path"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")) for c in columns]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def stats(self, start_us: int | None = None, end_us: int | None = None) -> tuple[int, int]:
        """Bytes and rows of the files a window touches: an upper bound, without reading them."""
        hit = [f for f in self.files() if (start_us is None or f["high"] is None or f["high"] >= start_us) and (end_us is None or f["low"] is None or f["low"] < end_us)]
        return sum(f["bytes"] for f in hit), sum(f["rows"] for f in hit)

    def _index_folder(self, column: str, kind: str) -> str:
        return f"{self.store.root}/index/{column}-{kind}"

    def _indexed(self, column: str, kind: str) -> DataFrame:
        if not self.store.exists(f"index/{column}-{kind}"):
            return self.spark.createDataFrame([], "path string, key string")
        return self.spark.read.schema("path string, key string").option("recursiveFileLookup", "true").parquet(self._index_folder(column, kind))

    def build_index(self, column: str, kind: str = "terms") -> int:
        """Lists which keys each file has that isn't indexed yet: the default tokens of the column
        (``terms``) or its runs of three characters (``trigrams``). Returns the files added."""
        keys = {"terms": text.tokens, "trigrams": trigrams}[kind](F.col(column))
        done = {r["path"] for r in self._indexed(column, kind).where("key is null").toLocalIterator()}
        new = [f["path"] for f in self.files() if f["path"] not in done]
        if not new:
            return 0
        path = F.regexp_extract(F.col("_metadata.file_path"), PLACE, 0).alias("path")
        found = self._open(new, self.schema()).select(path, F.explode(keys).alias("key")).distinct()
        marks = self.spark.createDataFrame([(p, None) for p in new], "path string, key string")
        found.unionByName(marks).write.parquet(f"{self._index_folder(column, kind)}/{uuid.uuid4().hex}")
        return len(new)

    def candidates(self, column: str, keys: list[str], kind: str) -> list[str]:
        """The files that can have a row with all the keys: those listed with each of them, and
        those not indexed."""
        index = self._indexed(column, kind)
        done = {r["path"] for r in index.where("key is null").toLocalIterator()}
        wanted = sorted(set(keys))
        hit = index.where(F.col("key").isin(wanted)).groupBy("path").agg(F.countDistinct("key").alias("n")).where(F.col("n") == len(wanted))
        have = {r["path"] for r in hit.toLocalIterator()}
        return [f["path"] for f in self.files() if f["path"] in have or f["path"] not in done]

    def search(self, column: str, query: str) -> DataFrame:
        """Rows that match all terms; files without one of them aren't opened."""
        return self._open(self.candidates(column, text.python_tokens(query), "terms"), self.schema()).where(text.match_terms(F.col(column), query))

    def containing(self, column: str, part: str) -> DataFrame:
        """Rows whose column contains the text; with three characters and more, files that lack one
        of its runs of three aren't opened. Token lists are cut off, so they never serve for this."""
        runs = [part[i : i + 3] for i in range(len(part) - 2)]
        paths = self.candidates(column, runs, "trigrams") if runs else [f["path"] for f in self.files()]
        return self._open(paths, self.schema()).where(F.col(column).contains(part))
