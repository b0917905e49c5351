"""Only new or changed records since a subscription's last successful run.

A manifest states what was processed, each thing with size and checksum: files (:class:`FileManifest`)
or, for a subscription, the versions of records it saw (:class:`RecordManifest`). What there is now is
anti-joined against it; what is left is written under a batch identifier, and only then does the
manifest count the batch (:class:`Ledger`), so a run that fails in between leaves neither gaps nor
repeats.

A subscription's manifest at its cursor is derived from the commits: a table's commits form a tree,
its current commit and that one's ancestors are the main line. A cursor off the main line (its
commit was rolled back) is the commits from it down to the main line, over the main line's state at
that point. Ancestry is found within blocks of commits and, between blocks, by pointer doubling.
A subscription meets the commits since its cursor and, through them, the records they
touched; no other record of its table is looked at.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loamlog.plans import ordered, scratch
from loamlog.plans.store import Store

SALTS = 16
FILES_A_READ = 10_000  # names the driver holds at a time
DEPTHS_A_BLOCK = 256
COMMITS_A_BLOCK = 16384
DAY_US = 86_400_000_000


def canonical_json(text: Column) -> Column:
    """One spelling of a JSON value (sorted keys, no blanks, no escapes); other text as it is."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def _local(block: pa.Table) -> pa.Table:
    """For each commit of a block its first ancestor outside of it (null: none) and the steps there, or
    to its root; ``circle`` if there is no end."""
    ids = block["snapshot_id"].to_pylist()
    parent = dict(zip(ids, block["parent"].to_pylist()))
    found: dict[int, tuple[int | None, int, bool]] = {}
    for start in parent:
        path, at, on_path = [], start, set()
        while at is not None and at in parent and at not in found and at not in on_path:
            path.append(at)
            on_path.add(at)
            at = parent[at]
        circle = at in on_path
        exit_, steps = (None, 0) if at is None or circle else (at, 0)
        if at in found and not circle:
            exit_, steps, circle = found[at]
        elif at is None:
            steps = -1  # the root itself is no step away
        for c in reversed(path):
            steps += 1
            found[c] = exit_, steps, circle
    for name, kind, i in (("exit", pa.int64(), 0), ("steps", pa.int64(), 1), ("circle", pa.bool_(), 2)):
        block = block.append_column(name, pa.array([found[c][i] for c in ids], kind))
    return block


def _marked(block: pa.Table) -> pa.Table:
    """For each commit of a block whether it is on the main line, which passes the block's commits that
    are entries, and its nearest ancestor in the block that is."""
    ids = block["snapshot_id"].to_pylist()
    parent = dict(zip(ids, block["parent"].to_pylist()))
    main: set[int] = set()
    for c, entry in zip(ids, block["entry"].to_pylist()):
        while entry and c in parent and c not in main:
            main.add(c)
            c = parent[c]
    near: dict[int, int | None] = {}
    for c in ids:
        path = []
        while c in parent and c not in main and c not in near:
            path.append(c)
            c = parent[c]
        got = c if c in main else near.get(c)
        near.update(dict.fromkeys(path, got))
    out = block.select(["snapshot_id", "table_name", "depth", "parent", "exit"]).append_column("main", pa.array([c in main for c in ids], pa.bool_()))
    return out.append_column("fork", pa.array([c if c in main else near[c] for c in ids], pa.int64()))


def commit_tree(snapshots: DataFrame) -> DataFrame:
    """Each commit with its ``depth`` and, if it isn't on the main line, ``fork``: its nearest
    ancestor that is. Commits whose line never meets the main one have fork null.
    A parent that isn't listed counts as none; parents that form a circle raise ValueError.

    Commits are cut into blocks along their order, and lines are followed within blocks; only the
    commits at which a line enters a block are left for pointer doubling.
    """
    order = F.first("sequence_no") if "sequence_no" in snapshots.columns else F.first("snapshot_id")
    base = snapshots.where(F.col("snapshot_id").isNotNull()).groupBy("snapshot_id").agg(F.first("parent_snapshot_id").alias("parent_snapshot_id"), F.first("table_name").alias("table_name"), F.max(F.coalesce("is_current", F.lit(False))).alias("is_current"), order.cast("long").alias("no"))
    known = base.select(F.col("snapshot_id").alias("parent_snapshot_id"), F.col("table_name").alias("p_table"))
    base = base.join(known, "parent_snapshot_id", "left").select("snapshot_id", "table_name", "is_current", "no", F.when(F.col("p_table") == F.col("table_name"), F.col("parent_snapshot_id")).alias("parent"))
    base, size = scratch.counted(base, "commits", n=F.lit(True))
    rows = ordered.frozen(base, ["table_name", "no", "snapshot_id"], "commits", max(1, -(-size["n"] // COMMITS_A_BLOCK)))
    kinds = "snapshot_id long, table_name string, is_current boolean, no long, parent long, block int, exit long, steps long, circle boolean"
    local, seen = scratch.counted(rows.groupBy("block").applyInArrow(lambda block: _local(block), kinds), "lines", circles=F.col("circle"), exits=F.col("exit").isNotNull())
    if seen["circles"]:
        raise ValueError("the commits' parents form a circle")
    if not seen["exits"]:
        met = local.withColumns({"depth": F.col("steps"), "entry": F.col("is_current")})
    else:
        gates = local.select(F.col("exit").alias("snapshot_id")).where("snapshot_id is not null").distinct()
        gates = local.join(gates.withColumn("gate", F.lit(True)), "snapshot_id", "left").where("gate or is_current").select("snapshot_id", F.col("exit").alias("jump"), F.col("steps").alias("depth"), F.col("is_current").alias("main"))
        now, left = scratch.counted(gates, "gates", jumps=F.col("jump").isNotNull())
        rounds = 0
        while left["jumps"]:
            before, rounds = now, rounds + 1
            if rounds > 40:
                raise ValueError("the commits' parents form a circle")
            # an ancestor by 2^k of a main commit is on the main line
            marks = now.where("main and jump is not null").select(F.col("jump").alias("snapshot_id")).distinct().withColumn("hit", F.lit(True))
            there = now.select(F.col("snapshot_id").alias("jump"), F.col("jump").alias("jump2"), F.col("depth").alias("depth2"))
            step = now.join(there, "jump", "left").join(marks, "snapshot_id", "left")
            now = step.select("snapshot_id", F.col("jump2").alias("jump"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), (F.col("main") | F.coalesce("hit", F.lit(False))).alias("main"))
            now, left = scratch.counted(now, "gates", jumps=F.col("jump").isNotNull())
            scratch.forget(before)
        entries = now.where("main").select("snapshot_id", F.lit(True).alias("entry"))
        below = now.select(F.col("snapshot_id").alias("exit"), F.col("depth").alias("below"))
        met = local.join(entries, "snapshot_id", "left").join(below, "exit", "left")
        met = met.withColumns({"depth": F.col("steps") + F.coalesce("below", F.lit(0)), "entry": F.coalesce("entry", F.lit(False))})
    kinds = "snapshot_id long, table_name string, depth long, parent long, exit long, main boolean, fork long"
    inputs = met.select("block", "snapshot_id", "table_name", "depth", "parent", "exit", "entry")
    done, left = scratch.counted(inputs.groupBy("block").applyInArrow(lambda block: _marked(block), kinds), "tree", open=F.col("fork").isNull() & F.col("exit").isNotNull())
    out = done.select("snapshot_id", "table_name", "depth", "parent", "main", "fork")
    if not left["open"]:
        return out
    # off the main line and through other blocks down to it
    gates = done.select(F.col("exit").alias("snapshot_id")).where("snapshot_id is not null").distinct()
    off = scratch.materialise(done.join(gates, "snapshot_id", "left_semi").select("snapshot_id", "fork", F.when(F.col("fork").isNull(), F.col("exit")).alias("jump")), "forks")
    while off.where("fork is null and jump is not null").limit(1).count():
        before = off
        there = off.select(F.col("snapshot_id").alias("jump"), F.col("fork").alias("fork2"), F.col("jump").alias("jump2"))
        off = scratch.materialise(off.join(there, "jump", "left").select("snapshot_id", F.coalesce("fork", "fork2").alias("fork"), F.when(F.coalesce("fork", "fork2").isNull(), F.col("jump2")).alias("jump")), "forks")
        scratch.forget(before)
    last = off.select(F.col("snapshot_id").alias("exit"), F.col("fork").alias("far"))
    return done.join(last, "exit", "left").select("snapshot_id", "table_name", "depth", "parent", "main", F.coalesce("fork", "far").alias("fork"))


def _off_line(tree: DataFrame, cursors: DataFrame) -> DataFrame:
    """(cursor, snapshot_id, depth) of the commits from each off-line cursor down to the main line."""
    off = tree.where(~F.col("main")).select("snapshot_id", "depth", F.col("parent").alias("jump"))
    own = off.select(F.col("snapshot_id").alias("jump"))
    jumps = off.join(own, "jump", "left_semi").select("snapshot_id", "jump")
    reach = scratch.materialise(cursors.join(off.select("snapshot_id"), cursors["cursor"] == F.col("snapshot_id"), "left_semi").select("cursor", F.col("cursor").alias("snapshot_id")), "reach")
    jumps, left = scratch.counted(jumps, "jumps", all=F.lit(True))
    while left["all"]:
        seen, old = reach, jumps
        more = reach.join(jumps, "snapshot_id").select("cursor", F.col("jump").alias("snapshot_id"))
        reach = scratch.materialise(reach.unionByName(more).distinct(), "reach")
        there = jumps.select(F.col("snapshot_id").alias("jump"), F.col("jump").alias("jump2"))
        jumps, left = scratch.counted(jumps.join(there, "jump").select("snapshot_id", F.col("jump2").alias("jump")), "jumps", all=F.lit(True))
        scratch.forget(seen)
        scratch.forget(old)
    return reach.join(off.select("snapshot_id", "depth"), "snapshot_id")


def last_success(runs: DataFrame) -> DataFrame:
    """For each subscription its table and the cursor of its succeeded run of the highest run_no.

    ``mode``: 'snapshot', 'time' (no snapshot at the cursor) or 'all' (no run succeeded; run_no -1).
    """
    good = F.when(F.col("run_status") == "succeeded", F.struct("run_no", "run_id", "cursor_snapshot_id", "cursor_time"))
    best = runs.where(F.col("subscription_id").isNotNull()).groupBy("subscription_id").agg(F.max("table_name").alias("table_name"), F.max(good).alias("best"))
    mode = F.when(F.col("best").isNull(), "all").when(F.col("best.cursor_snapshot_id").isNull(), "time").otherwise("snapshot")
    return best.select("subscription_id", "table_name", F.coalesce("best.run_no", F.lit(-1)).alias("run_no"), F.col("best.cursor_snapshot_id").alias("cursor"), F.col("best.cursor_time").alias("cursor_time"), mode.alias("mode"))


def _day(time: Column) -> Column:
    return F.floor(F.unix_micros(time.cast("timestamp")) / DAY_US)


def _touched(subs: DataFrame, listing: DataFrame) -> DataFrame:
    """Each subscription with the records of its table's current state that can differ from what it
    saw: those written by a commit of the main line since, those later than its time, or all."""
    out = ["subscription_id", "run_no", "table_name", "record_id", "v", "mode", "since", "cursor"]
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    ends = listing.groupBy("table_name").agg(F.max("depth").alias("top"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    mine = subs.join(ends, "table_name")
    # the commits, or the days, since the cursor: equi-joins, as many pairs as there is news
    commits = mine.where("mode = 'snapshot' and since < top").select("*", F.explode(F.sequence(F.col("since") + 1, F.col("top"))).alias("depth"))
    by_commit = commits.select("*", salts).join(listing, ["table_name", "depth", "salt"]).select(*out)
    first = F.greatest(_day(F.col("cursor_time")), F.col("first_day"))
    days = mine.where("mode = 'time'").where((first <= F.col("last_day")) & F.col("cursor_time").isNotNull()).select("*", F.explode(F.sequence(first, F.col("last_day"))).alias("day"))
    by_time = days.select("*", salts).join(listing, ["table_name", "day", "salt"]).where("v.event_time > cursor_time").select(*out)
    whole = mine.where("mode = 'all'").select("*", salts).join(listing, ["table_name", "salt"]).select(*out)
    return by_commit.unionByName(by_time).unionByName(whole)


PENDING = ["subscription_id", "run_no", "table_name", "record_id", "row_no", "event_time", "size", "checksum"]


def pending(snapshots: DataFrame, lake_rows: DataFrame, runs: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(subscription_id, run_no, table_name, record_id, row_no, event_time, size, checksum) of the
    records each subscription has to process next: those of its table's current state that its
    manifest lacks or has with another size or checksum. ``run_no`` is that of its last success.

    ``done``: (subscription_id, run_no, record_id, size, checksum, batch) of what was committed since
    that run; of a record the entry of the latest batch holds, before what the run's cursor says.

    Of several versions in one commit the one with the largest row_no counts. Rows whose commit is
    unknown, and rows without a record or commit, belong to no state. A cursor whose commit is
    unknown is a manifest without entries. Payloads are compared as JSON values; a null payload
    equals a null payload. Empty tables give an empty result.
    """
    tree = commit_tree(snapshots)
    content = canonical_json(F.col("payload"))
    version = F.struct("depth", "row_no", F.coalesce(F.length("text"), F.lit(-1)).alias("size"), F.coalesce(F.sha2("text", 256), F.lit("")).alias("checksum"), "event_time")
    versions = lake_rows.select("record_id", "snapshot_id", "row_no", "event_time", content.alias("text")).where("record_id is not null").join(tree.select("snapshot_id", "table_name", "depth", "main"), "snapshot_id")
    versions = versions.groupBy("table_name", "record_id", "snapshot_id", "depth", "main").agg(F.max(version).alias("v"))
    versions = scratch.materialise(versions, "versions")
    listing = versions.where("main").groupBy("table_name", "record_id").agg(F.max("v").alias("v"))
    listing = scratch.materialise(listing.withColumns({"salt": F.pmod(F.xxhash64("record_id"), F.lit(SALTS)), "depth": F.col("v.depth"), "day": _day(F.col("v.event_time"))}), "listing")

    subs = last_success(runs)
    cursors = subs.where("mode = 'snapshot'").select("cursor").distinct()
    points = tree.select(F.col("snapshot_id").alias("cursor"), F.col("fork")).join(tree.select(F.col("snapshot_id").alias("fork"), F.col("depth").alias("since")), "fork", "left").select("cursor", F.coalesce("since", F.lit(-1)).alias("since"))
    subs = scratch.materialise(subs.join(points, "cursor", "left").withColumn("since", F.coalesce("since", F.lit(-1))), "subscriptions")

    # what was touched on the main line since the cursor left it ...
    touched = _touched(subs, listing)
    # ... or else was written by a commit that was rolled back under the cursor
    off = _off_line(tree, cursors)
    seen_off = off.join(versions.where(~F.col("main")).select("snapshot_id", "record_id", "table_name", F.col("v").alias("mv")), "snapshot_id").groupBy("cursor", "table_name", "record_id").agg(F.max("mv").alias("mv"))
    seen_off = scratch.materialise(seen_off, "off")
    turned = subs.where("mode = 'snapshot'").join(seen_off, ["cursor", "table_name"]).join(listing.select("table_name", "record_id", "v", "depth"), ["table_name", "record_id"]).where("depth <= since").select(*touched.columns)
    listed = scratch.materialise(touched.unionByName(turned), "listed")

    # manifest entries of just these records: the rolled back version, or the main line's as of the cursor
    asked = listed.where("mode = 'snapshot'")
    entries_off = asked.join(seen_off, ["cursor", "table_name", "record_id"]).select("subscription_id", "record_id", "mv")
    points = asked.select("table_name", "record_id", "since").distinct()
    line = versions.where("main").join(points.select("table_name", "record_id").distinct(), ["table_name", "record_id"], "left_semi").select("table_name", "record_id", F.col("depth").alias("since"), F.lit(0).alias("kind"), F.col("v").alias("seen"))
    scan = line.unionByName(points.withColumns({"kind": F.lit(1), "seen": F.lit(None).cast(line.schema["seen"].dataType)})).withColumn("block", F.floor(F.col("since") / DEPTHS_A_BLOCK))
    as_of = ordered.last_before(scan, ["table_name", "record_id"], ["since", "kind"], "block", "seen", "mv").where("kind = 1 and mv is not null").select("table_name", "record_id", "since", "mv")
    on_line = asked.join(as_of, ["table_name", "record_id", "since"]).join(entries_off.select("subscription_id", "record_id"), ["subscription_id", "record_id"], "left_anti").select("subscription_id", "record_id", "mv")
    manifest = entries_off.unionByName(on_line).select("subscription_id", "record_id", F.col("mv.size").alias("size"), F.col("mv.checksum").alias("checksum"))
    if done is not None:
        newest = done.join(subs.select("subscription_id", "run_no"), ["subscription_id", "run_no"], "left_semi").groupBy("subscription_id", "record_id").agg(F.max(F.struct("batch", "size", "checksum")).alias("d"))
        manifest = manifest.join(newest, ["subscription_id", "record_id"], "left_anti").unionByName(newest.select("subscription_id", "record_id", "d.size", "d.checksum"))

    wanted = listed.select("subscription_id", "run_no", "table_name", "record_id", F.col("v.row_no").alias("row_no"), F.col("v.event_time").alias("event_time"), F.col("v.size").alias("size"), F.col("v.checksum").alias("checksum"))
    return wanted.join(manifest, ["subscription_id", "record_id", "size", "checksum"], "left_anti").select(*PENDING)


class Ledger:
    """Batches under ``path``. A batch is its intent (a file that names the run), its entries (what it
    is about to process), its output, and last its mark: only what has a mark counts.

    A run first drops what an earlier one left without a mark, output included, and then plans anew:
    nothing is skipped or repeated whenever a run dies. Readers go by the marks (:meth:`output`), so
    they see finished batches only. One run at a time is meant; of two at once, the one whose intent
    was dropped stops before its mark.
    """

    STEPS = ("intent", "entries", "output")

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path.rstrip("/"), Store(spark, path)

    def batches(self) -> list[str]:
        """Identifiers of the finished batches, in their order. One small file each."""
        return sorted(n for n, _, _ in self.store.names("marks") if n.isdigit())

    def entries(self, schema: str) -> DataFrame:
        """What the finished batches processed, with ``batch``."""
        return self._read(f"{self.path}/entries", schema)

    def output(self, schema, sink: str | None = None) -> DataFrame:
        """The rows of the finished batches, with ``batch``."""
        return self._read(sink or f"{self.path}/output", schema)

    def _read(self, folder: str, schema) -> DataFrame:
        found = [f"{folder}/batch={b}" for b in self.batches()]
        reader = self.spark.read.schema(schema)
        rows = reader.parquet(*found) if found else self.spark.createDataFrame([], schema)
        return rows.withColumn("batch", F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1) if found else F.lit(""))

    def recover(self, sink: str | None = None) -> list[str]:
        """Drops unfinished batches; returns their identifiers."""
        marks = set(self.batches())
        left = sorted({n for n, _, _ in self.store.names("intents") if n.isdigit()} - marks)
        for b in left:
            scratch.drop_path(self.spark, f"{sink or self.path + '/output'}/batch={b}")
            self.store.delete(f"entries/batch={b}")
            self.store.delete(f"intents/{b}.claim")
            self.store.delete(f"intents/{b}")
        return left

    def run(self, plan: Callable[[], DataFrame], process: Callable[[DataFrame], DataFrame], sink: str | None = None, stop_after: str | None = None) -> str | None:
        """Processes what ``plan`` finds outstanding; ``process`` maps those entries to the rows to
        write. Returns the batch's identifier, or None if nothing was outstanding.

        ``stop_after``, one of ``STEPS``, makes the run fail behind that step."""
        self.recover(sink)
        done = self.batches()
        batch, owner = f"{int(done[-1]) + 1 if done else 1:09d}", uuid.uuid4().hex

        def stop(step: str) -> None:
            if stop_after == step:
                raise RuntimeError(f"stopped after the {step}")

        if not self.store.create(f"intents/{batch}", owner):
            raise RuntimeError("another run has just begun")
        stop("intent")
        seen = Observation()
        todo = plan()
        todo.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/entries/batch={batch}")
        stop("entries")
        if not seen.get["n"]:
            self.recover(sink)
            return None
        frozen = self.spark.read.schema(todo.schema).parquet(f"{self.path}/entries/batch={batch}")
        process(frozen).write.mode("overwrite").option("compression", "zstd").parquet(f"{sink or self.path + '/output'}/batch={batch}")
        stop("output")
        if not self.store.exists(f"intents/{batch}") or self.store.read(f"intents/{batch}") != owner or not self.store.create(f"marks/{batch}", owner):
            raise RuntimeError("another run took this one for dead and dropped it")
        return batch


class RecordManifest:
    """What subscriptions processed since their last successful runs, under ``path``."""

    ENTRIES = "subscription_id long, run_no int, table_name string, record_id long, row_no long, event_time timestamp, size int, checksum string"

    def __init__(self, spark: SparkSession, path: str):
        self.ledger = Ledger(spark, path)

    def run_batch(self, snapshots: DataFrame, lake_rows: DataFrame, runs: DataFrame, process: Callable[[DataFrame], DataFrame] | None = None, stop_after: str | None = None) -> str | None:
        """Hands each subscription what it has to process (:func:`pending`), writes the outcome under
        the batch's identifier and commits. ``process`` defaults to the entries themselves."""
        plan = lambda: pending(snapshots, lake_rows, runs, self.ledger.entries(self.ENTRIES) if self.ledger.batches() else None)
        return self.ledger.run(plan, process or (lambda todo: todo), stop_after=stop_after)

    def processed(self) -> DataFrame:
        """The entries of all finished batches."""
        return self.ledger.output(self.ENTRIES)


class FileManifest:
    """Input files already processed, each with size and checksum, under ``path``.

    ``outstanding`` lists a folder and anti-joins it against the manifest; ``run_batch`` processes
    what is outstanding as one batch of a :class:`Ledger`. A file that changed in place has another
    checksum and is outstanding again. A file whose size and time of change are those of its entry is
    taken for unchanged, so that a run doesn't read all files ever processed; with ``trust_times``
    off, the checksum of each is taken anew.
    """

    SCHEMA = "path string, size long, modified timestamp, checksum string"

    def __init__(self, spark: SparkSession, path: str, trust_times: bool = True):
        self.spark, self.ledger, self.trust_times = spark, Ledger(spark, path), trust_times

    def entries(self) -> DataFrame:
        return self.ledger.entries(self.SCHEMA)

    def listing(self, folder: str, glob: str = "*") -> DataFrame:
        """(path, size, modified, checksum). The contents are read only if the checksum is used."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
        return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("checksum"))

    def outstanding(self, folder: str, glob: str = "*") -> DataFrame:
        """Files the manifest lacks, or has with another size or checksum: those touched without a
        change are not outstanding."""
        known, listed = self.entries().groupBy("path").agg(F.max_by(F.struct("size", "modified", "checksum"), "batch").alias("k")).select("path", "k.*"), self.listing(folder, glob)
        if not self.trust_times:
            return listed.join(known.drop("modified"), ["path", "size", "checksum"], "left_anti").select("path", "size", "modified", "checksum")
        touched = listed.drop("checksum").join(known, ["path", "size", "modified"], "left_anti").select("path")
        out, paths = self.spark.createDataFrame([], self.SCHEMA), touched.toLocalIterator()
        while names := [r["path"] for r in itertools.islice(paths, FILES_A_READ)]:
            fresh = self.spark.read.format("binaryFile").load(names).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("checksum"))
            out = out.unionByName(scratch.materialise(fresh.join(known, ["path", "size", "checksum"], "left_anti"), "fresh"))
        return out

    def run_batch(self, folder: str, process: Callable[[DataFrame], DataFrame], sink: str, glob: str = "*", fail_before_commit: bool = False, stop_after: str | None = None) -> str | None:
        """Processes the outstanding files; ``process`` maps their entries (path, size, modified,
        checksum) to the rows to write. Read the sink by :meth:`output`: a run that died may have
        left rows there that the next one removes."""
        return self.ledger.run(lambda: self.outstanding(folder, glob), process, sink, "output" if fail_before_commit else stop_after)

    def output(self, schema, sink: str) -> DataFrame:
        return self.ledger.output(schema, sink)
