"""Streams: landed segments into a lake, live tails, latest values, windows over event time."""

from __future__ import annotations

import json
import os
import time
import uuid
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loamlog.plans.store import Store, TaskStore
from loamlog.sources.lake import Conflict, Lake

# When a segment is sealed.
SEAL_ROWS, SEAL_SECONDS = 4096, 5

CANONICAL = T.StructType([T.StructField("timestamp", T.TimestampType()), *[T.StructField(n, T.StringType()) for n in ("host", "source", "sourcetype", "index", "raw")], T.StructField("timestamp_ns", T.LongType()), T.StructField("attributes", T.StringType())])


def landed(spark: SparkSession, folder: str, schema: T.StructType = CANONICAL, files_a_trigger: int = 1000) -> DataFrame:
    """The rows of Parquet segments as they land in a folder, with the segment's name."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)
    return rows.withColumn("segment", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def drain(segments: DataFrame, lake: Lake, checkpoint: str) -> StreamingQuery:
    """Commits each micro-batch with the names of the segments it consumed. A batch repeated after a
    failure finds its segments consumed and adds nothing."""

    def commit(batch: DataFrame, _: int) -> None:
        names = [r["segment"] for r in batch.select("segment").distinct().collect()]  # at most files_a_trigger
        done = lake.consumed() & set(names)
        fresh = batch.where(~F.col("segment").isin(*done)) if done else batch
        left = [n for n in names if n not in done]
        if left:
            try:
                lake.append(fresh.drop("segment"), consumed=left)
            except Conflict:
                if not set(left) <= lake.consumed():
                    raise

    return segments.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SERIES = ["host", "source", "sourcetype", "index"]


class Latest:
    """The newest row of each series of a stream, kept as a table under ``folder``: every micro-batch
    folds its own newest rows into it and writes the next generation. A row seen again or late changes
    nothing, and neither does a batch that is repeated. Nothing of it is held on the driver."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str] | None = None):
        self.spark, self.keys = spark, keys or SERIES
        self.store = Store(spark, folder)

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        best = F.max_by(F.struct(*rest), F.struct("timestamp_ns", "raw"))
        return rows.groupBy(*self.keys).agg(best.alias("x")).select(*self.keys, "x.*")

    def generation(self) -> int | None:
        found = [int(n) for n, _, _ in self.store.names("marks") if n.isdigit()]
        return max(found, default=None)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.store.root}/generations/{self.generation()}")

    def fold(self, batch: DataFrame, number: int) -> None:
        now = self.generation()
        if now is not None and now >= number:
            return
        rows = self._newest(batch)
        whole = rows if now is None else self._newest(self.read().unionByName(rows))
        whole.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.store.root}/generations/{number}")
        self.store.create(f"marks/{number}", "")
        if now is not None:
            self.store.delete(f"marks/{now}")
            self.store.delete(f"generations/{now}")

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_files(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream's finished rows to Parquet files, each once."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Tail:
    """A live tail: a stream's rows as they arrive, as files under ``folder``. ``batch`` and ``place`` are
    the order of their arrival. Readers see whole micro-batches only, up to the mark; one that is
    repeated replaces itself or, behind the mark, changes nothing. Nothing of it is held on the driver."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType):
        self.spark, self.schema = spark, T.StructType([*schema, T.StructField("place", T.LongType()), T.StructField("batch", T.LongType())])
        self.store = Store(spark, folder)

    def last(self) -> int | None:
        """The number of the newest whole batch."""
        return max((int(n) for n, _, _ in self.store.names("marks") if n.isdigit()), default=None)

    def read(self, after: int = -1) -> DataFrame:
        """The rows of the batches behind ``after``."""
        last = self.last()
        if last is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.store.root}/rows").where(F.col("batch").between(after + 1, last))

    def add(self, batch: DataFrame, number: int) -> None:
        last = self.last()
        if last is not None and last >= number:
            return
        batch.withColumn("place", F.monotonically_increasing_id()).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.store.root}/rows/batch={number}")
        self.store.create(f"marks/{number}", "")
        if last is not None:
            self.store.delete(f"marks/{last}")

    def follow(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(stream: DataFrame, width: str, slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Counts a window and source; rows later than ``lateness`` are dropped."""
    w = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    return stream.withWatermark("timestamp", lateness).groupBy(w.alias("w"), "source").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "source", "n")


def sessions(stream: DataFrame, gap: str, lateness: str = "10 minutes") -> DataFrame:
    """Counts a host's sessions: stretches without a pause longer than ``gap``."""
    return stream.withWatermark("timestamp", lateness).groupBy(F.session_window("timestamp", gap).alias("w"), "host").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "host", "n")


# Segments: Arrow streams with a checksum, consumed in order

SEALED, CLAIMED, COMMITTED = "sealed", "claimed", "committed"


class Segments:
    """A producer's folder of sealed segments, and consumers' durable cursors beside it, on any file
    system Spark reads.

    A segment is an Arrow stream followed by its CRC-32. It appears whole. Drainers share segments by
    their state: one claims a sealed segment for a while, and finishes it once its rows are committed
    elsewhere, or releases it; a claim that ran out is open to others again. In a task ``store`` is a
    :class:`TaskStore`, which has no claims.
    """

    def __init__(self, folder: str, spark: SparkSession | None = None, store: TaskStore | None = None):
        self.folder = folder
        self.store = store or Store(spark or SparkSession.active(), folder if ":" in folder else f"file://{os.path.abspath(folder)}")

    def seal(self, name: str, table) -> None:
        import pyarrow as pa

        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        data = sink.getvalue().to_pybytes()
        self.store.put(f"sealed/{name}", data + zlib.crc32(data).to_bytes(4, "big"))

    def names(self) -> list[str]:
        return sorted(n for n, _, _ in self.store.names("sealed") if not n.startswith("."))

    def read(self, name: str):
        import pyarrow as pa

        try:
            data = self.store.read_bytes(f"sealed/{name}")
        except Exception as e:  # a file system with checksums of its own
            if "ChecksumException" in str(e):
                raise ValueError(f"the segment {name} is damaged") from e
            raise
        if len(data) < 4 or zlib.crc32(data[:-4]) != int.from_bytes(data[-4:], "big"):
            raise ValueError(f"the segment {name} is damaged")
        return pa.ipc.open_stream(data[:-4]).read_all()

    def rows(self, names: list[str]):
        """The rows of a few segments: a consumer's batch."""
        import pyarrow as pa

        return pa.concat_tables([self.read(n) for n in names])

    def frame(self, spark: SparkSession, names: list[str]) -> DataFrame:
        return spark.createDataFrame(self.rows(names))

    def open(self, consumer: str) -> Consumer:
        return Consumer(self, consumer)

    # The state of a segment: a file of its own for each step, the last one holds

    def _steps(self, name: str) -> list[tuple[int, dict]]:
        found = sorted(int(n.split(".")[0]) for n, _, _ in self.store.names(f"state/{name}") if n.endswith(".json"))
        return [(k, json.loads(self.store.read(f"state/{name}/{k}.json"))) for k in found[-1:]]

    def state(self, name: str, now: float | None = None) -> str:
        return self._state(self._steps(name), now)

    def _state(self, steps: list[tuple[int, dict]], now: float | None) -> str:
        if not steps:
            return SEALED
        last = steps[-1][1]
        if last["state"] == CLAIMED and last["until"] <= (time.time() if now is None else now):
            return SEALED
        return last["state"]

    def _step(self, name: str, steps: list[tuple[int, dict]], step: dict) -> bool:
        """Adds a step to those that were seen, unless someone else did so first."""
        return self.store.create(f"state/{name}/{steps[-1][0] + 1 if steps else 1}.json", json.dumps(step))

    def claim(self, claimer: str, at_most: int = 100, seconds: float = 300, now: float | None = None) -> list[str]:
        """Claims sealed segments, the oldest first; two claimers never get the same one."""
        now = time.time() if now is None else now
        out: list[str] = []
        for name in self.names():
            if len(out) == at_most:
                break
            steps = self._steps(name)
            if self._state(steps, now) == SEALED and self._step(name, steps, {"state": CLAIMED, "claimer": claimer, "until": now + seconds}):
                out.append(name)
        return out

    def _held(self, name: str, claimer: str) -> list[tuple[int, dict]]:
        steps = self._steps(name)
        if not steps or steps[-1][1]["state"] != CLAIMED or steps[-1][1]["claimer"] != claimer:
            raise ValueError(f"{name} isn't claimed by {claimer}")
        return steps

    def release(self, name: str, claimer: str) -> None:
        self._step(name, self._held(name, claimer), {"state": SEALED})

    def finish(self, name: str, claimer: str) -> None:
        """The segment's rows are committed. A claim that ran out can be finished as long as no other
        claimer took the segment: whoever commits rows does so by the segment's name, once."""
        if not self._step(name, self._held(name, claimer), {"state": COMMITTED, "claimer": claimer}):
            raise ValueError(f"{name} was taken by another claimer")


class Producer:
    """Rows on their way into segments: sealed at ``SEAL_ROWS`` rows, or when the first of them has
    waited for ``SEAL_SECONDS``."""

    def __init__(self, segments: Segments, prefix: str, rows: int = SEAL_ROWS, seconds: float = SEAL_SECONDS):
        self.segments, self.prefix, self.rows, self.seconds = segments, prefix, rows, seconds
        self.waiting: list = []
        self.since: float | None = None
        self.n = sum(n.startswith(prefix) for n in segments.names())

    def append(self, table, now: float | None = None) -> list[str]:
        """Takes rows; returns the names of the segments sealed by that."""
        now = time.time() if now is None else now
        out = self.tick(now)
        if table.num_rows:
            self.since = now if self.since is None else self.since
            self.waiting.append(table)
        while sum(t.num_rows for t in self.waiting) >= self.rows:
            out.append(self._seal(self.rows))
            self.since = now if self.waiting else None
        return out

    def tick(self, now: float | None = None) -> list[str]:
        """Seals what has waited long enough."""
        now = time.time() if now is None else now
        return self.flush() if self.since is not None and now - self.since >= self.seconds else []

    def flush(self) -> list[str]:
        out = [self._seal(self.rows) for _ in range(-(-sum(t.num_rows for t in self.waiting) // self.rows))]
        self.since = None
        return out

    def _seal(self, rows: int) -> str:
        import pyarrow as pa

        whole = pa.concat_tables(self.waiting)
        name = f"{self.prefix}-{self.n:012d}"
        self.segments.seal(name, whole.slice(0, rows))
        self.n += 1
        rest = whole.slice(rows)
        self.waiting = [rest] if rest.num_rows else []
        return name


class Consumer:
    """poll, read, commit: what isn't committed is polled again."""

    def __init__(self, segments: Segments, name: str):
        self.segments, self.name = segments, name
        self.cursor_file = f"consumers/{name}.json"

    @property
    def last(self) -> str | None:
        store = self.segments.store
        return json.loads(store.read(self.cursor_file))["last_segment_name"] if store.exists(self.cursor_file) else None

    def poll(self, at_most: int = 100) -> list[str]:
        last = self.last
        return [n for n in self.segments.names() if last is None or n > last][:at_most]

    def read(self, spark: SparkSession, names: list[str]) -> DataFrame:
        return self.segments.frame(spark, names)

    def commit(self, name: str) -> None:
        if self.last is not None and name < self.last:
            raise ValueError("a cursor doesn't move back")
        self.segments.store.put(self.cursor_file, json.dumps({"last_segment_name": name}))


# Producers and consumers in tasks

SEGMENTS_A_FOLDER = 512  # each poll lists a folder, so a producer goes on in another one after so many


def produce(rows: DataFrame, folder: str, segment_rows: int = SEAL_ROWS, append_rows: int = 10_000) -> list[str]:
    """Seals a table's rows, by a producer for each of its partitions that appends ``append_rows`` at a
    time. Returns the folders of segments, below ``folder``; what a failed try of a task left isn't
    among them."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        at: list[str] = []
        producer = None
        for batch in batches:
            for start in range(0, batch.num_rows, append_rows):
                if producer is None or producer.n >= SEGMENTS_A_FOLDER:
                    if producer:
                        producer.flush()
                    at.append(f"{folder}/{uuid.uuid4().hex}")
                    producer = Producer(Segments(at[-1], store=TaskStore(at[-1])), "p", rows=segment_rows)
                producer.append(pa.Table.from_batches([batch.slice(start, append_rows)]), now=0.0)
        if producer:
            producer.flush()
        yield pa.RecordBatch.from_pydict({"folder": pa.array(at, pa.string())})

    return [r["folder"] for r in rows.mapInArrow(run, "folder string").collect()]


def consume(spark: SparkSession, folders: list[str], loop: Callable[[Segments], None]) -> None:
    """Runs a consumer's loop over each folder of segments, each in a task of its own. A task that is
    tried again goes on at its consumer's cursor."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in batch.column(0).to_pylist():
                loop(Segments(folders[i], store=TaskStore(folders[i])))
        yield pa.RecordBatch.from_pydict({"id": pa.array([], pa.int64())})

    if folders:
        spark.range(0, len(folders), 1, len(folders)).mapInArrow(run, "id long").collect()


def keep(store: TaskStore, name: str, rows) -> None:
    """Puts an Arrow table as a Parquet file, in place of one of the same name."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    sink = pa.BufferOutputStream()
    pq.write_table(rows, sink, compression="zstd")
    store.put(name, sink.getvalue().to_pybytes())
