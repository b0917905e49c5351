"""Small files of state beside a table's data, through Hadoop, so on any file system Spark reads."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import SparkSession

CLAIM_SECONDS = 30  # a claim older than this, whose file never came, was left by a writer that died


class Store:
    """Files below ``root``. ``claim_seconds``: how long a writer may take between claiming a name
    and putting the file there."""

    def __init__(self, spark: SparkSession, root: str, claim_seconds: float = CLAIM_SECONDS):
        self.spark, self.root, self.claim_seconds = spark, root.rstrip("/"), claim_seconds
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def path(self, name: str):
        return self._path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.path(name))

    def names(self, folder: str) -> list[tuple[str, int, int]]:
        """(name, bytes, changed at) of the folder's files."""
        if not self.exists(folder):
            return []
        return [(s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in self._fs.listStatus(self.path(folder)) if s.isFile()]

    def folders(self, folder: str) -> list[str]:
        if not self.exists(folder):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(self.path(folder)) if s.isDirectory()]

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read_bytes(self, name: str) -> bytes:
        stream = self._fs.open(self.path(name))
        try:
            return bytes(self._io.toByteArray(stream))
        finally:
            stream.close()

    def _write(self, name: str, text: str | bytes) -> None:
        stream = self._fs.create(self.path(name), False)  # fails if it is there
        try:
            stream.write(bytearray(text.encode() if isinstance(text, str) else text))
        finally:
            stream.close()

    def _write_first(self, name: str, text: str) -> None:
        """Fails if it is there, for all but one of several at once: on local folders Hadoop looks and
        then writes, so two may succeed."""
        if self._fs.getScheme() != "file":
            return self._write(name, text)
        local = self.path(name).toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        with open(local, "x") as f:
            f.write(text)

    def put(self, name: str, data: str | bytes) -> None:
        """Writes the file beside and moves it into place, in place of an older one."""
        beside = f"_tmp/{uuid.uuid4().hex}"
        self._write(beside, data)
        self._fs.mkdirs(self.path(name).getParent())
        if not self._fs.rename(self.path(beside), self.path(name)):  # file systems whose renaming doesn't replace
            self.delete(name)
            if not self._fs.rename(self.path(beside), self.path(name)):
                raise OSError(f"{name} could not be written")

    def create(self, name: str, text: str) -> bool:
        """Writes the file unless it exists; whether it did. The whole text or nothing appears: it is
        written beside and renamed by whoever holds the name's claim, a file created exclusively
        (renaming alone replaces on some file systems). A claim has an owner and expires."""
        if self.exists(name):
            return False
        owner = uuid.uuid4().hex
        beside, claim = f"_tmp/{owner}", f"{name}.claim"
        self._write(beside, text)
        if not self._claim(name, claim, owner) or self.exists(name) or self.read(claim) != owner:
            self.delete(beside)
            return False
        return self._fs.rename(self.path(beside), self.path(name))

    def _claim(self, name: str, claim: str, owner: str) -> bool:
        try:
            self._write_first(claim, owner)
            return True
        except Exception:
            if not self.exists(claim):
                return False
        try:
            age = time.time() - self._fs.getFileStatus(self.path(claim)).getModificationTime() / 1000
            if age < self.claim_seconds or self.exists(name):
                return False
            # of several writers that see it expired, one can move it away
            if not self._fs.rename(self.path(claim), self.path(f"_tmp/{owner}.expired")):
                return False
            self.delete(f"_tmp/{owner}.expired")
            self._write_first(claim, owner)
            return True
        except Exception:  # another one was faster
            return False

    def rename(self, name: str, to: str) -> bool:
        self._fs.mkdirs(self.path(to).getParent())
        return self._fs.rename(self.path(name), self.path(to))

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)


class TaskStore:
    """The part of :class:`Store` that reads and puts whole files, for tasks: Python workers have no way
    to Spark's file systems, so it is for those pyarrow knows by their URI."""

    def __init__(self, root: str):
        from pyarrow import fs

        self.root, root = root.rstrip("/"), root.rstrip("/")
        if root.startswith(("/", "file:")):
            self._fs, self._at = fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")
        else:
            self._fs, self._at = fs.FileSystem.from_uri(root)

    def exists(self, name: str) -> bool:
        return bool(self._fs.get_file_info(f"{self._at}/{name}").type)

    def names(self, folder: str) -> list[tuple[str, int, int]]:
        """(name, bytes, changed at) of the folder's files."""
        from pyarrow import fs

        found = self._fs.get_file_info(fs.FileSelector(f"{self._at}/{folder}", allow_not_found=True))
        return [(f.base_name, f.size, (f.mtime_ns or 0) // 1_000_000) for f in found if f.is_file]

    def read(self, name: str) -> str:
        return self.read_bytes(name).decode()

    def read_bytes(self, name: str) -> bytes:
        with self._fs.open_input_file(f"{self._at}/{name}") as stream:
            return stream.read()

    def put(self, name: str, data: str | bytes) -> None:
        """Writes the file beside and moves it into place, in place of an older one."""
        beside, (folder, _, last) = f"{self._at}/_tmp/{uuid.uuid4().hex}", f"{self._at}/{name}".rpartition("/")
        self._fs.create_dir(f"{self._at}/_tmp")
        self._fs.create_dir(folder)
        with self._fs.open_output_stream(beside) as stream:
            stream.write(data.encode() if isinstance(data, str) else data)
        sums = f"{folder}/.{last}.crc"  # Hadoop's, of the older file
        if self._fs.get_file_info(sums).type:
            self._fs.delete_file(sums)
        self._fs.move(beside, f"{folder}/{last}")
