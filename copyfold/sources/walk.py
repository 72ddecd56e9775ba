"""A data source of file metadata: roots are opened folder by folder until there are enough subtrees to share out."""

from __future__ import annotations

import fnmatch
import hashlib
import json
import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from copyfold.functions import dimensions as D
from copyfold.options import ScanOptions
from copyfold.schema import FILES

#: Bytes of a prefix hash and of a read.
PREFIX, CHUNK = 64 * 1024, 1024 * 1024
#: Subtrees that a scan is shared out in, about; levels of folders that are opened for that.
SUBTREES, LEVELS = 256, 4


class Subtree(InputPartition):
    """A folder of a root; ``deep`` is whether the folders below it belong to it. ``span`` are the times, in nanoseconds, between which its files changed."""

    def __init__(self, root: str, folder: str, deep: bool, span: tuple[int, int] | None = None):
        self.root, self.folder, self.deep, self.span = root, folder, deep, span


class WalkReader(DataSourceReader):
    """Lists files; folders that are out of scope are not entered, entries that can't be read are passed over."""

    def __init__(self, options: dict):
        self.options = json.loads(options.get("scan", "{}"))
        presets = self.options.get("exclusions", [])
        keys = list(D.PRESET_DIRS) if presets is None else presets
        self.dirs = {d for k in keys for d in D.PRESET_DIRS.get(k, ())}
        self.prefixes = [p for k in keys for p in D.PRESET_PREFIXES.get(k, ())]
        self.globs = [g for k in keys for g in D.PRESET_GLOBS.get(k, ())] + list(self.options.get("exclude", []))
        self.hidden = self.options.get("include_hidden", False)
        self.follow = self.options.get("follow_symlinks", False)
        self.ignored = set(self.options.get("ignore_dirs", []))

    def _enter(self, path: str, name: str) -> bool:
        if not self.hidden and name.startswith(".") or name in self.dirs or path in self.ignored:
            return False
        if any(fnmatch.fnmatchcase(path, g) or fnmatch.fnmatchcase(name, g) for g in self.globs):
            return False
        return not any(path == p or path.startswith(p + "/") for p in self.prefixes)

    def _entries(self, folder: str) -> list[os.DirEntry]:
        try:
            with os.scandir(folder) as found:
                return sorted(found, key=lambda e: e.name)
        except OSError:
            return []

    def _folders(self, folder: str) -> list[str]:
        out = []
        for e in self._entries(folder):
            try:
                if e.is_dir(follow_symlinks=self.follow) and self._enter(e.path, e.name) and not self._leads_up(e):
                    out.append(e.path)
            except OSError:
                continue
        return out

    @staticmethod
    def _leads_up(entry: os.DirEntry) -> bool:
        """Whether a link leads to a folder that it is in, so that following it would never end."""
        if not entry.is_symlink():
            return False
        target, folder = os.path.realpath(entry.path), os.path.realpath(os.path.dirname(entry.path))
        return folder == target or folder.startswith(target.rstrip("/") + "/")

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        open_ = [(root, root) for root in self.options.get("roots", []) if root not in self.ignored]
        for level in range(LEVELS):
            if level and len(parts) + len(open_) >= SUBTREES:
                break
            parts += [Subtree(root, folder, False) for root, folder in open_]
            open_ = [(root, f) for root, folder in open_ for f in self._folders(folder)]
        parts += [Subtree(root, folder, True) for root, folder in open_]
        return parts or [Subtree("", "", False)]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        stack = [partition.folder] if partition.folder else []
        while stack:
            folder = stack.pop()
            for e in self._entries(folder):
                if not self.hidden and e.name.startswith("."):
                    continue
                try:
                    if not e.is_file(follow_symlinks=self.follow):
                        continue
                    s = e.stat(follow_symlinks=self.follow)
                except OSError:
                    continue
                if partition.span and not partition.span[0] <= s.st_ctime_ns < partition.span[1]:
                    continue
                yield e.path, s.st_size, s.st_mtime, _signed(s.st_dev), _signed(s.st_ino), partition.root
            if partition.deep:
                stack += self._folders(folder)[::-1]


def _signed(n: int) -> int:
    """An unsigned 64-bit number as the bigint with the same bits."""
    return n - (1 << 64) if n >= 1 << 63 else n


class ArrivalReader(DataSourceStreamReader):
    """Files that came or changed since the last batch, by the time at which the file system says so: a file that is moved in with an old modification time counts too.

    An offset is a time; every batch walks the roots in subtrees, as the batch reader does. What changed within the last ``settle`` seconds
    waits for the next batch, as its clock may be behind.
    """

    def __init__(self, options: dict):
        self.walk, self.settle = WalkReader(options), float(options.get("settle", 1.0))

    def initialOffset(self) -> dict:
        return {"before": 0}

    def latestOffset(self) -> dict:
        return {"before": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        span = (start["before"], end["before"])
        return [Subtree(p.root, p.folder, p.deep, span) for p in self.walk.partitions()]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        return self.walk.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept that a batch could free."""


class WalkSource(DataSource):
    """``spark.read.format("copyfold_walk").option("scan", json)``, and the same with ``readStream`` for arrivals."""

    @classmethod
    def name(cls) -> str:
        return "copyfold_walk"

    def schema(self):
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return WalkReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ArrivalReader(self.options)


def walk(spark, options: ScanOptions) -> DataFrame:
    """Files below the roots of ``options``, with folders out of scope pruned; file filters follow as DataFrame operators."""
    spark.dataSource.register(WalkSource)
    return spark.read.format("copyfold_walk").option("scan", _scan(options)).load()


def arrivals(spark, options: ScanOptions, settle: float = 1.0) -> DataFrame:
    """A stream of the files below the roots of ``options`` as they come or change; its first batch has all that are there."""
    spark.dataSource.register(WalkSource)
    return spark.readStream.format("copyfold_walk").option("scan", _scan(options)).option("settle", str(settle)).load()


def _scan(options: ScanOptions) -> str:
    """What the walk has to know of ``options``."""
    return json.dumps({k: list(v) if isinstance(v, tuple) else v for k, v in vars(options).items() if k in ("roots", "exclusions", "exclude", "include_hidden", "follow_symlinks", "ignore_dirs")})


def file_digest(path: str, limit: int | None = None) -> str | None:
    """Hex SHA-256 of a file, or of its first bytes; null if it can't be read."""
    found = hashlib.sha256()
    try:
        with open(path, "rb") as f:
            left = limit
            while chunk := f.read(CHUNK if left is None else min(CHUNK, left)):
                found.update(chunk)
                if left is not None:
                    left -= len(chunk)
                    if not left:
                        break
    except OSError:
        return None
    return found.hexdigest()


def same_bytes(a: str, b: str) -> bool | None:
    """Whether two files are equal, read in step up to the first difference; null if one can't be read."""
    try:
        with open(a, "rb") as x, open(b, "rb") as y:
            while True:
                p, q = x.read(CHUNK), y.read(CHUNK)
                if p != q:
                    return False
                if not p:
                    return True
    except OSError:
        return None


def with_file_digest(files: DataFrame, name: str, limit: int | None = None) -> DataFrame:
    """``files`` with the digest of each file's content (or prefix) in the column ``name``. Reads the executors' file system."""
    at, names = files.columns.index("path"), [*files.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([file_digest(p, limit) for p in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=names)

    return files.mapInArrow(run, T.StructType([*files.schema, T.StructField(name, T.StringType())]))


def with_same_bytes(pairs: DataFrame) -> DataFrame:
    """``pairs`` (path, first) with the column same."""
    x, y, names = pairs.columns.index("path"), pairs.columns.index("first"), [*pairs.columns, "same"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([same_bytes(a, b) for a, b in zip(batch.column(x).to_pylist(), batch.column(y).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=names)

    return pairs.mapInArrow(run, T.StructType([*pairs.schema, T.StructField("same", T.BooleanType())]))
