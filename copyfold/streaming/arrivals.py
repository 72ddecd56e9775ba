"""Incremental rescans as a stream: file arrivals merged into the index batch by batch."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyfold.checkpoints import checkpointed
from copyfold.operators import index as fingerprints
from copyfold.operators.filters import distinct_files
from copyfold.schema import CONTENT_INDEX
from copyfold.sources.walk import with_file_digest


class IndexStream:
    """Keeps the newest version of the content index while batches of digested files arrive.

    Each micro-batch is looked up, its misses are put in (and read, if their digests don't come with them), and a new version is
    written beside the old ones, named by the checkpoint that it belongs to and its epoch. All state is in ``folder``: after a
    restart the newest whole version goes on, and an epoch that is played again starts from the version before it and replaces its own.
    """

    def __init__(self, spark: SparkSession, folder: str, cap: int | None = None):
        self.spark, self.folder, self.cap = spark, folder.rstrip("/"), cap
        self.run = "direct"

    def _versions(self) -> list[tuple[int, str, int, str]]:
        """(time written, run, epoch, path) of the whole versions, oldest first."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        pattern = hadoop.Path(f"{self.folder}/run=*/epoch=*/_SUCCESS")
        found = pattern.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) or []
        out = []
        for status in found:
            folder = status.getPath().getParent()
            out.append((status.getModificationTime(), folder.getParent().getName().removeprefix("run="), int(folder.getName().removeprefix("epoch=")), folder.toString()))
        return sorted(out, key=lambda v: (v[0], v[2]))

    def _before(self, epoch: int) -> str | None:
        """The version that an epoch of this run builds on: the run's last one before it, else the newest of other runs."""
        versions = self._versions()
        own = [v for v in versions if v[1] == self.run and v[2] < epoch]
        other = [v for v in versions if v[1] != self.run]
        return max(own, key=lambda v: v[2])[3] if own else other[-1][3] if other else None

    @property
    def path(self) -> str | None:
        """The newest version; None before the first."""
        versions = self._versions()
        own = [v for v in versions if v[1] == self.run]
        return max(own, key=lambda v: v[2])[3] if own else versions[-1][3] if versions else None

    def _read(self, path: str | None) -> DataFrame:
        return self.spark.createDataFrame([], CONTENT_INDEX) if path is None else fingerprints.load(self.spark, path, CONTENT_INDEX)

    def current(self) -> DataFrame:
        return self._read(self.path)

    def counts(self) -> tuple[int, int]:
        """Files reused and hashed by all epochs whose version is whole."""
        whole = {(v[1], v[2]) for v in self._versions()}
        if not whole:
            return 0, 0
        rows = self.spark.read.schema("reused bigint, hashed bigint, run string, epoch bigint").parquet(f"{self.folder}/counts").collect()
        kept = [r for r in rows if (r["run"], r["epoch"]) in whole]
        return sum(r["reused"] for r in kept), sum(r["hashed"] for r in kept)

    @property
    def reused(self) -> int:
        return self.counts()[0]

    @property
    def hashed(self) -> int:
        return self.counts()[1]

    def take(self, batch: DataFrame, epoch: int) -> None:
        """Merge one batch (path, dev, ino, size, mtime). With a column full_hash, that is the files' digest; without it, files that the index doesn't know are read, each once, and those that can't be read are passed over."""
        known = self._read(self._before(epoch))
        digested = "full_hash" in batch.columns
        rows = fingerprints.lookup(batch if digested else distinct_files(batch), known).withColumn("hit", F.col("sha256").isNotNull())
        if not digested:
            rows = checkpointed(rows)
            read = checkpointed(with_file_digest(rows.filter(~F.col("hit")), "full_hash").filter("full_hash IS NOT NULL"))
            rows = rows.filter("hit").withColumn("full_hash", F.lit(None).cast("string")).unionByName(read)
        found = rows.agg(F.count_if("hit").alias("reused"), F.count_if(~F.col("hit")).alias("hashed"))
        found.write.mode("overwrite").parquet(f"{self.folder}/counts/run={self.run}/epoch={epoch}")
        fresh = rows.filter(~F.col("hit")).select("path", "dev", "ino", "size", "mtime", F.col("full_hash").alias("sha256"), F.lit(epoch).cast("bigint").alias("write_seq"))
        fingerprints.upsert(known, fresh, self.cap).write.mode("overwrite").parquet(f"{self.folder}/run={self.run}/epoch={epoch}")

    def start(self, arrivals: DataFrame, checkpoint: str):
        """Begin to merge a streaming DataFrame of files, as of ``walk.arrivals``; whatever has arrived is taken, then the query ends."""
        self.run = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]
        return arrivals.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
