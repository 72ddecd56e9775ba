"""The fingerprint index and scans that reuse it."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyfold.checkpoints import checkpointed
from copyfold.operators.exact import candidates
from copyfold.skew import join_groups

#: Entries to which a content index and an image index can be cut; nothing is cut unless a cap is asked for.
CONTENT_CAP, IMAGE_CAP = 300_000, 200_000
#: What an image index knows of a file.
IMAGE_VALUES = ("phash", "dhash", "width", "height")


def lookup(files: DataFrame, index: DataFrame, values: tuple[str, ...] = ("sha256",)) -> DataFrame:
    """Files with the indexed values where path, size and mtime agree; device and inode don't matter."""
    known = index.select("path", "size", "mtime", *values)
    return files.join(known, ["path", "size", "mtime"], "left")


def incremental(files: DataFrame, index: DataFrame) -> DataFrame:
    """What a rescan does with each candidate (a file that shares its size).

    Adds sha256 (indexed), state and full_hash: 'reused' for index hits; 'hashed'
    for misses in a size with a hit, or that share their prefix; 'prefix_only'
    for other misses, which have no full_hash. ``files`` has prefix and full_hash
    columns; only rows that come out as hashed need theirs to be computed.
    """
    rows = checkpointed(lookup(candidates(files), index))
    hit = F.col("sha256").isNotNull()
    sizes = rows.groupBy("size").agg(F.bool_or(hit).alias("any_hit"), F.count(F.lit(1)).alias("_n"))
    rows = join_groups(rows, sizes, "size", "_n", F.col("path")).drop("_n").withColumn("_bucket", F.concat_ws(":", "size", "prefix"))
    prefixes = rows.filter(~hit).groupBy("_bucket").agg(F.count(F.lit(1)).alias("alike"))
    rows = join_groups(rows, prefixes, "_bucket", "alike", F.col("path")).drop("_bucket")
    state = F.when(hit, "reused").when(F.col("any_hit") | (F.col("alike") >= 2), "hashed").otherwise("prefix_only")
    rows = rows.withColumn("state", state).drop("any_hit", "alike")
    return rows.withColumn("full_hash", F.when(hit, F.col("sha256")).when(F.col("state") == "hashed", F.col("full_hash")))


def reuse_counts(scanned: DataFrame) -> DataFrame:
    """Files reused and fully hashed, by source."""
    return scanned.groupBy("source").agg(F.count_if(F.col("state") == "reused").alias("reused"), F.count_if(F.col("state") == "hashed").alias("hashed"))


def image_prints(files: DataFrame, index: DataFrame, fingerprint) -> DataFrame:
    """``files`` with the IMAGE_VALUES of each and reused: looked up in an image index, else ``fingerprint`` of the misses.

    ``fingerprint`` makes (path, *IMAGE_VALUES) of the files that it is given; only misses are read. A file that it has no row for has nulls.
    """
    known = checkpointed(lookup(files, index, IMAGE_VALUES))
    hits, misses = known.filter("phash IS NOT NULL"), known.filter("phash IS NULL").drop(*IMAGE_VALUES)
    fresh = misses.join(fingerprint(misses).select("path", *IMAGE_VALUES), "path", "left")
    return hits.withColumn("reused", F.lit(True)).unionByName(fresh.withColumn("reused", F.lit(False)))


def upsert(index: DataFrame, entries: DataFrame, cap: int | None = None) -> DataFrame:
    """The index with ``entries`` (write_seq from 0 in the order written) put in; with ``cap``, the last so many written stay.

    A path that is there already keeps its place in that order.
    """
    columns = [c for c in index.columns if c not in ("path", "write_seq")]
    old = index.select("path", F.col("write_seq").alias("_seq"), F.struct(*columns).alias("_old"))
    new = entries.select("path", F.col("write_seq").alias("_new_seq"), F.struct(*columns).alias("_new"))
    start = (index.agg(F.max("write_seq")).head()[0] if index.columns else None) or 0
    merged = old.join(new, "path", "full").withColumn("_row", F.coalesce("_new", "_old"))
    merged = merged.select("path", *[F.col(f"_row.{c}").alias(c) for c in columns], F.coalesce(F.col("_seq"), F.col("_new_seq") + start + 1).alias("write_seq"))
    return merged if cap is None else merged.orderBy(F.desc("write_seq"), "path").limit(cap)


def invalidate(index: DataFrame, acted: DataFrame) -> DataFrame:
    """The index without the paths that an action changed."""
    return index.join(acted.select("path"), "path", "left_anti")


def save(index: DataFrame, folder: str) -> str:
    """Write a new version below ``folder``, never over one that a plan may be reading; returns its path."""
    path = f"{folder.rstrip('/')}/version={uuid.uuid4().hex}"
    index.write.parquet(path)
    return path


def beside(version: str, name: str) -> str:
    """Where what is called ``name`` is kept with a version of the index."""
    folder, _, own = version.rstrip("/").rpartition("/")
    return f"{folder}/{name}/{own}"


def load(spark, path: str, schema) -> DataFrame:
    """A saved version; one that is missing is an empty index. One that can't be read is an error, so that it isn't written over."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
