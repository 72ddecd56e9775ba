"""Exact groups: size, prefix, digest, bytes, inodes.

Content is digested where it is read, so only digests move, and is read once: digests are
checkpointed. Counts of sizes and digests combine before the shuffle and come back
to the rows by ``join_groups``, so a size or digest that very many files have is in no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyfold.checkpoints import checkpointed
from copyfold.skew import join_groups


#: Bytes of a content that are compared as one.
CHUNK = 1 << 20
#: Groups of one digest and different bytes that are broadcast, at most.
DIFFERING = 10_000


def size_buckets(files: DataFrame) -> DataFrame:
    """Sizes that more than one file has, with the number of files."""
    return files.groupBy("size").agg(F.count(F.lit(1)).alias("files")).filter("files >= 2")


def candidates(files: DataFrame) -> DataFrame:
    """Files that share their size with another; content had better not be a column yet."""
    sizes = size_buckets(files).withColumnRenamed("files", "_files")
    return join_groups(files, sizes, "size", "_files", F.col("path")).filter("_files IS NOT NULL").drop("_files")


def with_digests(files: DataFrame, prefix_bytes: int = 65536) -> DataFrame:
    """Replace binary ``content`` by prefix (a hash of its first bytes) and full_hash (hex SHA-256)."""
    return files.withColumn("prefix", F.xxhash64(F.substring("content", 1, prefix_bytes))).withColumn("full_hash", F.sha2("content", 256)).drop("content")


def prefix_buckets(digested: DataFrame) -> DataFrame:
    """(size, prefix) that more than one file has."""
    return digested.groupBy("size", "prefix").agg(F.count(F.lit(1)).alias("files")).filter("files >= 2")


def digest_groups(digested: DataFrame) -> DataFrame:
    """Groups of files of one size and digest: group_id (the digest), size, files. Files that couldn't be read have no digest and are in none."""
    return digested.filter("full_hash IS NOT NULL").groupBy(F.col("full_hash").alias("group_id"), "size").agg(F.count(F.lit(1)).alias("files")).filter("files >= 2")


def members(digested: DataFrame) -> DataFrame:
    """The files of all digest groups, with group_id; sizes and digests are taken once and checkpointed."""
    return members_of(checkpointed(digested))


def members_of(rows: DataFrame) -> DataFrame:
    """members of ``rows`` that are written down already."""
    groups = digest_groups(rows).select(F.concat_ws(":", "group_id", F.col("size")).alias("_group"), F.col("files").alias("_files"))
    found = join_groups(rows.withColumn("_group", F.concat_ws(":", "full_hash", F.col("size"))), groups, "_group", "_files", F.col("path"))
    return found.filter("_files IS NOT NULL").drop("_group", "_files").withColumn("group_id", F.col("full_hash"))


def verified(found: DataFrame, files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``found`` (group_id, path) without the groups whose files' bytes aren't all the same.

    Contents are taken apart where they are read: what moves are digests of chunks, of another kind than the one
    that made the groups. The smallest and the largest digest of a group's chunk are equal if and only if all are, and each chunk must be in all
    files; all these combine before the shuffle. A group is dropped whole, also for a content that is null.
    """
    last = F.greatest(F.ceil(F.length("content") / chunk).cast("int") - 1, F.lit(0))
    digests = F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring("content", i * chunk + 1, chunk), 512))
    parts = files.select("path", F.posexplode(F.when(F.col("content").isNull(), F.array(F.lit(None).cast("string"))).otherwise(digests)).alias("chunk", "part"))
    rows = parts.join(found.select("group_id", "path"), "path")
    ends = rows.groupBy("group_id", "chunk").agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count("part").alias("read"), F.count(F.lit(1)).alias("n"))
    unlike = (F.col("read") < F.col("n")) | (F.col("least") != F.col("most"))
    groups = ends.groupBy("group_id").agg(F.bool_or(F.coalesce(unlike, F.lit(True))).alias("unlike"), F.min("n").alias("low"), F.max("n").alias("high"))
    differ = checkpointed(groups.filter("unlike OR low <> high").select("group_id"))
    if differ.count() <= DIFFERING:
        return found.join(F.broadcast(differ), "group_id", "left_anti")
    return found.join(differ, "group_id", "left_anti")


def collapse_inodes(found: DataFrame) -> DataFrame:
    """One path (the first) for each inode of a group, and only groups with two inodes or more."""
    rest = [c for c in found.columns if c not in ("group_id", "dev", "ino")]
    each = found.groupBy("group_id", "dev", "ino").agg(F.min_by(F.struct(*rest), "path").alias("f"))
    each = each.select("group_id", "dev", "ino", "f.*").select(*found.columns)
    groups = each.groupBy("group_id").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2").select("group_id")
    return each.join(groups, "group_id", "left_semi")


def exact_members(files: DataFrame, verify_bytes: bool = True, prefix_bytes: int = 65536, digested: DataFrame | None = None) -> DataFrame:
    """The whole cascade over files with binary content: size, prefix, digest, bytes, inodes.

    Content is hashed in the scan that reads it, so neither screen moves content: size and prefix are checked among the digests.
    ``digested`` is with_digests of the files, if it is written down already.
    """
    found = (members(with_digests(files, prefix_bytes)) if digested is None else members_of(digested)).drop("prefix")
    if verify_bytes:
        found = verified(found, files)
    return collapse_inodes(found)
