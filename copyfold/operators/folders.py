"""Folders above paths, for tables of folders of any size: joins on equal folders, never on prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyfold.checkpoints import checkpointed
from copyfold.functions.scalars import dirname
from copyfold.skew import join_groups


def ancestors(folder: Column) -> Column:
    """A folder and all folders above it, each once, from the topmost on."""
    parts = F.size(F.split(folder, "/", -1))
    each = F.transform(F.sequence(F.lit(1), parts), lambda n: F.call_function("substring_index", folder, F.lit("/"), n))
    return F.array_distinct(F.transform(each, lambda f: F.when((f == "") & F.startswith(folder, F.lit("/")), "/").otherwise(f)))


def deepest_folder(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """``paths`` (path and others) with ``folder``: the deepest of ``folders`` (folder) at or above each path, null if there is none.

    Distinct parent folders are looked up instead of paths, each by all folders above it; a folder above very many, as
    the root, and a parent of very many paths are in no single task.
    """
    named = folders.select("folder").distinct()
    parents = checkpointed(paths.groupBy(dirname(F.col("path")).alias("_parent")).agg(F.count(F.lit(1)).alias("_files")))
    above = parents.select("_parent", F.explode(ancestors(F.col("_parent"))).alias("folder"))
    known = above.groupBy("folder").agg(F.count(F.lit(1)).alias("_uses")).join(named, "folder")
    hits = join_groups(above, checkpointed(known), "folder", "_uses", F.col("_parent")).filter("_uses IS NOT NULL")
    deepest = hits.groupBy("_parent").agg(F.max_by("folder", F.length("folder")).alias("_above"))
    found = checkpointed(parents.join(deepest, "_parent", "left"))
    rows = join_groups(paths.withColumn("_parent", dirname(F.col("path"))), found, "_parent", "_files", F.col("path"))
    rows = rows.join(named.select(F.col("folder").alias("_own")), F.col("path") == F.col("_own"), "left")
    return rows.select(*paths.columns, F.coalesce("_own", "_above").alias("folder"))


def drop_below(files: DataFrame, folders: DataFrame) -> DataFrame:
    """``files`` without those at or below one of ``folders`` (folder), a table of any size."""
    return deepest_folder(files, folders).filter("folder IS NULL").drop("folder")
