"""Backups and keepers: what in a group is a backup, and which file stays.

Facts of a group are aggregates that combine before the shuffle and are joined
back, so a group of any size is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyfold.checkpoints import checkpointed
from copyfold.functions.scalars import backup_score, basename, depth, dirname, embedded_date, is_derived, pixels, under
from copyfold.skew import join_groups

#: Backups whose dates fall into one slot of so many seconds count as one generation.
SLOT_SECONDS = 300


def _with_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Members with the facts of their group (group_id, _n: its members, and more), however large a group is."""
    return join_groups(rows, checkpointed(facts), "group_id", "_n", F.col("path")).drop("_n")


def classify(files: DataFrame) -> DataFrame:
    """Add is_backup, backup_confidence and effective_date from each file's own name and place."""
    score, date = backup_score(F.col("path")), embedded_date(basename(F.col("path")))
    return (
        files.withColumn("backup_confidence", F.round(F.least(F.lit(1.0), score), 6))
        .withColumn("is_backup", score >= 0.5)
        .withColumn("effective_date", F.coalesce(date, F.col("mtime")))
    )


def classify_groups(members: DataFrame) -> DataFrame:
    """classify, and per group: two dated names make all dated ones backups; has_backups; is_newest.

    The newest is the file of the largest effective date, the first path of equals, and only set where there are backups.
    """
    rows = classify(members).withColumn("dated", embedded_date(basename(F.col("path"))).isNotNull())
    series = rows.groupBy("group_id").agg(
        F.count_if("dated").alias("n_dated"), F.bool_or("is_backup").alias("any_backup"),
        F.min_by("path", F.struct((-F.col("effective_date")).alias("d"), "path")).alias("newest"), F.count(F.lit(1)).alias("_n"),
    )
    rows = _with_facts(rows, series)
    in_series = F.col("dated") & (F.col("n_dated") >= 2)
    rows = rows.withColumn("is_backup", F.col("is_backup") | in_series).withColumn("backup_confidence", F.when(in_series, F.greatest("backup_confidence", F.lit(0.6))).otherwise(F.col("backup_confidence")))
    rows = rows.withColumn("has_backups", F.col("any_backup") | (F.col("n_dated") >= 2))
    return rows.withColumn("is_newest", F.col("has_backups") & (F.col("path") == F.col("newest"))).drop("dated", "n_dated", "any_backup", "newest")


def rank_key(preferred: tuple[str, ...], keep_newest: bool) -> Column:
    """A struct that is smallest for the file to keep."""
    backup_mode = F.col("has_backups") & F.lit(keep_newest)
    slot = F.when(backup_mode, F.floor(F.col("effective_date") / SLOT_SECONDS)).otherwise(0)
    original = F.when(backup_mode & F.col("is_backup"), 0).otherwise(F.when(backup_mode, 1).otherwise(0))
    area = F.when(F.col("kind") == "image", pixels(F.col("width"), F.col("height"))).otherwise(0)
    liked = F.lit(False)
    for root in preferred:
        liked = liked | under(F.col("path"), root)
    return F.struct(
        (-slot).alias("slot"), (-original).alias("original"), (-area).alias("area"), (-F.col("size")).alias("size"),
        is_derived(basename(F.col("path"))).alias("derived"), (~liked).alias("elsewhere"), F.col("mtime").alias("mtime"), depth(F.col("path")).alias("depth"), F.col("path").alias("path"),
    )


def rank(members: DataFrame, preferred: tuple[str, ...] = (), keep_newest: bool = True) -> DataFrame:
    """Add keeper to classified members (kind, width, height default to exact files): exactly one in each group."""
    for name, default in (("kind", F.lit("exact")), ("width", F.lit(0)), ("height", F.lit(0))):
        if name not in members.columns:
            members = members.withColumn(name, default)
    best = members.groupBy("group_id").agg(F.min(rank_key(preferred, keep_newest)).alias("k"), F.count(F.lit(1)).alias("_n")).select("group_id", "_n", F.col("k.path").alias("_keep"))
    return _with_facts(members, best).withColumn("keeper", F.col("path") == F.col("_keep")).drop("_keep")


def groups_view(ranked: DataFrame) -> DataFrame:
    """One row for each group: count, keeper, title, reclaimable, occupied, folders."""
    keeper = F.max(F.when(F.col("keeper"), F.col("path")))
    return ranked.groupBy("group_id", "kind").agg(
        F.count(F.lit(1)).alias("files"), keeper.alias("keeper"), F.coalesce(F.max(F.when(F.col("keeper"), basename(F.col("path")))), F.substring("group_id", 1, 12)).alias("title"),
        F.sum(F.when(~F.col("keeper"), F.col("size")).otherwise(0)).alias("reclaimable"), F.sum("size").alias("occupied"),
        F.array_join(F.array_sort(F.collect_set(dirname(F.col("path")))), ",").alias("folders"), F.bool_or("has_backups").alias("has_backups"),
    )


def ordered_members(ranked: DataFrame) -> DataFrame:
    """Members for display: keeper first, then by size, then by path."""
    return ranked.orderBy("group_id", F.desc("keeper"), F.desc("size"), "path")


def savings(ranked: DataFrame) -> DataFrame:
    """Totals over all groups; reclaimable_distinct counts a path once if several groups hold it."""
    by_path = ranked.groupBy("path").agg(F.max("size").alias("size"), F.bool_or("keeper").alias("kept"), F.sum(F.when(~F.col("keeper"), F.col("size")).otherwise(0)).alias("freed"), F.count(F.lit(1)).alias("n"))
    totals = by_path.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("files"), F.coalesce(F.sum("freed"), F.lit(0)).alias("reclaimable_sum"),
        F.coalesce(F.sum(F.when(F.col("freed") > 0, F.col("size"))), F.lit(0)).alias("reclaimable_distinct"), F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("occupied"),
    )
    groups = ranked.agg(F.count_if("keeper").alias("groups"))
    return totals.join(groups, F.lit(True)).withColumn("freed_fraction", F.when(F.col("occupied") > 0, F.round(F.least(F.lit(1.0), F.col("reclaimable_sum") / F.col("occupied")), 6)).otherwise(0.0))


def scan_totals(scanned: DataFrame, ranked: DataFrame) -> DataFrame:
    """One row of a whole scan: files, hashed and reused of ``scanned`` (path, state), and savings of its groups."""
    totals = scanned.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("state") == "hashed").alias("hashed"), F.count_if(F.col("state") == "reused").alias("reused"))
    return savings(ranked).join(totals, F.lit(True))


def per_source(files: DataFrame, roots: list[str]) -> DataFrame:
    """Files and bytes of every root, also of those without files."""
    spark = files.sparkSession
    counts = files.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    return spark.createDataFrame([(r,) for r in roots], "source string").join(counts, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("files"), F.coalesce("b", F.lit(0)).alias("bytes_scanned"))
