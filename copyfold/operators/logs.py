"""Run log, action log, action plans, glossary, previews and mounts."""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyfold.functions.dimensions import PREVIEW_EXTENSIONS, PROTECTED
from copyfold.functions.scalars import basename, extension, human_bytes, under
from copyfold.operators.folders import deepest_folder
from copyfold.schema import ACTIONS_LOG, GLOSSARY, RUNS

#: Entries that the run log and the action log keep; a change of duration by this factor is one.
RUNS_KEPT, ACTIONS_KEPT, CHANGED = 50, 100, 1.15


def run_stats(runs: DataFrame) -> DataFrame:
    """Runs with fingerprinted, cache_hit_pct (half to even), throughput and bytes_scanned, newest first, the last RUNS_KEPT."""
    total = F.col("total_hashed") + F.col("total_reused")
    out = runs.withColumn("fingerprinted", total)
    out = out.withColumn("cache_hit_pct", F.when(total > 0, F.bround(F.lit(100.0) * F.col("total_reused") / total)).otherwise(0.0).cast("bigint"))
    out = out.withColumn("throughput", F.when(F.col("duration") > 0, F.col("total_files") / F.col("duration")).otherwise(0.0))
    return out.orderBy(F.desc("seq")).limit(RUNS_KEPT)


def compare_runs(runs: DataFrame) -> DataFrame:
    """Each run's nearest earlier one that wasn't cancelled, of the same tier and set of sources, and how the durations compare.

    ``runs`` has seq, tier, sources (array of paths), duration, cancelled. verdict
    is faster, slower, same, or null if there is nothing to compare.
    """
    key = F.array_join(F.array_sort(F.array_distinct(F.transform("sources", lambda s: F.rtrim(s, F.lit("/"))))), "\n")
    before = Window.partitionBy("tier", "_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.last(F.when(~F.col("cancelled"), F.struct("seq", "duration")), ignorenulls=True).over(before)
    rows = runs.withColumn("_key", key).withColumn("_old", earlier)
    old, now = F.col("_old.duration"), F.col("duration")
    verdict = F.when(F.col("cancelled") | old.isNull() | (now <= 0) | (old <= 0), F.lit(None).cast("string")).when(now <= old / CHANGED, "faster").when(now >= old * CHANGED, "slower").otherwise("same")
    return rows.select("seq", "tier", "duration", "cancelled", F.col("_old.seq").alias("previous_seq"), old.alias("previous_duration"), verdict.alias("verdict"))


def last_run_per_source(runs: DataFrame) -> DataFrame:
    """The newest run that covers each source."""
    return runs.select("seq", "duration", F.explode("sources").alias("source")).groupBy("source").agg(F.max_by(F.struct("seq", "duration"), "seq").alias("r")).select("source", "r.seq", "r.duration")


def action_log(actions: DataFrame) -> DataFrame:
    """Actions with after_bytes, newest first, the last ACTIONS_KEPT."""
    return actions.withColumn("after_bytes", F.greatest(F.lit(0), F.col("before_bytes") - F.col("freed"))).orderBy(F.desc("when"), F.desc("before_bytes")).limit(ACTIONS_KEPT)


def append(entry: DataFrame, folder: str) -> None:
    """Add the rows of ``entry`` to a log; each append is a file of its own, so nothing is written over."""
    entry.coalesce(1).write.mode("append").parquet(folder)


def load_log(spark, folder: str, schema) -> DataFrame:
    """A log's rows in no order; one that is missing is empty."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def load_runs(spark, folder: str) -> DataFrame:
    """The run log, newest first, the last RUNS_KEPT."""
    return load_log(spark, folder, RUNS).orderBy(F.desc("seq")).limit(RUNS_KEPT)


def load_actions(spark, folder: str) -> DataFrame:
    """The action log with after_bytes, newest first, the last ACTIONS_KEPT."""
    return action_log(load_log(spark, folder, ACTIONS_LOG))


def action_entry(outcomes: DataFrame, action: str, when: float, before_bytes: int) -> DataFrame:
    """The log row of a confirmed action from its ``outcomes`` (path, size, done, error): ok if any file was done, and the first error by path."""
    return outcomes.agg(
        F.lit(float(when)).alias("when"), F.lit(action).alias("action"), F.count_if("done").cast("bigint").alias("files"), F.coalesce(F.sum(F.when(F.col("done"), F.col("size"))), F.lit(0)).cast("bigint").alias("freed"),
        F.lit(before_bytes).cast("bigint").alias("before_bytes"), (F.count_if("done") > 0).alias("ok"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("path"))).alias("error"),
    ).select(*ACTIONS_LOG.names)


def protected(path: Column, home: str | None = None) -> Column:
    """Whether a path is one that no action touches; what lies below it may be acted on."""
    stripped = F.rtrim(F.regexp_replace(F.regexp_replace(path, "/(?:[.]?/)+", "/"), "/[.]$", ""), F.lit("/"))
    return (path == "/") | stripped.isin(*[p.rstrip("/") for p in (*PROTECTED, home or str(Path.home()))])


def action_plan(ranked: DataFrame, action: str = "trash", ignored: Column | None = None, delete_all: tuple[str, ...] = ()) -> DataFrame:
    """What would be done with each selected file: (group_id, path, size, action, status). Nothing is touched.

    Extras are selected, and keepers of the groups in ``delete_all``, which
    'link' passes over. status: refused (protected), cross_fs, already_linked, or the action.
    """
    whole = F.col("group_id").isin(*delete_all) if delete_all else F.lit(False)
    rows = ranked if ignored is None else ranked.filter(~ignored)
    refused = protected(F.col("path"))
    if action == "trash":
        chosen = rows.filter(~F.col("keeper") | whole)
        return chosen.select("group_id", "path", "size", F.lit("trash").alias("action"), F.when(refused, "refused").otherwise("trash").alias("status"))
    keepers = ranked.filter("keeper").select("group_id", F.col("dev").alias("_dev"), F.col("ino").alias("_ino"))
    chosen = rows.filter(~F.col("keeper") & ~whole).join(keepers, "group_id")
    status = F.when(refused, "refused").when(F.col("dev") != F.col("_dev"), "cross_fs").when(F.col("ino") == F.col("_ino"), "already_linked").otherwise("link")
    return chosen.select("group_id", "path", "size", F.lit("link").alias("action"), status.alias("status"))


def plan_totals(plan: DataFrame) -> DataFrame:
    """Files and bytes of a plan by status."""
    return plan.groupBy("action", "status").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def load_glossary(spark, path: str) -> DataFrame:
    """Entries of a JSON file {"entries": [...]}; unknown keys are dropped, missing ones null."""
    from pyspark.sql import types as T

    document = T.StructType([T.StructField("entries", T.ArrayType(GLOSSARY))])
    return spark.read.schema(document).json(path, multiLine=True).select(F.posexplode("entries").alias("pos", "e")).select("pos", "e.*")


def search_glossary(entries: DataFrame, query: str) -> DataFrame:
    """Entries whose term, short, body or aliases hold the trimmed query, whatever the case; a blank query finds all."""
    text = F.lower(F.concat_ws(" ", "term", "short", "body", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " ")))
    return entries.filter(F.contains(text, F.lit(query.strip().lower())))


def glossary_entry(entries: DataFrame, key: str) -> DataFrame:
    """The entry of a key: no row or one, the first listed."""
    return entries.filter(F.col("key") == key).orderBy("pos").limit(1)


def glossary_short(entries: DataFrame, key: str) -> str:
    """The short text of a key; empty if there is none."""
    found = glossary_entry(entries, key).select("short").head()
    return (found["short"] or "") if found else ""


def categories(entries: DataFrame) -> DataFrame:
    """Categories in the order in which they first appear, with their entries."""
    return entries.groupBy("category").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("entries")).orderBy("first")


def preview_kind(path: Column, head: Column) -> Column:
    """image, video, audio, pdf, office, archive or text by extension; else text if ``head`` (binary) has bytes and none is zero, else meta."""
    ext = extension(basename(path))
    out = None
    for kind, names in PREVIEW_EXTENSIONS.items():
        out = F.when(ext.isin(*names), kind) if out is None else out.when(ext.isin(*names), kind)
    first = F.substring(head, 1, 512)
    sniffed = F.when((F.length(first) > 0) & ~F.contains(first, F.lit(b"\x00")), "text").otherwise("meta")
    return out.otherwise(sniffed)


# What ends a line of a text.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def preview_text(content: Column, lines: int = 200, limit: int = 65536) -> Column:
    """The first lines of the first bytes of a text; bytes that are no UTF-8, as a character cut at the limit, are replaced."""
    text = F.make_valid_utf8(F.substring(content, 1, limit).cast("string"))
    found = F.split(text, LINE_END, -1)
    # a line end at the end begins no line
    found = F.when(F.element_at(found, -1) == "", F.slice(found, 1, F.size(found) - 1)).otherwise(found)
    return F.array_join(F.slice(found, 1, lines), "\n")


def preview_meta(path: Column, size: Column) -> Column:
    ext = F.upper(F.substring(extension(basename(path)), 2, 20))
    return F.concat_ws(" · ", F.when(ext == "", "FILE").otherwise(ext), human_bytes(size))


def mount_of(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """Each path, once, with its mount: the longest mount point at or above it, the last listed of equals.

    ``mounts`` has mount, line and further columns.
    """
    rest = [c for c in mounts.columns if c not in ("mount", "line")]
    listed = mounts.groupBy("mount").agg(F.max_by(F.struct("mount", *rest), "line").alias("m"))
    found = deepest_folder(paths.select("path").distinct(), listed.select(F.col("mount").alias("folder")))
    return found.join(listed.withColumnRenamed("mount", "folder"), "folder", "left").select("path", "m.*")
