"""A scan of real files, from roots to ranked groups; what an index knows isn't read again."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyfold.checkpoints import checkpointed
from copyfold.operators import exact, filters, index, keeper, logs
from copyfold.options import ScanOptions
from copyfold.plans import scan
from copyfold.schema import CONTENT_INDEX, IMAGE_INDEX, RUNS
from copyfold.skew import join_groups
from copyfold.sources import drives, images, walk


@dataclass
class Screened:
    """What the exact cascade found: members; state of each candidate (path, source, size, state); entries for the index; files that couldn't be read; reads by kind."""

    members: DataFrame
    states: DataFrame
    entries: DataFrame
    errors: DataFrame
    reads: dict[str, int]


def exact_files(files: DataFrame, known: DataFrame, options: ScanOptions, prefix_bytes: int = walk.PREFIX) -> Screened:
    """The exact cascade over paths: size, index, prefix, digest, bytes, inodes. Only paths and digests move; contents are read where they are needed.

    Of the files of a size, those that ``known`` (a content index) has are not read. Where it has one, all others are hashed whole; where it
    has none, those that share their prefix. Bytes are compared in groups with a file that was hashed anew.
    """
    rows = checkpointed(index.lookup(exact.candidates(files), known if options.use_hash_cache else known.limit(0)))
    hit = F.col("sha256").isNotNull()
    sizes = rows.groupBy("size").agg(F.bool_or(hit).alias("_any"), F.count(F.lit(1)).alias("_n"))
    rows = checkpointed(join_groups(rows, sizes, "size", "_n", F.col("path")).drop("_n"))
    misses = rows.filter(~hit).drop("sha256")
    tasks = files.sparkSession.sparkContext.defaultParallelism
    screened = checkpointed(walk.with_file_digest(misses.filter("NOT _any").drop("_any").repartition(tasks, "path"), "prefix", prefix_bytes))
    read = screened.filter("prefix IS NOT NULL").withColumn("_key", F.concat_ws(":", "size", "prefix"))
    alike = read.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2")
    alike = join_groups(read, alike, "_key", "_n", F.col("path")).filter("_n IS NOT NULL").drop("_key", "_n", "prefix")
    whole = misses.filter("_any").drop("_any").unionByName(alike).repartition(tasks, "path")
    full = checkpointed(walk.with_file_digest(whole, "full_hash"))
    reused = rows.filter(hit).drop("_any").withColumnRenamed("sha256", "full_hash").withColumn("state", F.lit("reused"))
    digested = reused.unionByName(full.filter("full_hash IS NOT NULL").withColumn("state", F.lit("hashed")))
    found = checkpointed(exact.members(digested))
    compared = 0
    if options.verify_bytes:
        first = found.groupBy("group_id").agg(F.min("path").alias("first"), F.bool_or(F.col("state") == "hashed").alias("fresh"), F.count(F.lit(1)).alias("_n")).filter("fresh")
        pairs = join_groups(found.select("group_id", "path"), first, "group_id", "_n", F.col("path")).filter("first <> path").select("group_id", "path", "first")
        same = checkpointed(walk.with_same_bytes(pairs.repartition(tasks, "path")))
        compared = same.count()
        found = found.join(same.filter("same IS NULL OR NOT same").select("group_id").distinct(), "group_id", "left_anti")
    states = digested.select("path", "source", "size", "state").unionByName(screened.join(full.select("path"), "path", "left_anti").select("path", "source", "size", F.lit("prefix_only").alias("state")))
    entries = full.filter("full_hash IS NOT NULL").select("path", "dev", "ino", "size", "mtime", F.col("full_hash").alias("sha256"))
    entries = entries.withColumn("write_seq", F.monotonically_increasing_id())
    errors = screened.filter("prefix IS NULL").select("path", F.lit("prefix").alias("read")).unionByName(full.filter("full_hash IS NULL").select("path", F.lit("full").alias("read")))
    reads = {"prefix": screened.count(), "full": full.count(), "verify": compared}
    return Screened(exact.collapse_inodes(found.drop("full_hash", "state")), checkpointed(states), checkpointed(entries), errors, reads)


@dataclass
class Pictures:
    """What the image pass knows: prints (path, ph, dh, width, height) of images that can be read; state of each image; entries for the image index; files that are no images; how many were decoded."""

    prints: DataFrame
    states: DataFrame
    entries: DataFrame
    errors: DataFrame
    decoded: int


def image_files(files: DataFrame, known: DataFrame, options: ScanOptions, prints: Callable[[DataFrame], DataFrame] = images.file_prints) -> Pictures:
    """The fingerprints of the image files among ``files``, of which only those are decoded that ``known`` (an image index) doesn't have; a file that can't be decoded counts as hashed."""
    rows = index.image_prints(files.filter("is_image"), known if options.use_hash_cache else known.limit(0), prints)
    rows = checkpointed(rows.withColumn("state", F.when(F.col("reused"), "reused").otherwise("hashed")))
    good = rows.filter("phash IS NOT NULL")
    found = good.select("path", F.col("phash").alias("ph"), F.col("dhash").alias("dh"), "width", "height")
    fresh = good.filter("NOT reused").select("path", "size", "mtime", *index.IMAGE_VALUES, F.monotonically_increasing_id().alias("write_seq"))
    errors = rows.filter("phash IS NULL").select("path", F.lit("image").alias("read"))
    return Pictures(found, rows.select("path", "source", "size", "state"), fresh, errors, rows.filter("NOT reused").count())


@dataclass
class Scanned:
    """A scan's ranked members, the state of each candidate, unreadable files, the run's log row, and whether it was stopped."""

    members: DataFrame
    states: DataFrame
    errors: DataFrame
    run: dict
    index: str | None


def _drives(spark, roots: tuple[str, ...]) -> dict[str, dict]:
    """The drive of each root, as the run log has it, by the driver's mounts and block devices; a root without a mount has none."""
    if not roots:
        return {}
    found = drives.drives_of(spark.createDataFrame([(r,) for r in roots], "path string"), drives.mounts(spark), drives.block_devices(spark))
    return {r["path"]: {k: r[k] for k in ("model", "kind", "transport", "fstype")} | {"total": drives.capacity(r["path"])} for r in found.filter("mount IS NOT NULL").collect()}


def scan_files(
    spark, options: ScanOptions, index_folder: str | None = None, log_folder: str | None = None, prints: Callable[[DataFrame], DataFrame] = images.file_prints, index_version: str | None = None,
    on_groups: Callable[[str, DataFrame], None] | None = None, stop: Callable[[], bool] = lambda: False,
) -> Scanned:
    """Walk the roots of ``options``, group what is alike, rank it, save the index and log the run.

    ``on_groups`` gets each pass's name and members as soon as they are final. ``stop`` is asked before each pass;
    a stopped scan returns the groups it has, saves what it hashed and is logged as cancelled. ``index_version`` is the version of the index to start
    from; the new one is written below ``index_folder``, with that of images beside it. ``prints`` makes the fingerprints of image files, if ``options.find_images``.
    """
    began = time.time()
    files = checkpointed(scan.scoped(filters.distinct_files(walk.walk(spark, options)), options))
    known = index.load(spark, index_version, CONTENT_INDEX) if index_version else spark.createDataFrame([], CONTENT_INDEX)
    screened = exact_files(files, known, options)
    pictures = None
    if options.find_images:
        known_images = index.load(spark, index.beside(index_version, "images"), IMAGE_INDEX) if index_version else spark.createDataFrame([], IMAGE_INDEX)
        pictures = image_files(files, known_images, options, prints)
    passes = scan.group_passes(files, screened.members, options, pictures.prints if pictures else None)
    parts, cancelled = [], False
    for name, rows in passes:
        parts.append(rows)
        if on_groups is not None:
            on_groups(name, rows)
        if stop():
            cancelled = True
            passes.close()
            break
    ranked = checkpointed(scan.ranked(reduce(DataFrame.unionByName, parts), options))
    saved = index.save(index.upsert(known, screened.entries), index_folder) if index_folder else None
    states, errors, reads = screened.states, screened.errors, dict(screened.reads)
    if pictures:
        states, errors, reads["image"] = states.unionByName(pictures.states), errors.unionByName(pictures.errors), pictures.decoded
        if saved:
            index.upsert(known_images, pictures.entries).write.parquet(index.beside(saved, "images"))
    totals = keeper.scan_totals(states, ranked).head()
    counts = {r["source"]: r for r in index.reuse_counts(states).collect()}
    drive_of = _drives(spark, options.roots)
    sources = [
        {"path": r["source"], "files": r["files"], "bytes_scanned": r["bytes_scanned"], "hashed": counts[r["source"]]["hashed"] if r["source"] in counts else 0, "reused": counts[r["source"]]["reused"] if r["source"] in counts else 0, "drive": drive_of.get(r["source"])}
        for r in keeper.per_source(files, list(options.roots)).collect()
    ]
    run = {
        "seq": int(began * 1e6), "when": began, "tier": options.tier, "duration": time.time() - began, "cancelled": cancelled, "total_files": sum(s["files"] for s in sources), "groups": totals["groups"],
        "reclaimable": totals["reclaimable_sum"], "total_hashed": totals["hashed"], "total_reused": totals["reused"], "used_cache": options.use_hash_cache, "sources": sources,
    }
    if log_folder:
        logs.append(spark.createDataFrame([run], RUNS), log_folder)
    return Scanned(ranked, states, errors, run | {"reads": reads}, saved)


def main(arguments: list[str] | None = None) -> int:
    """``python -m copyfold ROOT...``: scan, print a line for each group and the run's totals; no file is touched."""
    import argparse

    from pyspark.sql import SparkSession

    parser = argparse.ArgumentParser(prog="copyfold", description="Find files that are alike; no file is touched.")
    parser.add_argument("roots", nargs="+")
    parser.add_argument("--index", help="folder in which index versions are kept")
    parser.add_argument("--index-version", help="version of the index to start from")
    parser.add_argument("--log", help="folder of the run log")
    parser.add_argument("--out", help="folder to write the ranked members to, as Parquet")
    parser.add_argument("--min-size", type=int, default=1)
    parser.add_argument("--hidden", action="store_true", help="take hidden files too")
    parser.add_argument("--exclude", action="append", default=[], help="a pattern of files or folders to leave out")
    parser.add_argument("--similar", action="store_true", help="group similar contents as well")
    parser.add_argument("--no-images", action="store_true", help="don't group images that look alike")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("copyfold").getOrCreate()
    options = ScanOptions(roots=tuple(given.roots), min_size=given.min_size, include_hidden=given.hidden, exclude=tuple(given.exclude), advanced_similar=given.similar, find_images=not given.no_images)
    result = scan_files(spark, options, given.index, given.log, index_version=given.index_version)
    if given.out:
        result.members.write.mode("overwrite").parquet(given.out)
    for row in keeper.groups_view(result.members).orderBy(F.desc("reclaimable"), "group_id").toLocalIterator():
        print(f"{row['kind']}\t{row['files']}\t{row['reclaimable']}\t{row['keeper']}")
    print(json.dumps({k: v for k, v in result.run.items() if k != "sources"} | {"index": result.index}))
    return 0
