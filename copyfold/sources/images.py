"""Fingerprints of image files by Spark's image source, which decodes what the JVM's readers can."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyfold.checkpoints import checkpointed
from copyfold.functions import fingerprints

#: Files that are listed for one read, so that the driver never holds more paths.
FILES = 10_000


def _literal(path: str) -> str:
    """A path in which no character stands for others."""
    return re.sub(r"([\\\[\]{}*?,])", r"\\\1", path)


def _batches(paths: Iterator[str], size: int) -> Iterator[list[str]]:
    held: list[str] = []
    for path in paths:
        held.append(path)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def file_prints(files: DataFrame) -> DataFrame:
    """(path, phash, dhash, width, height) of image files by their paths; values are null for a file that is no image or can't be read.

    Paths go to the image source in lots of FILES; each lot is decoded once, and its fingerprints are in the shared folder
    before the next begins.
    """
    spark = files.sparkSession
    found = []
    for paths in _batches((r["path"] for r in files.select("path").toLocalIterator()), FILES):
        images = spark.read.format("image").option("dropInvalid", False).option("ignoreMissingFiles", True).load([_literal(p) for p in paths])
        made = fingerprints.image_fingerprints(images.filter("image.height > 0"))
        # the source names a file by its URI, in which a plus sign is itself
        path = F.url_decode(F.replace(F.regexp_replace("path", "^file:/+", "/"), F.lit("+"), F.lit("%2B")))
        made = made.withColumn("path", path).withColumnsRenamed({"ph": "phash", "dh": "dhash"})
        found.append(checkpointed(made))
    if not found:
        return files.select("path", F.lit(None).cast("bigint").alias("phash"), F.lit(None).cast("bigint").alias("dhash"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))
    return files.select("path").join(reduce(DataFrame.unionByName, found), "path", "left")
