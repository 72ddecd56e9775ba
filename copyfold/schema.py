"""Schemas of the engine's tables."""

from pyspark.sql import types as T

#: One row for each file; flags that depend on a group are columns of its members instead.
FILES = T.StructType([
    T.StructField("path", T.StringType(), False), T.StructField("size", T.LongType()), T.StructField("mtime", T.DoubleType()),
    T.StructField("dev", T.LongType()), T.StructField("ino", T.LongType()), T.StructField("source", T.StringType()),
])
CONTENT_INDEX = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("dev", T.LongType()), T.StructField("ino", T.LongType()), T.StructField("size", T.LongType()),
    T.StructField("mtime", T.DoubleType()), T.StructField("sha256", T.StringType()), T.StructField("write_seq", T.LongType()),
])
IMAGE_INDEX = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("size", T.LongType()), T.StructField("mtime", T.DoubleType()), T.StructField("phash", T.LongType()),
    T.StructField("dhash", T.LongType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("write_seq", T.LongType()),
])
DRIVE = T.StructType([T.StructField(n, T.StringType()) for n in ("model", "kind", "transport", "fstype")] + [T.StructField("total", T.LongType())])
SOURCE_STAT = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("files", T.LongType()), T.StructField("bytes_scanned", T.LongType()),
    T.StructField("hashed", T.LongType()), T.StructField("reused", T.LongType()), T.StructField("drive", DRIVE),
])
RUNS = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("when", T.DoubleType()), T.StructField("tier", T.StringType()), T.StructField("duration", T.DoubleType()), T.StructField("cancelled", T.BooleanType()),
    T.StructField("total_files", T.LongType()), T.StructField("groups", T.LongType()), T.StructField("reclaimable", T.LongType()), T.StructField("total_hashed", T.LongType()),
    T.StructField("total_reused", T.LongType()), T.StructField("used_cache", T.BooleanType()), T.StructField("sources", T.ArrayType(SOURCE_STAT)),
])
ACTIONS_LOG = T.StructType([
    T.StructField("when", T.DoubleType()), T.StructField("action", T.StringType()), T.StructField("files", T.LongType()), T.StructField("freed", T.LongType()),
    T.StructField("before_bytes", T.LongType()), T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType()),
])
GLOSSARY = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("term", T.StringType()), T.StructField("category", T.StringType()), T.StructField("short", T.StringType()),
    T.StructField("body", T.StringType()), T.StructField("aliases", T.ArrayType(T.StringType())), T.StructField("see_also", T.ArrayType(T.StringType())),
])
