import zlib

import pytest
from pyspark.sql import types as T

WORDS = "la ruta del norte pasa por un valle frío donde crece el trigo y la gente canta cada noche bajo las estrellas".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * 3 + i * seed) % len(WORDS)] + str((seed * 31 + i * 17) % 97) for i in range(n))


def edge_rows():
    """Null and empty texts, ties, repeated rows and ids, odd white space, long texts, near copies, license lines."""
    base = sentence(1, 60)
    rows = [
        (0, base, "es", "a"), (1, base, "es", "b"), (1, base, "es", "b"), (2, base.replace(" ", "\t\n "), "es", "a"),
        (3, base.upper(), None, None), (4, base + " end", "es", "a"), (5, "x " + base + " y", "es", "c"), (6, sentence(2, 60), "en", "a"),
        (7, None, "en", "a"), (8, "", "en", "b"), (9, " \t\r\n\x0b\x0c ", "en", "b"), (10, "one", "en", "a"), (11, "ONE", "en", "a"), (12, "one  two three", None, "d"),
        (None, "no id here at all", "en", "a"), (None, base, "es", "a"), (13, "Released UNDER the  MIT-License.\nunder the mit license under the mit license", "en", "a"),
        (14, "Licensed under the Apache License, Version 2.0. All rights reserved.", "en", "b"), (15, "CC BY-NC 4.0 gnu general public license   cc by nc", "en", "b"),
        (16, sentence(3, 9000), "es", "a"), (17, "!!! \U0001f600 \U0001f600 don't stop 123 漢字", "zh", "e"), (-5, sentence(4, 40), "es", "a"), (50, sentence(1, 50), "es", "a"), (100, base, "es", "z"), (100, "one", "es", "z"),
    ]
    return [(i, t, lang, source, len(t or "")) for i, t, lang, source in rows]


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use inside or return.
CLASHES = ("size", "key", "digest", "s", "n", "content", "copies", "ticket", "score", "predicted", "kept", "keep_id", "class", "keys", "shard", "slot", "labels", "n_words", "mark", "batch", "lane", "token", "_key", "_hot", "length", "a", "b", "root")


def write(spark, folder, rows, schema=SCHEMA, name="documents", clashes=True):
    df = spark.createDataFrame(rows, schema).repartition(3)
    if clashes:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASHES if c not in df.columns])
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="session")
def edge_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("edge"))
    write(spark, folder, edge_rows())
    known = [(r[0], zlib.crc32(str(r[0]).encode()) % 2, 0) for r in edge_rows() if r[0] is not None] + [(None, 1, 0), (999, 0, 1), (6, None, None)]
    spark.createDataFrame(known, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    write(spark, folder, [])
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
