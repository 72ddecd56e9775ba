"""The driver tables in the shapes that the operators take."""

from __future__ import annotations

import html
import io
import itertools
import struct
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes for each core up to which an input counts as small.
SMALL = 64 << 20


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` dealt over the session's cores, if they are few bytes in fewer files than cores: a small file is often one group of rows, which is one task. All other inputs stay where they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if len(rows.inputFiles()) >= cores:
        return rows
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SMALL else rows


def document_files(spark, sf_dir: str, content: bool = False) -> DataFrame:
    """``documents`` as files: path, size, mtime, dev, ino, source (the root), and content if asked for."""
    n = F.col("doc_id").cast("string")
    kind = F.col("doc_id") % 6
    name = (
        F.when(kind == 0, F.concat(F.lit("doc-"), n, F.lit(".txt"))).when(kind == 1, F.concat(F.lit("doc-"), n, F.lit(" copy.txt"))).when(kind == 2, F.concat(F.lit("doc-"), n, F.lit(".txt.bak")))
        .when(kind == 3, F.concat(F.lit("db-2023-01-05-"), n, F.lit(".sql"))).when(kind == 4, F.concat(F.lit(".doc-"), n, F.lit(".txt"))).otherwise(F.concat(F.lit("IMG_"), n, F.lit(".jpg")))
    )
    root = F.concat(F.lit("/"), "source")
    columns = [
        F.concat(root, F.lit("/"), "lang", F.lit("/"), name).alias("path"), F.octet_length("text").cast("bigint").alias("size"),
        (F.lit(1.7e9) + F.col("doc_id") * 37 % 100000).cast("double").alias("mtime"), F.lit(1).cast("bigint").alias("dev"), F.col("doc_id").alias("ino"), root.alias("source"),
    ]
    if content:
        columns.append(F.col("text").cast("binary").alias("content"))
        return dealt(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")).select(*columns)
    return table(spark, sf_dir, "documents").select(*columns)


def made_files(spark, sf_dir: str, make) -> DataFrame:
    """(path, content) of ``make`` (doc_id, text), for parsers of binary formats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                made = [make(i, t or "") for i, t in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))]
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.binary())], names=["path", "content"])

    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).mapInArrow(run, "path string, content binary")


def zipped(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def office_file(doc_id: int, text: str) -> tuple[str, bytes]:
    """A document as a text file of one of two kinds, or as a spreadsheet of up to four sheets."""
    body = "<p>" + html.escape(text, quote=False) + "</p>"
    if doc_id % 3 == 2:
        return f"/office/{doc_id}.xlsx", zipped({f"xl/worksheets/sheet{k}.xml": "<c/>" for k in range(doc_id % 5)} | {"xl/sharedStrings.xml": body})
    return (f"/office/{doc_id}.odt", zipped({"content.xml": body})) if doc_id % 3 else (f"/office/{doc_id}.docx", zipped({"mimetype": "x", "word/document.xml": body}))


def archive_maker():
    """A maker of zip or tar archives (path, bytes) of up to 300 empty files; every seventh is damaged.

    The files are packed once: fewer of them are a prefix of each part of the archive of all.
    """
    names = [f"d/{k}.txt" for k in range(300)]
    headers = b"".join(tarfile.TarInfo(name).tobuf() for name in names)
    whole = zipped(dict.fromkeys(names, ""))
    with zipfile.ZipFile(io.BytesIO(whole)) as z:
        start = z.start_dir
        bodies = [entry.header_offset for entry in z.infolist()] + [start]
    entries = list(itertools.accumulate((46 + len(name) for name in names), initial=0))

    def archive_file(doc_id: int, text: str) -> tuple[str, bytes]:
        n = doc_id % 301
        if doc_id % 7 == 6:
            return f"/archives/{doc_id}.zip", b"PK\x03\x04 cut"
        if doc_id % 2:
            tail = struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, n, n, entries[n], bodies[n], 0)
            return f"/archives/{doc_id}.zip", whole[: bodies[n]] + whole[start : start + entries[n]] + tail
        records = -(-(n + 2) * tarfile.BLOCKSIZE // tarfile.RECORDSIZE)
        return f"/archives/{doc_id}.tar", headers[: n * tarfile.BLOCKSIZE].ljust(records * tarfile.RECORDSIZE, b"\x00")

    return archive_file


def photo_file(doc_id: int, text: str) -> tuple[str, bytes]:
    """The head of a JPEG whose EXIF block names a date (of one of two tags) and a camera; every fourth has none."""
    if doc_id % 4 == 3:
        return f"/photos/{doc_id}.jpg", b"\xff\xd8\xff\xdb" + text[:40].encode()
    date, model = f"2023:{doc_id % 12 + 1:02d}:{doc_id % 28 + 1:02d} 10:00:00".encode() + b"\x00", f" Cam {doc_id % 9} ".encode() + b"\x00"
    order = "<" if doc_id % 2 else ">"
    start = 8 + 2 + 2 * 12 + 4
    entries = [(0x0110, model, start), (0x0132 if doc_id % 4 else 0x9003, date, start + len(model))]
    ifd = struct.pack(f"{order}H", 2) + b"".join(struct.pack(f"{order}HHII", tag, 2, len(value), at) for tag, value, at in entries) + struct.pack(f"{order}I", 0)
    tiff = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 8) + ifd + model + date
    return f"/photos/{doc_id}.jpg", b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\x00\x00" + tiff


def index_snapshot(digested: DataFrame) -> DataFrame:
    """An older content index of document files with full_hash: without every third, stale in every seventh."""
    rows = digested.filter(F.col("ino") % 3 != 0)
    stale = F.when(F.col("ino") % 7 == 0, 1.0).otherwise(0.0)
    return rows.select("path", "dev", "ino", "size", (F.col("mtime") + stale).alias("mtime"), F.col("full_hash").alias("sha256"), F.col("ino").alias("write_seq"))


def signatures(spark, sf_dir: str) -> DataFrame:
    """(id, ph, dh): sign bits and rise bits of ``embeddings``, and perturbed copies of every fifth."""
    e = F.col("embedding")
    zero = F.lit(0).cast("bigint")

    def bits(n: int, test):
        return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), zero, lambda acc, i: acc.bitwiseOR(F.when(test(i), F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(zero)))

    ph = bits(64, lambda i: F.get(e, i) > 0)
    dh = bits(63, lambda i: F.get(e, i + 1) > F.get(e, i))
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), ph.alias("ph"), dh.alias("dh"))
    shift = lambda base, by: F.call_function("shiftleft", F.lit(base).cast("bigint"), by.cast("int"))
    copies = own.filter("id % 5 = 0").select((F.col("id") + 1000000).alias("id"), F.col("ph").bitwiseXOR(shift(7, F.col("id") % 60)).alias("ph"), F.col("dh").bitwiseXOR(shift(1, F.col("id") % 61)).alias("dh"))
    return own.unionByName(copies)


def _grey_image(name, embedding, more=0):
    """64 numbers as a grey image of 8 x 8 pixels in the shape of Spark's image source; ``more`` is added to the first pixel. Grey is computed in the type of the numbers: whole numbers beside a float would make a double of it, which can fall to another pixel."""
    wide, base = F.lit(40).cast("float"), F.lit(128).cast("float")
    grey = F.transform(embedding, lambda x, i: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(base + wide * x) + F.when(i == 0, F.lit(more)).otherwise(0))).cast("bigint")), 2, "0"))
    return F.struct(name.alias("origin"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.unhex(F.array_join(grey, "")).alias("data")).alias("image")


def embedding_images(spark, sf_dir: str) -> DataFrame:
    """``embeddings`` as images."""
    return table(spark, sf_dir, "embeddings").select(_grey_image(F.col("vec_id").cast("string"), F.col("embedding")))


def document_images(spark, sf_dir: str) -> DataFrame:
    """The pictures of those document files that are named as images: each twelve documents have two of them, which show one embedding, the second a little brighter in a corner. Files without an embedding have none."""
    files = document_files(spark, sf_dir).filter(F.col("ino") % 6 == 5).select("path", "ino", F.floor(F.col("ino") / 12).alias("vec_id"))
    both = files.join(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id")
    return both.select(_grey_image(F.col("path"), F.col("embedding"), F.when(F.col("ino") % 12 == 11, 16).otherwise(0)))


def word_sets(spark, sf_dir: str) -> DataFrame:
    """(id, tokens): the distinct lower-case words of ``documents``."""
    words = F.array_remove(F.split(F.lower("text"), r"[ \t\n\r\f\x0b]+"), "")
    return dealt(table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), F.array_distinct(words).alias("tokens"))


def event_runs(spark, sf_dir: str) -> DataFrame:
    """Scan runs from ``events``: one for each user and day."""
    e = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    runs = e.groupBy("user_id", "day").agg(
        F.array_sort(F.collect_set(F.concat(F.lit("/"), "event_type"))).alias("sources"), F.round(F.sum("value"), 2).alias("duration"), F.max("event_id").alias("seq"), F.count(F.lit(1)).alias("total_files"),
        F.count_if(F.col("event_type").isin("click", "view")).alias("total_hashed"), F.count_if(F.col("event_type") == "signup").alias("total_reused"),
        F.bool_or((F.col("event_type") == "error") & (F.col("value") > 90)).alias("cancelled"),
    )
    return runs.select("seq", F.when(F.col("user_id") % 2 == 0, "simple").otherwise("advanced").alias("tier"), "sources", "duration", "cancelled", "total_files", "total_hashed", "total_reused")
