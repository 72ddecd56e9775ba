"""Late arrivals: overwriting only the partitions that they touch.

A layout keeps the latest-arrived row of each sale in Parquet files by day. When late rows come, a Bloom filter of
their sale_ids prunes the scan of the layout's ids; an exact semi-join removes its false positives. The days in
which such sales stood, and the days of the late rows that win, are written anew by Spark's dynamic partition
overwrite; the files of all other days are not touched.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyfold.llm.common import broadcast_object, checkpointed, shared_folder

#: The columns of a layout's files, in order.
SALES = ("sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority")
#: Files into which a layout is cut, besides one for each day.
FILES = 1100
#: Arrivals from here on are late.
CUTOFF = "2024-03-20 00:00:00"
#: Bits and hashes of the Bloom filter: 2 MiB, whatever the input. Up to some 2 million late sales it lets one row in a hundred pass
#: in vain; beyond, it lets more pass, and the semi-join has more to remove.
BLOOM_BITS, HASHES = 1 << 24, 4

_DAY_MICROS = 86_400_000_000


def utc(rows: DataFrame, name: str) -> Column:
    """A column of times without a zone; times of the session's zone are turned into UTC."""
    if dict(rows.dtypes)[name] == "timestamp":
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(name).cast("timestamp_ntz"))
    return F.col(name).cast("timestamp_ntz")


def day_of(time: Column) -> Column:
    """Whole days since 1970; null: -1."""
    return F.coalesce(F.unix_date(F.to_date(time)), F.lit(-1)).cast("bigint")


def micros(time: Column) -> Column:
    """Microseconds since 1970 of a time without a zone, whatever the session's zone."""
    seconds = F.hour(time) * 3600 + F.minute(time) * 60
    return F.unix_date(F.to_date(time)).cast("bigint") * _DAY_MICROS + seconds.cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("bigint")


def sales_in_utc(sales: DataFrame) -> DataFrame:
    """The columns of SALES, times in UTC; further columns are not read."""
    return sales.select(*[utc(sales, c).alias(c) if c in ("sold_at", "arrived_at") else F.col(c) for c in SALES])


def with_corrections(rows: DataFrame) -> DataFrame:
    """``rows`` and a later correction of some: where crc32 h of the decimal sale_id is divisible by 3 and the day by 4, the row comes again with total + 1, sold h % 2 and arrived 1 + h % 97 days later."""
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    days = lambda n: F.make_dt_interval(n.cast("int"))
    changed = {"total": F.col("total") + 1, "sold_at": F.col("sold_at") + days(h % 2), "arrived_at": F.col("arrived_at") + days(h % 97 + 1)}
    own = F.struct(*[F.col(c).alias(c) for c in SALES])
    again = F.struct(*[changed.get(c, F.col(c)).alias(c) for c in SALES])
    due = (h % 3 == 0) & (day_of(F.col("sold_at")) % 4 == 0)
    return rows.select(F.explode(F.when(due, F.array(own, again)).otherwise(F.array(own))).alias("r")).select("r.*")


def latest(rows: DataFrame) -> DataFrame:
    """Of the rows of a sale_id the latest-arrived; of equal arrivals the one that is largest by sold_at, total, client_id, status, priority. Null is the smallest; rows without sale_id are one sale."""
    order = ("arrived_at", "sold_at", "total", "client_id", "status", "priority")
    return rows.groupBy("sale_id").agg(F.max(F.struct(*order)).alias("r")).select("sale_id", "r.*").select(*SALES)


def write_days(rows: DataFrame, folder: str, per_file: int) -> dict[int, int]:
    """Write ``rows`` below ``folder`` in files of ``per_file`` rows, sorted by sold_at and sale_id within their day; returns how many files each day has.

    Days and files that are there already are replaced, others stay. Rows are dealt to ranges of day, time and id, so a day
    of any size is sorted by many tasks; a row's place in its day comes from its place in its range and the rows of the
    ranges before. Only then are rows dealt by file, and each file is written by one task.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["day", "sold_at", "sale_id"]
    ranged = rows.withColumn("day", day_of(F.col("sold_at"))).repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # ids count within a partition, from its number shifted by 33 bits on
    ranged = checkpointed(ranged.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("at", 33)
    before = Window.partitionBy("day").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("day", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    # a row for each day and one more for each range that ends within a day
    starts = checkpointed(starts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")))
    placed = ranged.withColumn("part", part).join(F.broadcast(starts.select("day", "part", "shift")), ["day", "part"])
    placed = placed.withColumn("file_no", F.expr(f"(at + shift) div {int(per_file)}"))
    dealt = placed.repartition(ranges, "day", "file_no").sortWithinPartitions("day", "file_no", "at")
    dealt.select(*SALES, "day", "file_no").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 0).partitionBy("day", "file_no").parquet(folder)
    return {r["day"]: -(-r["n"] // per_file) for r in starts.groupBy("day").agg(F.sum("n").alias("n")).collect()}


def read_layout(spark, folder: str) -> DataFrame:
    """A layout with its partition columns day and file_no; a folder without files is an empty one."""
    schema = "sale_id bigint, client_id bigint, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, day bigint, file_no bigint"
    return spark.read.schema(schema).parquet(folder)


def drop_files(spark, folder: str, days: list[int], files: dict[int, int]) -> None:
    """Delete the files of ``days`` that their new number of ``files`` leaves over."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for day in days:
        own = path(f"{folder}/day={day}")
        if day not in files:
            fs.delete(own, True)
            continue
        for status in fs.listStatus(own):
            if int(status.getPath().getName().removeprefix("file_no=")) >= files[day]:
                fs.delete(status.getPath(), True)


def _places(h: np.ndarray) -> list[np.ndarray]:
    """The bits of the Bloom filter for hashes ``h``."""
    low, high = h & np.int64(0xFFFFFFFF), (h >> np.int64(32)) & np.int64(0xFFFFFFFF)
    return [(low + i * (2 * high + 1)) & np.int64(BLOOM_BITS - 1) for i in range(HASHES)]


def bloom_filter(ids: DataFrame) -> np.ndarray:
    """The Bloom filter of ``sale_id`` as words of 64 bits. Bits are set word by word in partial aggregates; the driver gets each word once."""
    h = F.xxhash64("sale_id")
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    places = F.array(*[(low + i * (2 * high + 1)).bitwiseAND(F.lit(BLOOM_BITS - 1)) for i in range(HASHES)])
    bits = ids.select(F.explode(places).alias("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    words = bits.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def maybe_in(rows: DataFrame, bloom: np.ndarray) -> DataFrame:
    """The rows (sale_id, day) that the filter lets pass: all whose sale_id is in it, and some others."""
    words = broadcast_object(rows.sparkSession, bloom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = words()
        for batch in batches:
            passes = np.ones(batch.num_rows, bool)
            for place in _places(batch.column(2).to_numpy()):
                passes &= (found[place >> 6] >> (place & 63)) & 1 == 1
            yield batch.select(["sale_id", "day"]).filter(pa.array(passes))

    return rows.select("sale_id", "day", F.xxhash64("sale_id").alias("h")).mapInArrow(run, "sale_id bigint, day bigint")


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.sale_id").eqNullSafe(F.col(f"{b}.sale_id"))


def overwrite_late(late: DataFrame, folder: str, per_file: int) -> list[int]:
    """Put the ``late`` rows (columns of SALES) into the layout below ``folder``; returns the days that were written anew.

    A late row replaces its sale's row if it arrived later; one without arrived_at only comes in if its sale isn't
    there. Files of other days aren't opened for anything but the ids of their sales. The days' new rows are in the shared folder before the first of their
    files is replaced, so a task that is lost is done again from there.
    """
    spark = late.sparkSession
    won = checkpointed(latest(late))
    layout = read_layout(spark, folder)
    passed = maybe_in(layout, bloom_filter(won.select("sale_id")))
    stood = passed.alias("s").join(won.alias("w"), _same("s", "w")).select("s.sale_id", "s.day", F.col("w.arrived_at").isNull().alias("unknown"))
    stood = checkpointed(stood)
    if not stood.filter("unknown").isEmpty():
        won = won.alias("w").join(stood.filter("unknown").select("sale_id").alias("s"), _same("w", "s"), "left_anti")
        stood = stood.filter("NOT unknown")
    days = [r[0] for r in stood.select("day").unionByName(won.select(day_of(F.col("sold_at")).alias("day"))).distinct().collect()]
    if not days:
        return []
    stay = layout.filter(F.col("day").isin(days)).select(*SALES).alias("l").join(stood.select("sale_id").alias("s"), _same("l", "s"), "left_anti")
    files = write_days(stay.unionByName(won.select(*SALES)), folder, per_file)
    drop_files(spark, folder, days, files)
    return days


def file_path() -> Column:
    """The path of a row's file; of a local one without its scheme."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")


def file_digests(spark, folder: str, before: DataFrame) -> DataFrame:
    """Per file of the layout: day, file_no, n_rows, cents, rows_crc, path, columns, ids_sha256, rewritten (not among ``before``, the starting files by path).

    Files are read by Spark with the place of each row; a file's rows meet in one task, sorted by place, and are streamed through the hash.
    """
    layout = read_layout(spark, folder)
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    finite = F.abs("total") < F.lit(float("inf"))
    cents = F.when(finite, F.floor(100 * F.col("total") + 0.5)).otherwise(0).cast("bigint")
    line = F.concat(text(F.col("sale_id")), F.lit(":"), text(micros(F.col("sold_at"))), F.lit(":"), text(micros(F.col("arrived_at"))))
    rows = layout.select("day", "file_no", file_path().alias("path"), F.col("_metadata.row_index").alias("at"), text(F.col("sale_id")).alias("id"), cents.alias("cents"), F.crc32(line.cast("binary")).alias("crc"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(ranges, "path").sortWithinPartitions("path", "at").select("day", "file_no", "path", "id", "cents", "crc")
    fields = [("day", pa.int64()), ("file_no", pa.int64()), ("path", pa.string()), ("n_rows", pa.int64()), ("cents", pa.int64()), ("rows_crc", pa.int64()), ("ids_sha256", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        digest, sums = hashlib.sha256(), [0, 0, 0]

        def closed():
            out.append((*now, *sums, digest.hexdigest()))

        for batch in batches:
            paths = batch.column(2).dictionary_encode().indices.to_numpy()
            starts = np.flatnonzero(np.append(True, paths[1:] != paths[:-1])).tolist() if len(paths) else []
            for i, j in zip(starts, [*starts[1:], batch.num_rows]):
                part = batch.slice(i, j - i)
                head = tuple(part.column(c)[0].as_py() for c in range(3))
                if head != now:
                    if now:
                        closed()
                    now, digest, sums = head, hashlib.sha256(), [0, 0, 0]
                ids = ",".join(part.column(3).to_pylist())
                digest.update((f",{ids}" if sums[0] else ids).encode())
                sums = [sums[0] + j - i, sums[1] + sum(part.column(4).to_pylist()), sums[2] + sum(part.column(5).to_pylist())]
        if now:
            closed()
        columns = zip(*out) if out else [[] for _ in fields]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(columns, fields)], names=[n for n, _ in fields])

    found = rows.mapInArrow(run, "day bigint, file_no bigint, path string, n_rows bigint, cents bigint, rows_crc bigint, ids_sha256 string")
    names = ",".join(c for c in layout.columns if c not in ("day", "file_no"))
    found = found.join(before.select("path", F.lit(True).alias("old")), "path", "left")
    return found.select("day", "file_no", "n_rows", "cents", "rows_crc", "path", F.lit(names).alias("columns"), "ids_sha256", F.col("old").isNull().alias("rewritten"))


def new_folder(spark) -> str:
    """A folder of its own below the one that driver and executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or shared_folder(spark)
    return f"{shared.rstrip('/')}/late-{uuid.uuid4().hex}"


def late_arrivals(sales: DataFrame, cutoff: str = CUTOFF, files: int = FILES) -> DataFrame:
    """The layout of the early rows of ``sales`` and their corrections, and then of all; file_digests of what is there in the end.

    Early rows arrived before ``cutoff``; rows without arrived_at are late. A file has 1 + floor(rows of ``sales`` / ``files``) rows, a day's
    last one perhaps fewer. Null, negative and infinite totals and all other broken values are kept as they are; null and infinite
    totals count no cents. Repeated rows are one row; ties are settled by ``latest``. Times that are null are in day -1 and sort first.
    Columns besides those of SALES are not read, whatever their names. An empty table gives an empty layout and no rows. Each call writes a
    folder of its own, which stays.
    """
    spark = sales.sparkSession
    rows = sales_in_utc(sales)
    per_file = 1 + rows.count() // files
    rows = with_corrections(rows)
    early = F.coalesce(F.col("arrived_at") < F.lit(cutoff).cast("timestamp_ntz"), F.lit(False))
    folder = new_folder(spark)
    write_days(latest(rows.filter(early)), folder, per_file)
    before = checkpointed(read_layout(spark, folder).select(file_path().alias("path")).distinct())
    overwrite_late(rows.filter(~early), folder, per_file)
    return file_digests(spark, folder, before)
