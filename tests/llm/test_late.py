"""Late arrivals against a plain version, file by file."""

import hashlib
import math
import os
import zlib
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest

from copyfold.llm import late_overwrite, queries

NAMES = ["sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority"]
SCHEMA = "sale_id bigint, client_id bigint, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
EPOCH = datetime(1970, 1, 1)
CUTOFF = datetime(2024, 3, 20)


def micros(t):
    return None if t is None else (t - EPOCH) // timedelta(microseconds=1)


def day(t):
    return -1 if t is None else (t - EPOCH).days


def key(v):
    """Nulls first, NaN last."""
    return (v is not None, math.isnan(v) if isinstance(v, float) else False, 0 if v is None or isinstance(v, float) and math.isnan(v) else v)


def with_copies(rows):
    out = list(rows)
    for i, client, status, total, sold, arrived, priority in rows:
        if i is None:
            continue
        h = zlib.crc32(str(i).encode())
        if h % 3 == 0 and day(sold) % 4 == 0:
            out.append((i, client, status, None if total is None else total + 1, sold + timedelta(days=h % 2), None if arrived is None else arrived + timedelta(days=1 + h % 97), priority))
    return out


def latest(rows):
    best = {}
    for r in rows:
        rank = [key(r[c]) for c in (5, 4, 3, 1, 2, 6)]
        if r[0] not in best or rank > best[r[0]][0]:
            best[r[0]] = rank, r
    return {i: r for i, (_, r) in best.items()}


def layout(kept, per_file):
    days = {}
    for r in kept.values():
        days.setdefault(day(r[4]), []).append(r)
    out = {}
    for d, rows in days.items():
        rows.sort(key=lambda r: (key(r[4]), key(r[0])))
        out |= {(d, k): rows[k * per_file : (k + 1) * per_file] for k in range(-(-len(rows) // per_file))}
    return out


def brute(rows, files=1100):
    """Per file (day, file_no): its rows and whether it is written anew."""
    per_file = 1 + len(rows) // files
    rows = with_copies(rows)
    late = [r for r in rows if r[5] is None or r[5] >= CUTOFF]
    start, end = latest([r for r in rows if r[5] is not None and r[5] < CUTOFF]), latest(rows)
    won = {i for i, r in end.items() if r in late and not (i in start and r[5] is None)}
    touched = {day(end[i][4]) for i in won} | {day(start[i][4]) for i in won if i in start}
    return {at: (part, at[0] in touched) for at, part in layout(end, per_file).items()}


def checked(out, rows, files=1100):
    want, found = brute(rows, files), {(r["day"], r["file_no"]): r for r in out.collect()}
    assert set(found) == set(want)
    text = lambda v: "" if v is None else str(v)
    for at, (part, fresh) in want.items():
        r = found[at]
        cents = sum(math.floor(100 * t + 0.5) for *_, t, _, _, _ in part if t is not None and math.isfinite(t))
        crc = sum(zlib.crc32(f"{text(i)}:{text(micros(s))}:{text(micros(a))}".encode()) for i, _, _, _, s, a, _ in part)
        ids = hashlib.sha256(",".join(text(p[0]) for p in part).encode()).hexdigest()
        assert (r["n_rows"], r["cents"], r["rows_crc"], r["columns"], r["ids_sha256"], r["rewritten"]) == (len(part), cents, crc, ",".join(NAMES), ids, fresh), at
        table = pq.ParquetFile(r["path"]).read()
        assert table.column_names == NAMES and [repr(tuple(x.values())) for x in table.to_pylist()] == [repr(p) for p in part]
    return found


def sales(n=1500):
    rows = []
    for i in range(n):
        sold = datetime(2024, 1, 1) + timedelta(hours=(i * 37) % 2600, seconds=i % 3, microseconds=i % 7)
        late = timedelta(days=(i * 13) % 60 if i % 5 == 0 else 0, minutes=i % 50)
        rows.append((i * 7, i % 11, "done", None if i % 97 == 0 else i / 3 - 20, None if i % 113 == 0 else sold, sold + late, i % 5))
    rows += [rows[k] for k in range(0, n, 10)]  # repeated rows
    rows += [(r[0], r[1], "again", r[3], r[4], r[5], 9) for r in rows[:50]]  # ties
    rows += [(r[0], 0, "later", 1.0, r[4] and r[4] + timedelta(days=30), r[5] + timedelta(days=90), 0) for r in rows[50:90]]
    rows += [(21, 0, "unknown", 1.0, datetime(2024, 2, 2), None, 0), (10**12, 0, "unknown", float("nan"), datetime(2024, 2, 3), None, 0), (10**12 + 1, 0, None, float("inf"), datetime(1969, 12, 30, 5), datetime(2024, 1, 1), None)]
    rows += [(None, 1, "x", 2.5, datetime(2024, 1, 5), datetime(2024, 1, 6), 1), (None, 1, "y", 3.5, datetime(2024, 1, 9), datetime(2024, 4, 6), 1), (5 * 10**11, 1, "z", -0.005, datetime(2024, 1, 5), datetime(2024, 1, 6), 1)]
    return rows


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_every_file_is_as_in_the_plain_version(spark, tmp_path, zone):
    rows = sales()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    from pyspark.sql import functions as F

    docs.select("*", F.lit("x").alias("day"), F.lit(1).alias("file_no"), F.lit(2).alias("at"), F.lit(3).alias("h")).write.parquet(f"{tmp_path}/sales.parquet")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        found = checked(queries.op11_late_overwrite(spark, str(tmp_path)), rows)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {r["rewritten"] for r in found.values()} == {True, False}
    folder = os.path.dirname(os.path.dirname(os.path.dirname(next(iter(found.values()))["path"])))
    left = {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}
    assert left == {r["path"] for r in found.values()}


def test_files_that_stay_are_not_touched(spark):
    rows = [r for r in sales(400) if r[0] is not None]
    frame = late_overwrite.sales_in_utc(spark.createDataFrame(rows, SCHEMA))
    early = frame.filter("arrived_at < timestamp_ntz'2024-03-20 00:00:00'")
    folder = late_overwrite.new_folder(spark)
    late_overwrite.write_days(late_overwrite.latest(early), folder, 3)
    state = lambda: {os.path.join(d, f): (os.stat(os.path.join(d, f)).st_mtime_ns, open(os.path.join(d, f), "rb").read()) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}
    before = state()
    moved = spark.createDataFrame([(rows[0][0], 1, "moved", 1.0, datetime(2024, 5, 1), datetime(2024, 5, 2), 1)], SCHEMA)
    days = late_overwrite.overwrite_late(moved, folder, 3)
    assert sorted(days) == sorted({day(datetime(2024, 5, 1)), day(latest([r for r in rows if r[5] is not None and r[5] < CUTOFF])[rows[0][0]][4])})
    after = state()
    same = {p for p in before if int(p.split("day=")[1].split("/")[0]) not in days}
    assert same and all(after[p] == before[p] for p in same) and {p for p in after if int(p.split("day=")[1].split("/")[0]) not in days} == same
    assert late_overwrite.overwrite_late(moved.limit(0), folder, 3) == [] and state() == after


def test_a_full_filter_still_gives_the_layout(spark, monkeypatch):
    monkeypatch.setattr(late_overwrite, "BLOOM_BITS", 256)
    rows = sales(300)
    checked(late_overwrite.late_arrivals(spark.createDataFrame(rows, SCHEMA), files=7), rows, 7)


def test_a_filter_passes_all_its_ids_and_few_others(spark):
    ids = spark.range(0, 30_000, 3).withColumnRenamed("id", "sale_id")
    from pyspark.sql import functions as F

    all_ids = spark.range(30_000).select(F.col("id").alias("sale_id"), F.lit(1).cast("bigint").alias("day"))
    passed = {r[0] for r in late_overwrite.maybe_in(all_ids, late_overwrite.bloom_filter(ids)).collect()}
    assert set(range(0, 30_000, 3)) <= passed and len(passed) < 10_100


def test_sales_of_one_day_and_no_sales(spark):
    one = [(i, 1, "s", 1.0, datetime(2024, 1, 2), datetime(2024, 1, 3), 1) for i in range(500)]
    checked(late_overwrite.late_arrivals(spark.createDataFrame(one, SCHEMA), files=20), one, 20)
    gone = [(1, 1, "s", 1.0, datetime(2024, 1, 2), datetime(2024, 1, 3), 1), (1, 1, "s", 1.0, datetime(2024, 1, 6), datetime(2024, 4, 3), 1)]
    checked(late_overwrite.late_arrivals(spark.createDataFrame(gone, SCHEMA)), gone)
    assert late_overwrite.late_arrivals(spark.createDataFrame([], SCHEMA)).collect() == []
