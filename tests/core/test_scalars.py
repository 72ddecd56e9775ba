"""Scalar expressions against CPython."""

import datetime
import os
import posixpath
import re

import pytest
from pyspark.sql import functions as F

from copyfold.functions import dimensions, scalars
from copyfold.operators import filters, keeper, logs, previews
from copyfold.sources import adapters

NAMES = ["a.txt", ".hidden", ".hidden.txt", "noext", "A.JPG", "x.tar.gz", "..a", "...", "a.", "copy of b.txt", "b copy.txt", "b (2).txt", "IMG_2381.jpg", "photo-edited.png", "x_small.jpg", "xcopy.txt", "report.docx.bak", "n~", "v2 notes.md", "db-2023-01-05.sql", "db-20230230.sql", "album (1999)", "d20240131x", "2023-13-01.txt"]


@pytest.fixture(scope="module")
def names(spark):
    return spark.createDataFrame([(f"/r/dir/{n}",) for n in NAMES], "path string")


def values(df, column):
    return {os.path.basename(r[0]): r[1] for r in df.select("path", column).collect()}


def test_paths(names):
    name = scalars.basename(F.col("path"))
    assert values(names, scalars.extension(name)) == {n: os.path.splitext(n)[1].lower() for n in NAMES}
    assert set(values(names, scalars.dirname(F.col("path"))).values()) == {"/r/dir"}
    assert set(values(names, scalars.depth(F.col("path"))).values()) == {3}


def test_dirname_of_the_root(spark):
    paths = ["/a", "/a/b", "a", "/a/b/c.d"]
    df = spark.createDataFrame([(p,) for p in paths], "path string").select("path", scalars.dirname(F.col("path")))
    assert {r[0]: r[1] for r in df.collect()} == {p: posixpath.dirname(p) for p in paths}


def test_derived_names(names):
    found = {n for n, d in values(names, scalars.is_derived(scalars.basename(F.col("path")))).items() if d}
    assert found == {"copy of b.txt", "b copy.txt", "b (2).txt", "photo-edited.png", "x_small.jpg", "album (1999)"}


def test_embedded_dates(names):
    found = values(names, scalars.embedded_date(scalars.basename(F.col("path"))))

    def plain(name):
        m = re.search(scalars.DATE, name)
        y = re.search(scalars.YEAR, name)
        try:
            parts = [int(x) for x in m.groups()] if m else [int(y[1]), 1, 1] if y else None
            return parts and datetime.datetime(*parts, tzinfo=datetime.timezone.utc).timestamp()
        except ValueError:
            return None

    assert found == {n: plain(n) for n in NAMES}
    assert found["db-20230230.sql"] is None and found["album (1999)"] is not None


def test_texts(spark):
    row = spark.range(1).select(
        scalars.human_bytes(F.lit(999)), scalars.human_bytes(F.lit(1234567)), scalars.human_count(F.lit(4200)), scalars.duration(F.lit(0.5)), scalars.duration(F.lit(12.34)), scalars.duration(F.lit(125.0)),
        scalars.relative_time(F.lit(0.0), 30), scalars.relative_time(F.lit(0.0), 7200), scalars.filter_label(F.array(*map(F.lit, "abcdef"))), scalars.filter_label(F.array().cast("array<string>")),
        scalars.drive_label(F.lit("Disk"), F.lit(""), F.lit("usb"), F.lit("ext4")), scalars.as_bool(F.lit(" YES ")), scalars.resolution(F.lit(0), F.lit(5)), scalars.resolution(F.lit(4), F.lit(5)), scalars.strip_markup(F.lit("<p>a  b</p>\n<i>c</i>")),
    ).head()
    assert tuple(row) == ("999 B", "1.2 MB", "4,200", "<1s", "12.3s", "2m 5s", "just now", "2 h ago", "a, b, c, d +2 more", "All Files", "Disk · USB · ext4", True, "", "4x5", "a b c")


def test_jaccard_of_empty_sets(spark):
    empty, some = F.array().cast("array<int>"), F.array(F.lit(1), F.lit(2))
    assert tuple(spark.range(1).select(scalars.jaccard(empty, empty), scalars.jaccard(some, empty), scalars.jaccard(some, F.array(F.lit(2)))).head()) == (1.0, 0.0, 0.5)


def test_extensions():
    assert dimensions.normalize_list([" JPG", ".png", "", "jpg"]) == [".jpg", ".png"]
    assert dimensions.resolve_types({}, []) == [] and dimensions.resolve_types({"PNG": True}, ["xyz"]) == [".png", ".xyz"]
    assert ".jpeg" in dimensions.category_extensions("image") and dimensions.category_extensions("nothing") == []


def test_exclusions(spark):
    paths = ["/r/node_modules/dep.js", "/r/$RECYCLE.BIN/x.jpg", "/r/a/.DS_Store", "/usr/x", "/usrx/y", "/r/keep.txt", "/r/build.txt", "/h/.local/share/Trash/files/z"]
    df = spark.createDataFrame([(p, "/r") for p in paths], "path string, source string")
    kept = lambda *a: {r[0] for r in df.filter(~filters.excluded(*a)).select("path").collect()}
    assert kept(None) == {"/usrx/y", "/r/keep.txt", "/r/build.txt"}
    assert kept(()) == set(paths) and kept(("unknown",)) == set(paths)
    assert kept((), ("*.txt",)) == set(paths) - {"/r/keep.txt", "/r/build.txt"}
    assert kept((), ("KEEP*",)) == set(paths)


def group(spark, rows):
    return spark.createDataFrame([("g", *r) for r in rows], "group_id string, path string, size bigint, mtime double")


def kept(spark, rows, preferred=(), newest=True, **columns):
    df = group(spark, rows)
    for k, v in columns.items():
        df = df.withColumn(k, v)
    out = keeper.rank(keeper.classify_groups(df), preferred, newest).collect()
    assert sum(r["keeper"] for r in out) == 1
    return next(r["path"] for r in out if r["keeper"])


def test_keepers(spark):
    assert kept(spark, [("/a/photo.jpg", 5, 9.0), ("/a/photo (1).jpg", 5, 1.0)]) == "/a/photo.jpg"
    assert kept(spark, [("/a/x", 5, 9.0), ("/a/y", 5, 1.0)]) == "/a/y"
    assert kept(spark, [("/disk2/x", 5, 1.0), ("/disk/x", 5, 9.0)], ("/disk",)) == "/disk/x"
    assert kept(spark, [("/a/db-2023-01-01.sql", 5, 999.0), ("/a/db-2024-06-01.sql", 5, 1.0)]) == "/a/db-2024-06-01.sql"
    assert kept(spark, [("/a/config.yaml", 5, 1000.0), ("/a/config.yaml.bak", 5, 1005.0)]) == "/a/config.yaml"
    assert kept(spark, [("/a/config.yaml", 5, 1199.0), ("/a/config.yaml.bak", 5, 1201.0)]) == "/a/config.yaml.bak"  # the grid of slots, not a distance
    big = F.when(F.col("path") == "/a/s", 640).otherwise(1920)
    assert kept(spark, [("/a/s", 9, 1.0), ("/a/l", 5, 1.0)], kind=F.lit("image"), width=big, height=big) == "/a/l"


def test_backups(spark):
    rows = keeper.classify_groups(group(spark, [("/a/report.docx.bak", 1, 5.0), ("/a/report.docx", 1, 9.0)])).collect()
    assert {r["path"]: (r["is_backup"], r["is_newest"]) for r in rows} == {"/a/report.docx.bak": (True, False), "/a/report.docx": (False, True)}
    rows = keeper.classify_groups(group(spark, [("/a/IMG_1.jpg", 1, 5.0), ("/b/IMG_1.jpg", 1, 9.0)])).collect()
    assert not any(r["has_backups"] or r["is_newest"] for r in rows)


def test_protected_paths(spark):
    df = spark.createDataFrame([(p,) for p in ("/", "/usr", "/usr/", "/usr/x", "/h/me", "/h/me/x")], "path string")
    assert {r[0] for r in df.filter(logs.protected(F.col("path"), "/h/me")).collect()} == {"/", "/usr", "/usr/", "/h/me"}


def test_names_and_archives():
    import io
    import zipfile

    assert previews.name_similarity("/a/report_final.txt", "/b/report_final.doc") == 1.0
    assert previews.name_similarity("vacation-photo.jpg", "vacation-photo(1).jpg") > 0.7 > previews.name_similarity("abc", "xyzw")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", "<w>Hello <b>there</b></w>")
        z.writestr("other", "x")
    assert previews.office_text(data.getvalue()) == "Hello there" and previews.archive_text(data.getvalue()).startswith("2 entries\n")
    assert previews.office_text(b"no") is None and previews.archive_entries(b"no") is None and previews.exif_fields(b"no") == (None, None)


def test_plain_archives_are_read_by_their_headers(monkeypatch):
    import io
    import tarfile
    import zipfile

    def packed(names, **options):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w", **options) as t:
            for i, name in enumerate(names):
                entry = tarfile.TarInfo(name)
                entry.size = 511 * i
                t.addfile(entry, io.BytesIO(b"x" * entry.size))
        return out.getvalue()

    def empty(n):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w") as t:
            for k in range(n):
                t.addfile(tarfile.TarInfo(f"d/{k}.txt"))
        return out.getvalue()

    names = ["a.txt", "d/b", "d/" + "c" * 90, "a.txt"]
    tar, zipped = packed(names), adapters.zipped(dict.fromkeys(names, "text"))
    other = [packed(["é", "x" * 150]), packed(["é", "x" * 150], format=tarfile.GNU_FORMAT), adapters.zipped({"é": "x"}), b"head" + zipped, zipped + b"tail"]
    want = []
    for content in other:
        try:
            want.append(zipfile.ZipFile(io.BytesIO(content)).namelist())
        except zipfile.BadZipFile:
            want.append(tarfile.open(fileobj=io.BytesIO(content)).getnames())
    assert [previews.archive_entries(content) for content in other] == want
    broken = tar[:3] + b"?" + tar[4:]  # the check sum is wrong
    assert previews.archive_entries(broken) is None and previews.archive_entries(tar[:700]) == tarfile.open(fileobj=io.BytesIO(tar[:700])).getnames()
    inner = packed(["x"])[:512] + zipped
    assert previews._tar_names(inner + bytes(2048)) is None

    def slow(*args, **options):
        raise AssertionError("the standard library was asked")

    monkeypatch.setattr(previews.tarfile, "open", slow)
    monkeypatch.setattr(previews.zipfile, "ZipFile", slow)
    assert previews.archive_entries(tar) == names and previews.archive_entries(zipped) == sorted(set(names), key=names.index)
    monkeypatch.undo()
    made = adapters.archive_maker()
    assert made(4, "")[1] == empty(4) and made(298, "")[1] == empty(298) and made(602, "")[1] == empty(0)
    for n in (1, 3, 299, 301):
        with zipfile.ZipFile(io.BytesIO(made(n, "")[1])) as z:
            assert z.testzip() is None and z.namelist() == [f"d/{k}.txt" for k in range(n % 301)]
