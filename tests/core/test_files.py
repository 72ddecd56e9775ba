"""Scans from paths, drives, logs, skew-safe joins, streams that start again, damaged files."""

import io
import os
import random
import zipfile
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from copyfold.functions import scalars
from copyfold.operators import components, exact, filters, index, logs, previews, simjoin
from copyfold.operators.components import connected_components
from copyfold.options import ScanOptions
from copyfold.plans import files as real
from copyfold.plans import scan
from copyfold.schema import CONTENT_INDEX, IMAGE_INDEX
from copyfold.skew import join_groups
from copyfold.sources import drives, images, walk
from copyfold.streaming.arrivals import IndexStream
from tests.core.test_scan import contents, png, put


def test_globs_prune_folders(spark, tmp_path):
    for name in ("X.bundle/f.txt", "X.bundle/deep/g.txt", "keep/f.bundle.txt", "keep/note.tmp", "a/b/c.txt"):
        put(tmp_path, name, b"x")
    root = str(tmp_path)
    names = lambda rows: {os.path.relpath(r["path"], root) for r in rows.collect()}
    globs = ("*.bundle", f"{root}/a/b", "*.tmp")
    every = walk.walk(spark, ScanOptions(roots=(root,)))
    assert names(every.filter(~filters.excluded((), globs))) == {"keep/f.bundle.txt"}
    walked = walk.walk(spark, ScanOptions(roots=(root,), exclude=globs))
    assert names(walked) == {"keep/f.bundle.txt", "keep/note.tmp"}  # folders are pruned by the walk, files by the filter
    bundle = ScanOptions(roots=(f"{root}/X.bundle",), exclude=("*.bundle",))
    assert names(scan.scoped(walk.walk(spark, bundle), bundle)) == {"X.bundle/f.txt", "X.bundle/deep/g.txt"}  # a root itself isn't asked


def test_walk_shares_out_and_ends_in_circles(spark, tmp_path, monkeypatch):
    for i in range(5):
        put(tmp_path, f"r/a/b{i}/c/d/e/f{i}.txt", b"x")
    os.symlink(tmp_path / "r", tmp_path / "r/a/b0/up")
    os.symlink(tmp_path / "r/a/b1", tmp_path / "r/a/link")
    options = ScanOptions(roots=(str(tmp_path / "r"),), follow_symlinks=True)
    files = walk.walk(spark, options)
    assert sorted(os.path.basename(r["path"]) for r in files.collect()) == ["f0.txt", "f1.txt", "f1.txt", "f2.txt", "f3.txt", "f4.txt"]
    assert files.rdd.getNumPartitions() > 5
    assert walk.walk(spark, ScanOptions(roots=(str(tmp_path / "r"),))).count() == 5


def test_a_repeat_scan_reads_nothing(spark, tmp_path):
    same = random.Random(1).randbytes(90_000)
    a, b = put(tmp_path, "r/a.dat", same), put(tmp_path, "r/x/b.dat", same)
    put(tmp_path, "r/c.dat", same[:70_000] + b"z" * 20_000)  # same size and prefix, other bytes
    put(tmp_path, "r/d.dat", b"y" * 90_000)  # same size, other prefix
    put(tmp_path, "r/e.dat", b"alone")
    os.link(a, tmp_path / "r/a2.dat")
    options = ScanOptions(roots=(str(tmp_path / "r"),))
    passes = []
    first = real.scan_files(spark, options, str(tmp_path / "index"), str(tmp_path / "log"), on_groups=lambda name, rows: passes.append((name, rows.count())))
    assert first.run["reads"] == {"prefix": 5, "full": 4, "verify": 2, "image": 0} and passes == [("exact", 2), ("image", 0)]
    assert {r["path"]: r["keeper"] for r in first.members.collect()}.keys() == {a, b} and first.run["groups"] == 1 and first.run["reclaimable"] == 90_000
    second = real.scan_files(spark, options, str(tmp_path / "index"), str(tmp_path / "log"), index_version=first.index)
    assert second.run["reads"] == {"prefix": 0, "full": 1, "verify": 0, "image": 0}  # a size with a hit: the file that only had a prefix is hashed whole
    third = real.scan_files(spark, options, str(tmp_path / "index"), str(tmp_path / "log"), index_version=second.index)
    assert third.run["reads"] == {"prefix": 0, "full": 0, "verify": 0, "image": 0} and {r["path"] for r in third.members.collect()} == {a, b}
    assert third.run["total_reused"] == 5 and third.run["total_hashed"] == 0
    log = logs.load_runs(spark, str(tmp_path / "log")).collect()
    assert [r["total_hashed"] for r in log] == [0, 1, 4] and all(r["sources"][0]["files"] == 6 and r["sources"][0]["drive"]["total"] > 0 and not r["cancelled"] for r in log)
    assert [r["verdict"] for r in logs.compare_runs(logs.load_runs(spark, str(tmp_path / "log")).withColumn("sources", F.transform("sources", lambda s: s["path"]))).collect()].count(None) == 1


def test_unreadable_files_and_a_stopped_scan(spark, tmp_path):
    files = spark.createDataFrame([(str(tmp_path / n), 5, 1.0, 1, i, "/s") for i, n in enumerate("abc")], "path string, size bigint, mtime double, dev bigint, ino bigint, source string")
    put(tmp_path, "a", b"same!")
    put(tmp_path, "b", b"same!")
    out = real.exact_files(files, spark.createDataFrame([], CONTENT_INDEX), ScanOptions())
    assert [(os.path.basename(r["path"]), r["read"]) for r in out.errors.collect()] == [("c", "prefix")] and out.members.count() == 2
    options = ScanOptions(roots=(str(tmp_path),), advanced_similar=True)
    stopped = real.scan_files(spark, options, str(tmp_path / "ix"), stop=lambda: True)
    assert stopped.run["cancelled"] and stopped.members.count() == 2 and index.load(spark, stopped.index, CONTENT_INDEX).count() == 2


def test_similar_files_from_paths(spark, tmp_path, capsys):
    data = random.Random(4).randbytes(40_000)
    put(tmp_path, "r/doc1.dat", data)
    put(tmp_path, "r/doc2.dat", data + b"tail" * 125)
    put(tmp_path, "r/other.dat", random.Random(5).randbytes(40_000))
    options = ScanOptions(roots=(str(tmp_path / "r"),), advanced_similar=True, similar_threshold=0.5, fuzzy=False)
    out = real.scan_files(spark, options).members.collect()
    assert {os.path.basename(r["path"]) for r in out} == {"doc1.dat", "doc2.dat"}
    assert real.main([str(tmp_path / "r"), "--similar", "--out", str(tmp_path / "out")]) == 0
    assert "doc" in capsys.readouterr().out and spark.read.parquet(str(tmp_path / "out")).count() == 2


@pytest.mark.parametrize("fuzzy", [False, True])
def test_hard_links_alone_are_not_similar(spark, tmp_path, fuzzy):
    words = " ".join(f"word{i * 7919 % 997}" for i in range(6000)).encode()
    a = put(tmp_path, "r/a.dat", words)
    os.link(a, tmp_path / "r/b.dat")
    options = ScanOptions(roots=(str(tmp_path / "r"),), advanced_similar=True, fuzzy=fuzzy, find_images=False)
    assert scan.all_groups(contents(spark, walk.walk(spark, options)), options).count() == 0
    rows = spark.createDataFrame([("/r/p", len(words), None, None, words), ("/r/q", len(words), None, None, words)], "path string, size bigint, dev bigint, ino bigint, content binary")
    assert scan.first_links(rows).count() == 2  # files without an inode stand for themselves


def test_join_groups_of_any_key(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).cast("bigint").alias("k"), F.col("id").alias("v"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"))
    for kind in ("bigint", "string", "binary"):
        cast = lambda df: df.withColumn("k", F.col("k").cast("string").cast(kind) if kind == "binary" else F.col("k").cast(kind))
        out = join_groups(cast(rows), cast(groups), "k", "n", F.col("v")).collect()
        assert len(out) == 6000 and all((r["n"], r["low"]) == ((4000, 0) if r["v"] < 4000 else (1, r["v"])) for r in out)
    assert [r["n"] for r in join_groups(rows.limit(0).unionByName(spark.createDataFrame([(99, 1)], "k bigint, v bigint")), groups, "k", "n", F.col("v")).collect()] == [None]


@pytest.mark.parametrize("plain", [1_000_000, 100])
def test_components_with_a_hot_node(spark, monkeypatch, plain):
    monkeypatch.setattr(components, "PLAIN_EDGES", plain)
    edges = [(0, i) for i in range(1, 3000)] + [(5000 + i, 5001 + i) for i in range(300)] + [(2999, 5300)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert len(found) == 3301 and set(found.values()) == {0}


def test_a_large_exact_group_and_one_that_differs(spark):
    rows = [(f"/s/{i}", 4, b"same", i) for i in range(3000)] + [("/s/x", 3, b"abc", 9001), ("/s/y", 3, b"abc", 9002), ("/s/n", 3, None, 9003), ("/s/m", 3, None, 9004)]
    files = spark.createDataFrame([(p, s, 1.0, 1, n, "/s", c) for p, s, c, n in rows], "path string, size bigint, mtime double, dev bigint, ino bigint, source string, content binary")
    found = exact.exact_members(files)
    assert found.count() == 3002 and found.filter("size = 3").count() == 2


def test_sets_whose_tokens_read_alike(spark):
    sets = [(1, ["a\nb"]), (2, ["a", "b"]), (3, ["1:a", "b"]), (4, ["b", "a"]), (5, [])]
    classes = simjoin.set_classes(spark.createDataFrame(sets, "id bigint, tokens array<string>"))
    assert sorted((r["rep"], r["rows"]) for r in classes.collect()) == [(1, 1), (2, 2), (3, 1)]


def test_set_join_of_many_like_sets(spark):
    rng = random.Random(3)
    sets = [["the", "of", f"w{i}"] for i in range(400)] + [sorted({f"x{rng.randrange(60)}" for _ in range(rng.randint(20, 40))}) for _ in range(60)]
    classes = simjoin.set_classes(spark.createDataFrame(list(enumerate(sets)), "id bigint, tokens array<string>"))
    found = {(r["a"], r["b"]) for r in simjoin.jaccard_pairs(classes, 0.5).collect()}
    assert found == {(i, j) for i, j in combinations(range(len(sets)), 2) if len(set(sets[i]) & set(sets[j])) >= 0.5 * len(set(sets[i]) | set(sets[j])) and set(sets[i]) != set(sets[j])}


def test_spread_in_blocks_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "SPREAD_BLOCK", 7)
    rng = random.Random(5)
    words = [(i, rng.getrandbits(62)) for i in range(80)]
    clusters = spark.createDataFrame([(i, 0 if i < 60 else 60) for i, _ in words], "node bigint, root bigint")
    values = spark.createDataFrame(words, "rep bigint, ph bigint")
    found = {r["root"]: r["spread"] for r in simjoin.spread(clusters, values, scalars.hamming(F.col("x.ph"), F.col("y.ph")), F.max).collect()}
    far = lambda part: max((a ^ b).bit_count() for (_, a), (_, b) in combinations(part, 2))
    assert found == {0: far(words[:60]), 60: far(words[60:])}


def test_a_stream_starts_again(spark, tmp_path):
    schema = "path string, dev bigint, ino bigint, size bigint, mtime double, full_hash string"
    folder, batches = str(tmp_path / "index"), [[("a", 1, 1, 5, 1.0, "h"), ("b", 1, 2, 5, 1.0, "h")], [("b", 1, 2, 5, 1.0, "h"), ("c", 1, 3, 6, 1.0, "i")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        arrivals = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        IndexStream(spark, folder).start(arrivals, str(tmp_path / "checkpoint")).awaitTermination()
    stream = IndexStream(spark, folder)
    assert {r["path"] for r in stream.current().collect()} == {"a", "b", "c"} and stream.counts() == (1, 3)
    stream.run = next(v[1] for v in stream._versions())
    stream.take(spark.createDataFrame(batches[1], schema), 1)  # the epoch is played again
    assert stream.counts() == (1, 3) and stream.current().count() == 3
    other = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    IndexStream(spark, folder).start(other, str(tmp_path / "new checkpoint")).awaitTermination()
    assert IndexStream(spark, folder).current().count() == 3


def test_an_index_that_cannot_be_read_is_an_error(spark, tmp_path):
    assert index.load(spark, str(tmp_path / "none"), CONTENT_INDEX).count() == 0
    spark.createDataFrame([("a", "text")], "path string, size string").write.parquet(str(tmp_path / "odd"))
    with pytest.raises(Exception):
        index.load(spark, str(tmp_path / "odd"), CONTENT_INDEX).collect()


def test_image_index(spark):
    known = spark.createDataFrame([("a", 5, 1.0, 11, 12, 2, 3, 0), ("b", 5, 9.0, 21, 22, 2, 3, 1)], IMAGE_INDEX)
    files = spark.createDataFrame([("a", 5, 1.0), ("b", 5, 1.0), ("c", 6, 1.0)], "path string, size bigint, mtime double")
    asked = []

    def prints(misses):
        asked.extend(r["path"] for r in misses.collect())
        return spark.createDataFrame([("b", 31, 32, 4, 5)], "path string, phash bigint, dhash bigint, width int, height int")

    out = {r["path"]: (r["phash"], r["reused"]) for r in index.image_prints(files, known, prints).collect()}
    assert out == {"a": (11, True), "b": (31, False), "c": (None, False)} and sorted(asked) == ["b", "c"]


def test_damaged_archives(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<w>" + "some words " * 400 + "</w>")
    whole = out.getvalue()
    at = whole.find(b"word/document.xml") + 17
    damaged = whole[:at] + bytes(b ^ 0xFF for b in whole[at : at + 40]) + whole[at + 40 :]
    for content in (b"", b"x", whole[:60], damaged):
        assert previews.office_text(content) is None
        previews.archive_text(content)
    assert previews.office_text(whole).startswith("some words") and len(previews.office_text(whole)) <= 6000


def test_logs_grow_and_actions_are_noted(spark, tmp_path):
    folder = str(tmp_path / "actions")
    assert logs.load_actions(spark, folder).count() == 0
    outcomes = spark.createDataFrame([("/a", 5, True, None), ("/c", 7, False, "late"), ("/b", 7, False, "no")], "path string, size bigint, done boolean, error string")
    for when in (1.0, 2.0):
        logs.append(logs.action_entry(outcomes, "trash", when, 100), folder)
    rows = logs.load_actions(spark, folder).collect()
    assert [(r["when"], r["files"], r["freed"], r["after_bytes"], r["ok"], r["error"]) for r in rows] == [(2.0, 1, 5, 95, True, "no"), (1.0, 1, 5, 95, True, "no")]
    plan = spark.createDataFrame([("/usr/",), ("//usr",), ("/usr/.",), ("/usr/x",), ("/",)], "path string").select("path", logs.protected(F.col("path")).alias("p"))
    assert {r["path"] for r in plan.collect() if r["p"]} == {"/usr/", "//usr", "/usr/.", "/"}


def test_glossary_keys(spark, tmp_path):
    put(tmp_path, "g.json", b'{"entries": [{"key": "a", "short": "first"}, {"key": "a", "short": "second"}, {"key": "b"}]}')
    entries = logs.load_glossary(spark, str(tmp_path / "g.json"))
    assert logs.glossary_short(entries, "a") == "first" and logs.glossary_short(entries, "b") == "" and logs.glossary_short(entries, "c") == "" and logs.glossary_entry(entries, "c").count() == 0


def test_drives(spark, tmp_path):
    assert drives.mount_rows("a /x\\040y ext4 rw\nshort\n") == [("/x y", "a", "ext4", 0)]
    assert drives.node_rows("no json") == [] and drives.node_rows("") == [] and drives.block_devices(spark, "{}").count() == 0
    assert drives.capacity("/") > 0 and drives.capacity("/no/such/folder") == 0
    assert drives.mounts(spark, str(tmp_path / "none")).count() == 0
    rows = drives.drives_of(spark.createDataFrame([("/x",)], "path string"), drives.mounts(spark, str(tmp_path / "none")), drives.block_devices(spark, "")).collect()
    assert [tuple(r) for r in rows] == [("/x", None, None, "", "", "", "", 0)]


@pytest.mark.parametrize("n", [0, 999, 1000, 1249, 1250, 1350, 1450, 999_949, 999_950, 1_050_000, 2_500_000_000, 12_345_678_901_234, 9_223_000_000_000_000_000])
def test_sizes_round_as_exact_binary_values(spark, n):
    units, x = iter(("B", "KB", "MB", "GB", "TB", "PB")), float(n)
    unit = next(units)
    while x >= 1000 and unit != "PB":
        unit = next(units)
        x = n / 10.0 ** (3 * ("B", "KB", "MB", "GB", "TB", "PB").index(unit))
    want = f"{n} B" if unit == "B" else f"{x:.1f} {unit}"
    assert spark.range(1).select(scalars.human_bytes(F.lit(n).cast("bigint"))).head()[0] == want


def test_options_are_stored(tmp_path):
    options = ScanOptions(roots=("/a/", "/b"), exclude=("*.tmp",), hamming=5, exclusions=None)
    options.save(str(tmp_path / "o.json"))
    assert ScanOptions.load(str(tmp_path / "o.json")) == options and ScanOptions.load(str(tmp_path / "none")) == ScanOptions()
    put(tmp_path, "odd.json", b"[1]")
    put(tmp_path, "bad.json", b"{")
    assert ScanOptions.load(str(tmp_path / "odd.json")) == ScanOptions.load(str(tmp_path / "bad.json")) == ScanOptions()


def test_similar_names_and_large_files(spark):
    pairs = spark.createDataFrame([("/a/Report Final.doc", "/b/report final (1).pdf"), ("/a/x", None)], "a string, b string")
    found = [r["similarity"] for r in previews.with_name_similarity(pairs).collect()]
    assert 0.8 < found[0] < 1 and found[1] is None
    assert [r[0] for r in spark.createDataFrame([(1 << 29,), ((1 << 29) - 1,)], "size bigint").select(filters.is_large(F.col("size"))).collect()] == [True, False]


def test_images_from_paths_are_decoded_once(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(images, "FILES", 2)
    y, x = np.mgrid[0:96, 0:128]
    picture = (x + 60 * np.sin(x / 9) * np.cos(y / 11) + 60).clip(0, 255)
    put(tmp_path, "r/a.png", png(picture))
    put(tmp_path, "r/x [1] {copy}*.png", png((picture + 3).clip(0, 255)))
    put(tmp_path, "r/pic+ture%20?.png", png(picture[::2, ::2]))
    put(tmp_path, "r/other.png", png((255 * ((x // 16 + y // 12) % 2)).clip(0, 255)))
    broken = put(tmp_path, "r/broken.png", b"no image")
    options = ScanOptions(roots=(str(tmp_path / "r"),))
    first = real.scan_files(spark, options, str(tmp_path / "index"))
    found = {(r["kind"], os.path.basename(r["path"])) for r in first.members.collect()}
    assert found == {("image", "a.png"), ("image", "x [1] {copy}*.png"), ("image", "pic+ture%20?.png")}
    assert {(r["width"], r["height"]) for r in first.members.collect()} == {(128, 96), (64, 48)}
    assert [(r["path"], r["read"]) for r in first.errors.collect()] == [(broken, "image")]
    assert first.run["reads"]["image"] == 5 and first.run["sources"][0]["hashed"] == 5
    second = real.scan_files(spark, options, str(tmp_path / "index"), index_version=first.index)
    assert second.run["reads"]["image"] == 1  # the one that can't be decoded is tried again
    assert second.run["sources"][0]["reused"] == 4 and {(r["kind"], os.path.basename(r["path"])) for r in second.members.collect()} == found
    put(tmp_path, "r/new.png", png(picture))
    third = real.scan_files(spark, options, str(tmp_path / "index"), index_version=second.index)
    assert third.run["reads"]["image"] == 2 and index.load(spark, index.beside(third.index, "images"), IMAGE_INDEX).count() == 5
    assert real.main([str(tmp_path / "r")]) == 0 and "image\t4" in capsys.readouterr().out
    assert real.main([str(tmp_path / "r"), "--no-images"]) == 0 and "image\t" not in capsys.readouterr().out
    with pytest.raises(ValueError):
        scan.all_groups(spark.createDataFrame([], "path string, size bigint, mtime double, dev bigint, ino bigint, source string, content binary"), options)


def test_deepest_folders(spark, monkeypatch):
    from copyfold import skew
    from copyfold.operators import folders

    monkeypatch.setattr(skew, "HOT_FLOOR", 10)
    rng = random.Random(8)
    paths = ["/" + "/".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(400)] + ["/hot/x/f%d" % i for i in range(300)] + ["rel/a/b", "rel", "/a b/c", "/", "/a/"]
    named = ["/a", "/a/b", "/b/c/a", "/c/c/c/c", "/hot", "rel/a", "/a b", "/a/b", "/nowhere", "/b/b/b/b/b/b"]
    rows = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, n int")
    table = spark.createDataFrame([(f,) for f in named], "folder string")
    want = {i: max((f for f in named if p == f or p.startswith(f.rstrip("/") + "/")), key=len, default=None) for i, p in enumerate(paths)}
    assert {r["n"]: r["folder"] for r in folders.deepest_folder(rows, table).collect()} == want
    assert {r["n"] for r in folders.drop_below(rows, table).collect()} == {i for i, f in want.items() if f is None}
    top = folders.deepest_folder(rows, spark.createDataFrame([("/",)], "folder string")).collect()
    assert all(r["folder"] == ("/" if r["path"].startswith("/") else None) for r in top)


def test_arrivals_as_a_stream(spark, tmp_path):
    import time

    root, stream = tmp_path / "r", IndexStream(spark, str(tmp_path / "index"))
    options = ScanOptions(roots=(str(root), str(root / "sub")), exclude=("*.tmp",))

    def run():
        time.sleep(0.3)
        stream.start(scan.scoped(walk.arrivals(spark, options, settle=0.1), options), str(tmp_path / "checkpoint")).awaitTermination()
        return {os.path.relpath(r["path"], root) for r in stream.current().collect()}, stream.counts()

    a, b = put(tmp_path, "r/a.txt", b"one"), put(tmp_path, "r/sub/b.txt", b"two")
    put(tmp_path, "r/c.tmp", b"no")
    assert run() == ({"a.txt", "sub/b.txt"}, (0, 2))
    put(tmp_path, "r/sub/new.txt", b"three")
    old = put(tmp_path, "old.txt", b"four")
    os.utime(old, (1, 1))
    os.rename(old, root / "moved.txt")  # an old file that comes now
    assert run() == ({"a.txt", "sub/b.txt", "sub/new.txt", "moved.txt"}, (0, 4))
    assert run()[1] == (0, 4)  # nothing new: nothing is read
    put(tmp_path, "r/a.txt", b"one and more")
    os.chmod(b, 0o600)  # looks changed, has the same size and time
    assert run()[1] == (1, 5)
    found = {os.path.basename(r["path"]): r["sha256"] for r in stream.current().collect()}
    assert found["a.txt"] == walk.file_digest(a) and len(found) == 4


def test_contents_are_compared_chunk_by_chunk(spark):
    rng = random.Random(2)
    base = rng.randbytes(1000)
    groups = {"same": [base, base, base], "end": [base, base[:-1] + b"x"], "middle": [base, base[:500] + b"?" + base[501:]], "shorter": [base, base[:999]], "less": [base, base[:128]], "none": [base, None], "empty": [b"", b""], "hollow": [b"", b"a"], "swapped": [base[:64] + base[64:128], base[64:128] + base[:64]]}
    rows = [(g, f"{g}{i}", c) for g, contents in groups.items() for i, c in enumerate(contents)] + [("many", f"m{i}", base) for i in range(500)]
    files = spark.createDataFrame([(p, c) for _, p, c in rows], "path string, content binary")
    found = spark.createDataFrame([(g, p) for g, p, _ in rows], "group_id string, path string")
    kept = {r["group_id"] for r in exact.verified(found, files, 64).collect()}
    assert kept == {"same", "empty", "many"} == {r["group_id"] for r in exact.verified(found, files).collect()}
