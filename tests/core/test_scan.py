"""Scans of real files, fingerprints, similarity joins, the index and its stream."""

import hashlib
import os
import random
import struct
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from copyfold.checkpoints import checkpointed
from copyfold.functions import ctph
from copyfold.functions import fingerprints as prints
from copyfold.operators import exact, filters, index, keeper, logs, packed, simjoin
from copyfold.operators.components import connected_components
from copyfold.options import ScanOptions
from copyfold.plans import registry, scan
from copyfold.sources import adapters, walk
from copyfold.streaming.arrivals import IndexStream

FILE = "path string, size bigint, mtime double, dev bigint, ino bigint, source string"


def put(folder, name, data):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    return str(path)


def test_walk(spark, tmp_path):
    for name in ("big.txt", ".hidden.txt", "node_modules/dep.js", "sub/deep/x.dat", ".git/config"):
        put(tmp_path, name, b"x" * 5000)
    put(tmp_path, "tiny.txt", b"x")
    root = str(tmp_path)
    files = walk.walk(spark, ScanOptions(roots=(root + "/", root), exclusions=("build",)))
    found = {os.path.relpath(r["path"], root): r for r in files.collect()}
    assert set(found) == {"big.txt", "tiny.txt", "sub/deep/x.dat"} and all(r["source"] == root for r in found.values())
    assert {r["path"] for r in filters.in_scope(files, 100).collect()} == {f"{root}/big.txt", f"{root}/sub/deep/x.dat"}
    assert walk.walk(spark, ScanOptions(roots=(str(tmp_path / "missing"),))).count() == 0


def contents(spark, files):
    rows = [(*r, open(r["path"], "rb").read()) for r in files.collect()]
    return spark.createDataFrame(rows, FILE + ", content binary")


def test_exact_scan(spark, tmp_path):
    data = b"the same content\n" * 2000
    a, b = put(tmp_path, "one/a.dat", data), put(tmp_path, "two/b.dat", data)
    put(tmp_path, "one/unique.dat", b"different" * 2000)
    os.link(a, tmp_path / "one/c.dat")
    options = ScanOptions(roots=(str(tmp_path / "one"), str(tmp_path / "two")), find_images=False)
    files = contents(spark, walk.walk(spark, options))
    ranked = scan.all_groups(files, options)
    view = keeper.groups_view(ranked).collect()
    assert len(view) == 1 and view[0]["files"] == 2 and view[0]["reclaimable"] == len(data) and view[0]["keeper"] == a
    assert {r["path"] for r in ranked.collect()} == {a, b}
    os.remove(b)
    assert scan.all_groups(contents(spark, walk.walk(spark, options)), options).count() == 0  # hard links alone are no group


def test_digests_of_real_files(spark, tmp_path):
    a, b = put(tmp_path, "a", b"x" * 3_000_000), put(tmp_path, "b", b"x" * 2_999_999 + b"y")
    files = spark.createDataFrame([(a,), (b,), (str(tmp_path / "none"),)], "path string")
    out = {r["path"]: r for r in walk.with_file_digest(walk.with_file_digest(files, "full"), "prefix", 65536).collect()}
    assert out[a]["full"] == hashlib.sha256(open(a, "rb").read()).hexdigest() and out[a]["prefix"] == out[b]["prefix"] and out[str(tmp_path / "none")]["full"] is None
    pairs = spark.createDataFrame([(a, a), (a, b), (a, "/none")], "path string, first string")
    assert {r["first"]: r["same"] for r in walk.with_same_bytes(pairs).collect()} == {a: True, b: False, "/none": None}
    assert walk.same_bytes(a, a) is True and walk.same_bytes(a, b) is False and walk.same_bytes(a, "/none") is None


def test_a_group_that_differs_is_dropped_whole(spark):
    files = spark.createDataFrame([("a", b"1"), ("b", b"1"), ("c", b"2"), ("d", b"3"), ("e", b"3")], "path string, content binary")
    found = spark.createDataFrame([("g", "a"), ("g", "b"), ("g", "c"), ("h", "d"), ("h", "e")], "group_id string, path string")
    assert {r["path"] for r in exact.verified(found, files).collect()} == {"d", "e"}


def test_gear_hashes_are_the_rolling_ones():
    data = np.frombuffer(random.Random(1).randbytes(500), np.uint8)
    h, want = 0, []
    for i, b in enumerate(data.tolist()):
        h = ((h << 1) + int(prints._GEAR[b])) & 0xFFFFFFFF
        if i >= 31:
            want.append(h)
    assert prints.gear_hashes(data).tolist() == want


def test_anchors_survive_an_insertion():
    data, other = random.Random(2).randbytes(60_000), random.Random(3).randbytes(60_000)
    a, b, c = (set(prints.anchors(x)) for x in (data, data[:30_000] + b"x" * 152 + data[30_000:], other))
    assert len(a & b) / len(a | b) > 0.6 and len(a & c) / len(a | c) < 0.2
    assert prints.anchors(b"") == [] and len(prints.anchors(b"abc")) == 1 and 60_000 / 64 < len(a) < 60_000 / 16


def test_advanced_scan(spark, tmp_path):
    data = random.Random(4).randbytes(40_000)
    for name, content in (("doc1", data), ("doc2", data + b"tail" * 125), ("other", random.Random(5).randbytes(40_000))):
        put(tmp_path, f"r/{name}.dat", content)
    options = ScanOptions(roots=(str(tmp_path / "r"),), advanced_similar=True, similar_threshold=0.5, fuzzy=False, find_images=False)
    out = scan.all_groups(contents(spark, walk.walk(spark, options)), options).collect()
    assert {os.path.basename(r["path"]) for r in out} == {"doc1.dat", "doc2.dat"} and {r["kind"] for r in out} == {"similar"}


def test_all_groups_query_is_brute_force(spark, tmp_path):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    big, near, part = text(340_000), text(3000), text(3000)
    texts = ["same " * 100, "same " * 100, big, big[:9000] + "an edit" + big[9000:], near, near[:500] + "edited" + near[540:], part, part + text(1500), text(3000), "short", ""]
    rows = [(i + i // 5, t, "en", "src0") for i, t in enumerate(texts)]  # no ids of images among these
    rows += [(i, f"picture {i}", "en", "src0") for i in (5, 11, 41, 47, 53)]  # the last shows nothing
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    seen = [float(np.sin(k * k)) for k in range(64)]
    spark.createDataFrame([(0, seen), (3, seen)], "vec_id bigint, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    content = {r["path"]: bytes(r["content"]) for r in adapters.document_files(spark, str(tmp_path), content=True).collect()}
    assert max(map(len, content.values())) > prints.ANCHOR_SIZES[1]
    hashes = {p: hashlib.sha256(c).hexdigest() for p, c in content.items() if c}
    want = {("exact", p, h) for p, h in hashes.items() if list(hashes.values()).count(h) > 1}
    rest = {p: content[p] for p in hashes if not any(p == w[1] for w in want) and "IMG_" not in p}
    digests = {p: ctph.digests([c])[0] for p, c in rest.items() if prints.DIGEST_SIZES[0] <= len(c) <= prints.DIGEST_SIZES[1]}
    fuzzy = fuzzy_roots(digests, 80, lambda a, b: 100 - ctph.compare(a, b))
    sets = {p: set(prints.anchors(c)) for p, c in rest.items() if p not in fuzzy and 64 <= len(c) <= 2 << 20}
    for a, b in combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.55:
            want |= {("similar", a, a), ("similar", b, a)}
    want |= {("similar", p, r) for p, r in fuzzy.items()}
    pictures = sorted(p for p in content if "IMG_" in p and "IMG_53" not in p)  # the two embeddings are alike
    want |= {("image", p, pictures[0]) for p in pictures}
    out = registry.QUERIES["all_groups"](spark, str(tmp_path)).collect()
    assert {(r["kind"], r["path"], r["group_id"]) for r in out} == want and len(out) == len(want)
    assert any(len(content[p]) > 2 << 20 for _, p, _ in want) and sum(r["keeper"] for r in out) == len({w[2] for w in want})


def test_a_scan_reads_contents_once_for_each_print(spark, monkeypatch):
    """Contents are never shuffled, joins read the files without them, and images are printed once."""
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(2000)).encode()
    near, shifted = text[:900] + b"an edit" + text[910:], text[6000:] + text[:5000]
    rows = [(f"/r/{n}", len(c), 1.0, 1, i, "/r", c) for i, (n, c) in enumerate([("a.txt", text), ("b.txt", text), ("c.txt", near), ("d.txt", shifted), ("e.txt", text[::-1]), ("f.jpg", b"f"), ("g.jpg", b"gg")])]
    files = spark.createDataFrame(rows, FILE + ", content binary")
    reads, printed = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    def pictured(batches):
        for batch in batches:
            printed.add(batch.num_rows)
            yield batch

    pictures = spark.createDataFrame([("/r/f.jpg", 1, 1, 8, 8), ("/r/g.jpg", 3, 1, 8, 8)], "path string, ph bigint, dh bigint, width int, height int")
    out = scan.all_groups(files.mapInArrow(counted, files.schema), ScanOptions(roots=("/r",), advanced_similar=True), pictures.mapInArrow(pictured, pictures.schema)).collect()
    assert {(r["kind"], r["path"]) for r in out} >= {("exact", "/r/a.txt"), ("exact", "/r/b.txt"), ("image", "/r/f.jpg"), ("image", "/r/g.jpg"), ("similar", "/r/c.txt"), ("similar", "/r/d.txt")}
    # digests, the bytes of exact groups, piecewise digests and anchors
    assert reads.value == 4 * len(rows) and printed.value == 2


def test_locality_digest():
    rng = random.Random(6)
    text = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(50)) for _ in range(800)).encode()
    near = text[:2000] + b"an edit of some words" + text[2040:]
    far = rng.randbytes(6000)
    a, b, c = map(prints.locality_digest, (text, near, far))
    assert prints.digest_distance(a, a) == 0 and prints.digest_distance(a, b) <= 80 < prints.digest_distance(a, c)
    assert prints.locality_digest(b"x" * 100) is None and prints.locality_digest(b"x" * 1000) is None


def fuzzy_roots(digests, distance, apart=prints.digest_distance):
    """Least name of the component of each of the named digests, by comparing all pairs; single ones are left out."""
    root = {n: n for n in digests}
    for a, b in combinations(sorted(digests), 2):
        if apart(digests[a], digests[b]) <= distance and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {n: low if r == high else r for n, r in root.items()}
    return {n: r for n, r in root.items() if list(root.values()).count(r) > 1}


@pytest.mark.parametrize("block", [7, 50, 32768])
def test_fuzzy_links_are_brute_force(spark, block):
    rng = random.Random(11)
    digests = {f"far{i}": bytes(rng.randrange(4) for _ in range(128)) for i in range(20)}
    for n, base in enumerate(list(digests.values())):
        for m, steps in enumerate((0, 16, 31, 32, 33, 40)):
            near = bytearray(base)
            for at in rng.sample(range(128), steps):
                near[at] += 1 if near[at] < 3 else -1
            digests[f"near{n}-{m}"] = bytes(near)
    spread = bytearray(digests["far0"])
    for at in range(0, 128, 8):  # one step in each run of eight codes
        spread[at] += 1 if spread[at] < 3 else -1
    turned = bytes(3 - c if at < 6 else c for at, c in enumerate(b"\x00" * 6 + digests["far1"][6:]))
    digests |= {"spread": bytes(spread), "low": b"\x00" * 6 + digests["far1"][6:], "turned": turned, "flat": b"\x01" * 128}
    links = scan.fuzzy_links(spark.createDataFrame(list(digests.items()), "path string, digest binary"), 80, block)
    found = {r["node"]: r["root"] for r in connected_components(links).collect()}
    assert found == fuzzy_roots(digests, 80) and found["spread"] == found["far0"]


def png(grey):
    """A grey image as PNG bytes."""
    h, w = grey.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\x00" + r.astype(np.uint8).tobytes() for r in grey)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    y, x = np.mgrid[0:192, 0:256]
    picture = (x / 2 + 60 * np.sin(x / 17) * np.cos(y / 23) + 60).clip(0, 255)
    noisy = (picture + np.random.default_rng(1).normal(0, 4, picture.shape)).clip(0, 255)
    other = (255 * ((x // 32 + y // 24) % 2)).clip(0, 255)
    for name, image in (("a.png", picture), ("half.png", picture[::2, ::2]), ("noisy.png", noisy), ("other.png", other)):
        put(tmp_path, f"r/{name}", png(image))
    put(tmp_path, "r/broken.png", b"not an image")
    options = ScanOptions(roots=(str(tmp_path / "r"),))
    images = spark.read.format("image").option("dropInvalid", True).load(str(tmp_path / "r"))
    found = prints.image_fingerprints(images).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    assert found.count() == 4
    out = scan.all_groups(contents(spark, walk.walk(spark, options)), options, found).collect()
    assert {os.path.basename(r["path"]) for r in out} == {"a.png", "half.png", "noisy.png"} and {r["kind"] for r in out} == {"image"}
    assert next(os.path.basename(r["path"]) for r in out if r["keeper"]) in ("a.png", "noisy.png")


def test_grey_of_floats_is_computed_in_floats(spark, tmp_path):
    numbers = np.array([-2.95] * 64, np.float32)  # on the edge of a pixel: 10 in floats, 9 in doubles
    spark.createDataFrame([(1, numbers.tolist())], "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    row = adapters.embedding_images(spark, str(tmp_path)).select("image.data").head()
    assert list(row["data"]) == np.floor(np.float32(128) + np.float32(40) * numbers).astype(int).tolist() == [10] * 64


def test_hamming_join_is_brute_force(spark):
    rng = random.Random(7)
    words = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(60)]
    for p, d in list(words):
        for _ in range(2):
            words.append((p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 10))), d ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 10)))))
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    rows = [(i, signed(p), signed(d)) for i, (p, d) in enumerate(words)]
    classes = simjoin.hamming_classes(spark.createDataFrame(rows, "id bigint, ph bigint, dh bigint"))
    for distance in (0, 3, 8):
        found = {(r["a"], r["b"]) for r in simjoin.hamming_pairs(classes, distance).collect()}
        first = {}
        for i, w in enumerate(words):
            first.setdefault(w, i)
        want = {(i, j) for i, j in combinations(sorted(first.values()), 2) if max((words[i][k] ^ words[j][k]).bit_count() for k in (0, 1)) <= distance}
        assert found == want


def test_hamming_cells_are_not_broadcast(spark):
    # 81 rows of each class, which the size that Spark estimates doesn't count
    pairs = simjoin.hamming_pairs(simjoin.hamming_classes(spark.range(50).selectExpr("id", "id * 3 AS ph", "id AS dh")))
    assert pairs.count() > 0
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.8, 1.0])
def test_jaccard_join_by_many_tokens_is_brute_force(spark, monkeypatch, threshold):
    monkeypatch.setattr(simjoin, "SHARE", 2)
    rng = random.Random(18)
    sets = [set(range(60)) - set(rng.sample(range(60), rng.randint(0, 35))) for _ in range(40)]
    sets += [{rng.randrange(60) for _ in range(rng.randint(1, 60))} for _ in range(40)]
    classes = simjoin.set_classes(spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id bigint, tokens array<bigint>"))
    found = {(r["a"], r["b"]) for r in simjoin.jaccard_pairs(classes, threshold).collect()}
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    assert found == {(i, j) for i, j in combinations(sorted(first.values()), 2) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}


def test_large_sets_need_more_than_one_token(spark):
    # neighbours share a token and no more
    sets = [(i, [1000 * i + k for k in range(200)] + [-1 - j for j in range(2 * i, 2 * i + 3)]) for i in range(20)]
    classes = spark.createDataFrame(sets, "rep bigint, tokens array<bigint>")
    assert simjoin.candidate_pairs(simjoin.ranked_sets(classes), 0.55).count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.8, 1.0])
def test_jaccard_join_is_brute_force(spark, threshold):
    rng = random.Random(8)
    sets = [sorted({rng.randrange(40) for _ in range(rng.randint(1, 14))}) for _ in range(120)]
    classes = simjoin.set_classes(spark.createDataFrame(list(enumerate(sets)), "id bigint, tokens array<bigint>"))
    found = {(r["a"], r["b"]): r["similarity"] for r in simjoin.jaccard_pairs(classes, threshold).collect()}
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(tuple(s), i)
    want = {(i, j): len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) for i, j in combinations(sorted(first.values()), 2)}
    assert found == {k: v for k, v in want.items() if v >= threshold}


@pytest.mark.parametrize("threshold", [0.3, 0.55, 1.0])
def test_jaccard_join_of_many_blocks_is_brute_force(spark, monkeypatch, threshold):
    # bands are cut into blocks, places are spelled out in many lots, and counted by groups of sets and by pairs
    for name, value in (("BLOCK_TOKENS", 400), ("BLOCK_SETS", 16), ("LOT", 40), ("PART_BLOCKS", 3)):
        monkeypatch.setattr(simjoin, name, value)
    rng = random.Random(21)
    base = [set(rng.sample(range(300), 30)) for _ in range(6)]
    sets = [base[i % 6] - set(rng.sample(sorted(base[i % 6]), rng.randint(0, 9))) | {rng.randrange(300) for _ in range(rng.randint(0, 6))} for i in range(90)]
    sets += [{rng.randrange(300) for _ in range(rng.randint(1, 40))} for _ in range(60)]
    classes = checkpointed(simjoin.ranked_sets(simjoin.set_classes(spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id bigint, tokens array<bigint>"))))
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    want = {(i, j) for i, j in combinations(sorted(first.values()), 2) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}
    pairs = simjoin.packed_pairs(classes, threshold)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want
    # pairs that meet are counted where the blocks are read: none of them is shuffled
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_links_of_alike_sets_are_a_forest(spark, monkeypatch):
    seen = []
    ours = scan.connected_components
    monkeypatch.setattr(scan, "connected_components", lambda edges: seen.append(edges.count()) or ours(edges))
    # all pairs of 60 sets are similar
    sets = spark.createDataFrame([(i, [*range(100), 1000 + i, 1000 + (i + 1) % 60]) for i in range(60)], "id bigint, tokens array<bigint>")
    assert {r["cluster"] for r in scan.set_clusters(sets).collect()} == {0}
    assert seen == [59]


def test_packed_sets(spark):
    rng = random.Random(5)
    sets = [sorted({rng.randrange(1 << rng.randint(1, 45)) for _ in range(rng.randint(0, 30))}) for _ in range(300)]
    whole = packed.pack(np.array([x for s in sets for x in s], np.int64), np.array([len(s) for s in sets], np.int64))
    for at, n in ((0, 300), (100, 50), (7, 0)):
        numbers, sizes = packed.unpack(whole.slice(at, n))
        assert numbers.tolist() == [x for s in sets[at : at + n] for x in s] and sizes.tolist() == [len(s) for s in sets[at : at + n]]
    # words of one set alone are only counted; the others take little more than a byte each, however long they are
    rows = [(i, [f"{k:040d}" for k in range(0, 1000, 1 + i % 3)] + [f"only {i}"] * (i > 2)) for i in range(9)]
    found = packed.numbered_sets(spark.createDataFrame([*rows, (9, []), (10, None)], "id bigint, tokens array<string>")).collect()
    assert {r["id"]: (r["size"], r["shared"]) for r in found} == {i: (len(t), len(t) - (i > 2)) for i, t in rows}
    assert all(len(r["s"]) < 2 * r["size"] for r in found) and len({r["class"] for r in found}) == 9


@pytest.mark.parametrize("block", [3, 2048])
def test_set_spreads_are_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simjoin, "SET_BLOCK", block)
    rng = random.Random(12)
    sets = [frozenset(range(100 * (i % 4), 100 * (i % 4) + 30)) - set(rng.sample(range(100 * (i % 4), 100 * (i % 4) + 30), rng.randint(0, 9))) for i in range(60)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(60), 2):
        if 100 * len(sets[i] & sets[j]) >= 55 * len(sets[i] | sets[j]):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {}
    for i, j in combinations(range(60), 2):
        if find(i) == find(j) and sets[i] != sets[j]:
            want[find(i)] = min(want.get(find(i), 100), 100 * len(sets[i] & sets[j]) // len(sets[i] | sets[j]))
    found = scan.set_spreads(spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id bigint, tokens array<bigint>"))
    assert {r["cluster"]: r["spread"] for r in found.collect()} == want


def test_similar_spread_query_counts_whole_hundredths(spark, tmp_path):
    # 57 of 100 words are shared, and 100 times 0.57 is below 57 in floats
    words = [f"w{k}" for k in range(100)]
    spark.createDataFrame([(3, " ".join(words)), (5, " ".join(words[:57]))], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert [tuple(r) for r in registry.QUERIES["similar_spread"](spark, str(tmp_path)).select("root", "spread").collect()] == [(3, 57)]


@pytest.mark.parametrize("block", [3, 4096])
def test_fuzzy_spread_is_brute_force(spark, block):
    rng = random.Random(3)
    digests = {f"p{i}": bytes(rng.choice((0, 0, 1, 2, 3, 3)) for _ in range(128)) for i in range(20)}
    digests |= {"q0": b"\x00" * 128, "q1": b"\x03" * 128, "r0": b"\x01" * 128, "r1": b"\x01" * 128}
    clusters = spark.createDataFrame([(p, p[0]) for p in digests], "node string, root string")
    found = {r["root"]: r["spread"] for r in scan.fuzzy_spread(spark.createDataFrame(list(digests.items()), "path string, digest binary"), clusters, block).collect()}
    assert found == {c: max(prints.digest_distance(a, b) for a, b in combinations([d for p, d in digests.items() if p[0] == c], 2)) for c in "pqr"}


def test_digests_far_from_a_box_are_not_compared(monkeypatch):
    rng = np.random.default_rng(4)
    near = lambda base: [np.where(rng.random(128) < 0.02, 1, base).astype(np.uint8).tobytes() for _ in range(300)]
    digests = near(0) + near(3)
    counted, whole = [], np.flatnonzero  # asked once for each block of pairs
    monkeypatch.setattr(prints.np, "flatnonzero", lambda pairs: counted.append(pairs.size) or whole(pairs))
    forest = prints.digest_forest(digests, None, 80)
    assert len(forest) == len(digests) - 2 and sum(counted) < 130_000 < 600 * 600 // 2
    assert prints.digest_forest([], digests[:1], 80) == []


def test_digests_of_one_component_are_not_compared(monkeypatch):
    rng = np.random.default_rng(5)
    digests = [np.where(rng.random(128) < 0.02, 1, 2).astype(np.uint8).tobytes() for _ in range(600)] + [bytes([0, 3] * 64), bytes([3, 0] * 64)]
    counted, whole = [], np.flatnonzero  # asked once for each block of pairs
    monkeypatch.setattr(prints.np, "flatnonzero", lambda pairs: counted.append(pairs.size) or whole(pairs))
    forest = prints.digest_forest(digests, None, 80)
    # all that are alike are joined by the first box
    assert len(forest) == 599 and sum(counted) < 60_000 < 600 * 600 // 2


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(50)] + [(7, 7), (3, 2)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {n: find(n) for n in nodes}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_index_lifecycle(spark, tmp_path):
    rows = [("a", 5, 1.0, "p", "h"), ("b", 5, 1.0, "p", "h"), ("c", 5, 2.0, "q", "i"), ("d", 7, 1.0, "r", "j"), ("e", 9, 1.0, "s", "k"), ("f", 9, 1.0, "t", "l")]
    files = spark.createDataFrame([(*r, "/s") for r in rows], "path string, size bigint, mtime double, prefix string, full_hash string, source string")
    none = index.load(spark, str(tmp_path / "missing"), index_schema())
    first = index.incremental(files, none)
    assert {r["path"]: r["state"] for r in first.collect()} == {"a": "hashed", "b": "hashed", "c": "prefix_only", "e": "prefix_only", "f": "prefix_only"}
    entries = first.filter("state = 'hashed'").select("path", F.lit(1).cast("bigint").alias("dev"), F.lit(1).cast("bigint").alias("ino"), "size", "mtime", F.col("full_hash").alias("sha256"), F.lit(0).cast("bigint").alias("write_seq"))
    saved = index.save(index.upsert(none, entries), str(tmp_path))
    again = index.incremental(files, index.load(spark, saved, index_schema()))
    assert {r["path"]: r["state"] for r in again.collect()} == {"a": "reused", "b": "reused", "c": "hashed", "e": "prefix_only", "f": "prefix_only"}
    assert [tuple(r) for r in index.reuse_counts(again).collect()] == [("/s", 2, 1)]
    assert index.invalidate(entries, files.filter("path = 'a'")).select("path").collect() == [("b",)]


def test_index_upsert_query_keeps_the_whole_index(spark, tmp_path):
    rows = [(i, f"text {i}", "en", "src0") for i in range(1200)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    files = {r["ino"]: (r["path"], r["mtime"]) for r in adapters.document_files(spark, str(tmp_path)).collect()}
    last = max(i for i in files if i % 3)
    want = {(p, m + (i % 7 == 0) * (i % 2), i if i % 3 else i // 2 + last + 1) for i, (p, m) in files.items() if i % 3 or i % 2 == 0}
    found = registry.QUERIES["index_upsert"](spark, str(tmp_path)).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want) == 1000


def test_index_upsert_drops_the_first_written(spark):
    row = lambda path, mtime, seq: (path, 1, 1, 5, mtime, "h", seq)
    old = spark.createDataFrame([row("a", 1.0, 0), row("b", 1.0, 1), row("c", 1.0, 2)], index_schema())
    new = spark.createDataFrame([row("a", 2.0, 0), row("d", 2.0, 1), row("c", 2.0, 2)], index_schema())
    kept = [(r["path"], r["mtime"], r["write_seq"]) for r in index.upsert(old, new, 3).collect()]
    assert kept == [("d", 2.0, 4), ("c", 2.0, 2), ("b", 1.0, 1)]


def index_schema():
    from copyfold.schema import CONTENT_INDEX

    return CONTENT_INDEX


def test_stream_of_arrivals(spark, tmp_path):
    schema = "path string, dev bigint, ino bigint, size bigint, mtime double, full_hash string"
    stream = IndexStream(spark, str(tmp_path / "index"))
    for i, rows in enumerate(([("a", 1, 1, 5, 1.0, "h"), ("b", 1, 2, 5, 1.0, "h")], [("b", 1, 2, 5, 1.0, "h"), ("c", 1, 3, 6, 1.0, "i")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        arrivals = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream.start(arrivals, str(tmp_path / "checkpoint")).awaitTermination()
    assert {r["path"] for r in stream.current().collect()} == {"a", "b", "c"} and (stream.reused, stream.hashed) == (1, 3)


def test_plans_and_logs(spark, tmp_path):
    ranked = spark.createDataFrame([("g", "/a/x", 5, True, 1, 1), ("g", "/a/y", 5, False, 1, 2), ("g", "/b/z", 5, False, 2, 3), ("g", "/a/w", 5, False, 1, 1), ("g", "/usr", 5, False, 1, 9)], "group_id string, path string, size bigint, keeper boolean, dev bigint, ino bigint")
    plan = {r["path"]: r["status"] for r in logs.action_plan(ranked, "link").collect()}
    assert plan == {"/a/y": "link", "/b/z": "cross_fs", "/a/w": "already_linked", "/usr": "refused"}
    assert {r["path"] for r in logs.action_plan(ranked, "trash", delete_all=("g",)).collect()} == {"/a/x", "/a/y", "/b/z", "/a/w", "/usr"}
    assert logs.action_plan(ranked, "link", delete_all=("g",)).count() == 0
    put(tmp_path, "g.json", b'{"entries": [{"key": "hard-link", "term": "Hard link", "category": "A", "short": "s", "body": "b", "aliases": ["dupe"], "odd": 1}, {"key": "k", "term": "T", "category": "B"}]}')
    glossary = logs.load_glossary(spark, str(tmp_path / "g.json"))
    assert [r["key"] for r in logs.search_glossary(glossary, " DUPE ").collect()] == ["hard-link"] and logs.search_glossary(glossary, " ").count() == 2
    assert [r["category"] for r in logs.categories(glossary).collect()] == ["A", "B"]


def test_text_preview_of_every_document(spark, tmp_path):
    texts = ["", "one\ntwo", "\n".join(map(str, range(300))), "x" * 70_000, "x" * 65_535 + "é" * 9, "x" * 65_534 + "€\nrest", "x" * 65_533 + "😀", "ab\n" * 40_000, "é" * 32_768, "a\r\nb\rc\n\rd\x0be\x0cf\x85g\u2028h\u2029i\x1cj\x1dk\x1el\r\n", "\n", "\r\n\r\n", "x\r" * 300]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r["doc_id"]: r["preview"] for r in registry.QUERIES["preview_text"](spark, str(tmp_path)).collect()}
    assert found == {i: "\n".join(t.encode()[:65536].decode("utf-8", "replace").splitlines()[:200]) for i, t in enumerate(texts)}


def test_the_rest_does_not_need_the_llm_part():
    import ast
    from pathlib import Path

    root = Path(scan.__file__).parent.parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            names = [n.module or "" for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.ImportFrom)]
            assert not any("copyfold.llm" in n for n in names), path
