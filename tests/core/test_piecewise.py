"""Piecewise digests against a byte-by-byte version, published values and all pairs."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from copyfold.functions import ctph
from copyfold.operators import piecewise


def plain(data):
    """The published procedure, a byte at a time; the block size is halved and all begun again while it gives too few letters."""
    block = 3
    while block * 64 < len(data):
        block *= 2
    while True:
        window, h1, h2, h3 = [0] * 7, 0, 0, 0
        parts = [["", 0x28021967, 63, block, None], ["", 0x28021967, 31, 2 * block, None]]
        roll = 0
        for n, c in enumerate(data):
            h2 = (h2 - h1 + 7 * c) & 0xFFFFFFFF
            h1 = (h1 + c - window[n % 7]) & 0xFFFFFFFF
            window[n % 7] = c
            h3 = (h3 << 5 ^ c) & 0xFFFFFFFF
            roll = (h1 + h2 + h3) & 0xFFFFFFFF
            for p in parts:
                p[1] = (p[1] * 0x01000193 ^ c) & 0xFFFFFFFF
                if roll % p[3] == p[3] - 1:
                    p[4] = ctph.LETTERS[p[1] % 64]
                    if len(p[0]) < p[2]:
                        p[0], p[1], p[4] = p[0] + p[4], 0x28021967, None
        if block == 3 or len(parts[0][0]) >= 32:
            ends = [ctph.LETTERS[p[1] % 64] if roll else p[4] or "" for p in parts]
            return f"{block}:{parts[0][0]}{ends[0]}:{parts[1][0]}{ends[1]}"
        block //= 2


def test_published_values():
    found = ctph.digests([b"Also called fuzzy hashes, Ctph can match inputs that have homologies.", b"Also called fuzzy hashes, CTPH can match inputs that have homologies."])
    assert found == ["3:AXGBicFlgVNhBGcL6wCrFQEv:AXGHsNhxLsr2C", "3:AXGBicFlIHBGcL6wCrFQEv:AXGH6xLsr2C"] and ctph.compare(*found) == 22


def test_digests_are_those_of_the_plain_version():
    rng = random.Random(3)
    texts = [b"", b"a", b"\x00" * 300, b"ab" * 700, rng.randbytes(100), rng.randbytes(5000) + b"\x00" * 10, rng.randbytes(40_000), b"z" * 5000 + rng.randbytes(900), rng.randbytes(9) * 900 + b"\x00" * 20]
    texts += [" ".join(rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(rng.randint(1, 900))).encode() for _ in range(40)]
    assert ctph.digests(texts) == [plain(t) for t in texts]
    assert [ctph.digests([t])[0] for t in texts[:8]] == [plain(t) for t in texts[:8]]


def test_common_subsequences():
    rng = random.Random(4)

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for c in a:
            row = [0] + [0] * len(b) if not row else row
            new = [0]
            for j, d in enumerate(b):
                new.append(row[j] + 1 if c == d else max(new[-1], row[j + 1]))
            row = new
        return row[-1]

    pairs = [("".join(rng.choice("ABCDEF") for _ in range(rng.randint(0, 64))), "".join(rng.choice("ABCDEF") for _ in range(rng.randint(0, 64)))) for _ in range(200)] + [("A" * 64, "A" * 64), ("", "")]
    assert ctph.common_letters(*map(list, zip(*pairs))).tolist() == [longest(a, b) for a, b in pairs]


def test_compare_of_odd_digests():
    long = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef"
    assert ctph.compare(f"3:{long}:x", f"12:{long}:x") == 0 and ctph.compare("3::", "3::") == 100 and ctph.compare("3:abc:", "3:abd:") == 0
    assert ctph.compare(f"96:{long}:q", f"48:q:{long}") == 100 and ctph.compare(f"48:q:{long}", f"96:{long}:q") == 100
    assert ctph.compare("96:AAAAAAAAbcd:", "96:AAAbcd:") == 100 and ctph.shortened("AAAAABBBBCC") == "AAABBBCC"


@pytest.mark.parametrize("block", [2, 512])
def test_clusters_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(piecewise, "BLOCK", block)
    rng = random.Random(5)
    texts = {}
    for n in range(12):
        base = rng.randbytes(6000)
        for m, (cut, join) in enumerate([(6000, b""), (5000, b""), (3000, rng.randbytes(3000)), (800, rng.randbytes(5200)), (1500, rng.randbytes(20_000))]):
            texts[f"t{n:02d}-{m}"] = base[:cut] + join
    shared = rng.randbytes(900)  # a passage in many texts that are otherwise apart
    texts |= {f"s{n:02d}": rng.randbytes(2500) + shared + rng.randbytes(2500) for n in range(25)} | {f"copy{n}": texts["t00-0"] for n in range(300)}
    digests = dict(zip(texts, ctph.digests(list(texts.values()))))
    root = {n: n for n in digests}
    distinct = {}
    for n in sorted(digests):
        distinct.setdefault(digests[n], n)
        root[n] = distinct[digests[n]]
    for a, b in combinations(sorted(distinct.values()), 2):
        if 100 - ctph.compare(digests[a], digests[b]) <= 80 and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {n: low if r == high else r for n, r in root.items()}
    want = {n: r for n, r in root.items() if list(root.values()).count(r) > 1}
    frame = spark.createDataFrame(list(digests.items()), "path string, digest string").repartition(5)
    assert {r["path"]: r["group_id"] for r in piecewise.piecewise_clusters(frame).collect()} == want and len(set(want.values())) > 8
    assert piecewise.piecewise_clusters(frame.filter(F.lit(False))).count() == 0


def test_shared_tokens_are_those_of_two_classes_or_more(spark):
    rng = random.Random(31)
    parts = ["".join(rng.choices(ctph.LETTERS, k=9)) for _ in range(6)]
    rows = [(i, 3 << i % 4, "".join(rng.sample(parts, i % 4)), "".join(rng.sample(parts, i % 3)) if i % 5 else "abc") for i in range(60)]
    nodes = {}
    for node, block, x, y in rows:
        for letters, size in ((x, block), (y, 2 * block)):
            for at in range(len(letters) - 6):
                nodes.setdefault((size, letters[at : at + 7]), set()).add(node)
    found = {}
    for r in piecewise.shared_tokens(spark.createDataFrame(rows, "node bigint, block bigint, x string, y string").repartition(3)).collect():
        assert r["node"] not in found.setdefault((r["token"], r["first"]), set())
        found[r["token"], r["first"]].add(r["node"])
    want = sorted(sorted(n) for n in nodes.values() if len(n) > 1)
    # of ever so many tokens that one class has alone, no row comes out
    assert sorted(sorted(n) for n in found.values()) == want and all(first == min(n) for (_, first), n in found.items())
    assert any(len(n) == 1 for n in nodes.values())
