"""Collocations against brute force, with bitmaps of any size."""

import re
from collections import Counter

import pytest
from tests.llm.conftest import collected, edge_rows, write

from copyfold.llm import collocations, queries


def brute(rows, least=30, longest=4, top=2000, absorbed=80):
    f = {}
    for lang, text in rows:
        counts = f.setdefault("und" if lang is None else lang, Counter())
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = [x for x in re.split("[ \t]+", piece) if x]
            counts.update(tuple(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        n, found = sum(c for p, c in counts.items() if len(p) == 1), []
        frequent = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in frequent.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= absorbed * a for q, b in frequent.items()):
                continue
            score, k = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, r, n, -score) for i, (score, a, p, left, r) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def spoken():
    parts = ["Über den Fluss gehen wir", "gehen wir heim", "a b a b a b a", "zu zu zu zu", "kalt; warm, kalt! warm", "x\ty  z\r\nx y z", "漢 字 漢 字", "one two three four five"]
    return [("de" if k % 3 else None, ". ".join(parts[(k * j) % len(parts)] for j in range(1, 5))) for k in range(150)] + [("und", "gehen wir"), ("xx", None), ("xx", ""), ("yy", " . ,\n"), (None, "lonely words here")]


@pytest.mark.parametrize("bits", [(22, 24), (4, 6), (17, 10)])
def test_bitmaps_change_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(collocations, "BUCKET_BITS", bits[0])
    monkeypatch.setattr(collocations, "MEMBER_BITS", bits[1])
    monkeypatch.setattr(collocations, "CHUNK", 200)
    monkeypatch.setattr(collocations, "ROWS", 50)
    docs = spark.createDataFrame(spoken(), "lang string, text string").repartition(3)
    assert collected(collocations.mine_collocations(docs, least=12)) == brute(spoken(), least=12)


def test_query_on_odd_documents(spark, tmp_path, empty_dir):
    rows = edge_rows() + [(200 + k, t, lang, None, 0) for k, (lang, t) in enumerate(spoken())]
    write(spark, str(tmp_path), rows)
    want = brute([(lang, t) for _, t, lang, *_ in rows])
    assert want and collected(queries.op13_collocations(spark, str(tmp_path))) == want
    assert collected(queries.op13_collocations(spark, empty_dir)) == []


def test_ranks_and_ties(spark):
    rows = [("aa", ". ".join(f"w{i:03d} v{i:03d}" for i in range(300)))] * 3 + [("bb", "p q")] * 5
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert collected(collocations.mine_collocations(docs, least=3, top=100)) == brute(rows, least=3, top=100)


def test_chunks_end_where_pieces_end():
    text = b"one two three. four five, " * 50 + b"no end here" * 20
    for most in (10, 64, 100_000):
        parts = [t for _, texts in collocations.chunks(iter([("en", text), ("en", b"short")]), most) for t in texts]
        assert b"".join(parts) == text + b"short" and all(p[:1] in b".," or p == parts[0] or p == b"short" for p in parts)


def test_a_bucket_is_set_if_tasks_reach_the_count_together(spark, monkeypatch):
    monkeypatch.setattr(collocations, "BUCKET_BITS", 8)
    docs = spark.createDataFrame([("en", b"left right")] * 10, "lang string, text binary").repartition(10)
    bitmap = collocations.bucket_bitmap(collocations._pass(docs, 1, None, 10, True), 10)
    assert sum(int(b).bit_count() for b in bitmap) == 1
    assert not collocations.bucket_bitmap(collocations._pass(docs, 1, None, 11, True), 11).any()
