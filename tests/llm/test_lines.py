"""Line dedup against brute force."""

import hashlib
from collections import defaultdict

import pytest
from tests.llm.conftest import CLASHES, collected, edge_rows, write

from copyfold.llm import line_dedup, queries

SPACES = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def brute(rows):
    """(doc_id, n_lines, n_dropped, sha256) of each row."""
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        first = lambda k: min((x for x in holders[k] if x is not None), default=None)
        kept = [x for x in lines if len(key(x)) < 10 or first(key(x)) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def odd_rows():
    long = "\n".join(f"line number {k} of many" for k in range(3000)) + "\n"
    return [
        (3, "Shared line of text\nown line of three\n  shared LINE of text \r"), (1, "x\n\tSHARED line of text\n"), (2, "own line\r\nshared line of text"), (2, "shared line of text\nother"),
        (None, "shared line of text\nonly without id"), (None, "only without id\nonly without id"), (7, "short\nshort"), (8, "short"), (9, "Ärger überall heute\n漢字漢字漢字漢字漢字"), (10, "Ärger überall heute\närger überall heute\n漢字漢字漢字漢字漢字"),
        (11, None), (12, ""), (13, "\n\n\n"), (20, long), (21, long + "last one here\n" + long), (21, long + "last one here\n" + long), (22, "\n".join(f"line number {k} of many" if k % 700 == 0 else f"k{k}" for k in range(2500))), (-4, "line number 64 of many"),
    ]


@pytest.mark.parametrize("floor", [5, 1000])
def test_lines_are_dropped_as_by_brute_force(spark, tmp_path, monkeypatch, floor):
    monkeypatch.setattr(line_dedup, "HOT_FLOOR", floor)
    monkeypatch.setattr(line_dedup, "HOT_GROUPS", 500)
    rows = odd_rows() + [(1000 + k, f"a very common line\nrow {k % 7} of the table\n{k}") for k in range(400)]
    write(spark, str(tmp_path), [(i, t, None, None, 0) for i, t in rows])
    assert collected(queries.op12_line_dedup(spark, str(tmp_path))) == brute(rows)


def test_lines_of_the_odd_documents(spark, edge_dir, empty_dir):
    assert collected(queries.op12_line_dedup(spark, edge_dir)) == brute([(i, t) for i, t, *_ in edge_rows()])
    assert collected(queries.op12_line_dedup(spark, empty_dir)) == []


def test_bitmaps_and_other_columns(spark, edge_dir):
    docs = spark.createDataFrame(odd_rows(), "doc_id bigint, text string")
    out = line_dedup.drop_lines(docs)
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped", "keep"]
    for row in out.collect():
        if row["keep"] is not None:
            words = [w for e in row["keep"] for w in [-1] * e["full"] + [e["bits"]]]
            assert sum(64 - (w & (1 << 64) - 1).bit_count() for w in words) == row["n_dropped"] and len(words) <= -(-row["n_lines"] // 64)
        elif row["n_dropped"]:
            raise AssertionError(row)
    clashing = spark.read.parquet(f"{edge_dir}/documents.parquet")
    assert [c for c in line_dedup.drop_lines(clashing).columns if c not in ("n_lines", "n_dropped", "keep")] == clashing.columns and set(CLASHES) <= set(clashing.columns)
