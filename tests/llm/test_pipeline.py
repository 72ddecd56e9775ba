"""The pipeline against a plain version of each stage, and on odd and empty tables.

Only the learned numbers come from the package: the network's parameters, which are applied by definition here. Ids are those of the tiktoken library.
"""

import base64
import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from copyfold.llm import queries, quality_cnn
from tests.llm.conftest import SCHEMA, edge_rows
from tests.llm.test_documents import components, normal, water_fill, words


def plain_score(net, text: bytes) -> float:
    """The network's formula, chunk by chunk."""
    size, step = len(net.tables), quality_cnn.STRIDE
    coded = np.array([b + 1 for b in text] + [0] * (size + step))
    starts = [0]
    while starts[-1] + size < len(text):
        starts.append(starts[-1] + step)
    best = np.full(net.tables.shape[2], -np.inf)
    for at in starts:
        best = np.maximum(best, net.tables[np.arange(size), coded[at : at + size]].sum(axis=0, dtype=np.float64))
    hidden = [math.tanh(sum(math.tanh(x) * float(w) for x, w in zip(best, column)) + float(b)) for column, b in zip(net.w1.T, net.b1)]
    return 1 / (1 + math.exp(-sum(h * float(w) for h, w in zip(hidden, net.w2)) - float(net.b2[0])))


def plain_mix(rows):
    """How often each of the rows (doc_id, text, source) is taken, by clamping, sharing and counting off."""
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, s))
    targets = water_fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2) if sizes else {}
    tickets = defaultdict(list)
    for row in rows:
        name = f"11:{'null' if row[0] is None else row[0]}:{hashlib.md5((row[1] or '').encode()).hexdigest()}"
        tickets[row[2], int(hashlib.md5(name.encode()).hexdigest()[:15], 16)].append(row)
    out = Counter()
    for source, size in sizes.items():
        whole = math.floor(targets[source] / size + 1e-12) if size else 0
        part, start, ended = targets[source] - whole * size, 0, False
        for key in sorted(k for k in tickets if k[0] == source):
            for row in tickets[key]:  # alike rows one by one
                here = len(words(row[1]))
                ended = ended or 2 * start + here > 2 * part + 1e-6 or part <= 0
                out[row] += whole + (not ended)
                start += here
    return +out


def by_hand(spark, docs, labels):
    """Ids and texts that the stages keep, computed in Python."""
    net = quality_cnn.fit(docs, labels)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    scores = [plain_score(net, (t or "").encode()) for _, t, _ in rows]
    assert all(abs(s - quality_cnn.THRESHOLD) > 1e-4 for s in scores)
    rows = [r for r, s in zip(rows, scores) if s >= quality_cnn.THRESHOLD]
    best = {}
    for r in rows:
        key, rank = normal(r[1]), (r[0] is None, r[0] or 0)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, r)
    rows = [r for _, r in best.values()]
    sets = [(lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())(words(t)) for _, t, _ in rows]
    roots = components(sets)
    least = {}
    for r, root in zip(rows, roots):
        rank = (r[0] is None, r[0] or 0)
        if root not in least or rank < least[root]:
            least[root] = rank
    return [r for r, s, root in zip(rows, sets, roots) if not s or (r[0] is None, r[0] or 0) == least[root]]


def check(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    kept = by_hand(spark, docs, labels)
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(public_tokenizers.path(queries.VOCABULARY), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for (doc_id, text, _), copies in plain_mix(kept).items():
        want[doc_id, np.array(library.encode_ordinary(text or ""), "<u4").tobytes()] += copies
    found = Counter((r["doc_id"], np.array(r["ids"], "<u4").tobytes()) for r in corpus_pipeline.run(spark, folder).collect())
    assert found == +want


def test_run_on_real_rows(spark):
    check(spark, "/root/testdata/sf0.001")


def test_run_on_odd_rows(spark, edge_dir):
    check(spark, edge_dir)


def test_run_on_an_empty_table(spark, empty_dir):
    assert corpus_pipeline.run(spark, empty_dir).collect() == []


def test_stages_keep_the_columns(spark, edge_dir, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "source mixing", "byte-level BPE"]
    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, edge_dir).dtypes == docs.dtypes, name
