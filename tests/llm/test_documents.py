"""The operators over documents, against brute force on a fixture of odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from tests.llm.conftest_llm import bm25_top, jump, stupid_backoff

from copyfold.llm import licenses, minhash, mixing, queries, trie_dedup
from tests.llm.conftest import collected, edge_rows

ROWS = [(i, t) for i, t, *_ in edge_rows()]
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def normal(text):
    return SPACE.sub(" ", text or "")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return [w for w in SPACE.split(lower(text)) if w]


def test_exact_dedup(spark, edge_dir):
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[normal(t)].append(i)
    least = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = sorted(((i, least[normal(t)], len(groups[normal(t)]), i == least[normal(t)], hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in ROWS), key=repr)
    assert collected(queries.op5_exact_dedup(spark, edge_dir)) == want


def test_drop_copies_keeps_one_row_of_each_text(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    out = trie_dedup.drop_copies(docs)
    assert out.columns == docs.columns
    assert Counter(normal(r["text"]) for r in out.collect()) == Counter({normal(t) for _, t in ROWS})


def test_trie_lets_go_of_subtrees():
    strings = [(b"%06d" % (i * 7919 % 1000) + b"x" * (i % 50), i, 1, 1) for i in range(3000)]
    strings += [(b"", 5, 1, 1), (b"", 3, 2, 2)]
    want = {}
    for key, best, best_rows, rows in strings:
        b, br, n = want.get(key, (best, 0, 0))
        want[key] = (min(b, best), best_rows if best < b or n == 0 else br + (best_rows if best == b else 0), n + rows)
    dealt = sorted(((key, hashlib.sha256(key).digest(), *rest) for key, *rest in strings), key=lambda r: (len(r[0]), r[1]))
    for budget in (1 << 30, 50_000, 3_000, 100):
        found = list(trie_dedup.own(iter(dealt), budget))
        assert {key: tuple(rest) for key, _, *rest in found} == want and len(found) == len(want)
        assert all(digest == hashlib.sha256(key).digest() for key, digest, *_ in found)


def test_drop_copies_of_tied_rows_with_clashing_names(spark):
    rows = [(1, "same  text", f"r{k}", k) for k in range(50)] + [(2, "same text", "x", 0), (None, "no id", "a", 1), (None, "no  id", "b", 2), (3, "alone", "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _rows string, digest int")
    kept = [sorted(map(repr, trie_dedup.drop_copies(d).collect())) for d in (docs, docs.repartition(5), docs.coalesce(1).orderBy("_rows"))]
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 3 and trie_dedup.drop_copies(docs).columns == docs.columns


def test_sharding_of_sparse_ids(spark):
    from copyfold.llm import sharding

    ids = [(i * 0x9E3779B97F4A7C15) % (1 << 63) for i in range(4000)] + [None] * 5
    docs = spark.createDataFrame([(i, "t") for i in ids], "doc_id bigint, text string")
    out = sharding.shard_documents(docs).collect()
    for shard in range(24):
        own = sorted((r["slot"], r["doc_id"]) for r in out if r["shard"] == shard and r["doc_id"] is not None)
        assert own == sorted(own, key=lambda x: x[1])
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_mixing_of_rows_without_ids(spark):
    """Rows without id of one source, far more of them than the mix takes: their texts tell them apart."""
    rows = [(None, f"{'w ' * (5 + k % 40)}{k}", "a") for k in range(400)] + [(k, f"{'w ' * (5 + k % 40)}{k}", "b") for k in range(400)] + [(7, f"again {k} times", "c") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken, target = Counter(), {}
    for r in mixing.mix(docs).collect():
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    assert len(target) == 3 and all(abs(taken[s] - target[s]) <= 46 for s in target)


def test_sharding(spark, edge_dir):
    out = queries.op6_jump_sharding(spark, edge_dir).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out if r["doc_id"] is not None) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in ROWS if i is not None)
    assert len(out) == len(ROWS)
    slots = defaultdict(list)
    for r in out:
        assert r["shard"] == jump(r["doc_id"] or 0, 24) and r["grown_shard"] == jump(r["doc_id"] or 0, 25) and r["law"] == "key"
        assert r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_repeated_rows_are_told_apart_in_runs(spark, monkeypatch):
    from copyfold.llm import sharding

    monkeypatch.setattr(sharding, "RUN", 3)
    docs = spark.createDataFrame([(7, "same")] * 10 + [(8, "other")], "doc_id bigint, text string")
    out = sharding.shard_documents(docs, 1).collect()
    assert sorted(r["slot"] for r in out) == list(range(11)) and {r["slot"] for r in out if r["doc_id"] == 8} == {10}


def water_fill(sizes, weights, total, epochs):
    """Clamp what is above its cap and share the rest by weight, until none is above."""
    fixed = {}
    while True:
        left = total - sum(fixed.values())
        free = [s for s in sizes if s not in fixed]
        share = {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        over = [s for s in free if share[s] > epochs * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(epochs * sizes[s]) for s in over}


def test_mixing(spark, edge_dir):
    out = queries.op4_source_mixing(spark, edge_dir).collect()
    again = queries.op4_source_mixing(spark, edge_dir).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again)) and len(out) == len(ROWS)
    sizes = Counter()
    for i, t, _, source, _ in edge_rows():
        sizes[source] += len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s))
    targets = water_fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    by_size = Counter((i, len(words(t))) for i, t in ROWS)
    assert Counter((r["doc_id"], r["size"]) for r in out) == by_size
    assert {round(r["target"], 6) for r in out} == {round(t, 6) for t in targets.values()}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]


def test_mix_meets_targets_to_half_a_document(spark):
    rows = [(i, " ".join(["w"] * (1 + i * i % 40)), "abc"[i % 3]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r in out:
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[s] - target[s]) <= 20 for s in target)
    assert Counter(r["doc_id"] for r in mixing.mixed_rows(docs).collect()) == Counter({r["doc_id"]: r["copies"] for r in out if r["copies"]})


def test_alike_rows_are_taken_one_by_one(spark):
    rows = [(7, "one two three", "b")] * 1000 + [(i, f"{'w ' * (i % 9)}x", "a") for i in range(1200)] + [(9, "again and again", "b")] * 40 + [(None, "", None)] * 5 + [(None, "no id", None)] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(7)
    for frame in (docs, docs.coalesce(1)):
        taken, target, copies = Counter(), {}, defaultdict(Counter)
        for r in mixing.mix(frame).collect():
            taken[r["source"]] += r["size"] * r["copies"]
            target[r["source"]] = r["target"]
            copies[r["source"]][r["copies"]] += 1
        assert all(abs(taken[s] - target[s]) <= 5 for s in target) and all(max(c) - min(c) <= 1 for c in copies.values())
    assert len(copies["b"]) == 2


def test_sources_join_in_lanes_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 5), "abc"[i % 3] if i % 7 else None) for i in range(60)], "doc_id bigint, text string, source string")
    want = collected(mixing.mix(docs))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert collected(mixing.mix(docs)) == want


def components(sets):
    """Smallest label reachable for each set by links of 80 percent."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def test_minhash(spark, edge_dir):
    found = queries.op7_minhash_dedup(spark, edge_dir).collect()
    sets = []
    for _, t in ROWS:
        w = words(t)
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    roots = components(sets)
    least = {r: min((i for (i, _), root in zip(ROWS, roots) if root == r and i is not None), default=None) for r in roots}
    want = sorted(((i, len(s), least[r] if s else i, i == (least[r] if s else i)) for (i, _), s, r in zip(ROWS, sets, roots)), key=repr)
    assert sorted((tuple(r) for r in found), key=repr) == want


def test_minhash_finds_chains_in_a_hot_group(spark):
    from copyfold.llm import minhash

    rows, text = [], [f"w{i}" for i in range(120)]
    for i in range(140):  # each differs from the one before by a word: links chain, the ends are unlike
        text = list(text)
        text[i % 120] = f"v{i}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(f"z{i}q{j}" for j in range(50))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    roots = components(sets)
    least = {r: min(i for (i, _), root in zip(rows, roots) if root == r) for r in roots}
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert found == {i: least[r] for (i, _), r in zip(rows, roots)}


def test_a_huge_group_of_copies_and_near_copies(spark):
    """Copies of one text, and changed ones that are linked with it but not with each other."""
    from copyfold.llm import minhash

    base = [f"w{k}" for k in range(60)]
    changed = [base[: k % 50 + 5] + [f"new{k}"] + base[k % 50 + 6 :] for k in range(500)]
    rows = [(0, " ".join(base))] + [(1 + k, " ".join(w)) for k, w in enumerate(changed)] + [(1000 + k, " ".join(base)) for k in range(2000)] + [(5000 + k, " ".join(f"{k}x{j}" for j in range(20))) for k in range(50)]
    out = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 4).collect()}
    assert out == {i: (0, i == 0) if i < 5000 else (i, True) for i, _ in rows}


def license_row(i, t):
    """The licence columns of a row, by looking through every block of every template's length."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    places = sorted((k, label) for label, p in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
    best, labels = 0.0, {label for _, label in places}
    for label, template in licenses.TEMPLATES:
        x = re.findall("[a-z0-9]+", template.lower())
        pairs = set(zip(x, x[1:]))
        span = len(x) + len(x) // licenses.SLACK
        for at in [k for k in range(len(w) - 1) if (w[k], w[k + 1]) in pairs]:
            share = len(pairs & set(zip(w[at : at + span], w[at + 1 : at + span]))) / len(pairs)
            if share >= licenses.CONTAINED - 1e-9:
                best = max(best, share)
                labels.add(label)
    base = {label for _, label in places}
    return i, len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(labels)), best


def test_license_scan(spark, edge_dir):
    assert collected(queries.op2_license_scan(spark, edge_dir)) == sorted((license_row(i, t) for i, t in ROWS), key=repr)


def test_license_blocks(spark):
    """Whole texts, texts with gaps and changes, words in another order, many copies of one notice, long documents."""
    texts = dict(enumerate([
        "no reserved seats here and all rights to refunds lapse", "All  RIGHTS\nreserved!", "reserved rights all", "all rights are reserved",
        *[text for _, text in licenses.TEMPLATES], *[" ".join(text.split()[:-3]) for _, text in licenses.TEMPLATES], *[" ".join(reversed(text.split())) for _, text in licenses.TEMPLATES],
        *["start of it " + text.replace(" of ", " of some ").replace("software", "program") + " and its end" for _, text in licenses.TEMPLATES],
        "x " * 30000 + "All rights reserved. " + "of the software and this permission " * 2000 + licenses.TEMPLATES[3][1],
    ]))
    rows = list(texts.items()) + [(1000 + k, texts[5]) for k in range(3000)] + [(None, "")] * 3000
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = licenses.scan_licenses(docs)
    found = {r["doc_id"]: r for r in out.filter("doc_id < 2000").collect()}
    for i, t in rows[: len(texts) + 1]:
        if i is not None:
            assert tuple(found[i])[:8] == license_row(i, t)
    assert found[0]["labels"] == "" and found[1]["labels"] == "all-rights-reserved" and found[2]["labels"] == ""
    places = found[len(texts) - 1]["places"]
    assert [(p["first_word"], p["last_word"]) for p in places if p["label"] == "all-rights-reserved"] == [(30000, 30002)] and any(p["label"] == "mit" and p["share"] == 1 for p in places)
    assert out.count() == len(rows) and out.filter("doc_id IS NULL AND labels = ''").count() == 3000


def test_stupid_backoff(spark, edge_dir):
    want = stupid_backoff([(i, words(t)) for i, t in ROWS], 3, 0.4)
    found = sorted((tuple(r) for r in queries.op3_stupid_backoff(spark, edge_dir).collect()), key=repr)
    assert len(found) == len(want)
    for a, b in zip(sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3])), sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))):
        assert a[:3] == b[:3] and math.isclose(a[3], b[3], abs_tol=2e-4)


@pytest.mark.parametrize("order", [1, 2, 4])
def test_backoff_orders_and_batches(spark, order, monkeypatch):
    from copyfold.llm import ngram_lm

    monkeypatch.setattr(ngram_lm, "BATCH_WORDS", 40)
    rows = [(i, " ".join(f"w{(i * k * k) % 7}" for k in range(25))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    want = {r[0]: r for r in stupid_backoff([(i, t.split()) for i, t in rows], order, 0.3)}
    for r in ngram_lm.score_documents(docs, order, 0.3, lanes=5).collect():
        assert r["n_backed_off"] == want[r["doc_id"]][2] and math.isclose(r["score"], want[r["doc_id"]][3], rel_tol=1e-9)


def test_search(spark, edge_dir):
    found = sorted((tuple(r) for r in queries.op1_topk_search(spark, edge_dir).collect()), key=repr)
    want = bm25_top([(i, words(t)) for i, t in ROWS], [(i, words(t)) for i, t in ROWS if i is not None and i % 50 == 0], 10)
    assert [r[:3] for r in found] == [r[:3] for r in sorted(want, key=repr)]
    assert all(math.isclose(a[3], b[3], abs_tol=2e-6) for a, b in zip(found, sorted(want, key=repr)))


def test_search_prunes_without_loss(spark, monkeypatch):
    from copyfold.llm import search

    monkeypatch.setattr(search, "SHARD_DOCS", 70)
    monkeypatch.setattr(search, "BLOCK", 8)
    monkeypatch.setattr(search, "BLOCK_QUERIES", 3)
    monkeypatch.setattr(search, "FIRST_SHARDS", 1)
    rows = [(i, " ".join(f"w{int((i * 2654435761 + k * 40503) % 1000 ** ((k % 3 + 1) / 3))}" for k in range(5 + i % 30))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    found = sorted(tuple(r) for r in search.top_documents(docs, docs.filter("doc_id % 50 = 0"), 7).collect())
    want = sorted(bm25_top([(i, t.split()) for i, t in rows], [(i, t.split()) for i, t in rows if i % 50 == 0], 7))
    assert [r[:3] for r in found] == [r[:3] for r in want]


def test_search_never_reads_a_skipped_block():
    import numpy as np

    from copyfold.llm import search

    one, two = np.array([1], np.uint64), np.array([2], np.uint64)
    n = 8 * search.BLOCK
    words = [np.concatenate([np.repeat(one, 9 if i < 64 else 1), two if i < 80 else one[:0], np.array([1000 + i], np.uint64)]) for i in range(n)]
    shard = search.Shard.of(list(range(n)), words)
    dfs = np.diff(shard.starts).astype(float)
    plain = search.Searcher(shard, dfs, n, 3.0)
    query = np.array([1, 2], np.uint64)
    docs, scores = plain.search(query, 10, 0.0)
    threshold = np.sort(scores)[-10]
    for poisoned in range(2, 8):
        searcher = search.Searcher(shard, dfs, n, 3.0)
        at = np.flatnonzero(shard.docs // search.BLOCK == poisoned)
        searcher.impacts[at], searcher.dense[poisoned * search.BLOCK : (poisoned + 1) * search.BLOCK] = np.nan, np.nan
        found, new = searcher.search(query, 10, threshold)
        assert set(found) == set(docs[scores >= threshold]) and np.isfinite(new).all() and searcher.touched < searcher.listed


def test_common_lists_are_read_for_few_documents():
    import numpy as np

    from copyfold.llm import search

    # all words but the own one are common; the documents like a query are a few in the midst of a block
    rng = np.random.default_rng(6)
    n = 16 * search.BLOCK
    groups = np.arange(n) // 8 % 32
    words = [np.concatenate([1 + 6 * g + np.arange(6), rng.choice(np.arange(200, 220), 8, replace=False), [1000 + i]]).astype(np.uint64) for i, g in enumerate(groups.tolist())]
    shard = search.Shard.of(list(range(n)), words)
    dfs = np.diff(shard.starts).astype(float)
    queries = [words[8 * g] for g in range(32)]
    plain, searcher = search.Searcher(shard, dfs, n, 15.0), search.Searcher(shard, dfs, n, 15.0)
    want = [plain.search(q, 10, 0.0) for q in queries]
    bars = [np.sort(scores)[-10] for _, scores in want]
    lists = [searcher.lists_of(q) for q in queries]
    found = searcher.search_batch([places[places >= 0] for places in lists], 10, bars)
    for (docs, scores), (all_docs, all_scores), bar in zip(found, want, bars):
        brute = {d: s for d, s in zip(all_docs.tolist(), all_scores.tolist()) if s >= bar}
        assert {d: s for d, s in zip(docs.tolist(), scores.tolist()) if s >= bar} == brute and len(brute) >= 10
    assert searcher.touched < searcher.listed / 4


def test_a_shard_looks_a_block_of_queries_up_once(spark, tmp_path, monkeypatch):
    import numpy as np

    from copyfold.llm import search

    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, 40) % 500)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    index = search.build_index(docs, str(tmp_path / "index"))
    ours = search.Searcher.lists_of
    asked = str(tmp_path / "asked")

    def counted(self, terms):
        with open(asked, "a") as f:
            f.write(f"{len(terms)}\n")
        return ours(self, terms)

    monkeypatch.setattr(search.Searcher, "lists_of", counted)
    texts = [t for i, t in rows if i % 10 == 0]
    terms = [np.unique(search.document_words(t)) for t in texts]
    found = search.search_block(index, [(str(q).encode(), t.tobytes()) for q, t in enumerate(terms)], 1, len(rows), 40 * len(rows), 5).collect()
    with open(asked) as f:
        assert [int(n) for n in f] == [len(np.unique(np.concatenate(terms)))]
    want = bm25_top([(i, words(t)) for i, t in rows], [(q, words(t)) for q, t in enumerate(texts)], 5)
    assert sorted((int(bytes(r["key"])), r["rank"], r["doc_id"]) for r in found) == sorted(r[:3] for r in want)


def test_search_of_repeated_queries_and_no_rows(spark):
    from copyfold.llm import search

    docs = spark.createDataFrame([(i, "same words here" if i % 2 else f"other {i}") for i in range(60)], "doc_id bigint, text string")
    asked = spark.createDataFrame([(None, "same words"), (None, "same words"), (7, "SAME words words"), (8, None), (9, "unheard")], "doc_id bigint, text string")
    found = [tuple(r) for r in search.top_documents(docs, asked, 3).collect()]
    assert sorted((str(q), r, d) for q, r, d, _ in found) == sorted((q, r, d) for q in ("None", "None", "7") for r, d in ((1, 1), (2, 3), (3, 5)))
    assert search.top_documents(docs.limit(0), asked, 3).count() == 0 and search.top_documents(docs, asked.limit(0), 3).count() == 0


@pytest.mark.parametrize("name", sorted(n for n in queries.QUERIES))
def test_empty_tables_give_no_rows(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).collect() == []


def test_minhash_hot_classes_pass_through_no_python_rdd(spark):
    sets = spark.range(4).selectExpr("encode(CAST(id AS STRING), 'UTF-8') AS class", "array(id, id + 1) AS shingles")
    pairs = spark.range(40).selectExpr("encode(IF(id < 30, '0', CAST(id % 4 AS STRING)), 'UTF-8') AS a", "encode(CAST(id + 100 AS STRING), 'UTF-8') AS b")
    found = minhash._with_set(pairs, sets, "a", [(bytearray(b"0"), 3), (bytearray(b"9"), 2)])
    assert "RDD" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = minhash._with_set(pairs, sets, "a", [])
    assert collected(found.select("a", "b", "_a")) == collected(want.select("a", "b", "_a")) and found.count() == 40
