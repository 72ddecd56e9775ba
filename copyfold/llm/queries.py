"""The queries of this subpackage over the driver tables, and their SQL oracles."""

from __future__ import annotations

import re

import public_tokenizers
from pyspark.sql import functions as F

from copyfold.llm import bpe, collocations, html_crf, late_overwrite, licenses, line_dedup, minhash, mixing, ngram_lm, quality_cnn, search, sharding, trie_dedup
from copyfold.llm.common import checkpointed, table


def op1_topk_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search.top_documents(docs, docs.filter("doc_id % 50 = 0"))


def op2_license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("places")


def op3_stupid_backoff(spark, sf_dir):
    out = ngram_lm.score_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_backed_off", F.round("score", 4).alias("score"), F.round("mean_score", 4).alias("mean_score"))


def op4_source_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = mixing.mix_sized(checkpointed(docs.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"), mixing.text_mark(F.col("text")).alias("mark"))))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_exact_dedup(spark, sf_dir):
    return trie_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_jump_sharding(spark, sf_dir):
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_minhash_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


def op8_quality_cnn(spark, sf_dir):
    return quality_cnn.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html_crf(spark, sf_dir):
    return html_crf.extract_main_text(table(spark, sf_dir, "pages"))


#: The vocabulary file of the queries; operators take any path.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op10_byte_bpe(spark, sf_dir):
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, with_ids=False)


def op11_late_overwrite(spark, sf_dir):
    return late_overwrite.late_arrivals(table(spark, sf_dir, "sales"))


def op12_line_dedup(spark, sf_dir):
    out = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op13_collocations(spark, sf_dir):
    return collocations.mine_collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_topk_search, op2_license_scan, op3_stupid_backoff, op4_source_mixing, op5_exact_dedup, op6_jump_sharding, op7_minhash_dedup, op8_quality_cnn, op9_html_crf, op10_byte_bpe, op11_late_overwrite, op12_line_dedup, op13_collocations)}

ORACLES: dict[str, str] = {
    "op4_source_mixing": r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
             ('0x' || substr(md5('11:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS ticket FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM d GROUP BY source),
t AS (SELECT *, 1.5 * sum(source_size) OVER () AS asked FROM s),
-- the level: of all candidate levels, one for each set of the k sources that are full first, the one that is consistent
f AS (SELECT a.source, (a.asked - coalesce(sum(2.0 * b.source_size) FILTER (2.0 * b.source_size / b.weight < 2.0 * a.source_size / a.weight), 0))
             / sum(b.weight) FILTER (2.0 * b.source_size / b.weight >= 2.0 * a.source_size / a.weight) AS level, 2.0 * any_value(a.source_size) / any_value(a.weight) AS full_at
      FROM t a, t b GROUP BY a.source, a.asked, a.source_size, a.weight),
v AS (SELECT arg_min(level, full_at) AS level FROM f WHERE level < full_at),
g AS (SELECT source, source_size, least(2.0 * source_size, coalesce(v.level * weight, 2.0 * source_size)) AS target FROM t, v),
-- rows that are alike come one after the other
r AS (SELECT d.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(g.target / g.source_size) ELSE 0 END AS whole,
             sum(size) OVER (PARTITION BY d.source ORDER BY ticket, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN 2 * upto - size <= 2 * (target - whole * source_size) AND target > whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
""",
    "op5_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t)::BIGINT AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d
""",
    "op6_jump_sharding": r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce([i::BIGINT] || list_transform(range(8), lambda z: z::BIGINT), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 8 AS size,
             xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, x: xor(c // 256, t[(xor(c % 256, x) + 1)::INT])), 4294967295)::BIGINT AS text_crc32
      FROM documents, tab),
k AS (SELECT DISTINCT doc_id, CASE WHEN coalesce(doc_id, 0) < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE coalesce(doc_id, 0)::HUGEINT END AS state, n FROM documents, (VALUES (24), (25)) s(n)),
w(doc_id, n, state, b, j) AS (
  SELECT doc_id, n, state, -1::BIGINT, 0::BIGINT FROM k
  UNION ALL
  SELECT doc_id, n, (state * 2862933555777941757 + 1) % 18446744073709551616, j,
         floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / (((state * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 + 1)::DOUBLE))::BIGINT
  FROM w WHERE j < n),
s AS (SELECT doc_id, max(b) FILTER (n = 24 AND j >= n)::INT AS shard, max(b) FILTER (n = 25 AND j >= n)::INT AS grown_shard FROM w GROUP BY doc_id)
SELECT d.doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY d.doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM d JOIN s ON d.doc_id IS NOT DISTINCT FROM s.doc_id
""",
    "op7_minhash_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.reached)
SELECT r.doc_id, any_value(len(s.g))::BIGINT AS n_shingles, min(reached) AS component_id, r.doc_id = min(reached) AS kept FROM r JOIN s USING (doc_id) GROUP BY r.doc_id
""",
    "op2_license_scan": r"""
WITH t(template, label, words) AS (SELECT template, label, string_split(text, ' ') FROM (VALUES %s) v(template, label, text)),
k AS (SELECT template, label, len(words) + len(words) // 4 AS span, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS tokens FROM t),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w, row_number() OVER () AS r FROM documents),
g AS (SELECT r, i - 1 AS pos, w[i] || ' ' || w[i + 1] AS token FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM d)),
o AS (SELECT r, template, label, span, n, pos, token FROM g JOIN (SELECT template, label, span, len(tokens) AS n, unnest(tokens) AS token FROM k) USING (token)),
b AS (SELECT a.r, a.label, a.template, a.pos, a.n, count(DISTINCT b.token) AS shared FROM o a JOIN o b ON a.r = b.r AND a.template = b.template AND b.pos BETWEEN a.pos AND a.pos + a.span - 2 GROUP BY ALL HAVING shared >= ceil(0.8 * a.n - 1e-9)),
h AS (SELECT r, list_distinct(list(label)) AS labels, max(shared / n) AS score FROM b GROUP BY r),
p AS (SELECT *, list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN w[i:i + 3] = ['under', 'the', 'mit', 'license'] THEN {'i': i - 1, 'l': 'mit'}
        WHEN w[i:i + 3] = ['apache', 'license', 'version', '2'] THEN {'i': i - 1, 'l': 'apache-2'} WHEN w[i:i + 2] = ['cc', 'by', 'nc'] THEN {'i': i - 1, 'l': 'cc-by-nc'} END), lambda z: z IS NOT NULL) AS z FROM d),
q AS (SELECT *, list_sort(list_distinct(list_transform(z, lambda y: y.l))) AS base FROM p)
SELECT doc_id, len(w)::BIGINT AS n_words, len(z)::BIGINT AS n_base, list_min(list_transform(z, lambda y: y.i))::BIGINT AS first_word, list_max(list_transform(z, lambda y: y.i))::BIGINT AS last_word,
       coalesce(array_to_string(base, ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ','), '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM q LEFT JOIN h USING (r)
""" % ", ".join(f"({i}, '{label}', '{' '.join(re.findall('[a-z0-9]+', text.lower()))}')" for i, (label, text) in enumerate(licenses.TEMPLATES)),
    "op3_stupid_backoff": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
t AS (SELECT r, i, w[i] AS w3, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS w23, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS w123, CASE WHEN i > 1 THEN w[i - 1] END AS w2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS w12
      FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
g AS (SELECT r, w3 AS x FROM t UNION ALL SELECT r, w23 FROM t WHERE i > 1 UNION ALL SELECT r, w123 FROM t WHERE i > 2),
o AS (SELECT r, x, count(*) AS own FROM g GROUP BY ALL),
c AS (SELECT r, x, sum(own) OVER (PARTITION BY x) - own AS n FROM o),
e AS (SELECT t.r, least(i, 3) AS longest, c1.n AS c3, c2.n AS c23, c3.n AS c123, c4.n AS c2, c5.n AS c12, (SELECT sum(len(w)) FROM d) - len(d.w) AS n
      FROM t JOIN d USING (r) JOIN c c1 ON c1.r = t.r AND c1.x = w3 LEFT JOIN c c2 ON c2.r = t.r AND c2.x = w23 LEFT JOIN c c3 ON c3.r = t.r AND c3.x = w123 LEFT JOIN c c4 ON c4.r = t.r AND c4.x = w2 LEFT JOIN c c5 ON c5.r = t.r AND c5.x = w12),
s AS (SELECT r, CASE WHEN c123 > 0 THEN log10(c123 / c12) WHEN c23 > 0 THEN log10(c23 / c2) + (longest - 2) * log10(0.4) WHEN c3 > 0 THEN log10(c3 / n) + (longest - 1) * log10(0.4) ELSE log10(1 / greatest(n, 1)) + longest * log10(0.4) END AS s,
             NOT coalesce((longest = 3 AND c123 > 0) OR (longest = 2 AND c23 > 0) OR (longest = 1 AND c3 > 0), false) AS gave FROM e)
SELECT doc_id, any_value(len(w))::BIGINT AS n_words, coalesce(count(*) FILTER (gave), 0)::BIGINT AS n_backed_off, round(coalesce(sum(s), 0), 4) AS score, round(coalesce(avg(s), 0), 4) AS mean_score
FROM d LEFT JOIN s USING (r) GROUP BY r, doc_id
""",
    "op1_topk_search": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
f AS (SELECT t, count(*) AS df FROM p GROUP BY t),
i AS (SELECT p.t, d.r, ln(1 + (n.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d.w) / mean)) AS impact FROM p JOIN f USING (t) JOIN d USING (r), n),
s AS (SELECT q.r AS q, i.r, round(sum(impact), 6) AS score FROM d q JOIN p ON p.r = q.r JOIN i ON i.t = p.t WHERE q.doc_id % 50 = 0 GROUP BY q.r, i.r),
k AS (SELECT q.doc_id AS query_id, d.doc_id, score, row_number() OVER (PARTITION BY s.q ORDER BY score DESC, d.doc_id NULLS FIRST)::INT AS rank FROM s JOIN d ON d.r = s.r JOIN d q ON q.r = s.q)
SELECT query_id, rank, doc_id, score FROM k WHERE rank <= 10
""",
    "op12_line_dedup": r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, r, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT *, coalesce(length(key) >= 10 AND doc_id IS DISTINCT FROM min(doc_id) OVER (PARTITION BY key), false) AS dropped FROM k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256 FROM f GROUP BY r, doc_id
""",
    "op13_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) v(k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
h AS MATERIALIZED (SELECT * FROM f WHERE f >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM h WHERE k >= 2),
u AS MATERIALIZED (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:k], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT u.lang, u.phrase, u.a, cut, l.f AS l, r.f AS r, ((2000000::HUGEINT * u.a) // (l.f + r.f))::BIGINT AS score FROM u JOIN h l ON l.lang = u.lang AND l.phrase = u.x JOIN h r ON r.lang = u.lang AND r.phrase = u.y),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
x AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM c, (VALUES (2), (3)) v(m) WHERE m < k) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN n USING (lang) LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase WHERE NOT coalesce(100::HUGEINT * longer >= 80::HUGEINT * a, false) QUALIFY rank <= 2000
""",
}
