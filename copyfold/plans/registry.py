"""Named queries over the driver tables and their SQL oracles."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from copyfold.checkpoints import checkpointed
from copyfold.functions import ctph, fingerprints, scalars
from copyfold.functions.dimensions import BACKUP_DIRS, BACKUP_EXTENSIONS, IMAGE_EXTENSIONS, PRESET_DIRS, PREVIEW_EXTENSIONS, type_table
from copyfold.operators import exact, filters, folders, index, keeper, logs, packed, previews, simjoin
from copyfold.operators.components import connected_components
from copyfold.options import ScanOptions
from copyfold.plans import scan
from copyfold.sources import adapters as A
from copyfold.sources import drives, walk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ---- parts of the SQL -------------------------------------------------------

FILES = """WITH f AS (SELECT '/' || source || '/' || lang || '/' || CASE doc_id % 6 WHEN 0 THEN 'doc-' || doc_id || '.txt' WHEN 1 THEN 'doc-' || doc_id || ' copy.txt' WHEN 2 THEN 'doc-' || doc_id || '.txt.bak'
  WHEN 3 THEN 'db-2023-01-05-' || doc_id || '.sql' WHEN 4 THEN '.doc-' || doc_id || '.txt' ELSE 'IMG_' || doc_id || '.jpg' END AS path,
  strlen(text)::BIGINT AS size, (1700000000 + doc_id * 37 % 100000)::DOUBLE AS mtime, 1::BIGINT AS dev, doc_id AS ino, '/' || source AS source, text, sha256(text) AS full_hash FROM documents),
n AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.*[^.].*(\\.[^.]*)$', 1)) AS ext, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM f)"""
MEMBERS = FILES + """,
m AS (SELECT full_hash AS group_id, * FROM n QUALIFY count(*) OVER (PARTITION BY size, full_hash) >= 2),
c0 AS (SELECT *, CASE WHEN name LIKE '%~' OR ext IN ({ext}) THEN 0.6 ELSE 0 END + CASE WHEN regexp_matches(lower(name), '{backup}') THEN 0.4 ELSE 0 END
  + CASE WHEN lower(regexp_extract(parent, '[^/]*$')) IN ({dirs}) THEN 0.4 ELSE 0 END + CASE WHEN regexp_matches(name, '2023-01-05') THEN 0.2 ELSE 0 END AS score, regexp_matches(name, '2023-01-05') AS dated FROM {src}),
c AS (SELECT *, round(least(1, score), 6)::DOUBLE AS backup_confidence, score >= 0.5 AS is_backup, CASE WHEN dated THEN 1672876800 ELSE mtime END::DOUBLE AS effective_date FROM c0)"""
MEMBERS = MEMBERS.replace("{backup}", scalars.BACKUP_WORDS).replace("{ext}", ", ".join(f"'{e}'" for e in BACKUP_EXTENSIONS)).replace("{dirs}", ", ".join(f"'{d}'" for d in BACKUP_DIRS))
GROUPED = MEMBERS.replace("{src}", "m") + """,
b AS (SELECT * REPLACE (is_backup OR (dated AND count(*) FILTER (dated) OVER g >= 2) AS is_backup, CASE WHEN dated AND count(*) FILTER (dated) OVER g >= 2 THEN greatest(backup_confidence, 0.6) ELSE backup_confidence END AS backup_confidence),
  bool_or(is_backup) OVER g OR count(*) FILTER (dated) OVER g >= 2 AS has_backups, row_number() OVER (PARTITION BY group_id ORDER BY effective_date DESC, path) = 1 AS newest FROM c WINDOW g AS (PARTITION BY group_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY CASE WHEN has_backups THEN floor(effective_date / 300) ELSE 0 END DESC, CASE WHEN has_backups AND is_backup THEN 0 ELSE 1 END DESC, size DESC,
  regexp_matches(lower(name), '{derived}'), NOT (path LIKE '/src0/%'), mtime, length(path) - length(replace(path, '/', '')), path) = 1 AS keeper FROM b)"""
GROUPED = GROUPED.replace("{derived}", scalars.DERIVED)
SIGNATURES = """WITH own AS (SELECT vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN CASE WHEN i = 64 THEN -9223372036854775808 ELSE (1::HUGEINT << (i - 1)::INT) END ELSE 0 END::HUGEINT))::BIGINT AS ph,
  list_sum(list_transform(range(1, 64), lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN (1::HUGEINT << (i - 1)::INT) ELSE 0 END::HUGEINT))::BIGINT AS dh FROM embeddings),
w AS (SELECT id, id + 1000000 AS copy, ph, dh, ((7::HUGEINT << (id % 60)::INT)) AS p, ((1::HUGEINT << (id % 61)::INT)) AS d FROM own WHERE id % 5 = 0),
s AS (SELECT id, ph, dh FROM own UNION ALL SELECT copy, xor(ph, p::BIGINT), xor(dh, d::BIGINT) FROM w),
h AS (SELECT ph, dh, min(id) AS rep FROM s GROUP BY ph, dh),
e AS (SELECT a.rep AS a, b.rep AS b, bit_count(xor(a.ph, b.ph))::BIGINT AS ph_distance, bit_count(xor(a.dh, b.dh))::BIGINT AS dh_distance, a.ph AS aph, b.ph AS bph FROM h a JOIN h b ON a.rep < b.rep WHERE bit_count(xor(a.ph, b.ph)) <= 8 AND bit_count(xor(a.dh, b.dh)) <= 8)"""
WORDS = """WITH RECURSIVE t AS (SELECT doc_id AS id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\r\\f\\x0b]+'), lambda w: w <> ''))) AS tokens FROM documents),
h AS (SELECT tokens, min(id) AS rep FROM t WHERE len(tokens) > 0 GROUP BY tokens),
u AS (SELECT rep, len(tokens) AS n, unnest(tokens) AS w FROM h),
e AS (SELECT a.rep AS a, b.rep AS b, count(*) / (a.n + b.n - count(*)) AS similarity FROM u a JOIN u b ON a.w = b.w AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.55)"""
RUNS = """WITH r AS (SELECT max(event_id) AS seq, CASE WHEN user_id % 2 = 0 THEN 'simple' ELSE 'advanced' END AS tier, list_sort(list_distinct(list('/' || event_type))) AS sources, round(sum(value), 2) AS duration, count(*) AS total_files,
  count(*) FILTER (event_type IN ('click', 'view')) AS total_hashed, count(*) FILTER (event_type = 'signup') AS total_reused, bool_or(event_type = 'error' AND value > 90) AS cancelled FROM events GROUP BY user_id, ts::DATE)"""
# The rolling hash at each byte from the 32nd on, from the sum of the shifted table values of 32 bytes; those that are sampled.
ANCHORS = f"""gear AS (SELECT {fingerprints._GEAR.tolist()} AS gear),
hb AS (SELECT path, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::INT) AS b FROM {{src}} WHERE size BETWEEN 64 AND 2097152),
hh AS (SELECT path, list_filter(list_transform(range(32, len(b) + 1), lambda i: list_sum(list_transform(range(32), lambda j: gear[b[i - j] + 1] * (1::BIGINT << j) % 4294967296))::BIGINT % 4294967296), lambda x: x % 32 = 0) AS hits FROM hb, gear)"""


def _triple(salt: int, places: tuple[int, int, int]) -> str:
    """The code of three bytes of a locality digest, from 0 to 127."""
    parts = [f"b[t + {at + 1}] * {factor}::BIGINT % 4294967296" for at, factor in zip(places, fingerprints.DIGEST_FACTORS)]
    return f"((xor(xor({parts[0]}, {parts[1]}), {parts[2]}) + {salt * fingerprints.DIGEST_SALT}) % 4294967296) * {fingerprints.DIGEST_MIX} % 4294967296 // 33554432"


# Locality digests, all pairs of them within 80, and their components.
FUZZY = f"""xb AS (SELECT path, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM {{src}} WHERE size BETWEEN 256 AND 67108864),
xv AS (SELECT path, unnest(flatten(list_transform(range(len(b) - 4), lambda t: [{", ".join(_triple(k, places) for k, places in enumerate(fingerprints.DIGEST_TRIPLES))}]))) AS bin FROM xb),
xc AS (SELECT path, list_transform(range(128), lambda z: coalesce(h[z], 0)) AS counts FROM (SELECT path, histogram(bin) AS h FROM xv GROUP BY path)),
xq AS (SELECT path, counts, list_sort(counts) AS s FROM xc),
xd AS (SELECT path, list_transform(counts, lambda x: (x > s[32])::INT + (x > s[64])::INT + (x > s[96])::INT) AS codes FROM xq WHERE s[96] > 0),
xe AS (SELECT x.path AS a, y.path AS b FROM xd x JOIN xd y ON x.path < y.path WHERE list_sum(list_transform(range(1, 129), lambda z: [0, 1, 2, 6][abs(x.codes[z] - y.codes[z]) + 1])) * 5 // 2 <= 80),
xr(a, b) AS (SELECT path, path FROM xd UNION SELECT xr.a, CASE WHEN xe.a = xr.b THEN xe.b ELSE xe.a END FROM xr JOIN xe ON xe.a = xr.b OR xe.b = xr.b),
fuzzy AS (SELECT * FROM (SELECT a AS path, min(b) AS group_id FROM xr GROUP BY a) QUALIFY count(*) OVER (PARTITION BY group_id) >= 2)"""
def _rolling() -> str:
    """The rolling hash of the seven bytes of b up to the one at i."""
    terms = [f"b[i - {j}]" for j in range(7)]
    bits = terms[0]
    for j in range(1, 7):
        bits = f"xor({bits}, {terms[j]} * {32 ** j} % 4294967296)"
    return f"({' + '.join(f'{7 + 1 - j} * {t}' for j, t in enumerate(terms))} + {bits}) % 4294967296"


def _piece_letters(block: str, most: int) -> str:
    """The letters of the pieces that end where z is divisible by a block size; no more than so many, and what is left."""
    stops = f"list_concat(list_filter(p, lambda i: z[i] % ({block}) = 0)[1:{most - 1}], CASE WHEN z[n] > 1 THEN [n] ELSE [] END)"
    starts = f"list_concat([1], list_transform({stops}, lambda i: i + 1))"
    piece = "list_reduce(list_concat([39::BIGINT], list_transform(b[s + 6:e + 6], lambda c: c % 64)), lambda h, c: xor(h * 19 % 64, c))"
    return f"array_to_string(list_transform(list_zip({starts}[1:len({stops})], {stops}), lambda v: substr('{ctph.LETTERS}', ({piece.replace('[s + 6:e + 6]', '[v[1] + 6:v[2] + 6]')} + 1)::INT, 1)), '')"


_ALIKE = "array_to_string(list_filter(string_split({0}, ''), lambda c, i: NOT (i > 3 AND c = substr({0}, i - 1, 1) AND c = substr({0}, i - 2, 1) AND c = substr({0}, i - 3, 1))), '')"
# Piecewise digests; their classes; pairs that share seven letters; those within 80, by the longest common subsequence in the bits of a word; components.
DIGESTS = f"""pb AS (SELECT path, list_concat([0, 0, 0, 0, 0, 0]::BIGINT[], list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)) AS b FROM {{src}} WHERE size BETWEEN 256 AND 67108864),
pz AS (SELECT path, b, (len(b) - 6)::BIGINT AS n, list_transform(range(7, len(b) + 1), lambda i: {_rolling()} + 1) AS z FROM pb),
pc AS (SELECT *, list_filter(range(1, n + 1), lambda i: z[i] % 3 = 0) AS p, list_filter(range(40), lambda k: 192 * (1::BIGINT << k::INT) >= n)[1] AS most FROM pz),
pk AS (SELECT *, 3 * (1::BIGINT << list_max(list_filter(range(most + 1), lambda k: k = 0 OR len(list_filter(p, lambda i: z[i] % (3 * (1::BIGINT << k::INT)) = 0)) >= 32))::INT) AS block FROM pc),
pd AS (SELECT path, block, {_piece_letters("block", 64)} AS s, {_piece_letters("2 * block", 32)} AS t FROM pk)"""
PIECEWISE = DIGESTS + f""",
pl AS (SELECT path, block, {_ALIKE.format("s")} AS x, {_ALIKE.format("t")} AS y FROM pd),
pe AS (SELECT min(path) AS rep, block, x, y FROM pl GROUP BY block, x, y),
pt AS (SELECT rep, bs, letters, unnest(list_distinct(list_transform(range(1, len(letters) - 5), lambda i: substr(letters, i, 7)))) AS gram FROM (SELECT rep, block AS bs, x AS letters FROM pe UNION ALL SELECT rep, 2 * block, y FROM pe)),
pp AS (SELECT DISTINCT a.rep AS a, b.rep AS b, a.bs, a.letters AS l, b.letters AS r FROM pt a JOIN pt b ON a.bs = b.bs AND a.gram = b.gram AND a.rep < b.rep),
pv AS (SELECT a, b, bs, len(l) AS ll, len(r) AS lr, list_reduce(list_concat([18446744073709551615::HUGEINT], list_transform(string_split(r, ''), lambda c: coalesce(list_sum(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN substr(l, i, 1) = c THEN 1::HUGEINT << (i - 1)::INT ELSE 0::HUGEINT END)), 0)::HUGEINT)),
  lambda v, m: ((v + (v & m)) | (v - (v & m))) & 18446744073709551615::HUGEINT) AS v FROM pp),
ps AS (SELECT a, b, bs, ll, lr, ll + lr - 2 * (ll - bit_count(v & ((1::HUGEINT << ll::INT) - 1))) AS apart FROM pv),
xe AS (SELECT DISTINCT a, b FROM ps WHERE least(100 - 100 * (apart * 64 // (ll + lr)) // 64, CASE WHEN bs < 45 THEN bs // 3 * least(ll, lr) ELSE 100 END) >= 20),
xr(a, b) AS (SELECT rep, rep FROM pe UNION SELECT xr.a, CASE WHEN xe.a = xr.b THEN xe.b ELSE xe.a END FROM xr JOIN xe ON xe.a = xr.b OR xe.b = xr.b),
xg AS (SELECT a AS rep, min(b) AS group_id FROM xr GROUP BY a),
fuzzy AS (SELECT path, group_id FROM pl JOIN pe USING (block, x, y) JOIN xg USING (rep) QUALIFY count(*) OVER (PARTITION BY group_id) >= 2)"""
# An 8 x 8 image doubled twice has each pixel in four rows and columns of the grid; a cell of nine columns has parts of two pixels.
_BASIS = [[sum(math.cos(math.pi * (2 * x + 1) * u / 64) for x in range(4 * i, 4 * i + 4)) for i in range(8)] for u in range(8)]
_AS_WORD = "list_sum(list_transform({bits}, lambda z, k: CASE WHEN z THEN CASE WHEN k = 1 THEN -9223372036854775808 ELSE 1::HUGEINT << (64 - k)::INT END ELSE 0 END::HUGEINT))::BIGINT"
# The hashes ip of the images g.
PRINTS = f"""il AS (SELECT path, p, list_transform(range(64), lambda k: round(list_sum(list_transform(range(64), lambda z: basis[k // 8 + 1][z // 8 + 1] * basis[k % 8 + 1][z % 8 + 1] * p[z + 1])), 6)) AS low FROM g, (SELECT {_BASIS} AS basis)),
iz AS (SELECT *, list_sort(low) AS sorted FROM il),
ip AS (SELECT path, {_AS_WORD.format(bits="list_transform(low, lambda x: x > (sorted[32] + sorted[33]) / 2)")} AS ph,
{_AS_WORD.format(bits="list_transform(range(64), lambda k: (k % 8 + 1) * p[k + 1] + (7 - k % 8) * coalesce(p[k + 2], 0) > (k % 8) * coalesce(p[greatest(k, 1)], 0) + (8 - k % 8) * p[k + 1])")} AS dh FROM iz)"""
# The images of the files n, and their groups.
IMAGES = f"""g AS (SELECT path, list_transform(embedding, lambda x, i: greatest(0, least(255, floor(128 + 40 * x) + CASE WHEN i = 1 AND ino % 12 = 11 THEN 16 ELSE 0 END))::DOUBLE) AS p FROM n JOIN embeddings ON ino % 6 = 5 AND vec_id = ino // 12),
{PRINTS},
ie AS (SELECT x.path AS a, y.path AS b FROM ip x JOIN ip y ON x.path < y.path AND bit_count(xor(x.ph, y.ph)) <= 8 AND bit_count(xor(x.dh, y.dh)) <= 8),
ir(a, b) AS (SELECT path, path FROM ip UNION SELECT ir.a, CASE WHEN ie.a = ir.b THEN ie.b ELSE ie.a END FROM ir JOIN ie ON ie.a = ir.b OR ie.b = ir.b),
image_ AS (SELECT * FROM (SELECT a AS path, min(b) AS group_id FROM ir GROUP BY a) QUALIFY count(*) OVER (PARTITION BY group_id) >= 2)"""
# The exact, image, fuzzy and similar groups of a whole scan, in place of the exact ones of GROUPED.
SIMILAR = """su AS (SELECT path, len(t) AS n, unnest(t) AS w FROM (SELECT path, CASE WHEN len(hits) = 0 THEN [path] ELSE list_distinct(hits)::VARCHAR[] END AS t FROM hh)),
se AS (SELECT a.path AS a, b.path AS b FROM su a JOIN su b ON a.w = b.w AND a.path < b.path GROUP BY a.path, b.path, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.55),
sr(a, b) AS (SELECT a, a FROM se UNION SELECT b, b FROM se UNION SELECT sr.a, CASE WHEN se.a = sr.b THEN se.b ELSE se.a END FROM sr JOIN se ON se.a = sr.b OR se.b = sr.b),
similar_ AS (SELECT a AS path, min(b) AS group_id FROM sr GROUP BY a)"""
SCANNED = (
    FILES.replace("WITH f", "WITH RECURSIVE f") + ", m AS (SELECT full_hash AS group_id, * FROM n WHERE size > 0 QUALIFY count(*) OVER (PARTITION BY size, full_hash) >= 2),\n"
    + f"left1 AS (SELECT * FROM n WHERE ext NOT IN {IMAGE_EXTENSIONS} AND path NOT IN (SELECT path FROM m)),\n" + PIECEWISE.replace("{src}", "left1") + ",\n"
    + "left2 AS (SELECT * FROM left1 WHERE path NOT IN (SELECT path FROM fuzzy)),\n" + ANCHORS.replace("{src}", "left2") + ",\n" + SIMILAR + ",\n"
    + IMAGES + ",\n"
    + "mm AS (SELECT group_id, 'exact' AS kind, path FROM m UNION ALL SELECT group_id, 'image', path FROM image_ UNION ALL SELECT group_id, 'similar', path FROM fuzzy UNION ALL SELECT group_id, 'similar', path FROM similar_),\n"
    + "ms AS (SELECT mm.group_id, mm.kind, n.* FROM mm JOIN n USING (path)),\n"
    + GROUPED[GROUPED.index("c0 AS ("):].replace("FROM m)", "FROM ms)", 1)
)
OPTIONS = ScanOptions(roots=("/src0", "/src1"))


def _digested(spark, sf_dir):
    return exact.with_digests(A.document_files(spark, sf_dir, content=True))


def _ranked(spark, sf_dir):
    return scan.ranked(checkpointed(exact.collapse_inodes(exact.members(_digested(spark, sf_dir)))), OPTIONS)


# ---- exact groups -----------------------------------------------------------


@query(FILES + " SELECT size, count(*) AS files FROM f GROUP BY size HAVING count(*) >= 2")
def size_bucket(spark, sf_dir):
    return exact.size_buckets(A.document_files(spark, sf_dir))


@query(FILES + ", p AS (SELECT size, encode(text)[1:65536] AS p, count(*) AS files FROM f GROUP BY ALL HAVING count(*) >= 2) SELECT size, files FROM p")
def prefix_bucket(spark, sf_dir):
    return exact.prefix_buckets(exact.with_digests(A.document_files(spark, sf_dir, content=True))).select("size", "files")


@query(FILES + " SELECT full_hash AS group_id, size, count(*) AS files FROM f GROUP BY ALL HAVING count(*) >= 2")
def exact_groups(spark, sf_dir):
    return exact.digest_groups(_digested(spark, sf_dir))


@query(FILES + " SELECT full_hash AS group_id, path FROM f QUALIFY count(*) OVER (PARTITION BY text) >= 2")
def byte_verify(spark, sf_dir):
    files = A.document_files(spark, sf_dir, content=True)
    return exact.verified(exact.members(exact.with_digests(files)).select("group_id", "path"), files)


@query(FILES + """, g AS (SELECT full_hash AS group_id, ino // 2 AS ino, min(path) AS path FROM f WHERE full_hash IN (SELECT full_hash FROM f GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL)
SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY group_id) >= 2""")
def inode_collapse(spark, sf_dir):
    found = exact.members(_digested(spark, sf_dir)).withColumn("ino", F.floor(F.col("ino") / 2))
    return exact.collapse_inodes(found).select("group_id", "ino", "path")


@query(GROUPED + """ SELECT group_id, 'exact' AS kind, count(*) AS files, max(path) FILTER (keeper) AS keeper, max(name) FILTER (keeper) AS title, coalesce(sum(size) FILTER (NOT keeper), 0)::BIGINT AS reclaimable, sum(size)::BIGINT AS occupied,
array_to_string(list_sort(list_distinct(list(parent))), ',') AS folders, bool_or(has_backups) AS has_backups FROM k GROUP BY group_id""")
def groups_view(spark, sf_dir):
    return keeper.groups_view(_ranked(spark, sf_dir))


@query(GROUPED + """ SELECT count(*) AS files, sum(CASE WHEN keeper THEN 0 ELSE size END)::BIGINT AS reclaimable_sum, sum(CASE WHEN keeper THEN 0 ELSE size END)::BIGINT AS reclaimable_distinct, sum(size)::BIGINT AS occupied, count(*) FILTER (keeper) AS groups,
round(sum(CASE WHEN keeper THEN 0 ELSE size END) / sum(size), 6) AS freed_fraction FROM k""")
def savings(spark, sf_dir):
    return keeper.savings(_ranked(spark, sf_dir))


@query(FILES + ", r(source) AS (VALUES ('/src0'), ('/src1'), ('/nowhere')) SELECT r.source, count(f.path) AS files, coalesce(sum(size), 0)::BIGINT AS bytes_scanned FROM r LEFT JOIN f USING (source) GROUP BY ALL")
def per_source(spark, sf_dir):
    return keeper.per_source(A.document_files(spark, sf_dir), ["/src0", "/src1", "/nowhere"])


# ---- scope ------------------------------------------------------------------


@query(FILES + " SELECT path FROM n WHERE name NOT LIKE '.%'")
def filter_hidden(spark, sf_dir):
    return filters.drop_hidden(A.document_files(spark, sf_dir)).select("path")


@query(FILES + " SELECT path FROM n WHERE NOT (path LIKE '/src1/%' OR list_has_any(string_split(parent, '/'), ['de']) OR regexp_matches(name, '^db-.*7\\.sql$'))")
def filter_exclusions(spark, sf_dir):
    rows = A.document_files(spark, sf_dir)
    taken = filters.excluded(None, ("db-*7.sql",)) | scalars.under(F.col("path"), "/src1") | F.arrays_overlap(F.split(scalars.dirname(F.col("path")), "/"), F.array(F.lit("de")))
    return rows.filter(~taken).select("path")


@query(FILES + f" SELECT path, size, ext, ext IN {IMAGE_EXTENSIONS} AS is_image FROM n WHERE size >= 500 AND ext <> '.bak' AND ext IN ('.txt', '.jpg', '.bak')")
def filter_scope(spark, sf_dir):
    return filters.in_scope(A.document_files(spark, sf_dir), 500, (".txt", ".JPG", ".bak"), (".BAK",)).select("path", "size", "ext", "is_image")


@query(FILES + " SELECT path, (path LIKE '/src2/en/%') OR path = '/src3/en/IMG_23.jpg' AS ignored FROM n")
def filter_ignored(spark, sf_dir):
    return A.document_files(spark, sf_dir).select("path", filters.ignored(("/src3/en/IMG_23.jpg",), ("/src2/en/",)).alias("ignored"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(list_transform(string_split(lang || ',.TXT , ' || upper(source) || ',,jpg', ','), lambda e: lower(trim(e))), lambda e: e <> ''), lambda e: CASE WHEN e LIKE '.%' THEN e ELSE '.' || e END))), ',') AS exts FROM documents")
def ext_normalize(spark, sf_dir):
    raw = F.split(F.concat("lang", F.lit(",.TXT , "), F.upper("source"), F.lit(",,jpg")), ",")
    return A.table(spark, sf_dir, "documents").select("doc_id", F.array_join(scalars.normalized_extensions(raw), ",").alias("exts"))


@query(r"SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(lang || ',.TXT ' || upper(source) || chr(9) || ' jpg,, .md', '[,\s]+'), lambda e: e <> ''), lambda e: CASE WHEN e LIKE '.%' THEN lower(e) ELSE '.' || lower(e) END))), ',') AS exts FROM documents")
def ext_parse(spark, sf_dir):
    typed = F.concat("lang", F.lit(",.TXT "), F.upper("source"), F.lit("\t jpg,, .md"))
    return A.table(spark, sf_dir, "documents").select("doc_id", F.array_join(scalars.parsed_extensions(typed), ",").alias("exts"))


#: Files in deeper folders, and a table of such folders that grows with the files.
_DEEP = """WITH p AS (SELECT doc_id, '/' || source || '/' || lang AS top, '/' || source || '/' || lang || '/' || doc_id % 100 AS low, '/' || source || '/' || lang || '/' || doc_id % 100 || '/' || doc_id // 100 AS inner_, '/' || source || '/' || lang || '/' || doc_id % 100 || '/' || doc_id // 100 || '/doc-' || doc_id AS path FROM documents),
d AS (SELECT DISTINCT unnest([CASE WHEN doc_id % 3 = 0 THEN inner_ END, CASE WHEN doc_id % 7 = 0 THEN low END, CASE WHEN doc_id % 501 = 0 THEN top END, CASE WHEN doc_id % 17 = 0 THEN path END]) AS folder FROM p)"""


@query(_DEEP + """, a AS (SELECT path, unnest(['/', '/' || split_part(path, '/', 2), top, low, inner_, path]) AS folder, unnest(range(6)) AS depth FROM p)
SELECT p.path, f.folder FROM p LEFT JOIN (SELECT path, arg_max(folder, depth) AS folder FROM a JOIN d USING (folder) GROUP BY path) f USING (path)""")
def folder_cover(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/"), "source", F.lit("/"), "lang").alias("top"))
    docs = docs.withColumn("low", F.concat("top", F.lit("/"), F.col("doc_id") % 100)).withColumn("inner", F.concat("low", F.lit("/"), F.expr("doc_id div 100"))).withColumn("path", F.concat("inner", F.lit("/doc-"), "doc_id"))
    some = lambda n, name: F.when(F.col("doc_id") % n == 0, F.col(name))
    named = docs.select(F.explode(F.array(some(3, "inner"), some(7, "low"), some(501, "top"), some(17, "path"))).alias("folder")).filter("folder IS NOT NULL")
    return folders.deepest_folder(docs.select("path"), named)


@query(FILES + " SELECT path, CASE WHEN path LIKE '/src1/en/%' THEN '/src1/en' WHEN path LIKE '/src1/%' THEN '/src1' WHEN path LIKE '/src2/%' THEN '/src2' ELSE '/src0' END AS source FROM n")
def source_of(spark, sf_dir):
    return filters.with_source(A.document_files(spark, sf_dir).select("path"), ["/src0", "/src1", "/src1/en", "/src2"])


# ---- backups and keepers ----------------------------------------------------


@query(MEMBERS.replace("{src}", "n") + " SELECT path, backup_confidence, is_backup, effective_date FROM c")
def backup_classify(spark, sf_dir):
    return keeper.classify(A.document_files(spark, sf_dir)).select("path", "backup_confidence", "is_backup", "effective_date")


@query(GROUPED + " SELECT group_id, path, is_backup, backup_confidence, has_backups, has_backups AND newest AS is_newest FROM b")
def backup_group(spark, sf_dir):
    return keeper.classify_groups(exact.members(_digested(spark, sf_dir))).select("group_id", "path", "is_backup", "backup_confidence", "has_backups", "is_newest")


@query(GROUPED + " SELECT group_id, path, keeper FROM k")
def keeper_rank(spark, sf_dir):
    return _ranked(spark, sf_dir).select("group_id", "path", "keeper")


# ---- the index --------------------------------------------------------------

INDEXED = FILES + ", i AS (SELECT path, dev, ino, size, mtime + CASE WHEN ino % 7 = 0 THEN 1 ELSE 0 END AS mtime, full_hash AS sha256, ino AS write_seq FROM f WHERE ino % 3 <> 0)"


@query(INDEXED + " SELECT f.path, i.sha256 FROM f LEFT JOIN i ON f.path = i.path AND f.size = i.size AND f.mtime = i.mtime")
def index_lookup(spark, sf_dir):
    files = _digested(spark, sf_dir)
    return index.lookup(files, A.index_snapshot(files)).select("path", "sha256")


@query(INDEXED + """, x AS (SELECT f.*, i.sha256 FROM f LEFT JOIN i ON f.path = i.path AND f.size = i.size AND f.mtime = i.mtime QUALIFY count(*) OVER (PARTITION BY f.size) >= 2),
y AS (SELECT *, CASE WHEN sha256 IS NOT NULL THEN 'reused' WHEN count(sha256) OVER (PARTITION BY size) > 0 OR count(*) FILTER (sha256 IS NULL) OVER (PARTITION BY size, text[1:65536]) >= 2 THEN 'hashed' ELSE 'prefix_only' END AS state FROM x)
SELECT path, state, CASE WHEN state = 'prefix_only' THEN NULL ELSE full_hash END AS full_hash FROM y""")
def incremental_exact(spark, sf_dir):
    files = _digested(spark, sf_dir)
    return index.incremental(files, A.index_snapshot(files)).select("path", "state", "full_hash")


@query(INDEXED + """, e AS (SELECT *, row_number() OVER (ORDER BY ino) - 1 AS s FROM f WHERE ino % 2 = 0), j AS (SELECT coalesce(e.path, i.path) AS path, coalesce(e.mtime, i.mtime) AS mtime, coalesce(i.write_seq, e.s + 1 + (SELECT max(write_seq) FROM i)) AS write_seq FROM e FULL JOIN i ON e.path = i.path)
SELECT path, mtime, write_seq FROM j""")
def index_upsert(spark, sf_dir):
    files = _digested(spark, sf_dir)
    fresh = files.filter("ino % 2 = 0").select("path", "dev", "ino", "size", "mtime", F.col("full_hash").alias("sha256"), F.floor(F.col("ino") / 2).alias("write_seq"))
    return index.upsert(A.index_snapshot(files), fresh).select("path", "mtime", "write_seq")


@query(INDEXED + " SELECT path, sha256 FROM i WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.path = i.path AND ext = '.bak')")
def index_invalidate(spark, sf_dir):
    files = _digested(spark, sf_dir)
    acted = files.filter(scalars.extension(scalars.basename(F.col("path"))) == ".bak")
    return index.invalidate(A.index_snapshot(files), acted).select("path", "sha256")


# ---- similarity -------------------------------------------------------------


@query(SIGNATURES + " SELECT a, b, ph_distance, dh_distance FROM e")
def hamming_pairs(spark, sf_dir):
    return simjoin.hamming_pairs(simjoin.hamming_classes(A.signatures(spark, sf_dir)))


@query(SIGNATURES + " SELECT a, b, ph_distance, dh_distance FROM e WHERE (aph >> 48) & 65535 = (bph >> 48) & 65535")
def hamming_pairs_bucketed(spark, sf_dir):
    return simjoin.hamming_pairs_bucketed(simjoin.hamming_classes(A.signatures(spark, sf_dir)))


CLUSTERED = ", r(a, b) AS (SELECT rep, rep FROM h UNION SELECT r.a, CASE WHEN e.a = r.b THEN e.b ELSE e.a END FROM r JOIN e ON e.a = r.b OR e.b = r.b), z AS (SELECT a AS rep, min(b) AS root FROM r GROUP BY a)"


@query(SIGNATURES.replace("WITH own", "WITH RECURSIVE own") + CLUSTERED + " SELECT s.id, root AS cluster FROM s JOIN h USING (ph, dh) JOIN z USING (rep) QUALIFY count(*) OVER (PARTITION BY root) >= 2")
def image_clusters(spark, sf_dir):
    return scan.hamming_clusters(A.signatures(spark, sf_dir))


@query(SIGNATURES.replace("WITH own", "WITH RECURSIVE own") + CLUSTERED + " SELECT x.root, max(bit_count(xor(p.ph, q.ph)))::BIGINT AS spread FROM z x JOIN z y ON x.root = y.root AND x.rep < y.rep JOIN h p ON p.rep = x.rep JOIN h q ON q.rep = y.rep GROUP BY x.root")
def cluster_spread(spark, sf_dir):
    signatures = A.signatures(spark, sf_dir)
    classes = simjoin.hamming_classes(signatures)
    clusters = scan.hamming_clusters(signatures).select(F.col("id").alias("node"), F.col("cluster").alias("root"))
    return simjoin.spread(clusters, classes.select("rep", "ph"), scalars.hamming(F.col("x.ph"), F.col("y.ph")), F.max).withColumn("spread", F.col("spread").cast("bigint"))


@query(WORDS + " SELECT a, b, round(similarity, 6) AS similarity FROM e")
def jaccard_pairs(spark, sf_dir):
    classes = checkpointed(packed.packed_classes(packed.numbered_sets(A.word_sets(spark, sf_dir))))
    return simjoin.packed_pairs(classes, OPTIONS.similar_threshold).withColumn("similarity", F.round("similarity", 6))


@query(WORDS + CLUSTERED + " SELECT t.id, root AS cluster FROM t JOIN h USING (tokens) JOIN z USING (rep) QUALIFY count(*) OVER (PARTITION BY root) >= 2")
def similar_clusters(spark, sf_dir):
    return scan.set_clusters(A.word_sets(spark, sf_dir))


@query(FILES + f" SELECT path FROM n WHERE ext NOT IN {IMAGE_EXTENSIONS} EXCEPT SELECT path FROM n QUALIFY count(*) OVER (PARTITION BY size, full_hash) >= 2")
def advanced_remaining(spark, sf_dir):
    files = filters.in_scope(_digested(spark, sf_dir), 0)
    return files.filter(~F.col("is_image")).join(exact.members(files).select("path"), "path", "left_anti").select("path")


@query(SCANNED + " SELECT group_id, kind, path, size, keeper, is_backup FROM k")
def all_groups(spark, sf_dir):
    files = A.document_files(spark, sf_dir, content=True)
    options = ScanOptions(roots=("/src0",), include_hidden=True, advanced_similar=True, exclusions=None)
    return scan.all_groups(files, options, fingerprints.image_fingerprints(A.document_images(spark, sf_dir))).select("group_id", "kind", "path", "size", "keeper", "is_backup")


@query(FILES + ", " + ANCHORS.replace("{src}", "f") + " SELECT path, CASE WHEN len(hits) = 0 THEN 1 ELSE least(4000, len(list_distinct(hits))) END::INT AS anchors FROM hh")
def anchor_sets(spark, sf_dir):
    return fingerprints.with_anchors(A.document_files(spark, sf_dir, content=True)).select("path", F.size("anchors").alias("anchors"))


@query(FILES.replace("WITH f", "WITH RECURSIVE f") + f", docs AS (SELECT * FROM n WHERE ext NOT IN {IMAGE_EXTENSIONS}), " + FUZZY.replace("{src}", "docs") + " SELECT path, group_id FROM fuzzy")
def fuzzy_groups(spark, sf_dir):
    files = filters.in_scope(A.document_files(spark, sf_dir, content=True), 0)
    return scan.fuzzy_members(files, files.limit(0), ScanOptions(fuzzy_digest="locality")).select("group_id", "path")


@query(FILES.replace("WITH f", "WITH RECURSIVE f") + f", docs AS (SELECT * FROM n WHERE ext NOT IN {IMAGE_EXTENSIONS}), " + FUZZY.replace("{src}", "docs") + """
SELECT x.group_id AS root, max(list_sum(list_transform(range(1, 129), lambda z: [0, 1, 2, 6][abs(a.codes[z] - b.codes[z]) + 1])) * 5 // 2)::BIGINT AS spread FROM fuzzy x JOIN fuzzy y ON x.group_id = y.group_id AND x.path < y.path JOIN xd a ON a.path = x.path JOIN xd b ON b.path = y.path GROUP BY x.group_id""")
def fuzzy_spread(spark, sf_dir):
    files = filters.in_scope(A.document_files(spark, sf_dir, content=True), 0).filter(~F.col("is_image"))
    digests = checkpointed(fingerprints.with_locality_digest(files))
    clusters = connected_components(scan.fuzzy_links(digests, OPTIONS.fuzzy_distance))
    return scan.fuzzy_spread(digests, clusters)


@query(FILES + ", " + DIGESTS.replace("{src}", "f") + " SELECT path, block || ':' || s || ':' || t AS digest FROM pd")
def piecewise_digest(spark, sf_dir):
    return ctph.with_piecewise_digest(A.document_files(spark, sf_dir, content=True))


@query(FILES.replace("WITH f", "WITH RECURSIVE f") + f", docs AS (SELECT * FROM n WHERE ext NOT IN {IMAGE_EXTENSIONS}), " + PIECEWISE.replace("{src}", "docs") + " SELECT path, group_id FROM fuzzy")
def piecewise_groups(spark, sf_dir):
    files = filters.in_scope(A.document_files(spark, sf_dir, content=True), 0)
    return scan.fuzzy_members(files, files.limit(0), ScanOptions()).select("path", "group_id")


# ---- logs, plans, previews --------------------------------------------------


@query(RUNS + """ SELECT seq, tier, duration, total_files, total_hashed + total_reused AS fingerprinted, CASE WHEN total_hashed + total_reused > 0 THEN round_even(100.0 * total_reused / (total_hashed + total_reused), 0) ELSE 0 END::BIGINT AS cache_hit_pct,
CASE WHEN duration > 0 THEN round(total_files / duration, 6) ELSE 0 END AS throughput FROM r ORDER BY seq DESC LIMIT 50""")
def run_log(spark, sf_dir):
    return logs.run_stats(A.event_runs(spark, sf_dir)).select("seq", "tier", "duration", "total_files", "fingerprinted", "cache_hit_pct", F.round("throughput", 6).alias("throughput"))


@query(RUNS + """, x AS (SELECT a.seq, a.tier, a.duration, a.cancelled, arg_max(b.seq, b.seq) AS previous_seq, arg_max(b.duration, b.seq) AS previous_duration FROM r a LEFT JOIN r b ON a.tier = b.tier AND a.sources = b.sources AND b.seq < a.seq AND NOT b.cancelled GROUP BY ALL)
SELECT *, CASE WHEN cancelled OR previous_seq IS NULL OR duration <= 0 OR previous_duration <= 0 THEN NULL WHEN duration <= previous_duration / 1.15 THEN 'faster' WHEN duration >= previous_duration * 1.15 THEN 'slower' ELSE 'same' END AS verdict FROM x""")
def run_compare(spark, sf_dir):
    return logs.compare_runs(A.event_runs(spark, sf_dir))


@query(RUNS + " SELECT source, max(seq) AS seq, arg_max(duration, seq) AS duration FROM (SELECT seq, duration, unnest(sources) AS source FROM r) GROUP BY source")
def last_run_per_source(spark, sf_dir):
    return logs.last_run_per_source(A.event_runs(spark, sf_dir))


@query("SELECT event_id AS before_bytes, epoch(ts)::DOUBLE AS \"when\", event_type AS action, round(value)::BIGINT AS freed, greatest(0, event_id - round(value)::BIGINT) AS after_bytes FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def action_log(spark, sf_dir):
    actions = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("before_bytes"), F.unix_micros(F.to_timestamp("ts")).alias("us"), F.col("event_type").alias("action"), F.round("value").cast("bigint").alias("freed"))
    return logs.action_log(actions.withColumn("when", F.col("us") / 1e6)).drop("us")


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'view') AS done, round(count(*) FILTER (event_type <> 'view') / count(*), 6) AS fraction FROM events GROUP BY user_id")
def progress_ratio(spark, sf_dir):
    e = A.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") != "view").alias("done"))
    return e.withColumn("fraction", F.round(scalars.fraction(F.col("done"), F.col("total")), 6))


@query(GROUPED + " SELECT group_id, path, size, 'trash' AS action, CASE WHEN path IN ('/', '/usr') THEN 'refused' ELSE 'trash' END AS status FROM k WHERE NOT keeper AND NOT (path LIKE '/src2/%')")
def action_plan(spark, sf_dir):
    return logs.action_plan(_ranked(spark, sf_dir), "trash", filters.ignored((), ("/src2",)))


@query(GROUPED + ", l AS (SELECT a.size, CASE WHEN a.ino = b.ino THEN 'already_linked' ELSE 'link' END AS status FROM k a JOIN k b ON a.group_id = b.group_id AND b.keeper WHERE NOT a.keeper) SELECT 'link' AS action, status, count(*) AS files, sum(size)::BIGINT AS bytes FROM l GROUP BY status")
def action_totals(spark, sf_dir):
    return logs.plan_totals(logs.action_plan(_ranked(spark, sf_dir), "link"))


_KINDS = " ".join(f"WHEN ext IN ({', '.join(repr(e) for e in exts)}) THEN '{kind}'" for kind, exts in PREVIEW_EXTENSIONS.items())


@query(FILES + f" SELECT path, CASE {_KINDS} WHEN size > 0 AND NOT contains(text[1:512], chr(0)) THEN 'text' ELSE 'meta' END AS kind FROM n")
def preview_kind(spark, sf_dir):
    return A.document_files(spark, sf_dir, content=True).select("path", logs.preview_kind(F.col("path"), F.col("content")).alias("kind"))


#: A text of more than 64 KiB is cut behind the last whole character within them; a character that the limit cuts is one replacement character.
@query(r"""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE strlen(text) > 65536),
w AS (SELECT doc_id, string_agg(ch, '' ORDER BY i) || CASE WHEN sum(strlen(ch)) < 65536 THEN chr(65533) ELSE '' END AS head FROM (SELECT *, sum(strlen(ch)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM c) WHERE upto <= 65536 GROUP BY doc_id),
s AS (SELECT doc_id, regexp_split_to_array(coalesce(head, text), '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS lines FROM documents LEFT JOIN w USING (doc_id))
SELECT doc_id, array_to_string((CASE WHEN lines[-1] = '' THEN lines[1:len(lines) - 1] ELSE lines END)[1:200], chr(10)) AS preview FROM s""")
def preview_text(spark, sf_dir):
    docs = A.table(spark, sf_dir, "documents")
    return docs.select("doc_id", logs.preview_text(F.col("text").cast("binary")).alias("preview"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def strip_markup(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", scalars.strip_markup(F.col("html")).alias("text"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_type || ' ' || p_brand), 'econ')")
def glossary_search(spark, sf_dir):
    parts = A.table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_name").alias("term"), F.col("p_type").alias("short"), F.col("p_brand").alias("body"), F.array().cast("array<string>").alias("aliases"))
    return logs.search_glossary(parts, "  ECON ").select("p_partkey", "p_name")


@query("SELECT p_brand AS category, min(p_partkey) AS first, count(*) AS entries FROM part GROUP BY p_brand")
def glossary_categories(spark, sf_dir):
    return logs.categories(A.table(spark, sf_dir, "part").select(F.col("p_brand").alias("category"), F.col("p_partkey").alias("pos")))


@query(FILES + ", m(mount, device, line) AS (VALUES ('/', 'sda1', 0), ('/src1', 'sdb1', 1), ('/src1/en', 'sdc1', 2), ('/src1', 'sdd1', 3)) SELECT path, mount, device FROM n, m WHERE mount = '/' OR path = mount OR path LIKE mount || '/%' QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(mount) DESC, line DESC) = 1")
def mount_lookup(spark, sf_dir):
    mounts = spark.createDataFrame([("/", "sda1", 0), ("/src1", "sdb1", 1), ("/src1/en", "sdc1", 2), ("/src1", "sdd1", 3)], "mount string, device string, line int")
    return logs.mount_of(A.document_files(spark, sf_dir).select("path"), mounts)


@query(FILES + " SELECT ext, count(*) AS files, sum(size)::BIGINT AS bytes, CASE ext WHEN '.txt' THEN 'document' WHEN '.jpg' THEN 'image' END AS category FROM n GROUP BY ext")
def type_breakdown(spark, sf_dir):
    files = filters.in_scope(A.document_files(spark, sf_dir), 0).groupBy("ext").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    return files.join(F.broadcast(type_table(spark).select("ext", "category")), "ext", "left")


_UNITS = " ".join(f"WHEN size < {scale}000 THEN printf('%.1f {unit}', size / {scale}.0::DOUBLE)" for unit, scale in (("KB", 10**3), ("MB", 10**6), ("GB", 10**9)))


@query(FILES + f""", x AS (SELECT path, ext, size, CASE WHEN size < 1000 THEN size || ' B' {_UNITS} END AS size_text, size / 100.0::DOUBLE AS s FROM n)
SELECT path, size_text, CASE WHEN ext = '' THEN 'FILE' ELSE upper(substr(ext, 2)) END || ' · ' || size_text AS meta, CASE WHEN s < 1 THEN '<1s' WHEN s < 60 THEN printf('%.1fs', s) ELSE printf('%dm %ds', floor(s)::BIGINT // 60, floor(s)::BIGINT % 60) END AS duration FROM x""")
def human_sizes(spark, sf_dir):
    files = A.document_files(spark, sf_dir)
    return files.select("path", scalars.human_bytes(F.col("size")).alias("size_text"), logs.preview_meta(F.col("path"), F.col("size")).alias("meta"), scalars.duration(F.col("size") / 100.0).alias("duration"))


@query(FILES + f" SELECT list_has_any(string_split(parent, '/'), {list(PRESET_DIRS['build'])}) AS hit, count(*) AS files FROM n GROUP BY ALL")
def preset_hits(spark, sf_dir):
    return A.document_files(spark, sf_dir).select(filters.excluded(("build",)).alias("hit")).groupBy("hit").agg(F.count(F.lit(1)).alias("files"))


@query()
def src_walk(spark, sf_dir):
    found = walk.walk(spark, ScanOptions(roots=(sf_dir,)))
    return found.select(scalars.basename(F.col("path")).alias("name"), "size")


@query("WITH g AS (SELECT vec_id::VARCHAR AS path, list_transform(embedding, lambda x: greatest(0, least(255, floor(128 + 40 * x)))::DOUBLE) AS p FROM embeddings), " + PRINTS + " SELECT path, ph, dh, 8::INT AS width, 8::INT AS height FROM ip")
def image_fp(spark, sf_dir):
    return fingerprints.image_fingerprints(A.embedding_images(spark, sf_dir))


@query("""SELECT '/photos/' || doc_id || '.jpg' AS path, CASE WHEN doc_id % 4 < 3 THEN printf('2023:%02d:%02d 10:00:00', doc_id % 12 + 1, doc_id % 28 + 1) END AS taken, CASE WHEN doc_id % 4 < 3 THEN 'Cam ' || doc_id % 9 END AS model FROM documents""")
def exif(spark, sf_dir):
    fields = previews.with_parsed(A.made_files(spark, sf_dir, A.photo_file), lambda content: "\n".join(x or "" for x in previews.exif_fields(content)), "found")
    part = F.split("found", "\n")
    return fields.select("path", F.nullif(part[0], F.lit("")).alias("taken"), F.nullif(part[1], F.lit("")).alias("model"))


@query("""SELECT '/office/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.docx' WHEN 1 THEN '.odt' ELSE '.xlsx' END AS path,
CASE WHEN doc_id % 3 < 2 THEN substr(trim(regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')), 1, 6000) WHEN doc_id % 5 > 0 THEN doc_id % 5 || ' sheets' END AS text FROM documents""")
def office_preview(spark, sf_dir):
    return previews.with_parsed(A.made_files(spark, sf_dir, A.office_file), previews.office_text, "text")


@query("""SELECT '/archives/' || doc_id || CASE WHEN doc_id % 7 = 6 OR doc_id % 2 = 1 THEN '.zip' ELSE '.tar' END AS path,
CASE WHEN doc_id % 7 < 6 THEN array_to_string(list_concat([doc_id % 301 || ' entries'], list_transform(range(least(200, doc_id % 301)), lambda k: 'd/' || k || '.txt')), chr(10)) END AS entries FROM documents""")
def archive_preview(spark, sf_dir):
    return previews.with_parsed(A.made_files(spark, sf_dir, A.archive_maker()), previews.archive_text, "entries")


# ---- reuse, images, ignored files, drives ------------------------------------


@query(INDEXED + """, x AS (SELECT f.*, i.sha256 FROM f LEFT JOIN i ON f.path = i.path AND f.size = i.size AND f.mtime = i.mtime QUALIFY count(*) OVER (PARTITION BY f.size) >= 2),
y AS (SELECT source, CASE WHEN sha256 IS NOT NULL THEN 'reused' WHEN count(sha256) OVER (PARTITION BY size) > 0 OR count(*) FILTER (sha256 IS NULL) OVER (PARTITION BY size, text[1:65536]) >= 2 THEN 'hashed' ELSE 'prefix_only' END AS state FROM x)
SELECT source, count(*) FILTER (state = 'reused') AS reused, count(*) FILTER (state = 'hashed') AS hashed FROM y GROUP BY source""")
def reuse_per_source(spark, sf_dir):
    files = checkpointed(_digested(spark, sf_dir))
    return index.reuse_counts(index.incremental(files, A.index_snapshot(files)))


@query(SIGNATURES + """, i AS (SELECT id, ph + 1 AS ph FROM own WHERE id % 3 = 0 AND id % 5 > 0) SELECT own.id::VARCHAR AS path, CASE WHEN i.id IS NULL THEN own.ph ELSE i.ph END AS phash, own.dh AS dhash, 8 AS width, 8 AS height, i.id IS NOT NULL AS reused FROM own LEFT JOIN i USING (id)""")
def image_index(spark, sf_dir):
    prints = A.signatures(spark, sf_dir).filter("id < 1000000").select(F.col("id").cast("string").alias("path"), F.col("ph").alias("phash"), F.col("dh").alias("dhash"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    files = prints.select("path", F.lit(64).cast("bigint").alias("size"), F.lit(0.0).alias("mtime"))
    number = F.col("path").cast("bigint")
    # an index of every third file, with a word that tells what came from it, and out of date for every fifth
    known = prints.filter(number % 3 == 0).select("path", F.lit(64).cast("bigint").alias("size"), F.when(number % 5 == 0, 1.0).otherwise(0.0).alias("mtime"), (F.col("phash") + 1).alias("phash"), "dhash", "width", "height")
    return index.image_prints(files, known, lambda misses: prints.join(misses.select("path"), "path", "left_semi")).select("path", "phash", "dhash", "width", "height", "reused")


@query(WORDS + CLUSTERED + """, c AS (SELECT z.root, z.rep, h.tokens FROM z JOIN h USING (rep))
SELECT x.root, min(floor(100 * len(list_intersect(x.tokens, y.tokens)) / (len(x.tokens) + len(y.tokens) - len(list_intersect(x.tokens, y.tokens)))))::BIGINT AS spread FROM c x JOIN c y ON x.root = y.root AND x.rep < y.rep GROUP BY x.root""")
def similar_spread(spark, sf_dir):
    return scan.set_spreads(A.word_sets(spark, sf_dir)).withColumnRenamed("cluster", "root")


@query(FILES + ", i AS (SELECT path FROM n WHERE ext = '.bak' UNION SELECT path FROM n WHERE path LIKE '/src1/%' EXCEPT SELECT path FROM n WHERE path LIKE '/src1/de/%') SELECT path FROM n EXCEPT SELECT path FROM i")
def ignore_edit(spark, sf_dir):
    files = A.document_files(spark, sf_dir).select("path")
    listed = filters.add_ignored(files.filter(scalars.extension(scalars.basename(F.col("path"))) == ".bak"), files.filter(scalars.under(F.col("path"), "/src1")))
    return filters.drop_ignored(files, filters.remove_ignored(listed, files.filter(scalars.under(F.col("path"), "/src1/de"))))


#: A machine of a disk with two partitions, one of them behind a mapper, and a solid-state disk.
_DEVICES = """{"blockdevices": [{"name": "sda", "path": "/dev/sda", "model": " Disk One ", "rota": true, "tran": "sata", "size": "4000",
"children": [{"name": "sda1", "path": "/dev/sda1", "fstype": "ext4", "size": 1000, "mountpoint": "/"}, {"name": "sda2", "path": "/dev/sda2", "size": "3000", "children": [{"name": "map", "path": "/dev/mapper/map", "fstype": "xfs", "size": 2900, "mountpoints": [null, "/src1"]}]}]},
{"name": "nvme0n1", "model": "Fast", "rota": "0", "tran": "nvme", "size": 500}]}"""
_MOUNTED = "/dev/sda1 / ext4 rw 0 0\n/dev/mapper/map /src1 - rw 0 0\n/dev/nvme0n1 /src1/en btrfs rw 0 0\nodd /src2/my\\040disk nfs rw 0 0\n/dev/gone /src3 vfat rw 0 0\n"


@query(FILES + """, m(mount, device, fstype, model, kind, transport, size) AS (VALUES ('/', '/dev/sda1', 'ext4', 'Disk One', 'HDD', 'sata', 1000), ('/src1', '/dev/mapper/map', '-', 'Disk One', 'HDD', 'sata', 2900),
  ('/src1/en', '/dev/nvme0n1', 'btrfs', 'Fast', 'SSD', 'nvme', 500), ('/src3', '/dev/gone', 'vfat', '', '', '', 0))
SELECT path, mount, device, fstype, model, kind, transport, m.size::BIGINT AS size FROM n, m WHERE mount = '/' OR path LIKE mount || '/%' QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(mount) DESC) = 1""")
def drive_probe(spark, sf_dir):
    mounted = spark.createDataFrame(drives.mount_rows(_MOUNTED), drives.MOUNTS)
    return drives.drives_of(A.document_files(spark, sf_dir).select("path"), mounted, drives.block_devices(spark, _DEVICES))
