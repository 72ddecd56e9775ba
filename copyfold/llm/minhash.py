"""MinHash near-deduplication: universal hash minima, banding, verification, components.

A text's set is its distinct word shingles. HASHES universal hashes (odd
multiplier and offset modulo 2^32, over 32 bits of each shingle's hash) have
their minima taken over the set; BANDS groups of ROWS minima are bucket keys.
Texts with the same set are one class from then on. A pair at the threshold of 0.8
shares no bucket with a chance of (1 - 0.8^ROWS)^BANDS, about 5e-6.

Within a bucket no pairs are spelled out: every member is compared with the
bucket's first class, then, where a bucket still spans several components,
with its last one; and only what is left in different components after both
is compared with each other, among sets of like size, in a join whose condition rules out nearly all pairs that
aren't linked by a bitmap of the parities of the sets' hashes, which bounds how far two
sets differ. Links are confirmed on the full
sets, so pairs of one component that weren't compared could not have changed a result.
Buckets, components and compared classes that hold much of all rows are split over tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyfold.checkpoints import checkpointed, compacted
from copyfold.llm.common import HOT_FLOOR, HOT_GROUPS, fold_words, join_groups, mix64, word_hashes
from copyfold.operators.components import connected_components

HASHES, ROWS = 240, 6
BANDS = HASHES // ROWS
#: Words of a shingle, unless a caller says otherwise; a link's least similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Bits of a set's parity bitmap; sets that differ in d elements have bitmaps that differ in d bits at most.
PARITY_BITS = 1024
#: Rows, and sets, of a part in which they are written between steps.
PART_ROWS, PART_SETS = 100_000, 8_000
#: Shingles whose hashes are taken at once; rows of an output batch.
SLICE, BATCH_ROWS = 1024, 1024

_rng = np.random.default_rng(1997)
_FACTOR = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSET = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_WORD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of ``n`` words."""
    return np.unique(fold_words(word_hashes(text), n))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each universal hash over a set that isn't empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    parts = [(x[i : i + SLICE, None] * _FACTOR + _OFFSET).min(axis=0) for i in range(0, len(x), SLICE)]
    return parts[0] if len(parts) == 1 else np.min(parts, axis=0)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit bucket key for each band."""
    rows = least.reshape(BANDS, ROWS).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = mix64(keys * _WORD + rows[:, r])
    return keys


def parities(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of elements falls to each bit of a bitmap, in 64-bit words."""
    counts = np.bincount((shingles % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


SIGNED = "doc_id bigint, mark bigint, n_shingles bigint, class binary, keys array<bigint>"


def signer(n: int):
    """Set size, class (a digest of the set) and bucket keys of each text by its ``n``-word shingles; no keys for an empty set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                sizes, classes, keys, counts = [], [], [], [0]
                for text in batch.column(2):
                    found = shingle_set((text.as_py() or "").encode(), n)
                    sizes.append(len(found))
                    classes.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    if len(found):
                        keys.append(band_keys(minima(found)).view(np.int64))
                    counts.append(BANDS if len(found) else 0)
                flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pa.array(flat))
                columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "n_shingles", "class", "keys"])

    return sign


SETS = "class binary, shingles array<bigint>, parity array<bigint>"


def set_maker(n: int):
    """Class, full set and parity bitmap of each text that has words."""

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS // 4):
                sets = [shingle_set((text.as_py() or "").encode(), n) for text in whole.slice(at, BATCH_ROWS // 4).column(0)]
                sets = [s for s in sets if len(s)]
                if not sets:
                    continue
                classes = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                parts = [[s.view(np.int64) for s in sets], [parities(s) for s in sets]]
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, p)]), pa.int32()), pa.array(np.concatenate(p))) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), *lists], names=["class", "shingles", "parity"])

    return full_sets


def _may_link(a: str, b: str):
    """Whether sizes and parities allow a link between two structs of class, size and parity.

    Sets of x and y elements with similarity of p percent or more differ in (x + y) * (100 - p) / (100 + p) elements at most.
    """
    small, large = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
    differ = sum((F.bit_count(F.get(f"{a}.parity", F.lit(i)).bitwiseXOR(F.get(f"{b}.parity", F.lit(i)))) for i in range(PARITY_BITS // 64)), F.lit(0))
    return (100 * small >= PERCENT * large) & ((100 + PERCENT) * differ <= (100 - PERCENT) * (small + large))


def _as_pairs(candidates: DataFrame, x: str, y: str) -> DataFrame:
    return candidates.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _hot_lanes(pairs: DataFrame, side: str, total: int) -> list[tuple[bytes, int]]:
    """The classes that are in over 1/HOT_GROUPS of the pairs, which are fewer than HOT_GROUPS whatever the data, and how many such parts they have."""
    part = max(HOT_FLOOR, total // HOT_GROUPS)
    counts = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > part)
    return [(r[side], -(-r["n"] // part)) for r in counts.collect()]


def _lane_rows(spark, lanes: list[tuple[bytes, int]], side: str) -> DataFrame:
    """``lanes`` as rows (side, _lanes). They go to the JVM as an Arrow table: rows of a plain list would pass through a Python RDD, for which each executor starts a second daemon and workers of its own."""
    classes, numbers = zip(*lanes)
    return spark.createDataFrame(pa.table({side: pa.array(map(bytes, classes), pa.binary()), "_lanes": pa.array(numbers, pa.int64())}))


def _with_set(pairs: DataFrame, sets: DataFrame, side: str, lanes: list[tuple[bytes, int]]) -> DataFrame:
    """``pairs`` with the full set of their class in the column ``side``, as _a or _b.

    The sets of the classes in ``lanes`` are copied to as many lanes, over which their pairs are dealt.
    """
    own = sets.select(F.col("class").alias(side), F.col("shingles").alias(f"_{side}"))
    if not lanes:
        return pairs.join(own, side)
    lanes = F.broadcast(_lane_rows(pairs.sparkSession, lanes, side))
    copies = own.join(lanes, side, "left").select(side, f"_{side}", F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce("_lanes", F.lit(1)))).alias("_lane"))
    other = "b" if side == "a" else "a"
    dealt = pairs.join(lanes, side, "left").withColumn("_lane", 1 + F.pmod(F.xxhash64(other), F.coalesce("_lanes", F.lit(1)))).drop("_lanes")
    return dealt.join(copies, [side, "_lane"]).drop("_lane")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets meet the threshold."""
    pairs, total = compacted(pairs, PART_ROWS)
    both = _with_set(pairs, sets, "a", _hot_lanes(pairs, "a", total))
    both = _with_set(both, sets, "b", _hot_lanes(pairs, "b", total)).withColumn("_both", F.size(F.array_intersect("_a", "_b")))
    return both.filter(100 * F.col("_both") >= PERCENT * (F.size("_a") + F.size("_b") - F.col("_both"))).select("a", "b")


def class_links(docs: DataFrame, signed: DataFrame, shingle: int) -> DataFrame | None:
    """(node, root) for the classes that are linked with others; None if no two share a bucket."""
    classes = signed.filter("n_shingles > 0").select("class", "keys").dropDuplicates(["class"])
    spread = classes.select("class", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    members, n_members = compacted(spread.join(shared, "key", "left_semi"), PART_ROWS)
    if not n_members:
        return None
    wanted = members.select("class").distinct()
    # ids combine before the shuffle, so a text that very many rows have costs no task more than a row for each part
    ids, _ = compacted(signed.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id")).join(wanted, "class", "left_semi"), PART_ROWS)
    known = docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    if not ids.filter("doc_id IS NULL").isEmpty():
        known = known.unionByName(docs.filter("doc_id IS NULL").select("text"))
    sets, _ = compacted(known.mapInArrow(set_maker(shingle), SETS).join(wanted, "class", "left_semi").dropDuplicates(["class"]), PART_SETS)
    # sizes of linked sets lie in one band or in neighbouring ones
    band = F.floor(F.log(F.size("shingles").cast("double")) / math.log(100 / PERCENT)).cast("int")
    facts = sets.select("class", F.struct("class", F.size("shingles").alias("size"), "parity").alias("x"), band.alias("band"))

    def leaders(rows: DataFrame, total: int, pick) -> DataFrame:
        first, _ = compacted(rows.groupBy("key").agg(pick("class").alias("lead"), F.count(F.lit(1)).alias("n")), PART_ROWS)
        return _as_pairs(join_groups(rows, first, "key", "n", F.col("class"), total).filter("class <> lead"), "class", "lead")

    links, _ = compacted(_linked(leaders(members, n_members, F.min), sets), PART_ROWS)
    for last in (False, True):
        roots = connected_components(links)
        placed = members.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        placed = checkpointed(placed)
        apart, _ = compacted(placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high").select("key", "n"), PART_ROWS)
        placed, n_placed = compacted(join_groups(placed, apart, "key", "n", F.col("class"), n_members).filter("n IS NOT NULL").drop("n"), PART_ROWS)
        if not n_placed:
            return roots
        if last:
            full = placed.join(facts, "class").select("key", "root", "x", "band")
            other = full.select("key", F.col("root").alias("other"), F.col("x").alias("y"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
            near = full.join(other, ["key", "band"]).filter((F.col("root") < F.col("other")) & _may_link("x", "y"))
            more, n_more = compacted(_linked(_as_pairs(near, "x.class", "y.class"), sets), PART_ROWS)
        else:
            more, n_more = compacted(_linked(leaders(placed.select("key", "class"), n_placed, F.max), sets), PART_ROWS)
        if not n_more and last:
            return roots
        links = links.unionByName(more)
    return connected_components(links)


def marked_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """near_duplicates with the further column mark, a hash of the row's text."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    signed = checkpointed(own.mapInArrow(signer(shingle), SIGNED))
    roots = class_links(own, signed, shingle)
    rows = signed.filter("n_shingles > 0").select("doc_id", "mark", "n_shingles", "class")
    groups = rows.groupBy("class").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    if roots is not None:
        placed = groups.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        placed, total = compacted(placed, PART_ROWS)
        least = placed.groupBy("root").agg(F.min("component_id").alias("least"), F.count(F.lit(1)).alias("n"))
        groups = join_groups(placed, least, "root", "n", F.col("class"), total).select("class", F.col("least").alias("component_id"), "rows")
    out = join_groups(rows, checkpointed(groups), "class", "rows", F.coalesce("doc_id", F.col("mark"))).drop("class", "rows")
    alone = signed.filter("n_shingles = 0").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its component of near-duplicates.

    Returns doc_id, n_shingles, component_id (the smallest doc_id that links
    lead to, its own included) and kept. Words are runs of [^\\x20\\x09-\\x0D], A-Z
    folded; a text of fewer than ``shingle`` words is one shingle. Texts without words, null
    ones too, are linked with nothing. Rows that repeat a doc_id are one node if
    their sets are equal. Null ids never become a component_id unless all ids
    of a component are null; kept then is true. Further columns are not read.
    """
    return marked_duplicates(docs, shingle).drop("mark")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs``, with all columns, that near_duplicates keeps."""
    gone = marked_duplicates(docs, shingle).filter(~F.col("kept")).select(F.col("doc_id").alias("_gone"), F.col("mark").alias("_mark"))
    match = docs["doc_id"].eqNullSafe(F.col("_gone")) & (F.xxhash64(docs["text"]) == F.col("_mark"))
    return docs.join(gone.distinct(), match, "left_anti")
