"""Exact similarity joins without comparing all pairs.

Rows that are alike come in as one class: joins return pairs of class
representatives, and ``*_classes`` says which row is in which class.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyfold.checkpoints import checkpointed
from copyfold.functions.scalars import hamming
from copyfold.operators.packed import blob, numbered_sets, unblob, unpack
from copyfold.skew import join_groups

#: 64-bit words of a set's parity bitmap; classes of a cluster that are compared in one block.
PARITY_WORDS, SPREAD_BLOCK = 16, 512
#: Sets of a cluster that are compared in one block; places where two sets meet that are spelled out at once.
SET_BLOCK, LOT = 2048, 1 << 19
#: Tokens and sets of a block of the join, about; bands of sizes in a doubling, of which a block has a quarter at most; blocks of a part of many.
BLOCK_TOKENS, BLOCK_SETS, BANDS, PART_BLOCKS = 1 << 22, 1 << 15, 16, 4
#: Candidates must meet in one of so many tokens that similar sets share.
SHARE = 32


def hamming_classes(signatures: DataFrame) -> DataFrame:
    """(ph, dh, rep, rows) of the distinct signatures of (id, ph, dh); rep is the smallest id."""
    return signatures.groupBy("ph", "dh").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows"))


def _bands(column: str, n: int):
    """``n`` disjoint runs of the bits of a 64-bit word; two words within n - 1 bits agree in one of them."""
    edges = [64 * i // n for i in range(n + 1)]
    if n == 1:
        return F.array(column)
    return F.array(*[F.shiftrightunsigned(column, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:])])


def hamming_pairs(classes: DataFrame, distance: int = 8) -> DataFrame:
    """(a, b, ph_distance, dh_distance) of the representatives within ``distance`` in both words, a < b.

    Words within d bits agree in one of d + 1 bands each, so a pair meets in the
    cell of such a band of ph and such a band of dh: an equi-join on both, and no pair is missed.
    """
    if distance >= 31:
        raise ValueError("bands would be too short to tell pairs apart")
    n = distance + 1
    cells = classes.select("rep", "ph", "dh", F.posexplode(_bands("ph", n)).alias("i", "p")).select("*", F.posexplode(_bands("dh", n)).alias("j", "d"))
    cells = cells.select("rep", "ph", "dh", (F.col("i") * n + F.col("j")).alias("cell"), "p", "d")
    x, y = cells.alias("x"), cells.alias("y")
    same = (F.col("x.cell") == F.col("y.cell")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.d") == F.col("y.d"))
    p, d = hamming(F.col("x.ph"), F.col("y.ph")), hamming(F.col("x.dh"), F.col("y.dh"))
    # sizes are estimated before the rows are exploded, so without the hint n * n times what is estimated is broadcast
    near = x.hint("merge").join(y, same & (F.col("x.rep") < F.col("y.rep")) & (p <= distance) & (d <= distance))
    return near.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), p.alias("ph_distance"), d.alias("dh_distance")).distinct()


def hamming_pairs_bucketed(classes: DataFrame, distance: int = 8) -> DataFrame:
    """As hamming_pairs, among words with the same 16 top bits of ph only: cheaper, and it misses the other pairs."""
    cells = classes.withColumn("top", F.shiftrightunsigned("ph", 48))
    x, y = cells.alias("x"), cells.alias("y")
    p, d = hamming(F.col("x.ph"), F.col("y.ph")), hamming(F.col("x.dh"), F.col("y.dh"))
    near = x.join(y, (F.col("x.top") == F.col("y.top")) & (F.col("x.rep") < F.col("y.rep")) & (p <= distance) & (d <= distance))
    return near.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), p.alias("ph_distance"), d.alias("dh_distance"))


def set_digest(tokens: Column) -> Column:
    """A digest of a set of tokens; each stands behind its length, so that no two sets read alike."""
    text = F.transform(F.sort_array(tokens).cast("array<string>"), lambda t: F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
    return F.sha2(F.array_join(text, "").cast("binary"), 256)


def set_classes(sets: DataFrame) -> DataFrame:
    """(class, rep, rows, tokens) of the distinct sets of (id, tokens); class digests the sorted tokens; empty sets have no class."""
    keyed = sets.filter(F.size("tokens") > 0).withColumn("class", set_digest(F.col("tokens")))
    return keyed.groupBy("class").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("tokens").alias("tokens"))


def ranked_sets(classes: DataFrame) -> DataFrame:
    """(rep, size, shared, s) of the classes (rep, tokens), as of numbered_sets: s has the tokens that other sets have too as numbers, the globally rarest first."""
    return numbered_sets(classes.select(F.col("rep").alias("id"), "tokens")).select(F.col("id").alias("rep"), "size", "shared", "s")


def _parity(numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A bitmap for each of the sets of so many numbers: a bit for each residue of the numbers' hashes, set where an odd number of tokens falls to it.
    The bitmaps of two sets differ in no more bits than the sets in numbered tokens."""
    bits = 64 * PARITY_WORDS
    out = np.empty((len(sizes), PARITY_WORDS), np.uint64)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(0, len(sizes), 1024):
        own = sizes[i : i + 1024]
        mixed = _mixed(numbers[ends[i] : ends[i + len(own)]]) >> np.uint64(64 - bits.bit_length() + 1)
        place = np.repeat(np.arange(len(own)) * bits, own) + mixed.astype(np.int64)
        odd = np.bincount(place, minlength=len(own) * bits) & 1
        out[i : i + len(own)] = np.packbits(odd.astype(np.uint8).reshape(-1, 64), axis=1, bitorder="little").view(np.uint64).reshape(-1, PARITY_WORDS)
    return out


def _mixed(numbers: np.ndarray) -> np.ndarray:
    return numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _least(sizes: np.ndarray, t: float) -> np.ndarray:
    """The tokens in which a pair whose smaller set has such a size must meet, less one."""
    return np.floor(min(1.0, t) * sizes / SHARE).astype(np.int64)


def _prefix(sizes: np.ndarray, low: int, high: int, t: float) -> np.ndarray:
    """Length of the prefix in which a set of such a size meets a similar one of ``low`` to ``high`` tokens as often as it must; 0 where none is similar by its size."""
    other = np.maximum(low, np.ceil(t * sizes - 1e-9).astype(np.int64))
    overlap = np.ceil(t / (1 + t) * (sizes + other) - 1e-9).astype(np.int64)
    out = sizes - overlap + 1 + _least(np.minimum(sizes, high), t)
    return np.where((other <= high) & (sizes >= t * other - 1e-9), out, 0)


class SetBlock:
    """Some of the sets, by size, and the tokens of their prefixes, by token."""

    def __init__(self, sets: pa.RecordBatch, postings: pa.RecordBatch):
        self.rep, self.size, self.shared = (sets.column(c).to_numpy().astype(np.int64) for c in range(3))
        self.parity = np.frombuffer(sets.column(3).buffers()[1], np.uint64, len(self.rep) * PARITY_WORDS, sets.column(3).offset * 8 * PARITY_WORDS).reshape(-1, PARITY_WORDS)
        self.s = sets.column(4)
        self.token, self.own, self.at = np.cumsum(postings.column(0).to_numpy(), dtype=np.int64), postings.column(1).to_numpy(), postings.column(2).to_numpy()
        self.low, self.high = int(self.size.min()), int(self.size.max())

    @staticmethod
    def pack(sets: pa.Table, t: float) -> tuple[int, int, bytes, bytes]:
        """The smallest and the largest size of the sets (rep, size, shared, s), and the two parts of their block."""
        sets = sets.combine_chunks().sort_by([("size", "ascending"), ("rep", "ascending")])
        s = pa.concat_arrays([c.cast(pa.binary()) for c in sets.column("s").chunks])
        size, shared = (sets.column(c).to_numpy().astype(np.int64) for c in ("size", "shared"))
        numbers, _ = unpack(s)
        parity = pa.Array.from_buffers(pa.binary(8 * PARITY_WORDS), len(size), [None, pa.py_buffer(_parity(numbers, shared).tobytes())])
        own = np.repeat(np.arange(len(size), dtype=np.int32), shared)
        at = (np.arange(len(numbers)) - np.repeat(np.cumsum(shared) - size, shared)).astype(np.int32)
        kept = np.flatnonzero(at < _prefix(size, 1, int(size.max()) * 2 + 1, t)[own])
        kept = kept[np.argsort(numbers[kept], kind="stable")]
        parts = dict(rep=sets.column("rep").combine_chunks(), size=pa.array(size.astype(np.int32)), shared=pa.array(shared.astype(np.int32)), parity=parity, s=s)
        postings = dict(token=pa.array(np.diff(numbers[kept], prepend=0)), own=pa.array(own[kept]), at=pa.array(at[kept]))
        return int(size[0]), int(size[-1]), blob(**parts), blob(**postings)

    def met_by(self, other: SetBlock, t: float) -> tuple[np.ndarray, np.ndarray]:
        """Token and set of the postings in prefixes in which sets can meet similar ones of ``other``, by token and set."""
        prefix = _prefix(self.size, other.low, other.high, t)
        kept = np.flatnonzero(self.at < prefix[self.own])
        return self.token[kept], self.own[kept]


def block_candidates(x: SetBlock, y: SetBlock, t: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the sets of ``x`` and ``y`` that meet in as many tokens of their prefixes as similar ones must; each pair once if both are the ``same`` block.

    The places where they meet are spelled out in lots. Where these are few beside the pairs, they are counted for groups of sets of y first, and
    only those in groups that meet often enough are sorted and counted by pairs.
    """
    token, own = y.met_by(x, t)
    if not len(token):
        return
    first = np.flatnonzero(np.diff(token, prepend=token[0] - 1))
    distinct, sizes = token[first], np.diff(np.append(first, len(token)))
    asked, by = x.met_by(y, t)
    place = np.minimum(np.searchsorted(distinct, asked), len(distinct) - 1)
    found = distinct[place] == asked
    place, by = place[found], by[found]
    order = np.argsort(by.astype(np.uint16) if len(x.rep) < 1 << 16 else by, kind="stable")
    by, place = by[order].astype(np.int64), place[order]
    start, many = first[place], sizes[place]
    total = np.concatenate([[0], np.cumsum(many)])
    ends = np.searchsorted(by, np.arange(len(x.rep) + 1))
    least, before, n, low = _least(np.minimum(x.size, y.low), t), total[ends], len(y.rep), 0
    while low < len(x.rep):
        high = max(low + 1, int(np.searchsorted(before, before[low] + LOT, side="right")) - 1)
        meets, rows = int(before[high] - before[low]), high - low
        if not meets:
            low = high
            continue
        cuts = [ends[low], *np.searchsorted(total, np.arange(before[low], before[high], LOT)[1:]).tolist(), ends[high]]
        shift = max(0, (rows * n // (2 * meets)).bit_length() - 1) if len(cuts) == 2 else 0
        width = (n - 1 >> shift) + 1
        enough, counts = least[low:high], None
        for i, j in zip(cuts, cuts[1:]):
            lot = many[i:j]
            at = np.repeat(start[i:j] - (total[i:j] - total[i]), lot)
            at += np.arange(len(at))
            row, at = np.repeat(by[i:j] - low, lot), own[at]
            key = row * width + (at >> shift)
            met = np.bincount(key, minlength=rows * width)
            counts = met if counts is None else np.add(counts, met, out=counts)
        often = counts.reshape(rows, width) > enough[:, None]
        if shift:
            kept = often.ravel()[key]
            pairs, met = np.unique(row[kept] * n + at[kept], return_counts=True)
        else:
            pairs = np.flatnonzero(often)
            met = counts[pairs]
        a, b = np.divmod(pairs, n)
        a += low
        small, large = np.minimum(x.size[a], y.size[b]), np.maximum(x.size[a], y.size[b])
        kept = (met > _least(small, t)) & (small >= t * large - 1e-9)
        if same:
            kept &= a < b
        yield a[kept], b[kept]
        low = high


def _joined_blocks(ranked: DataFrame, t: float, run, kind: str) -> DataFrame:
    """``run`` (a block, another or the same one, whether it is the same) of all two blocks of sets (rep, size, shared, s) that can be similar by their sizes.

    Sets are dealt by size to blocks of about BLOCK_TOKENS tokens and BLOCK_SETS sets, which are written down. Pairs of blocks are read together from there, so nothing
    that grows faster than the sets is shuffled or kept.
    """
    spark = ranked.sparkSession
    band = F.floor(F.log2("size") * BANDS).cast("int")
    weight = F.greatest(F.sum("shared") / F.lit(BLOCK_TOKENS), F.count(F.lit(1)) / F.lit(BLOCK_SETS))
    weights = dict(ranked.groupBy(band).agg(weight).collect())
    first, many, held, since, blocks = [0] * (max(weights, default=0) + 1), [1] * (max(weights, default=0) + 1), 0.0, 0, -1
    for k in sorted(weights):
        # a band is cut into blocks of its own, or shares one with those next to it
        parts = math.ceil(weights[k])
        if blocks < 0 or parts > 1 or held + weights[k] > 1 or k - since >= BANDS // 4:
            blocks, held, since = blocks + 1, 0.0, k
        first[k], many[k], held = blocks, parts, held + weights[k]
        blocks += parts - 1
    dealt = F.get(F.lit(first), band) + F.pmod(F.xxhash64("rep"), F.get(F.lit(many), band)).cast("int")

    def pack(key, sets):
        low, high, parts, postings = SetBlock.pack(sets.select(["rep", "size", "shared", "s"]), t)
        return pa.table({"block": pa.array([key[1].as_py()], pa.int32()), "low": pa.array([low], pa.int32()), "high": pa.array([high], pa.int32()), "sets": pa.array([parts], pa.binary()), "postings": pa.array([postings], pa.binary())})

    blocks += 1
    parts = max(1, min(blocks, max(-(-blocks // PART_BLOCKS), 2 * math.isqrt(spark.sparkContext.defaultParallelism) + 2)))
    rows = ranked.select("rep", "size", "shared", "s", dealt.alias("block")).withColumn("part", F.col("block") % parts).repartitionById(parts, F.col("part"))
    packed = checkpointed(rows.groupBy("part", "block").applyInArrow(pack, "block int, low int, high int, sets binary, postings binary"))
    other = packed.select(*(F.col(c).alias(f"other_{c}") for c in packed.columns)).hint("shuffle_replicate_nl")
    pairs = packed.join(other, (F.col("block") <= F.col("other_block")) & (F.col("high") >= t * F.col("other_low") - 1e-9))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = [(None, None), (None, None)]
        for batch in batches:
            for row in range(batch.num_rows):
                for side in (0, 1):
                    block = batch.column(3 * side)[row].as_py()
                    if held[side][0] != block:
                        held[side] = block, SetBlock(*(unblob(batch.column(3 * side + c)[row].as_py()) for c in (1, 2)))
                yield from run(held[0][1], held[1][1], held[0][0] == held[1][0])

    return pairs.select(*(side + c for side in ("", "other_") for c in ("block", "sets", "postings"))).mapInArrow(cells, kind)


def candidate_pairs(ranked: DataFrame, t: float) -> DataFrame:
    """(a, b) of the sets (rep, size, shared, s) that meet in as many tokens of their prefixes as sets with Jaccard similarity ``t`` or more do; see jaccard_pairs."""

    def run(x: SetBlock, y: SetBlock, same: bool) -> Iterator[pa.RecordBatch]:
        for a, b in block_candidates(x, y, t, same):
            yield _pairs(x.rep[a], y.rep[b])

    return _joined_blocks(ranked, t, run, "a bigint, b bigint")


def _pairs(left: np.ndarray, right: np.ndarray, **more) -> pa.RecordBatch:
    return pa.record_batch({"a": pa.array(np.minimum(left, right)), "b": pa.array(np.maximum(left, right)), **{k: pa.array(v) for k, v in more.items()}})


def _shared_tokens(left: pa.Array, right: pa.Array, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many numbers each two packed sets have in common: those at ``own`` of ``left``, which ascend, and at ``other`` of ``right``."""
    (x, m), (y, k) = unpack(left), unpack(right)
    starts, places = np.concatenate([[0], np.cumsum(m)]).tolist(), np.cumsum(k) - k
    runs = [*np.flatnonzero(np.diff(own, prepend=-1)).tolist(), len(own)]
    out = np.zeros(len(own), np.int64)
    for p, q in zip(runs, runs[1:]):
        at = own[p]
        numbers, sizes = x[starts[at] : starts[at + 1]], k[other[p:q]]
        ends = np.cumsum(sizes)
        asked = y[np.arange(int(ends[-1])) + np.repeat(places[other[p:q]] - (ends - sizes), sizes)]
        if len(numbers) and len(asked):
            found = np.cumsum(numbers[np.minimum(np.searchsorted(numbers, asked), len(numbers) - 1)] == asked)
            out[p:q] = np.diff(np.concatenate([[0], found])[ends], prepend=0)
    return out


def _similar(x: SetBlock, y: SetBlock, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarities of the sets at ``a`` of x, in ascending order, and at ``b`` of y."""
    (sets, own), (others, other) = (np.unique(places, return_inverse=True) for places in (a, b))
    common = _shared_tokens(x.s.take(pa.array(sets)), y.s.take(pa.array(others)), own, other)
    return common / (x.size[a] + y.size[b] - common)


class _Forest:
    """Which of so many places are joined by the links so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.root[a] != self.root[b]

    def link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The links, in turn, that join what was apart."""
        root, out = self.root, np.zeros(len(a), bool)

        def find(place: int) -> int:
            while root[place] != place:
                place = int(root[place])
            return place

        for i, (p, q) in enumerate(zip(a.tolist(), b.tolist())):
            u, v = find(p), find(q)
            if u != v:
                root[max(u, v)] = min(u, v)
                out[i] = True
        while (root[root] != root).any():
            root[:] = root[root]
        return out


def packed_pairs(ranked: DataFrame, threshold: float, forest: bool = False) -> DataFrame:
    """jaccard_pairs of the sets (rep bigint, size, shared, s) of numbered_sets, which are read several times.

    With ``forest``, of the pairs of two blocks only as many as join all that they join: a group of m sets alike gives m - 1 of them, not all m * m / 2.
    """
    if threshold <= 0:
        raise ValueError("a threshold of 0 links everything")
    t = float(threshold)

    def run(x: SetBlock, y: SetBlock, same: bool) -> Iterator[pa.RecordBatch]:
        shift = 0 if same else len(x.rep)
        linked = _Forest(shift + len(y.rep)) if forest else None
        for a, b in block_candidates(x, y, t, same):
            # the sets of a lot are spelled out
            lots = np.cumsum(x.shared[a] + y.shared[b]) // (2 * LOT)
            cuts = [0, *(np.flatnonzero(np.diff(lots)) + 1).tolist(), len(a)]
            for i, j in zip(cuts, cuts[1:]):
                p, q = a[i:j], b[i:j]
                if linked:
                    apart = linked.apart(p, q + shift)
                    p, q = p[apart], q[apart]
                # parity bitmaps bound how far two sets differ
                differ = np.bitwise_count(x.parity[p] ^ y.parity[q]).sum(axis=1, dtype=np.int64) + x.size[p] - x.shared[p] + y.size[q] - y.shared[q]
                near = differ <= (1 - t) / (1 + t) * (x.size[p] + y.size[q]) + 1e-9
                p, q = p[near], q[near]
                if not len(p):
                    continue
                similarity = _similar(x, y, p, q)
                kept = similarity >= threshold
                p, q, similarity = p[kept], q[kept], similarity[kept]
                if linked:
                    new = linked.link(p, q + shift)
                    p, q, similarity = p[new], q[new], similarity[new]
                yield _pairs(x.rep[p], y.rep[q], similarity=similarity)

    return _joined_blocks(ranked, t, run, "a bigint, b bigint, similarity double")


def jaccard_pairs(classes: DataFrame, threshold: float = 0.55) -> DataFrame:
    """(a, b, similarity) of the representatives of sets (rep, tokens) with Jaccard similarity ``threshold`` or more, a < b.

    Tokens are ordered from the globally rarest. Sets of n and k tokens that are similar share o = t / (1 + t) (n + k) of them, so one of
    these is among the first n - o + 1 of the one and the first k - o + 1 of the other. With m more tokens in both prefixes they have 1 + m of
    them in common, so large sets, whose prefixes are long, must meet in one of SHARE of their tokens. Sets are dealt by size to blocks,
    and each two blocks that can have similar sets are joined in one place. Each candidate is
    tested once by the parity bitmaps, which bound how far two sets differ, and what passes is intersected in full.
    """
    if dict(classes.dtypes)["rep"] == "bigint":
        return packed_pairs(checkpointed(ranked_sets(classes)), threshold)
    named = checkpointed(classes.select("rep", "tokens", F.monotonically_increasing_id().alias("node")))
    found = jaccard_pairs(named.select(F.col("node").alias("rep"), "tokens"), threshold)
    names = named.select("node", "rep")
    found = found.join(names.withColumnsRenamed({"node": "a", "rep": "_x"}), "a").join(names.withColumnsRenamed({"node": "b", "rep": "_y"}), "b")
    return found.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), "similarity")


def least_alike(left: tuple[np.ndarray, pa.Array], right: tuple[np.ndarray, pa.Array] | None, columns: int = 2048) -> int | None:
    """The smallest Jaccard similarity, in whole hundredths, of a set (size, s) of ``left`` with one of ``right``, or of two of ``left``; none without a pair.

    Tokens of two sets or more are columns of ones and zeros; a few columns at a time, products count what sets have in common.
    """
    sizes = np.concatenate([side[0] for side in (left, right) if side]).astype(np.int64)
    unpacked = [unpack(side[1]) for side in (left, right) if side]
    own = np.repeat(np.arange(len(sizes)), np.concatenate([k for _, k in unpacked]))
    tokens, column, many = np.unique(np.concatenate([x for x, _ in unpacked]), return_inverse=True, return_counts=True)
    place = np.cumsum(many > 1) - 1
    own, column = own[many[column] > 1], place[column[many[column] > 1]]
    order = np.argsort(column, kind="stable")
    own, column = own[order], column[order]
    m = len(left[0])
    common = np.zeros((m, len(sizes) - m if right else m), np.float32)
    for at in range(0, int(column.max(initial=-1)) + 1, columns):
        i, j = np.searchsorted(column, (at, at + columns))
        ones = np.zeros((len(sizes), int(column[j - 1]) - at + 1), np.float32)
        ones[own[i:j], column[i:j] - at] = 1
        common += ones[:m] @ (ones[m:] if right else ones).T
    common = common.astype(np.int64)
    alike = 100 * common // (sizes[:m, None] + (sizes[None, m:] if right else sizes) - common)
    alike = alike if right else alike[np.triu_indices(m, 1)]
    return int(alike.min()) if alike.size else None


def set_spread(members: DataFrame) -> DataFrame:
    """(root, spread) of the clusters of two classes (root bigint, class, size, s) or more: the smallest similarity of a pair, in whole hundredths.

    As by spread, but cells of blocks of SET_BLOCK classes give a number each, and no pair is a row.
    """
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
    rows = join_groups(members.select("root", "class", "size", "s"), sizes, "root", "n", F.col("class")).filter("n IS NOT NULL")
    blocks = F.ceil(F.col("n") / SET_BLOCK).cast("bigint")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("class"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    rows = rows.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "size", "s")

    def run(key, table):
        root, i, j = (k.as_py() for k in key)
        sides = []
        for block in (i, j)[: 1 + (i < j)]:
            side = table.filter(pc.equal(table.column("own"), block))
            sides.append((side.column("size").to_numpy(), pa.chunked_array(side.column("s").chunks, pa.binary()).combine_chunks()))
        return pa.table({"root": pa.array([root], pa.int64()), "spread": pa.array([least_alike(sides[0], sides[1] if i < j else None)], pa.int64())})

    return rows.groupBy("root", "i", "j").applyInArrow(run, "root bigint, spread bigint").groupBy("root").agg(F.min("spread").alias("spread"))


def spread(clusters: DataFrame, values: DataFrame, measure, pick) -> DataFrame:
    """Per cluster of (node, root), ``pick`` (F.max or F.min) of ``measure`` over its pairs of classes.

    Single links make clusters whose ends were never compared, so all pairs of a
    cluster's classes count. A cluster is cut into blocks of about SPREAD_BLOCK classes, and each pair of
    blocks is a cell of its own; pairs are streamed into partial aggregates, never gathered.
    """
    rows = clusters.join(values, clusters["node"] == values["rep"]).drop("rep")
    sizes = clusters.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / SPREAD_BLOCK).alias("_blocks"))
    rows = rows.join(sizes, "root").withColumn("_own", F.pmod(F.xxhash64("node"), F.col("_blocks")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
    rows = rows.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other"))
    x, y = rows.alias("x"), rows.alias("y")
    cell = (F.col("x.root") == F.col("y.root")) & (F.col("x._i") == F.col("y._i")) & (F.col("x._j") == F.col("y._j"))
    once = (F.col("x._i") == F.col("x._j")) | (F.col("x._own") != F.col("y._own"))
    pairs = x.join(y, cell & once & (F.col("x.node") < F.col("y.node")))
    return pairs.groupBy(F.col("x.root").alias("root")).agg(pick(measure).alias("spread"))
