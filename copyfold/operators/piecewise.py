"""Groups of files by piecewise digests: only digests that have seven letters in a row in common are compared.

The comparison of two digests is 0 unless strings of one block size share seven letters in a row, so these, with
the block size, are the tokens of an equi-join that misses no pair. Members of a token are compared with its first one; where that
leaves a token's members in several components, members of different components are compared in cells of two blocks.
Pairs within a component are never spelled out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyfold.checkpoints import checkpointed, row_count
from copyfold.functions import ctph
from copyfold.operators.components import connected_components
from copyfold.operators.packed import blob, unblob
from copyfold.skew import join_groups

#: Members of a token that are compared in one block.
BLOCK = 512
#: Classes for each task that joins tokens; a class has at most 84.
PART_CLASSES = 50_000
#: A token is the letters, six bits each, below the exponent of its block size.
_TOKEN_BITS = 6 * ctph.COMMON
_SIX = np.zeros(256, np.int64)
_SIX[list(ctph.LETTERS.encode())] = np.arange(64)


def _shortened(letters):
    return F.regexp_replace(letters, rf"(.)\1{{{ctph.ALIKE},}}", "$1" * ctph.ALIKE)


def piecewise_classes(digests: DataFrame) -> DataFrame:
    """(node, class, rep, rows, block, x, y) of the digests (path, digest) that read alike when compared: node is a number, rep the smallest path, x and y the strings of the block size and of its double."""
    part = F.split("digest", ":")
    keyed = digests.select("path", part[0].cast("bigint").alias("block"), _shortened(part[1]).alias("x"), _shortened(part[2]).alias("y"))
    keyed = keyed.withColumn("class", F.concat_ws(":", "block", "x", "y"))
    classes = keyed.groupBy("class", "block", "x", "y").agg(F.min("path").alias("rep"), F.count(F.lit(1)).alias("rows"))
    return checkpointed(classes.withColumn("node", F.monotonically_increasing_id()))


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(token, node): the runs of seven letters of both strings of each class (node, block, x, y), with their block sizes, as exact numbers; each once or more."""
    nodes, blocks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    strings = batch.column(2).to_pylist() + batch.column(3).to_pylist()
    lengths = np.array([len(x) for x in strings], np.int64)
    own = np.repeat(np.arange(len(strings)), lengths)
    six = _SIX[np.frombuffer("".join(strings).encode(), np.uint8)]
    n = max(len(six) - ctph.COMMON + 1, 0)
    run = sum(six[j : j + n] << 6 * (ctph.COMMON - 1 - j) for j in range(ctph.COMMON))
    whole = own[:n] == own[len(own) - n :]
    exponent = np.bitwise_count(blocks // ctph.LEAST_BLOCK - 1).astype(np.int64)
    exponent = np.concatenate([exponent, exponent + 1])
    own = own[:n][whole]
    return run[whole] | exponent[own] << _TOKEN_BITS, np.concatenate([nodes, nodes])[own]


def shared_tokens(classes: DataFrame) -> DataFrame:
    """(token, node, first) of the tokens that two classes or more have; first is the least of these.

    Tokens are dealt to lanes once, packed: a row has those of a batch of classes in one lane. Most are of one class alone and go no further.
    """
    spark = classes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, -(-row_count(classes) // PART_CLASSES))
    lanes = 4 * parts

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, node = _tokens(batch)
            lane = ((token.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % lanes
            order = np.lexsort((node, token, lane))
            token, node, lane = token[order], node[order], lane[order]
            new = (np.diff(token, prepend=-1) != 0) | (np.diff(node, prepend=-1) != 0)
            token, node, lane = token[new], node[new], lane[new]
            ends = np.searchsorted(lane, np.arange(lanes + 1)).tolist()
            found = [k for k in range(lanes) if ends[k] < ends[k + 1]]
            packed = [blob(token=pa.array(np.diff(token[ends[k] : ends[k + 1]], prepend=0)), node=pa.array(node[ends[k] : ends[k + 1]])) for k in found]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(packed, pa.binary())], names=["lane", "tokens"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, tokens) for batch in batches for k, tokens in zip(batch.column(0).to_pylist(), batch.column(1)))
        for _, own in itertools.groupby(rows, lambda row: row[0]):
            lots = [unblob(tokens.as_py()) for _, tokens in own]
            token = np.concatenate([np.cumsum(lot.column(0).to_numpy()) for lot in lots])
            node = np.concatenate([lot.column(1).to_numpy() for lot in lots])
            order = np.lexsort((node, token))
            token, node = token[order], node[order]
            starts = np.flatnonzero(np.diff(token, prepend=-1))
            many = np.diff(np.append(starts, len(token)))
            first, kept = np.repeat(node[starts], many), np.repeat(many > 1, many)
            for at in range(0, len(token), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(v[part][kept[part]]) for v in (token, node, first)], names=["token", "node", "first"])

    dealt = classes.select("node", "block", "x", "y").mapInArrow(deal, "lane int, tokens binary")
    return dealt.repartition(parts, "lane").sortWithinPartitions("lane").mapInArrow(meet, "token bigint, node bigint, first bigint")


def _alike(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """The links (a, b) among ``pairs`` (a, b, k), of classes that share a token of block exponent k, that are ``least`` alike or more."""
    small = classes.select("node", "block", "x", "y")
    both = pairs.join(small.select(F.col("node").alias("a"), F.col("block").alias("_p"), F.col("x").alias("_x"), F.col("y").alias("_y")), "a")
    both = both.join(small.select(F.col("node").alias("b"), F.col("block").alias("_q"), F.col("x").alias("_u"), F.col("y").alias("_v")), "b")
    size = F.call_function("shiftleft", F.lit(ctph.LEAST_BLOCK).cast("bigint"), F.col("k").cast("int"))
    both = both.select("a", "b", size.alias("size"), F.when(F.col("_p") == size, F.col("_x")).otherwise(F.col("_y")).alias("left"), F.when(F.col("_q") == size, F.col("_u")).otherwise(F.col("_v")).alias("right"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = ctph.scores(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(2).to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(score >= least))

    return both.mapInArrow(run, "a bigint, b bigint")


def piecewise_components(classes: DataFrame, distance: int) -> DataFrame:
    """(node, root) of the ``classes`` that link to others: 100 minus how alike they are is at most ``distance``."""
    least = 100 - distance
    if least < 1:
        raise ValueError("a distance of 100 links everything")
    each = checkpointed(shared_tokens(classes))
    exponent = F.shiftright("token", _TOKEN_BITS).cast("int").alias("k")
    stars = each.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"), exponent).distinct()
    links = checkpointed(_alike(stars, classes, least))
    known = connected_components(links)
    placed = each.select("token", "node").join(known, "node", "left").select("token", "node", F.coalesce("root", "node").alias("root"))
    placed = checkpointed(placed)
    split = placed.groupBy("token").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count(F.lit(1)).alias("n")).filter("_low <> _high")
    apart = join_groups(placed, split.select("token", "n"), "token", "n", F.col("node")).filter("n IS NOT NULL")
    blocks = F.ceil(F.col("n") / BLOCK).cast("bigint")
    cells = apart.withColumn("_own", F.pmod(F.xxhash64("node"), blocks)).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    cells = cells.select("token", "node", "root", "_own", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"))
    x, y = cells.alias("x"), cells.alias("y")
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    once = (F.col("x.i") == F.col("x.j")) | (F.col("x._own") != F.col("y._own"))
    met = x.join(y, same & once & (F.col("x.root") != F.col("y.root")) & (F.col("x.node") < F.col("y.node")))
    met = met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.shiftright("x.token", _TOKEN_BITS).cast("int").alias("k")).distinct()
    more = checkpointed(_alike(met, classes, least))
    return known if more.isEmpty() else connected_components(links.unionByName(more))


def piecewise_clusters(digests: DataFrame, distance: int = 80) -> DataFrame:
    """(path, group_id) of the digests (path, digest) in groups of two files or more; group_id is the smallest path of a group.

    Digests that read alike are one class at distance 0, however short they are.
    """
    classes = piecewise_classes(digests)
    found = classes.select("node", "class", "rep", "rows").join(piecewise_components(classes, distance), "node", "left")
    found = checkpointed(found.withColumn("root", F.coalesce("root", "node")))
    groups = found.groupBy("root").agg(F.min("rep").alias("group_id"), F.sum("rows").alias("files"), F.count(F.lit(1)).alias("n")).filter("files >= 2").drop("files")
    known = join_groups(found.select("class", "rows", "root"), groups, "root", "n", F.col("class")).filter("group_id IS NOT NULL").select("class", "rows", "group_id")
    part = F.split("digest", ":")
    keyed = digests.select("path", F.concat_ws(":", part[0], _shortened(part[1]), _shortened(part[2])).alias("class"))
    return join_groups(keyed, checkpointed(known), "class", "rows", F.col("path")).filter("group_id IS NOT NULL").select("path", "group_id")
