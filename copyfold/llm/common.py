"""What several operators of this subpackage share."""

from __future__ import annotations

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyfold.checkpoints import checkpointed, shared_folder  # noqa: F401
from copyfold.skew import HOT_FLOOR, HOT_GROUPS, join_groups  # noqa: F401

def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def single_spaces(text: Column) -> Column:
    """A text with each run of [\\x20\\x09-\\x0D] as one space; null: empty.

    Most texts have no such runs once tabs and line ends are spaces, so only the others go through a pattern.
    """
    out = F.coalesce(text, F.lit(""))
    for space in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(space), F.lit(" "))
    return F.when(F.contains(out, F.lit("  ")), F.regexp_replace(out, " {2,}", " ")).otherwise(out)


def lane_keys(spark, n: int) -> list[int]:
    """``n`` integers that a shuffle by their hash into ``n`` partitions puts into as many different ones, by partition."""
    tried = n * (n.bit_length() + 10)
    found: dict[int, int] = {}
    while len(found) < n:
        rows = spark.range(0, tried, numPartitions=1).select(F.col("id").cast("int").alias("key"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("part")).groupBy("part").agg(F.min("key").alias("key"))
        found = {r["part"]: r["key"] for r in rows.collect()}
        tried *= 2
    return [found[i] for i in range(n)]


def broadcast_object(spark, value):
    """A function that returns ``value`` on any executor; its class travels with it. For objects of a bounded size."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(packed.value)


#: The bytes of [\x20\x09-\x0D].
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_CODE_LOWER = _BYTE_CODE.copy()
_BYTE_CODE_LOWER[65:91] = _BYTE_CODE[97:123]
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2^64, at least ``n`` of each."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes, lower: bool = True, mark: np.ndarray = IS_SPACE) -> np.ndarray:
    """64-bit hashes of the words of ``text``: the runs of bytes that ``mark`` doesn't name.

    A word's hash depends on its bytes alone (A-Z folded when ``lower``): a
    polynomial over random byte codes, cut out of one running sum.
    """
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~mark[data]
    steps = np.diff(inside)
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    powers, inverses = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_CODE_LOWER if lower else _BYTE_CODE)[data] * powers[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))


def fold_words(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` consecutive words; of the whole sequence, if it is shorter."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - n + 1 + i])
    return out
