"""Joins that no group, however large, brings into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fewer rows than this never make a group hot.
HOT_FLOOR = 200
#: At most this many groups can each hold more than 1/HOT_GROUPS of all rows.
HOT_GROUPS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, spread: Column, total: int | None = None) -> DataFrame:
    """Give each row the columns of its group, however uneven the groups are; null where it has none.

    ``key`` (string, binary or bigint, not null) is unique in ``groups``, where ``size`` counts the
    rows that have it; ``total`` is their sum, if it is known. The groups that hold over 1/HOT_GROUPS of all rows are
    fewer than HOT_GROUPS whatever the data, so they are broadcast; their rows
    carry keys of their own, dealt by ``spread``, through the shuffle join that serves the rest.
    """
    if total is None:
        total = groups.agg(F.sum(size)).head()[0] or 0
    is_hot = F.col(size) > max(HOT_FLOOR, total // HOT_GROUPS)
    rest = [c for c in groups.columns if c != key]
    kind = dict(rows.dtypes)[key]
    lane = F.xxhash64(spread) if kind == "bigint" else F.concat(F.lit("#").cast(kind), F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("string").cast(kind))
    if total > HOT_FLOOR:
        hot = groups.filter(is_hot).select(key, F.struct(*rest).alias("__hot"))
        cold = groups.filter(~is_hot).select(F.col(key).alias("__key"), F.struct(*rest).alias("__cold"))
        out = rows.join(F.broadcast(hot), key, "left")
        out = out.withColumn("__key", F.when(F.col("__hot").isNull(), F.col(key)).otherwise(lane))
        # a lane's key may be a group's by chance, so what is hot counts first
        out = out.join(cold, "__key", "left").withColumn("__g", F.coalesce("__hot", "__cold"))
    else:
        out = rows.join(groups.select(F.col(key).alias("__key"), F.struct(*rest).alias("__g")), F.col(key) == F.col("__key"), "left")
    return out.select(*rows.columns, *[F.col(f"__g.{c}").alias(c) for c in rest])
