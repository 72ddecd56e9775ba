"""Sharding by jump consistent hashing, with DataFrame functions only.

The generator of the published algorithm steps a 64-bit state by
``state * 2862933555777941757 + 1`` modulo 2^64. ANSI arithmetic has no such
product, so the state is kept as two 32-bit halves and multiplied by 16-bit parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyfold.llm.common import checkpointed

#: Fixed values of the published algorithm.
MULTIPLIER = 2862933555777941757
#: Repeated rows are told apart in runs of so many.
RUN = 1 << 16

_LOW32, _LOW16 = 0xFFFFFFFF, 0xFFFF


def _low_product(x: Column, factor: int) -> Column:
    """x * factor modulo 2^32, both below 2^32."""
    low, high = x.bitwiseAND(F.lit(_LOW16)), F.shiftright(x, 16)
    return (low * F.lit(factor) + F.shiftleft((high * F.lit(factor)).bitwiseAND(F.lit(_LOW16)), 16)).bitwiseAND(F.lit(_LOW32))


def _step(state: Column) -> tuple[Column, Column]:
    """The halves of the next state."""
    low, high = state["low"], state["high"]
    factor_low, factor_high = MULTIPLIER & _LOW32, MULTIPLIER >> 32
    first = low.bitwiseAND(F.lit(_LOW16)) * F.lit(factor_low) + F.lit(1)
    second = F.shiftright(low, 16) * F.lit(factor_low)
    total = first + F.shiftleft(second.bitwiseAND(F.lit(_LOW16)), 16)
    carried = F.shiftright(total, 32) + F.shiftright(second, 16) + _low_product(low, factor_high) + _low_product(high, factor_low)
    return total.bitwiseAND(F.lit(_LOW32)), carried.bitwiseAND(F.lit(_LOW32))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0, of a bigint key among ``shards``; a null key counts as 0.

    Each jump leads at least one shard on, so ``shards`` steps end every walk;
    a walk that is over stands still.
    """
    key = F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint"))
    start = F.struct(
        key.bitwiseAND(F.lit(_LOW32)).alias("low"),
        F.shiftrightunsigned(key, 32).alias("high"),
        F.lit(-1).cast("bigint").alias("at"),
        F.lit(0).cast("bigint").alias("next"),
    )

    def jump(state: Column, _: Column) -> Column:
        low, high = _step(state)
        ahead = (state["next"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(high, 1) + 1).cast("double"))
        moved = F.struct(low.alias("low"), high.alias("high"), state["next"].alias("at"), F.floor(ahead).cast("bigint").alias("next"))
        return F.when(state["next"] < shards, moved).otherwise(state)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, jump, lambda state: state["at"]).cast("int")


def with_shard(rows: DataFrame, key: str, shards: int, name: str = "shard") -> DataFrame:
    """``rows`` with the shard of their ``key`` in a further column."""
    return rows.withColumn(name, jump_hash(F.col(key), shards))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Place every row of ``docs`` (doc_id, text) into shards 0 to ``shards`` - 1 by its doc_id.

    Returns doc_id, size, text_crc32, law ('key'), shard, slot, grown_shard. size
    is the text's UTF-8 bytes plus 8 (null: 8; its CRC is that of no bytes, 0).
    Slots count from 0 without gaps in each shard, by doc_id (null first), size
    and CRC. grown_shard is the shard among one more. Rows that are alike in
    all three get slots in a row; they are counted before the shuffle and told apart
    after it, so any number of them costs no task more than RUN rows at once.

    Ids are dealt to ranges of about equal numbers of rows, however they lie; slots are
    counted within a range and shard, after the rows of the ranges before. A null text has no bytes; texts
    of any length do no harm. An empty table gives no rows. Further columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    alike = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    alike = alike.withColumn("shard", jump_hash(F.col("doc_id"), shards))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), "size", "text_crc32"]
    alike = checkpointed(alike.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()))
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = alike.groupBy("shard", "range").agg(F.sum("n").alias("rows"))
    starts = starts.select("shard", "range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("range_start"))
    within = Window.partitionBy("shard", "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = alike.withColumn("start", F.coalesce(F.sum("n").over(within), F.lit(0)))
    placed = placed.join(starts, ["shard", "range"]).withColumn("start", F.col("start") + F.col("range_start"))
    runs = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(RUN).cast("bigint"))))
    each = runs.withColumn("i", F.explode(F.sequence(F.col("run"), F.least(F.col("run") + RUN, F.col("n")) - 1)))
    return each.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("i")).alias("slot"),
        jump_hash(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
