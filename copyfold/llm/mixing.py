"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

A source's target is min(cap, level * weight); the one level at which all
targets add up to what is asked for is what clamping sources at their cap and
sharing the excess among the others by weight comes to. The whole part of
target / size repeats each document; the rest is a seeded sample: documents in
the order of a hash of seed, doc_id and text, until the words are met. Documents that are alike
in all of these are counted and taken one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyfold.llm.common import checkpointed, single_spaces

#: Production parameters.
WEIGHTS, SHARE, MAX_EPOCHS, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 11
#: Bits of a document's hash, and of its part by which documents are first summed.
HASH_BITS, BUCKET_BITS = 60, 12
#: Up to so many sources are broadcast; more are joined by shuffling.
BROADCAST_SOURCES = 50_000
#: Ways into which the rows of a source are dealt for that shuffle.
LANES = 64


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text; null: 0."""
    words = F.trim(single_spaces(text))
    gaps = F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit("")))
    return F.when(words == "", F.lit(0)).otherwise(gaps + 1).cast("bigint")


def text_mark(text: Column) -> Column:
    """A digest of a text; null: that of the empty one."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def ticket(seed: int) -> Column:
    """A document's place in the sampling order, from 0 to 2^60 - 1, by its doc_id and mark."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("mark"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("bigint")


def water_fill(sources: DataFrame, total: Column, max_epochs: float) -> DataFrame:
    """Add ``target`` to rows of (source, weight, source_size): level * weight, at most max_epochs * source_size, in sum ``total``.

    Sources are taken from the first to reach its cap. A source is capped when
    the level that those from it on would share, were it and they alone uncapped, reaches it.
    """
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    by_cap = Window.orderBy(F.col("full_at"), F.col("source").asc_nulls_last())
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    done = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rows = sources.withColumn("cap", cap).withColumn("full_at", F.col("cap") / F.col("weight"))
    rows = rows.withColumn("level", (total - F.coalesce(F.sum("cap").over(done), F.lit(0.0))) / F.sum("weight").over(onward))
    open_level = F.min(F.when(F.col("level") < F.col("full_at"), F.struct("full_at", "level"))).over(Window.partitionBy())["level"]
    rows = rows.withColumn("target", F.least(F.col("cap"), F.coalesce(open_level * F.col("weight"), F.col("cap"))))
    return rows.drop("cap", "full_at", "level")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Per source of ``sizes`` (source, size): source_size, target, whole (repetitions) and part (words of the sample).

    Sources by code point, null last, take the weights in turn. One row for each
    source goes through one task, which orders them; the documents don't.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int"))
    total = F.lit(float(share)) * F.sum("source_size").over(Window.partitionBy())
    rows = water_fill(sources.withColumn("weight", weight).withColumn("asked", total), F.col("asked"), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    return rows.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))


def sample_ends(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source: last_ticket and last_size of the last rows that are in its sample as a whole (-1: none), and edge_ticket, edge_size and edge_rows of those of which only some are.

    A row is in the sample if its words end nearer to the part asked for than
    they begin. ``sizes`` counts in n the rows of each source, ticket and size, which are alike; words are summed
    by bucket of tickets, and only the bucket in which a part ends is gone through by ticket.
    """
    tickets = sizes.withColumn("words", F.col("size") * F.col("n")).withColumn("bucket", F.shiftright("ticket", HASH_BITS - BUCKET_BITS))
    buckets = tickets.groupBy("source", "bucket").agg(F.sum("words").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    small = sources.select(F.col("source").alias("_source"), "part")
    ends = buckets.join(small, F.col("source").eqNullSafe(F.col("_source"))).filter("start < part AND part <= start + words")
    ends = ends.select("_source", F.col("bucket").alias("_bucket"), "start", "part")
    inside = tickets.join(ends, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    before = Window.partitionBy("source").orderBy("ticket", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("start", F.col("start") + F.coalesce(F.sum("words").over(before), F.lit(0)))
    part, start, size = 2 * F.col("part"), F.col("start"), F.col("size")
    fits = lambda k: 2 * start + (2 * k + 1) * size <= part  # noqa: E731  the row k, from 0, of those alike
    guess = F.greatest(F.lit(0), F.least(F.col("n"), F.floor((part - 2 * start + size) / F.nullif(2 * size, F.lit(0)))))
    near = F.when(fits(guess), guess + 1).when((guess > 0) & ~fits(guess - 1), guess - 1).otherwise(guess)
    inside = inside.withColumn("_in", F.when(size == 0, F.when(fits(F.lit(0)), F.col("n")).otherwise(0)).otherwise(F.least(F.col("n"), near)).cast("bigint"))
    lowest = F.shiftleft(F.min("bucket"), HASH_BITS - BUCKET_BITS) - 1
    last = F.coalesce(F.max(F.when(F.col("_in") == F.col("n"), F.struct("ticket", "size"))), F.struct(lowest.alias("ticket"), F.lit(0).cast("bigint").alias("size")))
    edge = F.max(F.when((F.col("_in") > 0) & (F.col("_in") < F.col("n")), F.struct("ticket", "size", "_in")))
    found = inside.groupBy("source").agg(last.alias("last"), edge.alias("edge"))
    found = found.select(F.col("source").alias("_source"), F.col("last.ticket").alias("last_ticket"), F.col("last.size").alias("last_size"), F.col("edge.ticket").alias("edge_ticket"), F.col("edge.size").alias("edge_size"), F.col("edge._in").alias("edge_rows"))
    out = sources.join(found, F.col("source").eqNullSafe(F.col("_source")), "left")
    return out.drop("_source").withColumn("last_ticket", F.coalesce("last_ticket", F.lit(-1)).cast("bigint")).withColumn("last_size", F.coalesce("last_size", F.lit(0)).cast("bigint"))


def numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with place: their number, from 0, among those of their source.

    Rows are counted within the part of the table in which they stand, after the rows of the parts before, so however many
    a source has, a task orders those of one part.
    """
    rows = checkpointed(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.select(F.col("source").alias("_source"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = rows.withColumn("_k", F.row_number().over(Window.partitionBy("source", "_part").orderBy("_at")) - 1)
    out = within.join(parts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_part") == F.col("_p")))
    return out.withColumn("place", F.col("_start") + F.col("_k")).drop("_part", "_at", "_source", "_p", "_start", "_k")


def join_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Give each row the columns of its source.

    The sources are broadcast up to BROADCAST_SOURCES of them; beyond that each
    is copied to LANES lanes, over which its rows are dealt, and both sides are shuffled.
    """
    sources = sources.withColumnRenamed("source", "_source")
    same = F.col("source").eqNullSafe(F.col("_source"))
    if len(sources.select("_source").take(BROADCAST_SOURCES + 1)) <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(sources), same).drop("_source")
    lanes = sources.withColumn("_lane_", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
    dealt = rows.withColumn("_lane", F.pmod(F.col("ticket"), F.lit(LANES)).cast("int"))
    return dealt.join(lanes, same & (F.col("_lane") == F.col("_lane_"))).drop("_source", "_lane", "_lane_")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source) with size, source_size, target, and copies: how often the mix takes each row.

    Rows that share source, doc_id and text have one ticket; where the sample ends among them, as many of them as fit are
    in it, whichever these are. Rows without doc_id are told apart by their texts. A null or empty text has size 0; a source
    without words gets target 0. An empty table gives no rows. Columns of
    ``docs`` that clash with the new ones are replaced.
    """
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), text_mark(F.col("text")).alias("mark"), F.struct(*own).alias("row"))
    return mix_sized(rows, weights, share, max_epochs, seed).select("row.*", "size", "source_size", "target", "copies")


def mix_sized(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``rows`` (doc_id, source, size, mark) with ticket, source_size, target and copies; see mix."""
    rows = rows.withColumn("ticket", ticket(seed))
    sizes = checkpointed(rows.groupBy("source", "ticket", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = checkpointed(source_targets(sizes.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, max_epochs))
    sources = checkpointed(sample_ends(sizes, sources).drop("weight", "asked", "part"))
    out = join_sources(rows, sources)
    own = [*rows.columns, "source_size", "target"]
    below = (F.col("ticket") < F.col("last_ticket")) | ((F.col("ticket") == F.col("last_ticket")) & (F.col("size") <= F.col("last_size")))
    whole = out.select(*own, (F.col("whole") + below.cast("bigint")).alias("copies"), "whole", "edge_rows", ((F.col("ticket") == F.col("edge_ticket")) & (F.col("size") == F.col("edge_size"))).alias("_edge"))
    if sources.filter("edge_rows IS NOT NULL").isEmpty():
        return whole.select(*own, "copies")
    edge = numbered(whole.filter("_edge"))
    edge = edge.select(*own, (F.col("whole") + (F.col("place") < F.col("edge_rows")).cast("bigint")).alias("copies"))
    return whole.filter("_edge IS NULL OR NOT _edge").select(*own, "copies").unionByName(edge)


def mixed_rows(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: each row of ``docs``, with all columns, as often as it is taken."""
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), text_mark(F.col("text")).alias("mark"), F.struct(*docs.columns).alias("row"))
    out = mix_sized(rows, **parameters).filter("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select("row.*")
