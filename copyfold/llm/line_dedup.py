"""Dropping lines that other documents hold already, with DataFrame functions only.

Each line that is long enough becomes a 128-bit hash with its document and position. Hashes are dealt to ranges
and sorted by hash, document and position; a window streams over them, and the first document of a hash
is the one that keeps it. What goes back to the texts is no text: a bitmap for each document that loses lines.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyfold.llm.common import HOT_FLOOR, HOT_GROUPS, checkpointed

#: Fewest code points of a line's key that can be dropped.
LEAST = 10
#: Buckets of hashes in which lines are counted to find the hot ones.
BUCKETS = 1 << 16
#: Stripped at both ends of a line.
SPACES = " \t\n\x0b\x0c\r"


def folded(text: Column) -> Column:
    """``text`` with A-Z in lower case and all else as it is."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def _row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that name a document's row: rows with the same id and text share them, and the fate of their lines."""
    return F.xxhash64(doc_id, text), F.xxhash64(F.lit(1), text, doc_id)


def line_keys(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(h, g, doc, r, q, pos) of the lines of ``docs`` (doc_id, text) whose key has ``least`` code points or more: the key's hash, the document's id, the row's key, the line's place."""
    text = F.coalesce("text", F.lit(""))
    r, q = _row_key(F.col("doc_id"), text)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc"), r.alias("r"), q.alias("q"), F.posexplode(F.split(folded(text), "\n")).alias("pos", "line"))
    rows = rows.select("doc", "r", "q", "pos", F.btrim("line", F.lit(SPACES)).alias("key")).filter(F.char_length("key") >= least)
    return rows.select(F.xxhash64("key").alias("h"), F.xxhash64(F.lit(1), "key").alias("g"), "doc", "r", "q", "pos")


def _first_doc() -> Column:
    """The smallest id of a group's rows; rows without id come last."""
    return F.struct(F.min("doc").alias("doc"))


def hot_keys(lines: DataFrame, total: int) -> DataFrame:
    """(h, g, first) of the keys that more than one in HOT_GROUPS of all lines have; there are fewer than HOT_GROUPS of them.

    Lines are counted by bucket first, and by key only in the buckets that are hot themselves.
    """
    least = max(HOT_FLOOR, total // HOT_GROUPS)
    bucket = F.pmod("h", F.lit(BUCKETS))
    buckets = lines.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least).select("_bucket")
    inside = lines.withColumn("_bucket", bucket).join(F.broadcast(buckets), "_bucket", "left_semi")
    return inside.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), _first_doc().alias("first")).filter(F.col("n") > least).drop("n")


def dropped_lines(lines: DataFrame) -> DataFrame:
    """(r, q, pos) of the ``lines`` that another document with a smaller id holds; rows without id are one document behind all others.

    A hot key's first document is known from the count, so its lines need no stream and stay where they are. All
    others are dealt to ranges of their hashes and sorted by document and position within.
    """
    total = lines.count()
    first = F.col("first.doc")
    if total > HOT_FLOOR:
        marked = lines.join(F.broadcast(checkpointed(hot_keys(lines, total))), ["h", "g"], "left")
        hot = marked.filter(F.col("first").isNotNull() & ~F.col("doc").eqNullSafe(first)).select("r", "q", "pos")
        cold = marked.filter(F.col("first").isNull()).drop("first")
    else:
        hot, cold = None, lines
    ranges = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = Window.partitionBy("h", "g").orderBy(F.col("doc").asc_nulls_last(), "r", "q", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = cold.repartitionByRange(ranges, "h", "g").withColumn("first", F.first(F.struct("doc")).over(stream))
    found = ranged.filter(~F.col("doc").eqNullSafe(first)).select("r", "q", "pos")
    return found if hot is None else found.unionByName(hot)


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """Per row key of ``dropped`` (r, q, pos): n_dropped and keep, a bitmap of 64 lines a word.

    keep is compressed: an entry stands for ``full`` words without a dropped line and one word, ``bits``, with a bit for each line that stays.
    What follows the last entry stays. The same line named twice counts once.
    """
    word = F.shiftright("pos", 6).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("pos").bitwiseAND(F.lit(63)).cast("int"))
    words = dropped.groupBy("r", "q", word.alias("word")).agg(F.bit_or(bit).alias("gone"))
    rows = words.groupBy("r", "q").agg(F.sum(F.bit_count("gone")).cast("bigint").alias("n_dropped"), F.sort_array(F.collect_list(F.struct("word", "gone"))).alias("words"))

    def entry(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get("words", i - 1)["word"], F.lit(-1))
        return F.struct((x["word"] - before - 1).cast("int").alias("full"), F.bitwise_not(x["gone"]).alias("bits"))

    return rows.select("r", "q", "n_dropped", F.transform("words", entry).alias("keep"))


def line_keeps(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """keep_bitmaps of ``docs`` (doc_id, text): which lines each document keeps; documents that keep all have no row.

    The lines' hashes are written to the shared folder, so texts are split once for counting, dealing and sorting.
    """
    return keep_bitmaps(dropped_lines(checkpointed(line_keys(docs, least))))


def drop_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` (doc_id, text) with the lines taken out that a document with a smaller id holds; adds n_lines, n_dropped and keep.

    Lines are compared by their keys: stripped of white space at both ends, A-Z in lower case. Keys of fewer than
    ``least`` code points are left alone. A document with a key's smallest id keeps all its lines of that key. Rows that
    share a doc_id are one document, and so are all rows without one, which come behind all others. A null text reads as
    empty, which is one empty line, and stays null; a text without a dropped line is returned as it is. Repeated rows each get
    their row. Texts of any length and number of lines do no harm. An empty table gives no rows. Columns of ``docs``
    that clash with the new ones are replaced.
    """
    text = F.coalesce("text", F.lit(""))
    r, q = _row_key(F.col("doc_id"), text)
    keeps = line_keeps(docs, least)
    # one word for each 64 lines, so that a line's bit is found at once
    words = F.flatten(F.transform("keep", lambda e: F.concat(F.array_repeat(F.lit(-1).cast("bigint"), e["full"]), F.array(e["bits"]))))
    keeps = keeps.select("r", "q", F.struct("n_dropped", "keep", words.alias("words")).alias("_k"))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "keep")]
    rows = docs.select(F.struct(*own).alias("row"), r.alias("r"), q.alias("q")).join(keeps, ["r", "q"], "left")

    def stays(_: Column, i: Column) -> Column:
        of_line = F.coalesce(F.get(F.col("_k.words"), F.shiftright(i, 6)), F.lit(-1).cast("bigint"))
        return F.getbit(of_line, i.bitwiseAND(F.lit(63))) == 1

    text = F.coalesce("row.text", F.lit(""))
    kept = F.when(F.col("_k").isNull(), F.col("row.text")).otherwise(F.array_join(F.filter(F.split(text, "\n"), stays), "\n"))
    n_lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")
    columns = [kept.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in own]
    return rows.select(*columns, n_lines.alias("n_lines"), F.coalesce("_k.n_dropped", F.lit(0).cast("bigint")).alias("n_dropped"), F.col("_k.keep").alias("keep"))
