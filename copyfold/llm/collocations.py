"""Collocations: phrases that stand together more often than their parts, mined length by length.

Pass k counts the phrases of k words exactly and, in the same reading, those of k + 1 words by hash bucket (PCY, and
from the second pass on DHP: only such phrases as can still be frequent). Between passes the driver holds two bitmaps of fixed sizes and
broadcasts them: buckets that reach the least count, and hashes of the frequent phrases of k words (Apriori). The
next pass counts a phrase exactly if both its parts of one word less and its bucket are set. Bitmaps only leave out
what can't be frequent; what is counted is counted by its whole text, so the result doesn't depend on hashes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from copyfold.llm.common import broadcast_object, checkpointed, join_groups, mix64, shared_folder, word_hashes

#: Production parameters: least count of a phrase, most words, phrases returned of each language, percent at which a longer phrase absorbs one.
LEAST, LONGEST, TOP, ABSORBED = 30, 4, 2000, 80
#: Bits of a hash that name its bucket, and its place in the bitmap of frequent phrases: bitmaps of 8 MiB and 2 MiB, whatever the input.
BUCKET_BITS, MEMBER_BITS = 26, 24
#: Buckets that go through the shuffle as one row, of which only the counters in use are sent.
SEGMENT = 1 << 16
#: Bytes of texts that are worked on at once, rows of counts and buckets that a task holds before it hands them on.
CHUNK, ROWS, HELD = 4 << 20, 400_000, 4_000_000
#: Lanes over which a language's phrases are dealt to find its first ones.
LANES = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What a byte is: part of a word, space between words, end of a piece.
_WORD, _SPACE, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 32]] = _SPACE
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_KIND[list(_BREAKS)] = _BREAK
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def chunks(rows: Iterator[tuple[str, bytes]], most: int) -> Iterator[tuple[list[str], list[bytes]]]:
    """``rows`` (lang, text) in lists of about ``most`` bytes; a longer text is cut where a piece ends, so that no phrase is cut."""
    langs, texts, size = [], [], 0
    for lang, text in rows:
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > most:
                cut = max(text.rfind(b, at, at + most) for b in _BREAKS)
                if cut <= at:
                    cut = min((i for b in _BREAKS if (i := text.find(b, at + 1)) >= 0), default=end)
                end = max(cut, at + 1)
            langs.append(lang)
            texts.append(text[at:end])
            size, at = size + end - at, end
            if size >= most:
                yield langs, texts
                langs, texts, size = [], [], 0
    if texts:
        yield langs, texts


class Words:
    """The words of some texts: per word its number ``word`` in ``dictionary``, its language's number, hash and piece."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        kind = _KIND[data]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[1:] = kind == _WORD
        steps = np.diff(inside)
        starts = np.flatnonzero(steps == 1)
        ends = np.flatnonzero(steps == -1)
        self.piece = np.cumsum(kind == _BREAK, dtype=np.int32)[starts]
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=offsets[1:])
        letters = _LOWER[data[kind == _WORD]]
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        self.word, self.dictionary = found.indices.to_numpy(), found.dictionary
        self.langs = list(dict.fromkeys(langs))
        number = {lang: i for i, lang in enumerate(self.langs)}
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        self.lang = np.array([number[lang] for lang in langs], np.int32)[np.searchsorted(text_ends, starts, "right")]
        self.hash = word_hashes(b" ".join(self.dictionary.to_pylist()), lower=False)[self.word] if len(starts) else np.empty(0, np.uint64)
        seeds = np.array([int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big") for lang in self.langs], np.uint64)
        self.phrase_hash = [mix64(self.hash ^ seeds[self.lang]) if len(starts) else self.hash]

    def phrases(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Per place: the hash of the ``k`` words from it on with their language, and whether they stand in one piece."""
        n = max(len(self.word) - k + 1, 0)
        while len(self.phrase_hash) < k:
            j = len(self.phrase_hash)
            m = max(len(self.word) - j, 0)
            self.phrase_hash.append(mix64(self.phrase_hash[-1][:m] * _FOLD + self.hash[j : j + m]))
        return self.phrase_hash[k - 1], self.piece[:n] == self.piece[k - 1 : k - 1 + n]

    def counts(self, at: np.ndarray, k: int) -> pa.Table:
        """(lang, phrase, n) of the phrases of ``k`` words at the places ``at``, each distinct one once."""
        h = self.phrase_hash[k - 1][at]
        order = np.argsort(h)
        at = at[order]
        parts = [self.lang[at], *[self.word[at + j] for j in range(k)]]
        new = np.ones(len(at), bool)
        new[1:] = reduce(np.logical_or, [p[1:] != p[:-1] for p in parts])
        first = np.flatnonzero(new)
        # where hashes of different phrases agree, a phrase comes in several runs; they are summed with the others
        columns = [self.dictionary.take(pa.array(p[first])) for p in parts[1:]]
        phrase = columns[0] if k == 1 else pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary()))
        lang = pa.array(self.langs, pa.string()).take(pa.array(parts[0][first]))
        return pa.table({"lang": lang, "phrase": phrase.cast(pa.binary()), "n": pa.array(np.diff(np.append(first, len(at))))})


def _set(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Is the bit set that the first ``bits`` bits of a hash name."""
    place = h >> np.uint64(64 - bits)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def survivors(words: Words, k: int, members: np.ndarray | None, buckets: np.ndarray | None) -> np.ndarray:
    """Per place: can the ``k`` words from it on be a frequent phrase, by the bitmaps of frequent shorter phrases and of buckets."""
    h, ok = words.phrases(k)
    if members is not None:
        shorter, _ = words.phrases(k - 1)
        known = _set(members, shorter, MEMBER_BITS)
        ok = ok & known[:-1] & known[1:] if len(ok) else ok
    if buckets is not None:
        ok = ok & _set(buckets, h, BUCKET_BITS)
    return ok


_FIELDS = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("n", pa.int64()), ("segment", pa.int32()), ("counts", pa.binary())])
_PASSED = "lang string, phrase binary, n bigint, segment int, counts binary"


def _counted_rows(held: list[pa.Table]) -> list[pa.RecordBatch]:
    """The counts of several chunks, each phrase once, as rows of a pass."""
    rows = pa.concat_tables(held).group_by(["lang", "phrase"]).aggregate([("n", "sum")]).rename_columns(["lang", "phrase", "n"])
    for field in list(_FIELDS)[3:]:
        rows = rows.append_column(field, pa.nulls(rows.num_rows, field.type))
    return rows.select(_FIELDS.names).cast(_FIELDS).combine_chunks().to_batches(max_chunksize=100_000)


def _bucket_rows(places: list[np.ndarray], least: int) -> pa.RecordBatch:
    """The buckets ``places`` as rows of a pass: per segment the steps from one place in use to the next and the counters, which say no more beyond ``least``. Bytes of one kind stand together, as they compress best."""
    place, n = np.unique(np.concatenate(places), return_counts=True)
    n = np.minimum(n, least).astype(np.uint8)
    segments, starts = np.unique(place // SEGMENT, return_index=True)
    steps = np.diff(place, prepend=place[:1])
    steps[starts] = place[starts] % SEGMENT
    low, high = (steps & 255).astype(np.uint8), (steps >> 8).astype(np.uint8)
    packed = [low[i:j].tobytes() + high[i:j].tobytes() + n[i:j].tobytes() for i, j in zip(starts, np.append(starts[1:], len(place)))]
    return pa.RecordBatch.from_arrays([pa.nulls(len(packed), f.type) for f in list(_FIELDS)[:3]] + [pa.array(segments, pa.int32()), pa.array(packed, pa.binary())], schema=_FIELDS)


def _pass(docs: DataFrame, k: int, bitmaps, least: int, ahead: bool) -> DataFrame:
    """Pass ``k`` over ``docs`` (lang, text): rows of counts (lang, phrase, n), and if ``ahead`` of counters of buckets (segment, counts) for the next length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, buckets = bitmaps() if bitmaps else (None, None)
        held: list[pa.Table] = []
        places: list[np.ndarray] = []
        rows = ((lang.as_py(), text.as_py()) for batch in batches for lang, text in zip(*batch.columns))
        for langs, texts in chunks(rows, CHUNK):
            words = Words(langs, texts)
            ok = survivors(words, k, members, buckets)
            held.append(words.counts(np.flatnonzero(ok), k))
            if ahead and len(ok) > 1:
                h, longer = words.phrases(k + 1)
                places.append((h[longer & ok[:-1] & ok[1:]] >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32))
            del words, ok
            if sum(t.num_rows for t in held) > ROWS:
                yield from _counted_rows(held)
                held = []
            if sum(map(len, places)) > HELD:
                yield _bucket_rows(places, least)
                places = []
        if held:
            yield from _counted_rows(held)
        if places:
            yield _bucket_rows(places, least)

    return docs.mapInArrow(run, _PASSED)


def bucket_bitmap(passed: DataFrame, least: int) -> np.ndarray:
    """The bitmap of the buckets whose counters reach ``least`` in sum; each task streams over the counters of its segments."""
    span = min(SEGMENT, 1 << BUCKET_BITS)
    segments = (1 << BUCKET_BITS) // span
    parts = min(segments, int(passed.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, packed in zip(*(c.to_pylist() for c in batch.columns)):
                low, high, n = np.frombuffer(packed, np.uint8).reshape(3, -1)
                place = np.cumsum(low + (high.astype(np.int64) << 8))
                own = sums.setdefault(segment, np.zeros(span, np.uint8))
                own[place] = np.minimum(own[place] + n, least)
        bits = [np.packbits(part >= least, bitorder="little").tobytes() for part in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], names=["segment", "bits"])

    found = passed.filter("segment IS NOT NULL").select("segment", "counts").repartition(parts, "segment").mapInArrow(run, "segment int, bits binary")
    bitmap = np.zeros((segments, span // 8), np.uint8)
    for row in found.toLocalIterator():  # at most one for each segment
        bitmap[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return bitmap.ravel()


def member_bitmap(frequent: DataFrame, k: int) -> np.ndarray:
    """The bitmap of the hashes of ``frequent`` (lang, phrase), phrases of ``k`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = Words(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                h, _ = words.phrases(k)
                yield pa.RecordBatch.from_arrays([pa.array(h[::k].view(np.int64))], names=["h"])

    place = F.shiftrightunsigned("h", 64 - MEMBER_BITS)
    frequent = frequent.select("lang", F.col("phrase").cast("binary")).mapInArrow(run, "h bigint")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = frequent.select(F.shiftright(place, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros((1 << MEMBER_BITS) // 64, np.int64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy()
    return bitmap.view(np.uint8)


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of the phrases of 1 to ``longest`` words of ``docs`` (lang, text) that stand ``least`` times or more in their language; and (lang, n), all words of each."""
    if not 1 <= least <= 127:
        raise ValueError("counters of buckets hold 1 to 127")
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).filter("octet_length(text) > 0")
    found, bitmaps, sizes = [], None, None
    for k in range(1, longest + 1):
        ahead = k < longest
        folder = f"{shared_folder(spark)}/pass-{uuid.uuid4().hex}"
        _pass(rows, k, bitmaps, least, ahead).write.option("compression", "zstd").parquet(folder)
        passed = spark.read.schema(_PASSED).parquet(folder)
        counts = passed.filter("segment IS NULL")
        sums = counts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        frequent = checkpointed(sums.select("lang", F.col("phrase").cast("string").alias("phrase"), F.lit(k).alias("k"), "f"))
        found.append(frequent)
        if k == 1:
            sizes = checkpointed(counts.groupBy("lang").agg(F.sum("n").alias("n")))
        if ahead:
            bitmaps = broadcast_object(spark, (member_bitmap(frequent, k), bucket_bitmap(passed, least)))
        # all that is taken from the pass is written down, so nothing reads it again
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return reduce(DataFrame.unionByName, found), sizes


def _key(lang: str, phrase: Column) -> Column:
    """A language and a phrase in one string that no other two read as."""
    return F.concat(F.octet_length(lang).cast("string"), F.lit(":"), F.col(lang), phrase)


def scored(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two words or more: the cut with the lowest score counts, of equal ones the first.

    Phrases begin or end alike in great numbers, so the parts' counts are joined by ``join_groups``. Scores are integers
    of decimals of 38 digits.
    """
    words = F.split("phrase", " ", -1)
    cuts = frequent.filter("k >= 2").select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    part = lambda start, length: _key("lang", F.array_join(F.slice("w", start, length), " "))
    cuts = checkpointed(cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.size("w") - F.col("cut")).alias("right")))
    uses = cuts.select(F.explode(F.array("left", "right")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    groups = checkpointed(uses.join(frequent.select(_key("lang", F.col("phrase")).alias("key"), "f"), "key"))
    both = join_groups(cuts, groups.withColumnsRenamed({"key": "left", "f": "l"}), "left", "uses", F.col("phrase")).drop("uses")
    both = join_groups(both, groups.withColumnsRenamed({"key": "right", "f": "r"}), "right", "uses", F.col("phrase"))
    both = both.withColumn("score", F.expr("cast(2000000 * cast(a AS decimal(20, 0)) div cast(l + r AS decimal(20, 0)) AS bigint)"))
    best = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def absorbing(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the highest count of a longer frequent phrase in which a phrase of two words or more stands."""
    w, k = F.split("phrase", " ", -1), F.col("k")
    starts = lambda m: F.transform(F.sequence(F.lit(1), k - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), k - 1), starts))
    parts = frequent.filter("k >= 3").select("lang", "f", "k", w.alias("w")).select("lang", "f", F.explode(inner).alias("phrase"))
    return parts.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def mine_collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, absorbed: int = ABSORBED) -> DataFrame:
    """The first ``top`` collocations of each language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score.

    Texts are put in lower case (A-Z) and cut at . , ; : ! ? and line ends into pieces, these at spaces and tabs into
    words. A phrase of 2 to ``longest`` words counts each place, overlaps too, where it stands in one piece; a is its count in the language and
    must reach ``least``. Cut in two, with l and r the counts of its parts, it scores floor(2000000 a / (l + r)); its lowest score counts. A
    phrase goes if a longer one that holds its words in a row has ``absorbed`` percent of its count or more. Ranks are by score, count and
    phrase (by bytes); n is the number of words of the language.

    A null language is 'und'; null and empty texts have no words. Repeated rows count as often as they come. Texts of any length
    are worked on in chunks that end where a piece ends; one piece is held whole. An empty table gives no rows. Further columns are not read.
    """
    frequent, sizes = frequent_phrases(docs, least, longest)
    frequent = checkpointed(frequent)
    rows = scored(frequent).join(absorbing(frequent), ["lang", "phrase"], "left")
    stays = F.expr(f"100 * cast(longer AS decimal(20, 0)) < {int(absorbed)} * cast(a AS decimal(20, 0))")
    rows = rows.filter(F.col("longer").isNull() | stays).drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each lane, then the first of these: at most LANES * top rows of a language meet
    lane = F.pmod(F.xxhash64("phrase"), F.lit(LANES))
    rows = rows.withColumn("lane", lane).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lane").orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return rows.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
