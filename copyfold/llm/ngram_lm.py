"""Stupid-backoff scores by joins of n-gram counts.

The tables are relations of packed rows. Batches of documents are exploded
into n-grams, which are counted within the batch, sorted by hash and cut into lanes of the
hash range; a row holds a batch's n-grams of one lane, coded by their gaps.
Each lane sums its rows into its part of the global count table and joins the
table back to them: a reply to each batch, in its own order. The batches' words and
the replies meet by batch, where each word is scored and the scores are
summed per document. A frequent n-gram costs a lane one entry for each batch, so no key is hot.

A document isn't scored by its own counts: they are taken off the global
ones. A word in its context then gets the relative frequency at the longest
context with which the word stands in other documents, times BACKOFF for each
word given up; a word that no other document has gives up one more, and counts once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyfold.llm.common import lane_keys, mix64, word_hashes

#: Longest n-gram; factor for each word of context that is given up.
ORDER, BACKOFF = 3, 0.4
#: Bits of an n-gram's hash: a count is off by a collision for about one in 2^56 / distinct n-grams.
BITS = 56
#: Words of a batch, but for a longer document's, which is a batch of its own.
BATCH_WORDS = 1 << 20
#: Bytes of text for each lane of the count tables, about.
LANE_BYTES = 16 << 20

_TOP = np.uint64(64 - BITS)
_WORD = np.uint64(0x9E3779B97F4A7C15)
#: The n-gram of no words; its count is that of all words.
EMPTY = np.uint64(0)


def document_words(text: str | None) -> np.ndarray:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of a text, A-Z folded."""
    return word_hashes((text or "").encode())


class Batch:
    """Documents' ids, their lengths and their words, one document after the other."""

    def __init__(self, ids: list, lengths: list[int], words: np.ndarray):
        self.ids, self.lengths, self.words = ids, np.array(lengths, np.int64), words

    @property
    def name(self) -> bytes:
        """A digest of ids and words."""
        digest = hashlib.blake2b(repr(self.ids).encode(), digest_size=16)
        digest.update(self.lengths.tobytes())
        digest.update(self.words.tobytes())
        return digest.digest()

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the n-grams that end at each word, a row for each n; and how many words of its document stand before each word."""
        n = len(self.words)
        starts = np.cumsum(self.lengths) - self.lengths
        before = np.arange(n) - np.repeat(starts, self.lengths)
        out = np.full((order, n), 0, np.uint64)
        for k in range(1, order + 1):
            h = np.full(max(0, n - k + 1), k, np.uint64)
            for i in range(k):
                h = mix64(h * _WORD + self.words[i : n - k + 1 + i])
            out[k - 1, k - 1 :] = h >> _TOP
        return out, before

    def counts(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct n-grams (EMPTY first), their counts in the batch, each word's places among them by n (-1: none), and each word's document."""
        grams, before = self.grams(order)
        valid = before[None, :] >= np.arange(order)[:, None]
        distinct, inverse, count = np.unique(grams[valid], return_inverse=True, return_counts=True)
        places = np.full(grams.shape, -1, np.int64)
        places[valid] = inverse + 1
        distinct = np.concatenate([[EMPTY], distinct])
        return distinct, np.concatenate([[len(self.words)], count]), places, np.repeat(np.arange(len(self.ids)), self.lengths)

    def pack(self) -> bytes:
        """The batch in bytes, entropy-coded: distinct words, the most frequent first, then the places of all words among them."""
        distinct, inverse, counts = np.unique(self.words, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        distinct, places = distinct[order], rank[inverse]
        head = np.array([len(self.ids), len(distinct), len(self.words)], np.int64)
        known = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        low = places.astype("<u4").view(np.uint8).reshape(-1, 4)
        # one plane for each byte of the places: the high ones are nearly constant
        return squeeze(b"".join(x.tobytes() for x in (head, ids, known, self.lengths, distinct, low[:, 0], low[:, 1], low[:, 2], low[:, 3])))

    @classmethod
    def unpack(cls, packed: bytes) -> Batch:
        packed = unsqueeze(packed)
        docs, distinct, words = np.frombuffer(packed, np.int64, 3).tolist()
        at = 24
        ids = np.frombuffer(packed, np.int64, docs, at).tolist()
        known = np.frombuffer(packed, np.uint8, docs, at := at + 8 * docs)
        lengths = np.frombuffer(packed, np.int64, docs, at := at + docs).tolist()
        table = np.frombuffer(packed, np.uint64, distinct, at := at + 8 * docs)
        planes = np.frombuffer(packed, np.uint8, 4 * words, at + 8 * distinct).reshape(4, words)
        places = np.ascontiguousarray(planes.T).view("<u4").ravel()
        return cls([i if k else None for i, k in zip(ids, known)], lengths, table[places])


def batches_of(rows: Iterator[tuple[int | None, str | None]], size: int = BATCH_WORDS) -> Iterator[Batch]:
    """Consecutive documents until they have ``size`` words."""
    ids, parts, held = [], [], 0
    for doc_id, text in rows:
        words = document_words(text)
        ids.append(doc_id)
        parts.append(words)
        held += len(words)
        if held >= size or len(ids) >= size:
            yield Batch(ids, list(map(len, parts)), np.concatenate(parts))
            ids, parts, held = [], [], 0
    if ids:
        yield Batch(ids, list(map(len, parts)), np.concatenate(parts))


def squeeze(raw: bytes) -> bytes:
    """Entropy-coded bytes behind their length."""
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueeze(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted integers as the first of them and the bytes of the gaps, as many for each as the largest gap needs."""
    gaps = np.diff(values)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + values[:1].astype("<u8").tobytes() + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(packed: bytes) -> np.ndarray:
    width = packed[0]
    raw = np.frombuffer(packed, np.uint8, offset=9).reshape(-1, width)
    gaps = np.zeros((len(raw) + 1, 8), np.uint8)
    gaps[0] = np.frombuffer(packed, np.uint8, 8, 1)
    gaps[1:, :width] = raw
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def pack_planes(values: np.ndarray) -> bytes:
    """Counts byte by byte: all lowest bytes, then all second ones, as far as the largest count needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    raw = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + squeeze(np.ascontiguousarray(raw.T).tobytes())


def unpack_planes(packed: bytes) -> np.ndarray:
    width = packed[0]
    planes = np.frombuffer(unsqueeze(packed[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").ravel()


def _documents(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield doc_id, text.as_py()


def score_batch(batch: Batch, totals: np.ndarray, order: int = ORDER, backoff: float = BACKOFF) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log10 scores and number of words that gave up context, for each document.

    ``totals`` are the global counts of the batch's distinct n-grams, in their order.
    """
    _, _, places, document = batch.counts(order)
    n = len(batch.words)
    others = np.zeros((order + 1, n))
    others[0] = totals[0] - batch.lengths[document]
    for k in range(order):
        here = np.flatnonzero(places[k] >= 0)
        key = places[k, here] * len(batch.ids) + document[here]
        _, inverse, own = np.unique(key, return_inverse=True, return_counts=True)
        others[k + 1, here] = totals[places[k, here]] - own[inverse]
    scores, open_, gave = np.zeros(n), np.ones(n, bool), np.zeros(n, np.int64)
    longest = np.maximum.reduce([np.where(places[k] >= 0, k + 1, 0) for k in range(order)]) if n else np.zeros(0, np.int64)
    for k in range(order, 0, -1):
        context = others[0] if k == 1 else np.concatenate([[0.0], others[k - 1, :-1]])
        hit = open_ & (longest >= k) & (others[k] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            value = np.log10(others[k] / context) + (longest - k) * np.log10(backoff)
        scores[hit] = value[hit]
        gave[hit] = (longest - k)[hit]
        open_ &= ~hit
    # a word that no other document has
    unseen = np.log10(1 / np.maximum(others[0], 1)) + longest * np.log10(backoff)
    scores[open_], gave[open_] = unseen[open_], longest[open_]
    return np.bincount(document, scores, len(batch.ids)), np.bincount(document, gave > 0, len(batch.ids)).astype(np.int64)


def score_documents(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, lanes: int | None = None) -> DataFrame:
    """Stupid-backoff score of every row of ``docs`` (doc_id, text) by the n-grams of all the other rows.

    Returns doc_id, n_words, n_backed_off (words scored with less context than
    their document has), score (sum of log10) and mean_score (per word; 0 without words).
    Null texts count as empty. Rows that repeat count each, so a copy scores
    high. ``lanes`` cuts the count tables, by default into one for LANE_BYTES of text or so, so a lane stays as large
    as it is however many documents there are. ``docs`` is read twice and must come in the same rows and order, as from
    files; batches that don't meet their replies are an error, not a wrong score. An empty table gives no rows. Further
    columns are not read.
    """
    spark = docs.sparkSession
    if lanes is None:
        size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
        lanes = max(spark.sparkContext.defaultParallelism, -(-size // LANE_BYTES))
    edges = np.array([-(-(i << BITS) // lanes) for i in range(1, lanes)], np.uint64)
    keys = lane_keys(spark, lanes)
    source = docs.selectExpr("cast(doc_id as bigint)", "text")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(_documents(batches)):
            distinct, counts, _, _ = batch.counts(order)
            name = batch.name
            ends = [0, *np.searchsorted(distinct, edges).tolist(), len(distinct)]
            rows = [(keys[lane], lane, name, pack_sorted(distinct[a:b]), pack_planes(counts[a:b])) for lane, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "lane", "batch", "grams", "counts"])

    def tally(table: pa.Table) -> pa.Table:
        parts = [unpack_sorted(x.as_py()) for x in table["grams"]]
        counts = np.concatenate([unpack_planes(x.as_py()) for x in table["counts"]])
        distinct, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        totals = np.bincount(inverse, counts, len(distinct)).astype(np.int64)[inverse]
        ends = np.cumsum([len(p) for p in parts])[:-1]
        replies = [pack_planes(t) for t in np.split(totals, ends)]
        return pa.table({"batch": table["batch"], "lane": table["lane"], "body": pa.array(replies, pa.binary())})

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(_documents(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([batch.name], pa.binary()), pa.array([-1], pa.int32()), pa.array([batch.pack()], pa.binary())], names=["batch", "lane", "body"])

    def score(table: pa.Table) -> pa.Table:
        replies, bodies = {}, []
        for lane, body in zip(table["lane"].to_pylist(), table["body"].to_pylist()):
            if lane < 0:
                bodies.append(body)
            else:
                replies[lane] = body
        totals = np.concatenate([unpack_planes(replies[lane]) for lane in sorted(replies)])
        out: list[list] = [[], [], [], [], []]
        for body in bodies:
            batch = Batch.unpack(body)
            if len(totals) != len(batch.counts(order)[0]):
                raise ValueError("the documents came in other batches when they were read again")
            sums, gave = score_batch(batch, totals, order, backoff)
            for column, values in zip(out, (batch.ids, batch.lengths.tolist(), gave.tolist(), sums.tolist(), (sums / np.maximum(batch.lengths, 1)).tolist())):
                column += values
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        if replies and not bodies:
            raise ValueError("the documents came in other batches when they were read again")
        return pa.table({name: pa.array(c, k) for name, c, k in zip(("doc_id", "n_words", "n_backed_off", "score", "mean_score"), out, kinds)})

    exploded = source.mapInArrow(explode, "part int, lane int, batch binary, grams binary, counts binary")
    # a task for each lane, and several for the batches that one lane's bytes come from
    replies = exploded.repartition(lanes, "part").groupBy("part", "lane").applyInArrow(tally, "batch binary, lane int, body binary")
    both = replies.unionByName(source.mapInArrow(words, "batch binary, lane int, body binary"))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * lanes)
    return both.repartition(tasks, "batch").groupBy("batch").applyInArrow(score, "doc_id bigint, n_words bigint, n_backed_off bigint, score double, mean_score double")
