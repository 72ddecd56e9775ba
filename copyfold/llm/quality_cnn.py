"""A byte-level convolutional network in numpy that scores the quality of whole texts.

Learned filters look at overlapping chunks of CHUNK bytes, STRIDE apart, that
cover the text from its first byte to its last; what a filter sees is summed
from a learned table for each offset and byte. Each filter's largest response
over all chunks goes through a small hidden layer into one probability.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copyfold.llm.common import broadcast_object

#: Shape of the network: bytes of a chunk, bytes between chunks, filters, hidden units.
CHUNK, STRIDE, FILTERS, HIDDEN = 24, 8, 24, 16
#: Training: labelled rows of each class at most, steps, texts of a step, step size, seed.
SAMPLE_PER_CLASS, STEPS, STEP_TEXTS, RATE, SEED = 700, 640, 32, 0.004, 7
#: Rows whose crc32(doc_id) mod 4 is HELD_OUT are never trained on.
FOLDS, HELD_OUT = 4, 2
#: A text is accepted from this score on.
THRESHOLD = 0.7
#: Chunks that are scored at once; rows whose texts are taken out of a batch at once.
SLICE, BATCH_ROWS = 1 << 15, 256


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the chunks that cover ``n`` bytes; the last chunk may reach beyond them, into padding."""
    return np.arange(0, max(1, n - CHUNK + STRIDE), STRIDE)


def padded(text: bytes) -> np.ndarray:
    """The bytes of a text counted from 1, followed by as many zeros as its last chunk needs."""
    out = np.zeros(len(text) + CHUNK + STRIDE, np.int32)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    out[: len(text)] += 1
    return out


class Network:
    """Parameters as arrays: tables (offset, byte, filter), and two dense layers."""

    def __init__(self, rng: np.random.Generator):
        self.tables = rng.normal(0, 0.12, (CHUNK, 257, FILTERS)).astype(np.float32)
        self.tables[:, 0] = 0
        self.w1 = rng.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)).astype(np.float32)
        self.b1 = np.zeros(HIDDEN, np.float32)
        self.w2 = rng.normal(0, HIDDEN**-0.5, HIDDEN).astype(np.float32)
        self.b2 = np.zeros(1, np.float32)

    def responses(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """What each filter makes of the chunk at each start."""
        out = self.tables[0][data[starts]]
        for offset in range(1, CHUNK):
            out += self.tables[offset][data[starts + offset]]
        return out

    def best(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest response over all chunks, and the start of the chunk that has it."""
        most, where = None, None
        for i in range(0, len(starts), SLICE):
            part = self.responses(data, starts[i : i + SLICE])
            top = part.argmax(axis=0)
            here = part[top, np.arange(FILTERS)]
            if most is None:
                most, where = here, starts[i + top]
            else:
                where = np.where(here > most, starts[i + top], where)
                most = np.maximum(most, here)
        return most, where

    def pooled(self, text: bytes) -> np.ndarray:
        """Each filter's largest response over the whole text."""
        data, starts = padded(text), chunk_starts(len(text))
        parts = [self.responses(data, starts[i : i + SLICE]).max(axis=0) for i in range(0, len(starts), SLICE)]
        return np.max(parts, axis=0)

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden units and the logit for rows of pooled responses."""
        hidden = np.tanh(np.tanh(pooled) @ self.w1 + self.b1)
        return hidden, hidden @ self.w2 + self.b2[0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """One probability for each text, higher where label 1 is likelier."""
        if not texts:
            return np.empty(0)
        _, logit = self.head(np.array([self.pooled(t) for t in texts], np.float32))
        return 1 / (1 + np.exp(-logit.astype(np.float64)))


class Adam:
    """Step sizes from running moments of the gradients."""

    def __init__(self, parameters: list[np.ndarray]):
        self.parameters, self.t = parameters, 0
        self.first = [np.zeros_like(p) for p in parameters]
        self.second = [np.zeros_like(p) for p in parameters]

    def step(self, gradients: list[np.ndarray], rate: float) -> None:
        self.t += 1
        for p, g, m, v in zip(self.parameters, gradients, self.first, self.second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-7)


def train(texts: list[bytes], labels: list[int], seed: int = SEED) -> Network:
    """Fit a network to labelled texts.

    Classes weigh alike. Every step looks at all chunks of its texts, as scoring
    does. Without texts of both classes the network scores all texts by the share of label 1 (none: 0.5).
    """
    rng = np.random.default_rng(seed)
    net = Network(rng)
    y = np.array(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        net.w2[:] = 0
        net.b2[:] = 0 if len(y) == 0 else 6 * (2 * y[0] - 1)
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    data = [padded(t) for t in texts]
    starts = [chunk_starts(len(t)) for t in texts]
    adam = Adam([net.tables, net.w1, net.b1, net.w2, net.b2])
    while adam.t < STEPS:
        order = rng.permutation(len(y))
        for at in range(0, len(y), STEP_TEXTS):
            rows = order[at : at + STEP_TEXTS]
            windows, best = [], []
            for r in rows:
                most, where = net.best(data[r], starts[r])
                best.append(most)
                windows.append(data[r][where[:, None] + np.arange(CHUNK)])
            pooled = np.array(best, np.float32)
            squashed = np.tanh(pooled)
            hidden, logit = net.head(pooled)
            slope = (1 / (1 + np.exp(-logit)) - y[rows]) * weight[rows] / len(rows)
            d_hidden = slope[:, None] * net.w2 * (1 - hidden**2)
            d_pooled = (d_hidden @ net.w1.T) * (1 - squashed**2)
            d_tables = np.zeros_like(net.tables)
            where = np.array(windows)
            np.add.at(d_tables, (np.arange(CHUNK)[None, None], where, np.arange(FILTERS)[None, :, None]), d_pooled[:, :, None])
            d_tables[:, 0] = 0
            adam.step([d_tables, squashed.T @ d_hidden, d_hidden.sum(0), hidden.T @ slope, slope.sum(keepdims=True)], RATE * (1 - 0.9 * min(1, adam.t / STEPS)))
    return net


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo FOLDS; a null id has no fold."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> Network:
    """Train on at most ``per_class`` labelled rows of each class, those with the smallest hash of doc_id, outside the held-out fold.

    The sample is bounded, so it may go to the driver and its ids may be
    broadcast. Texts are whole. Labels other than 0 and 1, ids with both labels, and ids that aren't in
    ``docs`` don't count; of rows that repeat an id, the smallest text stands for it.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter((fold() != HELD_OUT) & F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most").drop("most")
    order = F.xxhash64(F.col("doc_id"), F.lit(SEED))
    chosen = [known.filter(F.col("quality") == q).orderBy(order, "doc_id").limit(per_class) for q in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([(r["text"] or "").encode() for r in rows], [r["quality"] for r in rows])


def encoded(texts: pa.Array) -> list[bytes]:
    return [(t.as_py() or "").encode() for t in texts]


def score(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` with the further columns score (double, 0 to 1) and predicted (int); null texts score as empty ones.

    Each batch of rows is scored whole text by whole text, BATCH_ROWS texts and SLICE chunks at a time.
    """
    model = broadcast_object(docs.sparkSession, network)
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    at = own.index("text")
    schema = docs.select(*own).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = model()
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                found = network.scores(encoded(batch.column(at)))
                columns = [*batch.columns, pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[*own, "score", "predicted"])

    return docs.select(*own).mapInArrow(run, schema.add("score", T.DoubleType()).add("predicted", T.IntegerType()))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``, by a network fitted to ``labels``.

    held_out is whether the row is in the fold that training leaves out (null
    ids: false). Null texts score as empty ones, texts of any length as a whole; rows that repeat are scored
    alike. An empty table gives no rows. Further columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scored = score(rows, fit(rows, labels))
    return scored.select("doc_id", F.coalesce(fold() == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text is accepted.

    Rows go to the scoring tasks once, and only accepted ones come back; BATCH_ROWS texts at a time are taken out of a batch.
    """
    model = broadcast_object(docs.sparkSession, fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = model()
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(start, BATCH_ROWS)
                yield batch.filter(pa.array(network.scores(encoded(batch.column(at))) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
