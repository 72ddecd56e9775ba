"""Sets of tokens as sorted numbers packed into bytes, so that shuffles and checkpoints of joins over sets move little."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from copyfold.checkpoints import checkpointed

#: Tokens of the sets that share one table of distinct tokens.
BATCH_TOKENS = 1 << 20
#: Bytes of a number, seven bits each.
_BYTES = 9


def pack(numbers: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of the sets of so many ascending numbers each: steps from number to number, seven bits a byte, low ones first."""
    starts = np.cumsum(sizes) - sizes
    steps = np.diff(numbers, prepend=0)
    first = starts[sizes > 0]
    steps[first] = numbers[first]
    lengths = np.ones(len(steps), np.int64)
    for k in range(1, _BYTES):
        lengths += steps >= 1 << 7 * k
    at = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), np.uint8)
    for k in range(int(lengths.max(initial=0))):
        here = lengths > k
        out[at[here] + k] = (steps[here] >> 7 * k) & 127 | (lengths[here] > k + 1) << 7
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])]
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])


def unpack(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all packed sets in a row, and how many each has."""
    lengths = packed.cast(pa.large_binary())
    offsets = np.frombuffer(lengths.buffers()[1], np.int64)[lengths.offset : lengths.offset + len(lengths) + 1] if len(lengths) else np.zeros(1, np.int64)
    data = np.frombuffer(lengths.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    last = data < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    steps = np.zeros(len(ends), np.int64)
    for k in range(int((ends - starts).max(initial=-1)) + 1):
        here = starts + k <= ends
        steps[here] |= (data[starts[here] + k].astype(np.int64) & 127) << 7 * k
    sizes = np.diff(np.concatenate([[0], np.cumsum(last)])[offsets - offsets[0]])
    total = np.concatenate([[0], np.cumsum(steps)])
    return total[1:] - np.repeat(total[np.cumsum(sizes) - sizes], sizes), sizes


def blob(**columns) -> bytes:
    """Columns of one length as compressed bytes."""
    batch = pa.record_batch(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unblob(data: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(data)))


def _tabled(sets: DataFrame) -> DataFrame:
    """(batch, sets, words) of the sets (id, tokens): the sets of a batch have their tokens as places in the batch's table of distinct tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for whole in batches:
            lots = np.cumsum(whole.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)) // BATCH_TOKENS
            bounds = [0, *(np.flatnonzero(np.diff(lots)) + 1).tolist(), whole.num_rows]
            for at, to in zip(bounds, bounds[1:]):
                if at == to:
                    continue
                lists = whole.column(1).slice(at, to - at)
                coded = lists.flatten().dictionary_encode()
                places = coded.indices.to_numpy()
                counts = np.bincount(places, minlength=len(coded.dictionary))
                order = np.argsort(-counts, kind="stable")
                rank = np.empty(len(order), np.int32)
                rank[order] = np.arange(len(order), dtype=np.int32)
                lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(rank[places]))
                kept = blob(id=whole.column(0).slice(at, to - at), tokens=tokens)
                words = blob(token=coded.dictionary.take(pa.array(order)), c=pa.array(counts[order].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([kept], pa.binary()), pa.array([words], pa.binary())], names=["batch", "sets", "words"])
                number += 1

    return sets.filter(F.size("tokens") > 0).select("id", "tokens").mapInArrow(run, "batch bigint, sets binary, words binary")


def numbered_sets(sets: DataFrame) -> DataFrame:
    """(id, class, size, shared, s) of the sets (id, tokens) that aren't empty: s has the ``shared`` tokens that other sets have too, packed as ascending numbers, the globally rarest first.

    A token of one set alone gets no number, but counts in size. Sets that are alike have the same class. Tokens are counted and looked up once for each
    batch of sets that has them, not for each set.
    """
    tabled = checkpointed(_tabled(sets))
    token = sets.schema["tokens"].dataType.elementType

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                table = unblob(words.as_py())
                n = table.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(np.arange(n, dtype=np.int32)), *table.columns], names=["batch", "place", "token", "c"])

    kind = T.StructType([T.StructField("batch", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("token", token), T.StructField("c", T.IntegerType())])
    each = tabled.select("batch", "words").mapInArrow(listed, kind)
    counts = each.groupBy("token").agg(F.sum("c").alias("n")).filter("n >= 2")
    # ids rise with the order of the sort, partition by partition; the parts' sizes make them follow each other
    order = checkpointed(counts.orderBy("n", "token").select("token", F.monotonically_increasing_id().alias("_id")))
    part = F.shiftright("_id", 33).cast("int")
    sizes = dict(order.groupBy(part).count().collect())
    bases = np.concatenate([[0], np.cumsum([sizes.get(p, 0) for p in range(max(sizes, default=0) + 1)])]).tolist()
    number = F.get(F.lit(bases), part) + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    found = each.select("batch", "place", "token").join(order.select("token", number.cast("bigint").alias("number")), "token").select("batch", "place", "number")

    def run(key, places, kept):
        out = []
        for own in kept.column("sets").to_pylist():
            batch = unblob(own)
            lists = batch.column(1)
            codes, lengths = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            numbers = np.full(int(codes.max()) + 1, -1)
            numbers[places.column("place").to_numpy()] = places.column("number").to_numpy()
            numbers, of = numbers[codes], np.repeat(np.arange(len(lengths)), lengths)
            numbers, of = numbers[numbers >= 0], of[numbers >= 0]
            numbers = numbers[np.lexsort((numbers, of))]
            shared = np.bincount(of, minlength=len(lengths))
            s = pack(numbers, shared)
            classes = [hashlib.sha256(x).hexdigest() if n == m else f"{key[0].as_py()}.{i}" for i, (x, n, m) in enumerate(zip(s.to_pylist(), lengths.tolist(), shared.tolist()))]
            out.append(pa.table([batch.column(0), pa.array(classes, pa.string()), pa.array(lengths.astype(np.int32)), pa.array(shared.astype(np.int32)), s], names=["id", "class", "size", "shared", "s"]))
        return pa.concat_tables(out) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary())], names=["id", "class", "size", "shared", "s"])

    kind = T.StructType([sets.schema["id"], T.StructField("class", T.StringType()), T.StructField("size", T.IntegerType()), T.StructField("shared", T.IntegerType()), T.StructField("s", T.BinaryType())])
    return found.groupBy("batch").cogroup(tabled.select("batch", "sets").groupBy("batch")).applyInArrow(run, kind)


def packed_classes(numbered: DataFrame) -> DataFrame:
    """(class, rep, rows, size, shared, s) of the distinct sets of numbered_sets; rep is the smallest id."""
    alike = [F.first(c).alias(c) for c in ("size", "shared", "s")]
    return numbered.groupBy("class").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("rows"), *alike)
