"""Exact deduplication with Patricia tries.

Texts are equal when their normalised bytes are. Each input partition first
inserts its byte strings into a compressed radix trie, which folds local
copies into one terminal node with the smallest identifier and a count. What
is left is dealt by length and content hash to owner partitions, where Spark sorts it by the two; the owners insert
the full byte strings into tries of their own. A hot text thus costs an owner
at most a row for each input partition. When a trie outgrows its budget, its
largest subtrees are let go: the combiner hands their strings on to the owners, and an
owner returns them as finished, which they are once the next length and hash
begin. So tries stay in their budget, and what must wait on disk waits in Spark's own sort.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from copyfold.llm.common import checkpointed, join_groups

#: Bytes of labels that a trie keeps before it lets go of a subtree.
TRIE_BUDGET = 32 << 20
#: Rows and bytes of an output batch.
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20


#: A string, its digest (null: not taken yet), its smallest id (null: no row has one), the rows that have this id, and all its rows.
Item = tuple[bytes, bytes | None, int | None, int, int]


class Node:
    """An edge label, the nodes below by first byte, and at terminals the digest, the smallest id, its rows and all rows."""

    __slots__ = ("label", "below", "digest", "best", "best_rows", "rows")

    def __init__(self, label: bytes):
        self.label, self.below, self.digest, self.best, self.best_rows, self.rows = label, None, None, None, 0, 0


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of ``a`` and ``b[at:]``."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[at + low : at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """A radix trie over byte strings; ``held`` counts the bytes of its labels."""

    def __init__(self):
        self.root, self.held = Node(b""), 0

    def insert(self, key: bytes, digest: bytes | None, best: int | None, best_rows: int = 1, rows: int = 1) -> None:
        node, at = self.root, 0
        while at < len(key):
            below = node.below
            if below is None:
                below = node.below = {}
            child = below.get(key[at])
            if child is None:
                child = below[key[at]] = Node(key[at:] if at else key)
                self.held += len(key) - at + 200
                node = child
                break
            label = child.label
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            n = _shared(label, key, at)
            fork = Node(label[:n])
            child.label = label[n:]
            fork.below = {label[n]: child}
            below[key[at]] = fork
            self.held += 200
            node, at = fork, at + n
        if node.best == best:
            node.best_rows += best_rows
        elif node.rows == 0 or node.best is None or best is not None and best < node.best:
            node.best, node.best_rows = best, best_rows
        node.digest = digest
        node.rows += rows

    def items(self, prefix: bytes = b"", node: Node | None = None) -> Iterator[Item]:
        """Every string from ``node`` down; ``prefix`` is the path above it."""
        stack = [(prefix, node or self.root)]
        while stack:
            head, node = stack.pop()
            key = head + node.label
            if node.rows:
                yield key, node.digest, node.best, node.best_rows, node.rows
            if node.below:
                stack.extend((key, child) for child in node.below.values())

    def cut(self) -> tuple[bytes, Node]:
        """Remove the subtree below the first fork that holds most; its path and node."""
        path, node = b"", self.root
        while node.below and len(node.below) == 1 and not node.rows:
            node = next(iter(node.below.values()))
            path += node.label
        if not node.below:
            path, node = b"", self.root
        sizes = {first: self._held(child) for first, child in node.below.items()}
        first = max(sizes, key=sizes.get)
        self.held -= sizes[first]
        return path, node.below.pop(first)

    @staticmethod
    def _held(top: Node) -> int:
        total, stack = 0, [top]
        while stack:
            node = stack.pop()
            total += len(node.label) + 200
            if node.below:
                stack.extend(node.below.values())
        return total


def own(strings: Iterator[Item], budget: int = TRIE_BUDGET) -> Iterator[Item]:
    """Each distinct string with its smallest id and number of rows, in memory of about ``budget`` bytes.

    Strings come in the order of length and digest, so that equal ones follow
    each other. Where length or digest change, all that the trie holds is
    finished, and a trie over its budget lets go of its largest subtrees.
    """
    trie, last = PatriciaTrie(), None
    for item in strings:
        mark = len(item[0]), item[1]
        if mark != last:
            last = mark
            while trie.held > budget and _forks(trie.root):
                yield from trie.items(*trie.cut())
            if trie.held > budget:
                yield from trie.items()
                trie = PatriciaTrie()
        trie.insert(*item)
    yield from trie.items()


def _forks(root: Node) -> bool:
    """Whether the trie holds more than one string, so that something can be cut and something stays."""
    node = root
    while node.below and len(node.below) == 1 and not node.rows:
        node = next(iter(node.below.values()))
    return bool(node.below)


PARTIAL = pa.schema([("length", pa.int64()), ("digest", pa.binary()), ("content", pa.binary()), ("keep_id", pa.int64()), ("keep_rows", pa.int64()), ("group_size", pa.int64())])
OWNED = pa.schema([("digest", pa.string()), ("keep_id", pa.int64()), ("keep_rows", pa.int64()), ("group_size", pa.int64())])


def _batches(rows: Iterator[tuple], schema: pa.Schema, weigh) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += weigh(row)
        if len(held) >= BATCH_ROWS or weight >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the copies within an input partition; columns content, doc_id in."""

    def rows():
        trie = PatriciaTrie()

        def out(items):
            for key, _, *rest in items:
                yield len(key), hashlib.sha256(key).digest(), key, *rest

        for batch in batches:
            for key, doc_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                trie.insert(key, None, doc_id)
                while trie.held > TRIE_BUDGET and _forks(trie.root):
                    yield from out(trie.items(*trie.cut()))
                if trie.held > TRIE_BUDGET:
                    yield from out(trie.items())
                    trie = PatriciaTrie()
        yield from out(trie.items())

    return _batches(rows(), PARTIAL, lambda row: row[0])


def own_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Own the byte strings of one length-and-hash partition; the columns of PARTIAL in, sorted by length and digest."""

    def strings():
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                # whole rows, some megabytes of them at a time
                lengths = batch.column(0).slice(at, BATCH_ROWS).to_pylist()
                n = total = 0
                while n < len(lengths) and total < BATCH_BYTES:
                    total += lengths[n]
                    n += 1
                part = batch.slice(at, n)
                yield from zip(*(part.column(c).to_pylist() for c in ("content", "digest", "keep_id", "keep_rows", "group_size")))
                at += n

    rows = ((digest.hex(), *rest) for _, digest, *rest in own(strings()))
    return _batches(rows, OWNED, lambda row: 100)


def normalised(text: Column) -> Column:
    """Each run of [\\x20\\x09-\\x0D] as one space, null as the empty text; single spaces need no change."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def owners(docs: DataFrame) -> DataFrame:
    """One row for each distinct normalised text: digest (hex SHA-256), keep_id, group_size."""
    content = docs.select(normalised(F.col("text")).cast("binary").alias("content"), F.col("doc_id").cast("bigint"))
    partial = content.mapInArrow(combine, "length bigint, digest binary, content binary, keep_id bigint, keep_rows bigint, group_size bigint")
    dealt = partial.repartition("length", "digest").sortWithinPartitions("length", "digest")
    return dealt.mapInArrow(own_partition, "digest string, keep_id bigint, keep_rows bigint, group_size bigint")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with the row that stays for its text.

    Returns doc_id, keep_id, group_size, kept, text_sha256. Null texts count as
    empty, and empty texts are copies of each other. keep_id is the smallest
    doc_id that isn't null; of rows that repeat it, all are kept. Where all ids
    of a text are null, keep_id is null and kept is true. Further columns of
    ``docs`` are not read. An empty table gives no rows.
    """
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("digest"))
    groups = checkpointed(owners(docs))
    out = join_groups(ids, groups, "digest", "group_size", F.coalesce("doc_id", F.monotonically_increasing_id()))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that exact_dedup keeps; of rows that repeat a text and its smallest id, the one with the smallest hash of all columns."""
    groups = checkpointed(owners(docs))
    groups = groups.select(F.col("digest").alias("_digest"), F.col("keep_id").alias("_keep"), F.col("keep_rows").alias("_rows"))
    digest = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    rows = docs.select(digest.alias("digest"), F.col("doc_id").cast("bigint").alias("id"), F.struct(*docs.columns).alias("row"))
    out = rows.join(groups, (F.col("digest") == F.col("_digest")) & F.col("id").eqNullSafe(F.col("_keep")))
    if groups.filter("_rows > 1").isEmpty():
        return out.select("row.*")
    tied = out.filter("_rows > 1").groupBy("digest").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return out.filter("_rows = 1").select("row.*").unionByName(tied.select("row.*"))
