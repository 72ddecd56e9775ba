"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is itself in the vocabulary is resolved by a minimal perfect
hash (hash, displace, compare). The others are merged: a heap holds the ranks of
adjacent pairs over a linked list of their bytes, and the lowest rank, leftmost
first, is merged until no pair has a rank. What was resolved is remembered in
a bounded memo, whose entries are the ids' bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from copyfold.llm.common import broadcast_object

#: Mean number of keys that share a displacement.
KEYS_PER_BUCKET = 4
#: Entries and longest key of a worker's memo.
MEMO_ENTRIES, MEMO_KEY = 500_000, 64
#: Rows and characters of text in an output batch.
BATCH_ROWS, BATCH_IDS = 2048, 1 << 20

_MASK, _PLACE = (1 << 64) - 1, (1 << 40) - 1


class MinimalPerfectHash:
    """Maps each of n known byte strings to a place of its own in 0..n-1; any other string to some place.

    Keys fall into buckets by one hash; buckets, largest first, get the smallest
    displacement that puts all their keys on free places. A bucket of one key
    names the place itself, as the complement of a displacement.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, -(-self.n // KEYS_PER_BUCKET))
        self.shifts = [0] * self.buckets
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        for key in keys:
            h = xxhash.xxh3_64_intdigest(key)
            members[h % self.buckets].append(h)
        taken, free = bytearray(self.n), 0
        for bucket in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            hashes = members[bucket]
            if not hashes:
                break
            if len(hashes) == 1:
                free = taken.index(0, free)
                self.shifts[bucket] = ~free
                taken[free] = 1
                continue
            shift = 0
            while True:
                places = {self.place_of(h, shift) for h in hashes}
                if len(places) == len(hashes) and not any(taken[p] for p in places):
                    break
                shift += 1
            self.shifts[bucket] = shift
            for p in places:
                taken[p] = 1

    def place_of(self, h: int, shift: int) -> int:
        if shift < 0:
            return ~shift
        x = (h ^ (shift * 0x9E3779B97F4A7C15)) & _MASK
        x = (x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & _MASK
        return (x ^ (x >> 32)) % self.n

    def __call__(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        return self.place_of(h, self.shifts[h % self.buckets])


class Vocabulary:
    """Token byte strings and their ranks behind a minimal perfect hash; the rank of each pair of tokens that make one."""

    def __init__(self, ranks: dict[bytes, int]):
        self.hash = MinimalPerfectHash(list(ranks))
        self.tokens: list[bytes] = [b""] * len(ranks)
        self.ids = [0] * len(ranks)
        for token, rank in ranks.items():
            place = self.hash(token)
            self.tokens[place], self.ids[place] = token, rank
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.pairs = {
            ranks[token[:i]] << 32 | ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        """Read a rank file: a base64 token and its rank in each line."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def rank(self, token: bytes) -> int | None:
        place = self.hash(token)
        return self.ids[place] if self.tokens[place] == token else None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece that isn't a token: the pair of lowest rank is merged first, the leftmost of equals.

        Heap entries are rank and position in one integer; an entry that its pair has outlived is passed over.
        """
        n, pairs = len(piece), self.pairs.get
        ids = list(map(self.byte_ids.__getitem__, piece))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 40 | i for i in range(n - 1) if (r := pairs(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & _PLACE
            j = after[i]
            if ids[i] is None or j >= n or pairs(ids[i] << 32 | ids[j]) != entry >> 40:
                continue
            merged = ids[i] = entry >> 40
            ids[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := pairs(merged << 32 | ids[k])) is not None:
                    heappush(heap, r << 40 | i)
            h = before[i]
            if h >= 0 and (r := pairs(ids[h] << 32 | merged)) is not None:
                heappush(heap, r << 40 | h)
        return [x for x in ids if x is not None]


class Encoder(dict):
    """Ids of pre-tokens as little-endian unsigned 32-bit words; a dict that fills itself."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        super().__init__()
        self.vocabulary, self.split = vocabulary, regex.compile(pattern).findall

    def __missing__(self, word: str) -> bytes:
        piece = word.encode("utf-8")
        rank = self.vocabulary.rank(piece)
        ids = [rank] if rank is not None else self.vocabulary.merge(piece)
        packed = np.array(ids, "<u4").tobytes()
        if len(word) <= MEMO_KEY:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32()))])
COLUMNS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids array<int>"


def encode_documents(docs: DataFrame, vocabulary_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """Encode every whole text of ``docs`` (doc_id, text) and decode it again.

    Returns for each row doc_id, n_tokens, ids_sha256 (of the ids as
    little-endian unsigned 32-bit words), decoded_sha256 and, if ``with_ids``,
    ids. Null texts count as empty and have no tokens. Rows that repeat are encoded
    each; further columns aren't read. An empty table gives no rows; texts of any length are encoded whole. The vocabulary is read and hashed once,
    on the driver, and broadcast: its size is that of its file, whatever the data.
    """
    vocabulary = broadcast_object(docs.sparkSession, Vocabulary.from_file(vocabulary_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary(), pattern)
        fields = list(SCHEMA)[: 5 if with_ids else 4]
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows))
            arrays = [pa.array(c, f.type) for c, f in zip(columns[:4], fields)]
            if with_ids:
                ends = np.cumsum([0, *columns[1]], dtype=np.int32)
                flat = pa.array(np.frombuffer(b"".join(columns[4]), "<i4"))
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), flat))
            return pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))

        for part in batches:
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1)):
                packed = encoder.encode(text.as_py() or "")
                decoded = hashlib.sha256(encoder.decode(packed)).hexdigest()
                rows.append((doc_id, len(packed) // 4, hashlib.sha256(packed).hexdigest(), decoded, packed if with_ids else None))
                held += len(packed) // 4 if with_ids else 1
                if len(rows) >= BATCH_ROWS or held >= BATCH_IDS:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()

    columns = COLUMNS if with_ids else COLUMNS.rpartition(",")[0]
    return docs.selectExpr("cast(doc_id as bigint) as doc_id", "text").mapInArrow(encode, columns)
