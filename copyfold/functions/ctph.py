"""Context-triggered piecewise hashes in the published spamsum form, and their comparison, in numpy for Arrow batches.

A text is cut where a rolling hash of seven bytes says so, so that an edit changes the pieces around it alone; each piece gives a
letter. A digest is the block size and two strings of letters, for it and for twice of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from copyfold.functions.fingerprints import DIGEST_SIZES, read_bytes

# Fixed values of the published algorithm: letters of a digest and their number, the least block size, the rolling window, first value and
# factor of the hash of a piece (of which six bits count), the letters two strings must have in a row, what more than so many alike in a row count as.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LENGTH, LEAST_BLOCK, WINDOW, FIRST, FACTOR, COMMON, ALIKE = 64, 3, 7, 0x28021967, 0x01000193, 7, 3

#: Bytes of contents that are hashed at once.
BATCH = 8 << 20

_state = np.arange(64, dtype=np.int32)[:, None] * (FACTOR & 63)
#: The state after a byte, and after two: (state, six bits of each byte) to state.
_ONE = ((_state & 63) ^ np.arange(64, dtype=np.int32)).ravel()
_TWO = _ONE[(_ONE[:, None] << 6) | np.arange(64, dtype=np.int32)].ravel()


def rolling(padded: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte from the seventh on: sum, weighted sum and shifted bits of the last seven bytes."""
    n = len(padded) - WINDOW + 1
    out = np.zeros(max(n, 0), np.uint32)
    bits = np.zeros_like(out)
    for j in range(WINDOW):
        byte = padded[WINDOW - 1 - j : WINDOW - 1 - j + n].astype(np.uint32)
        out += byte * np.uint32(1 + WINDOW - j)
        bits ^= byte << np.uint32(5 * j)
    return out + bits


def _piece_states(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The six bits of each piece's hash. Pieces go forward together, two bytes at a step, the longest for longest."""
    order = np.argsort(-lengths, kind="stable")
    at, steps = starts[order].copy(), lengths[order] // 2
    six = (data & 63).astype(np.int32)
    two = np.zeros(len(six), np.int32)
    two[:-1] = six[:-1] << 6 | six[1:]
    state = np.full(len(at), FIRST & 63, np.int32)
    active = len(at) - np.cumsum(np.bincount(steps)) if len(at) else np.empty(0, np.int64)
    for n in active.tolist():
        if not n:
            break
        state[:n] = _TWO[(state[:n] << 12) | two[at[:n]]]
        at[:n] += 2
    odd = np.flatnonzero(lengths[order] % 2)
    state[odd] = _ONE[(state[odd] << 6) | six[at[odd]]]
    out = np.empty(len(at), np.int32)
    out[order] = state
    return out


def digests(contents: list[bytes]) -> list[str]:
    """The digest of each of some contents."""
    gap = b"\x00" * (WINDOW - 1)
    data = np.frombuffer(gap + gap.join(contents) + gap, np.uint8)
    roll = rolling(data)  # of the byte six places on
    z = roll.astype(np.uint64) + np.uint64(1)
    cuts = np.flatnonzero(z % np.uint64(LEAST_BLOCK) == 0)
    low = z[cuts] & (~z[cuts] + np.uint64(1))
    level = np.bitwise_count(low - np.uint64(1))
    cuts += WINDOW - 1
    sizes = np.array([len(c) for c in contents], np.int64)
    ends = np.cumsum(sizes + WINDOW - 1)
    begins = ends - sizes
    first, last = np.searchsorted(cuts, begins), np.searchsorted(cuts, ends)
    starts, lengths, blocks, counts = [], [], [], []
    for begin, end, i, j in zip(begins.tolist(), ends.tolist(), first.tolist(), last.tolist()):
        own, levels = cuts[i:j], level[i:j]
        k = 0
        while LEAST_BLOCK * LENGTH << k < end - begin:
            k += 1
        while k and np.count_nonzero(levels >= k) < LENGTH // 2:
            k -= 1
        blocks.append(LEAST_BLOCK << k)
        for most, found in ((LENGTH, own[levels >= k]), (LENGTH // 2, own[levels >= k + 1])):
            kept = found[: most - 1] + 1
            bounds = np.concatenate([[begin], kept])
            # what follows the last cut gives a letter, unless the text ends in zeros; then the last cut beyond the letters' number ends it
            tail = end if end > begin and roll[end - WINDOW] else int(found[-1]) + 1 if len(found) >= most else None
            stops = kept if tail is None else np.concatenate([kept, [tail]])
            starts.append(bounds[: len(stops)])
            lengths.append(stops - bounds[: len(stops)])
            counts.append(len(stops))
    states = _piece_states(data, np.concatenate(starts).astype(np.int64), np.concatenate(lengths).astype(np.int64)) if contents else np.empty(0, np.int32)
    letters = np.frombuffer(LETTERS.encode(), np.uint8)[states].tobytes().decode()
    out, at = [], 0
    for n, block in enumerate(blocks):
        middle, stop = at + counts[2 * n], at + counts[2 * n] + counts[2 * n + 1]
        out.append(f"{block}:{letters[at:middle]}:{letters[middle:stop]}")
        at = stop
    return out


def shortened(letters: str) -> str:
    """Letters with at most ALIKE of the same in a row, as they are compared."""
    return re.sub(rf"(.)\1{{{ALIKE},}}", lambda m: m[1] * ALIKE, letters)


def common_letters(left: list[str], right: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each two strings of at most 64 letters, in the bits of a word."""
    n = len(left)
    a = np.zeros((n, LENGTH), np.uint8)
    b = np.full((n, LENGTH), 255, np.uint8)
    for out, strings in ((a, left), (b, right)):
        sizes = np.array([len(s) for s in strings], np.int64)
        flat = np.frombuffer("".join(strings).encode(), np.uint8)
        out[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    v = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for j in range(max(map(len, right), default=0)):
        same = np.packbits(a == b[:, j, None], axis=1, bitorder="little").view(np.uint64).ravel()
        u = v & same
        v = (v + u) | (v - u)
    return LENGTH - np.bitwise_count(v).astype(np.int64)


def scores(left: list[str], right: list[str], blocks: np.ndarray) -> np.ndarray:
    """How alike shortened strings of one block size are, 0 to 100, given that they have COMMON letters in a row alike: by the insertions and deletions between them, and bounded for short strings of small blocks."""
    a, b = np.array([len(s) for s in left], np.int64), np.array([len(s) for s in right], np.int64)
    apart = a + b - 2 * common_letters(left, right)
    score = 100 - 100 * (apart * LENGTH // np.maximum(a + b, 1)) // LENGTH
    bounded = blocks < (99 + WINDOW) // WINDOW * LEAST_BLOCK
    return np.where(bounded, np.minimum(score, blocks // LEAST_BLOCK * np.minimum(a, b)), score)


def compare(a: str, b: str) -> int:
    """How alike two digests are, 0 to 100."""
    (n, *x), (m, *y) = ((int(d.split(":")[0]), *map(shortened, d.split(":")[1:])) for d in (a, b))
    if n == m and x == y:
        return 100
    roles = [(x[0], y[0], n), (x[1], y[1], 2 * n)] if n == m else [(x[1], y[0], m)] if m == 2 * n else [(x[0], y[1], n)] if n == 2 * m else []
    roles = [(p, q, block) for p, q, block in roles if {p[i : i + COMMON] for i in range(len(p) - COMMON + 1)} & {q[i : i + COMMON] for i in range(len(q) - COMMON + 1)}]
    return max((int(scores([p], [q], np.array([block]))[0]) for p, q, block in roles), default=0)


def with_piecewise_digest(files: DataFrame) -> DataFrame:
    """(path, digest) of files whose size is in DIGEST_SIZES, from binary content or from their paths; a file that can't be read has no row."""
    columns = ["path", "content"] if "content" in files.columns else ["path"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(paths: list[str], contents: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(digests(contents), pa.string())], names=["path", "digest"])

        paths, contents, held = [], [], 0
        for batch in batches:
            given = (c.as_py() for c in batch.column(1)) if len(columns) > 1 else (read_bytes(p, DIGEST_SIZES[1]) for p in batch.column(0).to_pylist())
            for path, content in zip(batch.column(0).to_pylist(), given):
                if content:
                    paths.append(path)
                    contents.append(content)
                    held += len(content)
                if held > BATCH:
                    yield made(paths, contents)
                    paths, contents, held = [], [], 0
        if paths:
            yield made(paths, contents)

    return files.filter(files["size"].between(*DIGEST_SIZES)).select(*columns).mapInArrow(run, "path string, digest string")
