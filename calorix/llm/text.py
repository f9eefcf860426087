"""Words, hashes and windows of many texts at once, in numpy, for one Arrow batch.

Hashes have 64 bits. Word hashes are sums over random byte values times powers of an odd number,
taken from one running total per block, then mixed; equal words have equal hashes everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of ``x`` over the word (a bijection)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_VALUES = mix(np.arange(1, 257, dtype=U) * U(_BASE))
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_FOLDED = _VALUES[_FOLD]

#: Bytes between words: ASCII white space; and everything of ASCII but letters and digits.
BLANKS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
SIGNS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, U(base & (2**64 - 1)))
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its texts; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    elif not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("").cast(column.type))
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    first = offsets[0]
    return np.frombuffer(data, np.uint8)[first : offsets[-1]], offsets - first


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together; a longer text is alone."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def word_spans(
    data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = BLANKS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for every text the number of its first word (and the total)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~gaps[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edges[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False
) -> np.ndarray:
    """Hash of every span of bytes; ``fold`` takes A-Z as a-z. Spans are in order, apart."""
    out = np.empty(len(starts), U)
    table = _FOLDED if fold else _VALUES
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK, "right")))
        a, b = starts[lo], ends[hi - 1]
        up, down = powers(b - a)
        total = np.zeros(b - a + 1, U)
        np.cumsum(table[data[a:b]] * up[: b - a], out=total[1:])
        s = starts[lo:hi] - a
        out[lo:hi] = (total[ends[lo:hi] - a] - total[s]) * down[s]
        lo = hi
    return mix(out)


def byte_hashes(data: np.ndarray) -> np.ndarray:
    """A random value for each byte."""
    return _VALUES[data]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    if size <= 8:
        out = np.zeros(n, U)
        for k in range(size):
            out *= U(_BASE)
            out += hashes[k : k + n]
        return mix(out)
    up, down = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[size:] - total[:n]) * down[:n])


def run_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each of some runs of consecutive hashes."""
    up, down = powers(len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[: len(hashes)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def run_of(counts: np.ndarray) -> np.ndarray:
    """0, 0, 1, 1, 1, … : the number of its group for each member of groups of these sizes."""
    return np.repeat(np.arange(len(counts)), counts)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts`` and have ``counts`` members."""
    if not len(counts):
        return np.zeros(0, np.int64)
    first = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(starts - first, counts)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its least one, the leftmost of equals.

    Values are compared by their upper 40 bits, so a place fits beside them in one word.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    step = (1 << 20) - width
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        part = values[lo : hi + width - 1]
        m = -(-len(part) // width) * width
        packed = np.full(m, np.iinfo(U).max, U)
        packed[: len(part)] = (part & ~U(0xFFFFFF)) | np.arange(len(part), dtype=U)
        rows = packed.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        k = hi - lo
        least = np.minimum(back[:k], ahead[width - 1 : width - 1 + k])
        out[lo:hi] = (least & U(0xFFFFFF)).astype(np.int64) + lo
    return out


def counted(keys: np.ndarray, shards: np.ndarray, name: str) -> pa.RecordBatch:
    """Distinct keys of each shard with the times they are found, two for more."""
    order = np.lexsort((shards, keys))
    keys, shards = keys[order], shards[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (shards[1:] != shards[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(keys)))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys[at].view(np.int64)),
            pa.array(shards[at].astype(np.int32)),
            pa.array(np.minimum(n, 2), pa.int64()),
        ],
        names=[name, "shard", "n"],
    )
