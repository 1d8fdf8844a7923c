"""Batch text primitives on Arrow buffers: words, hashes and ragged gathers without a Python loop per word.

Every operator of this package that reads whole texts works on slices of one Arrow string column. A slice holds at
most ``limit`` bytes, or one text if that text alone is longer, so memory follows the slice and not the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once.
SLICE_BYTES = 1 << 20

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Values from which a run is hashed by itself.
LONG_RUN = 4096


def byte_table(members: bytes) -> np.ndarray:
    """A boolean table of 256 entries, true for the given bytes."""
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


#: U+0020 and U+0009 to U+000D.
WHITE = byte_table(b" \t\n\x0b\x0c\r")
#: What separates words once A-Z are lower-cased: ASCII other than digits and a-z.
NOT_ALNUM = byte_table(bytes(c for c in range(128) if not chr(c).isalnum() or chr(c).isupper()))
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, row after the last, bytes, offsets from 0) over a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of the maximal runs of bytes that are no separators; no run crosses texts."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~separator[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    cuts = offsets[1:-1]
    start, end = inside & ~before, before & ~inside
    start[cuts] |= inside[cuts]
    end[cuts] |= before[cuts]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end)
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that any of their bits can serve as a key (splitmix64's finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of values: Horner's rule by position, over all runs at once, longest first; very long runs one by one."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    if lengths.max() > LONG_RUN:
        out, long = np.empty(len(starts), np.uint64), lengths > LONG_RUN
        out[~long] = run_hashes(data, starts[~long], lengths[~long])
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(lengths.max()), MULTIPLIER)]))
        for i in np.flatnonzero(long):
            n, values = int(lengths[i]), data[starts[i] : starts[i] + lengths[i]].astype(np.uint64) + np.uint64(1)
            out[i : i + 1] = powers[n : n + 1] * np.uint64(n) + (values * powers[n - 1 :: -1]).sum(dtype=np.uint64, keepdims=True)
        out[long] = mix(out[long])
        return out
    order = np.argsort(lengths.astype(np.uint16), kind="stable")[::-1]
    at, sizes = starts[order], lengths[order]
    more = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")
    h = sizes.astype(np.uint64)
    for k, m in enumerate(more):
        h[:m] *= MULTIPLIER
        h[:m] += data[at[:m] + k]
        h[:m] += np.uint64(1)
    out = np.empty_like(h)
    out[order] = mix(h)
    return out


def shingle_hashes(word_hash: np.ndarray, texts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of k words inside one text, and the index of its first word."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(texts[:n] == texts[k - 1 :])
    h = np.zeros(len(at), np.uint64)
    for i in range(k):
        h = h * MULTIPLIER + word_hash[at + i]
    return mix(h), at


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of each run, one run after the other."""
    total = np.cumsum(lengths)
    if not len(total) or not total[-1]:
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(starts - (total - lengths), lengths)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds; empty stretches give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]
