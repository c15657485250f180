"""Whole texts as NumPy arrays of code points, words and hashes, one Arrow slice at a time.

Words are runs of characters other than space and U+0009-U+000D. Null texts count as
empty. Slices are bounded by characters (one text at least), so a worker's memory follows
its longest text and not the number of rows that Spark sends at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_CHARS = 1 << 20
SLICE_ROWS = 1 << 14

# Odd multipliers of the hashes.
WORD_FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text",
           chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds at most ``chars`` bytes of ``column`` and
    ``SLICE_ROWS`` rows."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + chars, "right")))
            stop = min(stop, start + SLICE_ROWS)
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row (uint32), and where each text starts, plus the end."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    return points, np.concatenate([np.zeros(1, np.int64), ends])


def lower_ascii(points: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all else as it is."""
    return points + ((points - np.uint32(65)) < 26).astype(np.uint32) * np.uint32(32)


def is_space(points: np.ndarray) -> np.ndarray:
    return (points == 32) | ((points - np.uint32(9)) < 5)


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each run of true cells; texts never share a run."""
    if not len(mask):
        none = np.zeros(0, np.int64)
        return none, none, none
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(mask))]
    first[inner] = mask[inner]
    last[inner - 1] = mask[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mix(hashes: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    hashes = (hashes ^ (hashes >> np.uint64(30))) * MIX_1
    hashes = (hashes ^ (hashes >> np.uint64(27))) * MIX_2
    return hashes ^ (hashes >> np.uint64(31))


def run_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the characters of each run."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), WORD_FACTOR, np.uint64))
    inside = points[place + np.repeat(starts, lengths)]
    return mix(np.add.reduceat((inside.astype(np.uint64) + np.uint64(1)) * powers[place], first))


def words(texts: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word of the texts, in order."""
    points, offsets = code_points(texts)
    if lower:
        points = lower_ascii(points)
    starts, ends, text = runs(~is_space(points), offsets)
    return run_hashes(points, starts, ends), text


def joined_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` neighbours; position i covers i .. i + size - 1."""
    total = hashes[:max(0, len(hashes) - size + 1)].copy()
    for k in range(1, size):
        total = total * WORD_FACTOR + hashes[k:k + len(total)]
    return mix(total + np.uint64(size))


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """A hash of every q code points in a row, put together from runs of 1, 2, 4 .."""
    whole, length, run, run_length = None, 0, points.astype(np.uint64), 1
    factor = WORD_FACTOR
    while length < q:
        if q & run_length:
            if whole is None:
                whole = run
            else:
                n = max(0, min(len(whole), len(run) - length))
                whole = whole[:n] * factor + run[length:length + n]
            length += run_length
        run = run[:max(0, len(run) - run_length)] * factor + run[run_length:]
        factor = np.uint64((int(factor) * int(WORD_FACTOR) + 2) % 2**64)
        run_length *= 2
    return mix(whole)


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of every ``size`` words of each text.

    A text of fewer words is one shingle, its whole sequence; no words, no shingles.
    """
    hashes, text = words(texts)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    joined = joined_hashes(hashes, size)
    sets = []
    for start, end in zip(bounds[:-1], bounds[1:]):
        if end - start >= size:
            sets.append(np.unique(joined[start:end - size + 1]))
        elif end > start:
            sets.append(joined_hashes(hashes[start:end], int(end - start)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
