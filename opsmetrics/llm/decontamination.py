"""Benchmark passages in documents by the q-gram lemma and banded alignment.

Texts are compared as lower-case letters and digits with single spaces between. A passage
of m characters found with at most k edits shares m - q + 1 - q k q-grams with the item,
all on diagonals (text position minus item position) at most k apart. Shared q-grams are
counted in overlapping bands of diagonals; bands with fewer are ruled out, the others are
aligned within the band.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.llm.tables import materialize
from opsmetrics.llm.text import code_points, distinct, gram_hashes, slices, texts_of

Q = 8
EDIT_PERCENT = 10
LEAST_CHARS = 40
BLOCK_CHARS = 2_000_000
FILTER_BITS = 20
ALIGNED_CELLS = 1 << 21
HITS_AT_ONCE = 1 << 20
SLICE = 1 << 21

_FOUND = pa.schema([("_key", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int64()),
                    ("item_chars", pa.int64()), ("at", pa.int64())])


def normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in lower case, other characters than letters and digits
    one space, and where each text starts. Every text is followed by a space."""
    points, offsets = code_points([f"{t.lower()} " for t in texts])
    table = _letters()
    solid = table[np.minimum(points, len(table) - 1)]
    values = np.where(solid, points, np.uint32(32))
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    keep[offsets[:-1]] = solid[offsets[:-1]]
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])
    return values[keep], ends[offsets]


_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters or digits; beyond the basic plane all count."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalnum() for c in range(0x10000)] + [True]))
    return _LETTERS[0]


@dataclass
class Index:
    """The q-grams of a block of items: sorted hashes, and item and place of each."""

    ids: np.ndarray
    points: list[np.ndarray]
    edits: np.ndarray
    least: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    some: np.ndarray
    begin: np.ndarray
    steps: int

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose hash the items have, and its number."""
        top = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        at = np.flatnonzero(self.some[top])
        wanted, where = hashes[at], self.begin[top[at]]
        for _ in range(self.steps):
            where = where + (self.hashes[where] < wanted)
        same = self.hashes[where] == wanted
        return at[same], where[same]


def build_index(ids: list[int], texts: list[str], q: int = Q, percent: int = EDIT_PERCENT,
                least_chars: int = LEAST_CHARS) -> Index | None:
    """Items of fewer than ``least_chars`` normal characters are left out, as are such
    whose edit budget leaves no shared q-gram to count."""
    points, offsets = normal(texts)
    kept, cut = [], []
    for number, (start, end) in enumerate(zip(offsets[:-1], offsets[1:])):
        chars = points[start:end]
        chars = chars[:-1] if len(chars) and chars[-1] == 32 else chars
        budget = len(chars) * percent // 100
        if len(chars) >= least_chars and len(chars) - q + 1 - q * budget >= 1:
            kept.append(number)
            cut.append(chars)
    if not kept:
        return None
    grams = [gram_hashes(c, q) for c in cut]
    item = np.repeat(np.arange(len(cut)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams])
    flat = np.concatenate(grams)
    order = np.argsort(flat, kind="stable")
    hashes, first = np.unique(flat[order], return_index=True)
    top = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    number = np.bincount(top, minlength=1 << FILTER_BITS)
    lengths = np.array([len(c) for c in cut])
    edits = lengths * percent // 100
    return Index(np.array([ids[k] for k in kept]), cut, edits, lengths - q + 1 - q * edits,
                 np.append(hashes, np.uint64(2**64 - 1)), np.append(first, [len(flat)] * 2),
                 item[order], place[order], number > 0, np.cumsum(number) - number,
                 int(number.max()))


def _candidates(index: Index, points: np.ndarray, offsets: np.ndarray, q: int):
    """Item and first diagonal of each band with enough shared q-grams, over all texts of
    a slice laid end to end. A band is two cells of k + 1 diagonals, the next starts one
    cell on, so any k + 1 neighbouring diagonals lie in one."""
    at, where = index.lookup(gram_hashes(points, q))
    number = index.first[where + 1] - index.first[where]
    ends = np.cumsum(number)
    lengths = np.array([len(p) for p in index.points])
    cells = len(points) + int(lengths.max()) + 3
    places = int(lengths.max())
    keys = []
    start = 0
    while start < len(at):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + HITS_AT_ONCE, "right")))
        n = number[start:stop]
        entry = (np.repeat(index.first[where[start:stop]], n) + np.arange(int(n.sum()))
                 - np.repeat(np.cumsum(n) - n, n))
        item = index.item[entry]
        width = index.edits[item] + 1
        diagonal = np.repeat(at[start:stop], n) - index.place[entry]
        cell = (diagonal + lengths[item]) // width + 1
        keys.append(distinct((item * cells + cell) * places + index.place[entry]))
        start = stop
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # An item's q-gram counts once in a cell, however often the text repeats it there.
    seen = distinct(np.concatenate(keys)) // places
    begin = np.flatnonzero(np.append(True, seen[1:] != seen[:-1]))
    key, count = seen[begin], np.diff(np.append(begin, len(seen)))
    follows = np.append(key[1:] == key[:-1] + 1, False)
    both = count + np.where(follows, np.append(count[1:], 0), 0)
    # Bands that begin at a cell with hits, and at the empty cell before one.
    first = both >= index.least[key // cells]
    lone = (count >= index.least[key // cells]) & ~np.append(False, follows[:-1])
    bands = np.concatenate([key[first], key[lone] - 1])
    item, cell = bands // cells, bands % cells
    return item, (cell - 1) * (index.edits[item] + 1) - lengths[item]


def align(index: Index, points: np.ndarray, item: np.ndarray, first: np.ndarray,
          low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edits of each item within its band of diagonals, and the diagonal it ends on.

    The item may begin at any diagonal of the band and stays within it and within
    low .. high of the text. All candidates advance by one item character at a time.
    """
    lengths = np.array([len(index.points[i]) for i in item])
    band = 2 * (index.edits[item] + 1)
    width = int(band.max())
    span = np.arange(width)
    letters = np.zeros((len(item), int(lengths.max())), np.uint32)
    for row, i in enumerate(item):
        letters[row, :lengths[row]] = index.points[i]
    outside = np.int32(1 << 20)
    cost = np.where((span < band[:, None]) & (first[:, None] + span <= high[:, None])
                    & (first[:, None] + span >= low[:, None] - lengths[:, None]), 0, outside
                    ).astype(np.int32)
    cost = np.where(first[:, None] + span < low[:, None],
                    np.minimum(outside, cost + (low[:, None] - first[:, None] - span)), cost
                    ).astype(np.int32)
    best = np.full(len(item), outside)
    where = np.zeros(len(item), np.int64)
    for row in range(letters.shape[1]):
        at = first[:, None] + span + row
        inside = (at >= low[:, None]) & (at < high[:, None])
        differs = points[np.clip(at, 0, len(points) - 1)] != letters[:, row:row + 1]
        through = np.where(inside, cost + differs, np.where(at < low[:, None], cost, outside))
        skipped = np.full_like(cost, outside)
        skipped[:, :-1] = cost[:, 1:] + 1
        step = np.minimum(through, skipped)
        step = np.minimum.accumulate(step - span, axis=1) + span
        cost = np.where(span < band[:, None], np.minimum(step, outside), outside).astype(np.int32)
        done = np.flatnonzero(lengths == row + 1)
        if len(done):
            best[done] = cost[done].min(axis=1)
            where[done] = cost[done].argmin(axis=1) + first[done]
    return best, where


def find(index: Index, texts: list[str], q: int = Q):
    """(text number, item number, edits, place) of every band in which an item is found
    within its budget."""
    points, offsets = normal(texts)
    item, first = _candidates(index, points, offsets, q)
    rows = []
    # A band may lie across the border of two texts; each of them is then tried.
    lengths = np.array([len(p) for p in index.points])
    begin = np.searchsorted(offsets, np.clip(first, 0, None), "right") - 1
    finish = np.searchsorted(offsets, np.minimum(
        first + 2 * (index.edits[item] + 1) + lengths[item], len(points) - 1), "right") - 1
    for_band = finish - begin + 1
    owner = np.repeat(np.arange(len(item)), for_band)
    text = (np.repeat(begin, for_band) + np.arange(int(for_band.sum()))
            - np.repeat(np.cumsum(for_band) - for_band, for_band))
    text = np.clip(text, 0, len(texts) - 1)
    long_enough = (offsets[text + 1] - offsets[text]
                   >= lengths[item[owner]] - index.edits[item[owner]])
    owner, text = owner[long_enough], text[long_enough]
    order = np.argsort(lengths[item[owner]], kind="stable")
    owner, text = owner[order], text[order]
    start = 0
    while start < len(owner):
        widest = 2 * (index.edits[item[owner[start:]]].max() + 1) if len(owner) else 1
        stop = min(len(owner), start + max(1, ALIGNED_CELLS // int(widest)))
        part, of = owner[start:stop], text[start:stop]
        best, where = align(index, points, item[part], first[part], offsets[of], offsets[of + 1])
        for k in np.flatnonzero(best <= index.edits[item[part]]):
            rows.append((int(of[k]), int(item[part[k]]), int(best[k]),
                         int(where[k] - offsets[of[k]])))
        start = stop
    return rows


def _find_batches(batches, index: Index, q: int):
    for batch in slices(batches, chars=SLICE):
        found = find(index, texts_of(batch.column("text")), q)
        ids = batch.column("_key").to_pylist()
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for text, item, edits, at in found:
            best[text, item] = min(best.get((text, item), (edits, at)), (edits, at))
        columns = ([ids[t] for t, _ in best], [int(index.ids[i]) for _, i in best],
                   [e for e, _ in best.values()], [len(index.points[i]) for _, i in best],
                   [a for _, a in best.values()])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, _FOUND.types)], schema=_FOUND)


def _blocks(benchmark: DataFrame, block_chars: int):
    """Items in blocks of bounded size, as they come from the workers one by one."""
    ids, texts, size = [], [], 0
    rows = (benchmark.select(F.col("item_id").cast("bigint"), "text")
            .filter("item_id IS NOT NULL AND text IS NOT NULL").distinct())
    for row in rows.toLocalIterator():
        if texts and size + len(row.text) > block_chars:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text)
    if texts:
        yield ids, texts


def find_passages(docs: DataFrame, benchmark: DataFrame, q: int = Q,
                  percent: int = EDIT_PERCENT, least_chars: int = LEAST_CHARS,
                  block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, edits, item_chars, at`` of every benchmark item in a document.

    One row for each document and item: the occurrence with the fewest edits, the first
    of those; ``at`` is its place in the normal text, from the diagonal it ends on. An
    item is found where it aligns, whole, with at most ``percent`` edits for 100 of its
    characters. Null and empty texts hold nothing, rows with a null doc_id or item_id
    take no part, repeated rows are reported once, items of fewer than ``least_chars``
    characters are not looked for. No rows on either side give none. Other columns are
    not read. Items are indexed in blocks of at most ``block_chars`` characters (or one
    item), and every block is looked for in all documents.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_key"), "text").filter(
        "_key IS NOT NULL")
    found = None
    for ids, texts in _blocks(benchmark, block_chars):
        index = build_index(ids, texts, q, percent, least_chars)
        if index is None:
            continue
        part = rows.mapInArrow(
            partial(_find_batches, index=index, q=q),
            "_key bigint, item_id bigint, edits bigint, item_chars bigint, at bigint")
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame(
            [], "_key bigint, item_id bigint, edits bigint, item_chars bigint, at bigint")
    return (found.groupBy(F.col("_key").alias("doc_id"), "item_id")
            .agg(F.min(F.struct("edits", "at", "item_chars")).alias("_best"))
            .select("doc_id", "item_id", "_best.edits", "_best.item_chars", "_best.at"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, of documents that hold no benchmark item.

    Rows with a null doc_id cannot be told apart and stay.
    """
    hit = materialize(find_passages(docs, benchmark, **options)
                      .select(F.col("doc_id").alias("_hit")).distinct())
    return docs.hint("merge").join(hit, docs["doc_id"] == hit["_hit"], "left_anti")
