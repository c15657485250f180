"""Near-duplicate documents by circulant MinHash, confirmed on full shingle sets.

Documents with equal shingle sets form a class, whose smallest doc_id represents it. Two
permutations sign a set: the first spreads the shingles over a ring of places, the second
gives every place a rank; coordinate k of the signature is the smallest rank found k
places further round the ring. Coordinates are cut into bands. Where several classes
share a band they are compared with the smallest class there, the hub, never with each
other, so a band shared by a third of all rows stays linear. Links between two classes of
a hub that the hub itself does not connect are found exactly by ``_beside_hub``.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.llm.components import smallest_reachable
from opsmetrics.llm.tables import materialize
from opsmetrics.llm.text import WORD_FACTOR, mix, shingle_sets, slices, texts_of

RING = 1 << 20
ROWS_PER_BAND = 6
BLOCK = 4096

_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()),
                     ("set_a", pa.int64()), ("set_b", pa.int64()),
                     ("bands", pa.list_(pa.int64()))])
_SETS = pa.schema([*list(_SIGNED)[:4], ("shingles", pa.list_(pa.int64()))])
_SET_KEY = "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint"


def bands_for(percent: int, rows: int = ROWS_PER_BAND, miss: float = 1e-6) -> int:
    """Bands needed to miss a pair at the threshold with a chance of at most ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-(percent / 100) ** rows))


def circulant_tables(coordinates: int, seed: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """The place of each shingle on the ring, and for each place the ranks of it and the
    ``coordinates - 1`` places after it (a view, so the shifts cost no memory)."""
    random = np.random.default_rng(seed)
    places = random.permutation(RING).astype(np.uint32)
    ranks = random.permutation(RING).astype(np.uint32)
    ring = np.concatenate([ranks, ranks[:coordinates - 1]])
    return places, np.lib.stride_tricks.sliding_window_view(ring, coordinates)


def signature(shingles: np.ndarray, places: np.ndarray, shifted: np.ndarray) -> np.ndarray:
    """The smallest rank at every shift, block by block so that long texts fit."""
    at = places[(shingles & np.uint64(RING - 1)).astype(np.int64)]
    least = np.full(shifted.shape[1], RING, np.uint32)
    for start in range(0, len(at), BLOCK):
        np.minimum(least, shifted[at[start:start + BLOCK]].min(axis=0), out=least)
    return least


def _band_hashes(least: np.ndarray, bands: int) -> np.ndarray:
    total = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, -1).T:
        total = mix(total * WORD_FACTOR + column)
    return total.view(np.int64)


def _described(batch: pa.RecordBatch, sets: list[np.ndarray], last: list, schema: pa.Schema):
    """A batch of doc_id, set size, a 128-bit hash of the set, and one list column."""
    sums = [[int(mix(s ^ key).sum(dtype=np.uint64).view(np.int64)) for s in sets]
            for key in (np.uint64(0), WORD_FACTOR)]
    columns = [[len(s) for s in sets], *sums, last]
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), *[pa.array(x, t) for x, t in zip(columns, schema.types[1:])]],
        schema=schema)


def _sign(batches, size: int, bands: int, rows: int):
    places, shifted = circulant_tables(bands * rows)
    for batch in slices(batches):
        sets = shingle_sets(texts_of(batch.column("text")), size)
        yield _described(batch, sets, [
            _band_hashes(signature(s, places, shifted), bands) if len(s) else None
            for s in sets], _SIGNED)


def _sets(batches, size: int):
    for batch in slices(batches):
        sets = shingle_sets(texts_of(batch.column("text")), size)
        yield _described(batch, sets, [s.view(np.int64) for s in sets], _SETS)


def _one_of_each(df: DataFrame, column: str) -> DataFrame:
    """One row for each doc_id: the one with the smallest set key."""
    order = ["n_shingles", "set_a", "set_b", column]
    return (df.groupBy("doc_id").agg(F.min(F.struct(*order)).alias("_row"))
            .select("doc_id", "_row.*"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Per document: ``doc_id, n_shingles, component_id, kept``.

    Documents whose sets of ``size``-word shingles have a Jaccard similarity of
    ``percent`` / 100 or more are linked; ``component_id`` is the smallest doc_id that
    links reach and ``kept`` marks that document. Texts that are null, empty or without
    words have no shingles and are linked with nothing. Rows without a doc_id are left
    out; of rows that repeat a doc_id the one with the smallest set key counts. Columns
    besides doc_id and text are not read. No rows give none. This runs jobs.
    """
    bands = bands_for(percent)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(
        "doc_id IS NOT NULL")
    signed = materialize(_one_of_each(source.mapInArrow(
        partial(_sign, size=size, bands=bands, rows=ROWS_PER_BAND),
        f"{_SET_KEY}, bands array<bigint>"), "bands"))

    by_set = ["n_shingles", "set_a", "set_b"]
    classes = materialize(
        signed.filter("n_shingles > 0").groupBy(*by_set)
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    ring = classes.select("rep", F.explode("bands").alias("band"))
    hubs = ring.groupBy("band").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("n"))
    pairs = materialize(
        ring.join(hubs.filter("n > 1"), "band").filter("rep <> hub")
        .select("hub", "rep").distinct())

    wanted = pairs.select(F.explode(F.array("hub", "rep")).alias("doc_id")).distinct()
    sets = materialize(_one_of_each(
        source.hint("merge").join(wanted, "doc_id", "left_semi")
        .mapInArrow(partial(_sets, size=size), f"{_SET_KEY}, shingles array<bigint>"),
        "shingles").select("doc_id", "shingles"))
    compared = materialize(_compared(pairs, sets, percent))
    links = compared.filter("linked").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    joined = materialize(smallest_reachable(links))
    more = materialize(_beside_hub(compared, joined, sets, percent))
    if not more.isEmpty():
        joined = smallest_reachable(more.union(joined.toDF("a", "b")))
    return (
        signed.select("doc_id", *by_set)
        .join(classes.select(*by_set, "rep"), by_set, "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select("doc_id", "n_shingles",
                F.coalesce("component", "rep", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id")))


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact similarity of every hub and class, and the shingles only one of them has."""
    left = sets.select(F.col("doc_id").alias("hub"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("rep"), F.col("shingles").alias("y"))
    return (
        pairs.hint("merge").join(left, "hub").hint("merge").join(right, "rep")
        .select("hub", "rep", F.size("x").alias("n_hub"), F.size("y").alias("n"),
                F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("apart"))
        .withColumn("n_apart", F.size("apart"))
        .withColumn("linked", _similar(F.col("n_hub") + F.col("n"), F.col("n_apart"), percent)))


def _similar(total, apart, percent: int):
    """100 * intersection >= percent * union, from |x| + |y| and |x xor y|."""
    return (100 - percent) * total >= (100 + percent) * apart


def _beside_hub(compared: DataFrame, joined: DataFrame, sets: DataFrame,
                percent: int) -> DataFrame:
    """Links between two classes of one hub that ``joined`` does not connect yet. One of
    them, x, is then open: not connected to the hub, so not linked to it either.

    Write D(x) for the shingles that only one of x and the hub has. |x xor y| is
    |D(x)| + |D(y)| - 2 |D(x) & D(y)|, so a link of y with an x too far from the hub
    needs more than (1 - s) / 2 of D(y) in common, where s = (100 - p) / (100 + p).
    Likewise |D(x)| - |x xor y| of D(x) has to be common. Rare shingles come first in
    both, and two sets that need c in common share one of the first |D| - c + 1 of each:
    mostly their own edits, which other near copies do not have. Candidates are then
    confirmed in full.
    """
    slack = (100 - percent) / (100 + percent)
    of_rep = joined.select(F.col("node").alias("rep"), F.col("component").alias("_rep_in"))
    of_hub = joined.select(F.col("node").alias("hub"), F.col("component").alias("_hub_in"))
    known = (
        compared.join(of_rep, "rep", "left").join(of_hub, "hub", "left")
        .withColumn("inside", F.coalesce("_rep_in", "rep"))
        .withColumn("open", F.col("inside") != F.coalesce("_hub_in", "hub")))
    far = known.filter("open").select("hub").distinct()
    around = materialize(known.join(far, "hub", "left_semi").select(
        "hub", "rep", "n", "n_apart", "open", "inside", "apart"))
    parts = around.select("hub", "rep", F.explode("apart").alias("s"))
    often = (parts.groupBy("hub", "s").agg(F.count(F.lit(1)).alias("often")))
    ranked = (
        around.select("hub", "rep", "n", "n_apart", "open", "inside",
                      F.explode("apart").alias("s"))
        .join(often, ["hub", "s"])
        .groupBy("hub", "rep")
        .agg(F.first("n").alias("n"), F.first("n_apart").alias("n_apart"),
             F.first("open").alias("open"), F.first("inside").alias("inside"),
             F.array_sort(F.collect_list(F.struct("often", "s"))).alias("apart")))
    # The least that x and y have in common, from the far side and from any side.
    most = F.floor(F.col("n") * ((100 - percent) / percent) + 1e-6)
    far_least = F.greatest(F.lit(1), F.col("n_apart") - most)
    any_least = F.floor(F.col("n_apart") * ((1 - slack) / 2) - 1e-6) + 1

    def side(frame, least, name):
        """The first shingles of each set with their places, without those no other has."""
        first = F.slice("apart", 1, F.greatest(
            F.lit(1), (F.col("n_apart") - least + 1).cast("int")))
        placed = F.transform(first, lambda e, i: F.struct(
            e["s"].alias("s"), e["often"].alias("often"), (i + 1).alias("place")))
        return (
            frame.select("hub", F.explode(F.filter(placed, lambda e: e["often"] > 1)).alias("e"),
                         F.col("rep").alias(name), F.col("n").alias(f"n_{name}"),
                         F.col("n_apart").alias(f"apart_{name}"),
                         F.col("open").alias(f"open_{name}"),
                         F.col("inside").alias(f"inside_{name}"))
            .withColumns({"s": F.col("e.s"), f"place_{name}": F.col("e.place")}).drop("e"))

    ranked = materialize(ranked)
    x = side(ranked.filter("open"), far_least, "x")
    y = side(ranked, any_least, "y")
    # What this very pair needs in common, how far its first common shingle may be, and what
    # two equal orders can still have in common before and after a shingle at these places.
    shared = F.greatest(F.lit(1), F.ceil(
        (F.col("apart_x") + F.col("apart_y") - slack * (F.col("n_x") + F.col("n_y"))) / 2 - 1e-6))
    close = (
        (x["hub"] == y["hub"]) & (x["s"] == y["s"]) & (F.col("inside_x") != F.col("inside_y"))
        & (~F.col("open_y") | (F.col("x") < F.col("y")))
        & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y"))
        & (F.col("place_x") <= F.col("apart_x") - shared + 1)
        & (F.col("place_y") <= F.col("apart_y") - shared + 1)
        & (F.least("place_x", "place_y")
           + F.least(F.col("apart_x") - F.col("place_x"), F.col("apart_y") - F.col("place_y"))
           >= shared))
    candidates = materialize(x.join(y, close).select(F.col("x").alias("hub"),
                                                     F.col("y").alias("rep")).distinct())
    return (_compared(candidates, sets, percent).filter("linked")
            .select(F.col("hub").alias("a"), F.col("rep").alias("b")))


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each component stays.

    Rows are compared, not ids: different texts of one doc_id, and texts without one, go only
    if they are near copies of another. Of a component the smallest doc_id stays, a null one
    last, and of several texts or rows of that id the first by a hash of the row. Rows
    whose text is null, empty or without words are near copies of nothing and all stay, in
    repeated rows too. All columns are returned, whatever their names. No rows give none. This
    runs jobs.
    """
    has_words = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.filter(has_words).select(
        F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"),
        "text", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("_text_key"),
        F.xxhash64(*hashed).alias("_order"))
    near = near_duplicates(rows.select(F.col("_text_key").alias("doc_id"), "text"), size, percent)
    ids = rows.groupBy("_text_key").agg(F.min("doc_id").alias("_id"))
    kept = materialize(
        ids.join(near.select("doc_id", "component_id"), F.col("_text_key") == near["doc_id"])
        .groupBy("component_id").agg(F.min(F.struct(
            F.col("_id").isNull().alias("none"), "_id", "_text_key"))["_text_key"].alias("_kept"))
        .select("_kept"))
    one = (
        rows.hint("merge").join(kept, F.col("_text_key") == F.col("_kept"), "left_semi")
        .groupBy("_text_key").agg(F.min_by("_row", "_order").alias("_row")).select("_row.*"))
    return one.unionByName(docs.filter(~has_words))
