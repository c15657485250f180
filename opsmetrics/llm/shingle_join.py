"""Exact Jaccard join of word n-gram sets by size-banded tiles and bitmap signatures.

Documents with equal sets form a class. Sets are put in one order, those shingles last that
many documents have, and two sets as similar as asked share one of their first shingles:
with n shingles and a share p of them needed, one of the first n - pn + 1. Classes with a
first shingle in common are compared in two rounds.

The first round compares each with the smallest class there, the hub, and most groups of
near copies are connected by it. The second compares what is still apart, in tiles: the
classes of a shingle are cut into bands of sizes, so that partners are in the same band or
the next, and bands into blocks of bounded length; a tile holds one block of classes that
are not connected to the hub and one block of any. So a shingle that a third of all
documents have is many tiles, and its connected classes meet no other of their kind.

Both rounds compare signatures first. A signature has a bit for every hash value of a band's
size, set if an odd number of shingles have that value. The bits in which two of them differ
are no more than the shingles that only one set has, which bounds the overlap from above.
What passes is verified by intersecting the sorted sets.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.llm.components import smallest_reachable
from opsmetrics.llm.tables import materialize
from opsmetrics.llm.text import WORD_FACTOR, mix, shingle_sets, slices, texts_of

# At most so many shingles are known to be frequent, 16 bytes each; bits of the filter.
FREQUENT = 1 << 20
FILTER = 1 << 26
CHUNK = 1 << 21
BLOCK = 1024
PAIRS_SENT = 1 << 16

_DESCRIBED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()),
                        ("class", pa.int64()), ("bits", pa.binary()),
                        ("shingle", pa.int64()), ("often", pa.int64())])
_TILE = ["shingle", "tile", "left", "right"]


def class_of(shingles: np.ndarray) -> int:
    """A 64-bit name of a set: equal sets have the same."""
    total = mix(shingles ^ WORD_FACTOR).sum(dtype=np.uint64)
    return int(mix(np.array([total + np.uint64(len(shingles))])).view(np.int64)[0])


def prefix_size(n: int, percent: int) -> int:
    """Two sets with 100 * intersection >= percent * union have one of so many first
    shingles in common: at least percent * n / 100 of n are in both."""
    return n + (-percent * n // 100) + 1


def band_of(n, percent: int):
    """The number of the size band. Partners are in the same one or the next: their sizes
    are at most 100 / percent times each other, and a band is a little wider than that."""
    return F.floor(F.log(n) * ((1 - 1e-9) / math.log(100 / percent))).cast("int")


def width_of(n: int, percent: int) -> int:
    """Bits of a signature: a power of two, at least the largest size of the band. Sets without
    a shingle in common then differ in twice as many bits as a link of 80 percent allows, and
    signatures are most of what is shuffled."""
    band = math.floor(math.log(n) * (1 - 1e-9) / math.log(100 / percent))
    return max(64, 1 << math.ceil(math.log2((100 / percent) ** (band + 1))))


def signature(shingles: np.ndarray, width: int) -> bytes:
    """The parity of the number of shingles at each of ``width`` hash values."""
    at = (mix(shingles) & np.uint64(width - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=width) & 1, bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> bytes:
    """The signature of the same set with ``size`` bytes, half or a smaller part of it."""
    while len(bits) > size:
        whole = np.frombuffer(bits, np.uint8).reshape(2, -1)
        bits = (whole[0] ^ whole[1]).tobytes()
    return bits


def _slices_of_sets(batches, size: int):
    for batch in slices(batches):
        yield batch.column("doc_id"), shingle_sets(texts_of(batch.column("text")), size)


def _describe(batches, size: int, percent: int):
    """Doc_id, set size and class of each row, and the signature with the first named row
    of a class in a chunk. Then the shingles that several distinct sets of a chunk have, with
    their number: what many documents have is in more sets than there are chunks, so in
    several of one chunk."""
    known, held, there = set(), [], 0
    for ids, sets in _slices_of_sets(batches, size):
        classes, signs = [class_of(s) for s in sets], []
        for doc_id, name, shingles in zip(ids.to_pylist(), classes, sets):
            new = doc_id is not None and len(shingles) and name not in known
            signs.append(signature(shingles, width_of(len(shingles), percent)) if new else None)
            if new:
                known.add(name)
                held.append(shingles)
                there += len(shingles)
        none = pa.nulls(len(sets), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()),
             pa.array(signs, pa.binary()), none, none], schema=_DESCRIBED)
        if there >= CHUNK:
            yield _often(held)
            known, held, there = set(), [], 0
    if held:
        yield _often(held)


def _often(held: list[np.ndarray]) -> pa.RecordBatch:
    shingles, number = np.unique(np.concatenate(held), return_counts=True)
    shingles, number = shingles[number > 1], number[number > 1]
    none = pa.nulls(len(shingles), pa.int64())
    return pa.RecordBatch.from_arrays(
        [none, none, none, pa.nulls(len(shingles), pa.binary()),
         pa.array(shingles.view(np.int64)), pa.array(number.astype(np.int64))],
        schema=_DESCRIBED)


def first_shingles(shingles: np.ndarray, percent: int, frequent: np.ndarray,
                   numbers: np.ndarray) -> np.ndarray:
    """The prefix of a sorted set: by hash, but frequent ones last and by their number."""
    take = prefix_size(len(shingles), percent)
    if not len(frequent):
        return shingles[:take]
    place = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    often = frequent[place] == shingles
    rare = shingles[~often][:take]
    if len(rare) == take:
        return rare
    rest, number = shingles[often], numbers[place[often]]
    return np.concatenate([rare, rest[np.lexsort((rest, number))][:take - len(rare)]])


def _post(batches, size: int, percent: int, frequent: np.ndarray, numbers: np.ndarray):
    """(class, shingle, place) of the prefix of each distinct set of a task."""
    known = set()
    for _, sets in _slices_of_sets(batches, size):
        classes, firsts = [], []
        for shingles in sets:
            name = class_of(shingles)
            if len(shingles) and name not in known:
                known.add(name)
                firsts.append(first_shingles(shingles, percent, frequent, numbers))
                classes.append(np.full(len(firsts[-1]), name))
        if firsts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(classes)), pa.array(np.concatenate(firsts).view(np.int64)),
                 pa.array(np.concatenate([np.arange(1, len(f) + 1, dtype=np.int32)
                                          for f in firsts]))],
                names=["class", "shingle", "place"])


def _sets(batches, size: int, filter_: np.ndarray):
    """(class, shingles) of the rows whose place in the filter is marked."""
    for batch in batches:
        slot = batch.column("slot").to_numpy(zero_copy_only=False)
        marked = filter_[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)
        for _, sets in _slices_of_sets([batch.filter(pa.array(marked.astype(bool)))], size):
            full = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([class_of(s) for s in full], pa.int64()),
                 pa.array([s.view(np.int64) for s in full], pa.list_(pa.int64()))],
                names=["class", "shingles"])


def _within(apart, total, percent: int):
    """100 * intersection >= percent * union, from |x xor y| and |x| + |y|."""
    return (100 + percent) * apart <= (100 - percent) * total


def _promising(batches, percent: int):
    """The pairs whose sizes and signatures allow a link."""
    for batch in batches:
        keep = []
        for n_a, n_b, a, b in zip(*[batch.column(c).to_pylist()
                                    for c in ("n_a", "n_b", "bits_a", "bits_b")]):
            size = min(len(a), len(b))
            apart = int.from_bytes(folded(a, size)) ^ int.from_bytes(folded(b, size))
            keep.append(_within(max(abs(n_a - n_b), apart.bit_count()), n_a + n_b, percent))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _tiles(batches, percent: int):
    """Promising pairs of each tile, whose rows follow each other. Rows of a tile that a
    batch cuts wait for the next one."""
    waiting = None
    for batch in batches:
        rows = batch if waiting is None else pa.concat_batches([waiting, batch])
        keys = [rows.column(c).to_numpy(zero_copy_only=False) for c in _TILE]
        new = np.zeros(len(rows), bool)
        for key in keys:
            new[1:] |= key[1:] != key[:-1]
        starts = np.concatenate([[0], np.flatnonzero(new)])
        yield from _of_tiles(rows, starts, percent)
        waiting = rows.slice(int(starts[-1]))
    if waiting is not None and len(waiting):
        yield from _of_tiles(waiting, np.array([0, len(waiting)]), percent)


def _of_tiles(rows: pa.RecordBatch, starts: np.ndarray, percent: int):
    names, sizes, places, parts, bands, opens = [
        rows.column(c).to_numpy(zero_copy_only=False)
        for c in ("class", "n", "place", "part", "upper", "open")]
    # The first shingle that two sets have in common has so many after it in each at least.
    after = sizes - places + 1
    bits = rows.column("bits")
    found, there = [], 0
    for start, end in zip(starts[:-1], starts[1:]):
        probe = start + np.flatnonzero(opens[start:end])
        target = start + np.flatnonzero(~opens[start:end])
        if not len(probe) or not len(target):
            continue
        signs = [x.as_buffer().to_pybytes() for x in bits.slice(start, end - start)]
        size = min(map(len, signs))
        matrix = np.frombuffer(b"".join(folded(x, size) for x in signs),
                               np.uint64).reshape(len(signs), -1)
        for i in probe:
            needed = -(-percent * (sizes[target] + sizes[i]) // (100 + percent))
            other = target[(parts[target] != parts[i]) & ~(bands[target] & bands[i])
                           & (np.minimum(after[target], after[i]) >= needed)]
            apart = np.bitwise_count(matrix[other - start] ^ matrix[i - start]).sum(
                axis=1, dtype=np.int64)
            apart = np.maximum(apart, np.abs(sizes[other] - sizes[i]))
            near = other[_within(apart, sizes[other] + sizes[i], percent)]
            if len(near):
                found.append((np.minimum(names[near], names[i]), np.maximum(names[near], names[i])))
                there += len(near)
        if there >= PAIRS_SENT:
            yield _paired(found)
            found, there = [], 0
    yield _paired(found)


def _paired(found) -> pa.RecordBatch:
    columns = [np.concatenate([np.zeros(0, np.int64), *side]) for side in zip(*found)] if found \
        else [np.zeros(0, np.int64)] * 2
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b"])


def linked_documents(docs: DataFrame, size: int = 5, percent: int = 80,
                     block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Documents whose sets of ``size``-word shingles have a Jaccard similarity of ``percent`` /
    100 or more are linked; ``component_id`` is the smallest doc_id that links reach, the
    document itself included. Texts that are null, empty or without words have no shingles
    and are linked with nothing. Rows that repeat a doc_id are each linked by their own
    text. A row without a doc_id has its set size and a null component, and links nothing.
    Columns besides doc_id and text are not read. No rows give none. This runs jobs.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    described = materialize(source.mapInArrow(
        partial(_describe, size=size, percent=percent),
        "doc_id bigint, n_shingles bigint, class bigint, bits binary, shingle bigint, "
        "often bigint"))
    rows = described.filter("class IS NOT NULL").select("doc_id", "n_shingles", "class")
    classes = materialize(
        described.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("class")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"),
             F.first("bits", ignorenulls=True).alias("bits")))
    frequent, numbers = _frequent(described)

    named = source.filter("doc_id IS NOT NULL")
    firsts = named.mapInArrow(
        partial(_post, size=size, percent=percent, frequent=frequent, numbers=numbers),
        "class bigint, shingle bigint, place int").repartition("shingle")
    # Places are at least 1. Asked for here, both uses read the same columns, and so one shuffle.
    ends = (firsts.groupBy("shingle").agg(F.min("class").alias("hub"), F.max("class").alias("_most"),
                                          F.min("place").alias("_least"))
            .filter("hub <> _most AND _least > 0").drop("_most", "_least"))
    shared = materialize(firsts.join(ends.hint("shuffle_hash"), "shingle")
                         .dropDuplicates(["shingle", "class"]))

    def verified(pairs: DataFrame) -> DataFrame:
        return materialize(_verified(*_with_sets(pairs, classes, named, size), percent))

    hubs = shared.filter("class <> hub").select(
        F.col("hub").alias("a"), F.col("class").alias("b")).distinct()
    links = verified(_signed(hubs, classes).mapInArrow(
        partial(_promising, percent=percent), "a bigint, b bigint"))
    parts = materialize(smallest_reachable(links))
    across = verified(
        _tile_rows(shared, parts, classes, percent, block)
        .repartition(*_TILE).sortWithinPartitions(*_TILE)
        .mapInArrow(partial(_tiles, percent=percent), "a bigint, b bigint").distinct())
    if not across.isEmpty():
        parts = materialize(smallest_reachable(across.union(parts.toDF("a", "b"))))

    whole = classes.join(parts, F.col("class") == F.col("node"), "left").select(
        "class", F.coalesce("component", "class").alias("part"), "rep")
    least = whole.groupBy("part").agg(F.min("rep").alias("component_id"))
    of_class = whole.join(least, "part").select("class", "component_id")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("class"))
    return (
        rows.withColumn("class", own).join(of_class, "class", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def _frequent(described: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shingles that make up more than one in ``FREQUENT`` of all each, so at most
    that many, and their numbers. Those are counted in the chunks, which leaves out a
    document in each chunk that has no other with it; the order needs no more."""
    total = described.agg(F.sum("n_shingles")).first()[0] or 0
    table = (described.filter("shingle IS NOT NULL").groupBy("shingle")
             .agg(F.sum("often").alias("often"))
             .filter(F.col("often") > max(2, total / FREQUENT)).toArrow())
    shingles = table.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(shingles)
    return shingles[order], table.column("often").to_numpy()[order]


def _signed(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    for side in "ab":
        pairs = pairs.hint("merge").join(classes.select(
            F.col("class").alias(side), F.col("n").alias(f"n_{side}"),
            F.col("bits").alias(f"bits_{side}")), side)
    return pairs


def _with_sets(pairs: DataFrame, classes: DataFrame, named: DataFrame,
               size: int) -> tuple[DataFrame, DataFrame]:
    """The stored pairs, and the sets of the classes in them. Texts are not shuffled for
    that: a filter of a fixed number of bits says which ids are wanted, and the few other
    rows it lets through have other classes."""
    pairs = materialize(pairs)
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
                         .join(classes.select("class", "rep"), "class"))

    def slot(doc_id: str):
        return F.pmod(F.xxhash64(doc_id), F.lit(FILTER))

    marks = (
        wanted.select(slot("rep").alias("slot")).groupBy(F.shiftright("slot", 6).alias("at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 63))")).alias("bits")).toArrow())
    filter_ = np.zeros(FILTER >> 6, np.uint64)
    filter_[marks.column("at").to_numpy()] = marks.column("bits").to_numpy().view(np.uint64)
    sets = (
        named.select("doc_id", "text", slot("doc_id").alias("slot"))
        .mapInArrow(partial(_sets, size=size, filter_=filter_),
                    "class bigint, shingles array<bigint>")
        .join(wanted.select("class"), "class", "left_semi").dropDuplicates(["class"]))
    return pairs, materialize(sets)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that are linked, by intersecting their sorted sets."""
    for side in "ab":
        pairs = pairs.hint("merge").join(sets.select(
            F.col("class").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    total = F.size("set_a") + F.size("set_b")
    apart = total - 2 * F.size(F.array_intersect("set_a", "set_b"))
    return pairs.filter(_within(apart, total, percent)).select("a", "b")


def _first_of_equal(shared: DataFrame) -> DataFrame:
    """Of the shingles that the same classes have, the first in the order of the sets. A pair
    that meets at another of them meets there too, and earlier."""
    groups = shared.groupBy("hub", "shingle").agg(
        F.min("place").alias("place"), F.count(F.lit(1)).alias("n"),
        F.bit_xor(F.xxhash64("class")).alias("same"))
    return groups.groupBy("hub", "n", "same").agg(
        F.min(F.struct("place", "shingle"))["shingle"].alias("shingle")).select("shingle")


def _tile_rows(shared: DataFrame, parts: DataFrame, classes: DataFrame, percent: int,
               block: int) -> DataFrame:
    """The rows of the tiles: classes with a first shingle in common that no link connects
    yet. Hubs have been compared with all others of their shingles."""
    by_shingle = Window.partitionBy("shingle")
    main = F.min(F.struct("class", "part")).over(by_shingle)["part"]
    known = (
        shared.join(_first_of_equal(shared), "shingle", "left_semi")
        .filter("class <> hub").join(parts, F.col("class") == F.col("node"), "left")
        .select("shingle", "class", "place", F.coalesce("component", "class").alias("part"))
        .withColumn("open", F.col("part") != main)
        .withColumn("any", F.max("open").over(by_shingle)).filter("any").drop("any"))
    banded = (
        known.join(classes.select("class", "n"), "class")
        .withColumn("band", band_of(F.col("n"), percent))
        .withColumn("_t", F.explode(F.array(
            F.struct(F.col("band").alias("tile"), F.lit(False).alias("upper")),
            F.struct((F.col("band") - 1).alias("tile"), F.lit(True).alias("upper")))))
        .select("shingle", "class", "place", "part", "open", "n", "_t.*"))
    in_tile = Window.partitionBy("shingle", "tile")
    in_order = in_tile.orderBy(F.desc("open"), "upper", "n", "class")
    numbered = (
        banded
        .withColumns({"opens": F.sum(F.col("open").cast("int")).over(in_tile),
                      "all": F.count(F.lit(1)).over(in_tile),
                      "lower": F.min("upper").over(in_tile),
                      "apart": F.min("part").over(in_tile) != F.max("part").over(in_tile),
                      "number": ((F.row_number().over(in_order) - 1) / block).cast("int")})
        .filter(F.col("opens") > 0).filter("apart").filter(~F.col("lower")))

    def blocks(column: str):
        return F.explode(F.sequence(F.lit(0), ((F.col(column) - 1) / block).cast("int")))

    kept = ["shingle", "tile", "class", "place", "part", "n", "upper"]
    left = numbered.filter("open").select(
        *kept, F.lit(True).alias("open"), F.col("number").alias("left"),
        blocks("all").alias("right"))
    right = numbered.select(
        *kept, F.lit(False).alias("open"), blocks("opens").alias("left"),
        F.col("number").alias("right"))
    return left.union(right.select(left.columns)).join(classes.select("class", "bits"), "class")
