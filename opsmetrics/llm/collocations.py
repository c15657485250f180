"""Phrases whose words belong together, by best-first growth with bounds.

With f the number of occurrences in a language, a phrase of two or three words with a = f
scores the least a * a / (f(first part) * f(rest)) of its cuts, and counts only if no longer
phrase around it has half of its occurrences or more. Phrases grow from their prefixes:

- a phrase is no more frequent than its words and shorter phrases, so only frequent words
  are paired and only frequent pairs grow;
- with c the number of a pair, a phrase of three words that begins with it scores at most
  c / f(first word), and one that ends with it at most c / f(last word): the bounds;
- the frontier of a language is a limit on scores, at first what twice as many pairs as are
  asked for reach. Grown are pairs whose bounds reach the limit, as only they can lead to such
  a phrase, and pairs that reach it themselves, as longer phrases may drop them. So all
  phrases at or above the limit are known with their ties. Languages with fewer of them than
  asked for go on with a frontier of four times as many pairs, until nothing is left to grow.

Words and phrases are keyed by 64-bit hashes of language and words; counts are exact, and
products are decimals. What tasks know of frequent words and of the frontier are filters of
a fixed number of bits; they may let more through, which the joins with the counts drop.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.llm.tables import materialize
from opsmetrics.llm.text import (
    WORD_FACTOR, code_points, lower_ascii, mix, run_hashes, runs, slices, texts_of)

# What ends a piece, what parts words, and the name of no language.
ENDS = [ord(c) for c in ".,;:!?\n\v\f\r"]
BLANKS = [ord(c) for c in " \t"]
NO_LANG = "und"
MILLION = 1_000_000

WORD_BITS = 26
PAIR_BITS = 25
SLICE = 1 << 20
SALTS = 64

# What a pair may be: the begin or the end of a phrase, a phrase itself, and frequent.
BEGINS, ENDS_IT, PHRASE, FREQUENT = 1, 2, 4, 8


def _class_table() -> np.ndarray:
    """0 for characters of words, 1 for blanks, 2 for ends of pieces."""
    table = np.zeros(128, np.uint8)
    table[BLANKS] = 1
    table[ENDS] = 2
    return table


def lang_key(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Words:
    """The words of a slice: keys, text numbers, and whether the next word follows in the
    same piece."""

    def __init__(self, batch: pa.RecordBatch):
        points, offsets = code_points(texts_of(batch.column("text")))
        self.points = lower_ascii(points)
        kind = np.where(self.points < 128, _class_table()[np.minimum(self.points, 127)], 0)
        self.starts, self.ends, self.text = runs(kind == 0, offsets)
        self.langs = batch.column("lang").to_pylist()
        of_lang = {lang: lang_key(lang) for lang in set(self.langs)}
        langs = np.array([of_lang[lang] for lang in self.langs], np.uint64)
        self.keys = mix(run_hashes(self.points, self.starts, self.ends) * WORD_FACTOR
                        + langs[self.text])
        ended = np.cumsum(kind == 2)[self.starts] if len(self.starts) else self.starts
        self.follows = (ended[1:] == ended[:-1]) & (self.text[1:] == self.text[:-1])

    def word(self, i: int) -> str:
        return self.points[self.starts[i]:self.ends[i]].tobytes().decode("utf-32-le")


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * WORD_FACTOR + second)


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(keys.view(np.int64))


def _count_words(batches):
    for batch in slices(batches, chars=SLICE):
        words = Words(batch)
        keys, first, n = np.unique(words.keys, return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array([words.langs[i] for i in words.text[first]], pa.string()), _signed(keys),
             pa.array([words.word(i) for i in first], pa.string()), pa.array(n.astype(np.int64))],
            names=["lang", "key", "word", "n"])


def _count_pairs(batches, frequent: np.ndarray):
    """Pairs of words that may both be frequent."""
    for batch in slices(batches, chars=SLICE):
        words = Words(batch)
        slot = words.keys & np.uint64((1 << WORD_BITS) - 1)
        often = (frequent[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)) > 0
        at = np.flatnonzero(words.follows & often[:-1] & often[1:])
        first, second = words.keys[at], words.keys[at + 1]
        _, one, n = np.unique(pair_keys(first, second), return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [_signed(first[one]), _signed(second[one]), pa.array(n.astype(np.int64))],
            names=["k1", "k2", "n"])


def _flags_of(keys: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    slot = keys >> np.uint64(64 - PAIR_BITS)
    return (filter_[slot >> np.uint64(4)] >> (np.uint64(4) * (slot & np.uint64(15)))).astype(
        np.uint8) & 15


def _count_triples(batches, filter_: np.ndarray):
    """Phrases of three words that the frontier lets grow from their pairs."""
    for batch in slices(batches, chars=SLICE):
        words = Words(batch)
        key = words.keys
        flags = np.where(words.follows, _flags_of(pair_keys(key[:-1], key[1:]), filter_), 0)
        begin, end = flags[:-1], flags[1:]
        grown = ((begin & BEGINS > 0) & (end & ENDS_IT > 0)) | ((begin | end) & PHRASE > 0)
        at = np.flatnonzero(grown & (begin & end & FREQUENT > 0))
        parts = key[at], key[at + 1], key[at + 2]
        _, one, n = np.unique(pair_keys(pair_keys(*parts[:2]), parts[2]),
                              return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays(
            [*[_signed(k[one]) for k in parts], pa.array(n.astype(np.int64))],
            names=["k1", "k2", "k3", "n"])


def _slots(batches):
    """The place of each pair in the filter, 16 to a number, and its flags there."""
    for batch in batches:
        k1, k2, flags = [batch.column(c).to_numpy(zero_copy_only=False)
                         for c in ("k1", "k2", "flags")]
        slot = pair_keys(k1.view(np.uint64), k2.view(np.uint64)) >> np.uint64(64 - PAIR_BITS)
        bits = flags.astype(np.uint64) << (np.uint64(4) * (slot & np.uint64(15)))
        yield pa.RecordBatch.from_arrays(
            [_signed(slot >> np.uint64(4)), _signed(bits)], names=["at", "bits"])


def _filter(marks: DataFrame, size: int) -> np.ndarray:
    """``at, bits`` as an array of ``size`` numbers."""
    table = marks.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    filter_ = np.zeros(size, np.uint64)
    filter_[table.column("at").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return filter_


def _share(number: str, *parts: str) -> str:
    """SQL of floor(1000000 * number / the product of the parts), in exact decimals."""
    exact = [f"cast({p} as decimal(20,0))" for p in (number, *parts)]
    above = " * ".join([f"cast({MILLION} as decimal(7,0))", *exact[:1] * len(parts)])
    return f"cast(({above}) div ({' * '.join(exact[1:])}) as bigint)"


def collocations(docs: DataFrame, top: int = 2000, least: int = 10,
                 percent: int = 50) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language.

    Texts are lower-cased in A-Z, cut into pieces at ``.,;:!?`` and U+000A-U+000D, and those
    into words at spaces and tabs. Phrases have two or three words in a piece and ``least``
    occurrences; ``a``, ``l`` and ``r`` count the phrase and the parts of its lowest-scoring
    cut, the first of equally low ones, and ``n`` all words of the language. A phrase is left
    out if a longer one around it has ``percent`` in 100 of its occurrences or more. The order
    is by score, then ``a``, both from above, then phrase. A null language is ``und``; null
    and empty texts have no words; repeated rows count again; other columns are not read. No
    rows give none. This runs jobs.
    """
    source = docs.select(F.coalesce("lang", F.lit(NO_LANG)).alias("lang"), "text")
    words = materialize(
        source.mapInArrow(_count_words, "lang string, key bigint, word string, n bigint")
        .groupBy("lang", "key", "word").agg(F.sum("n").alias("n")))
    pairs = _pairs(source, words, least)
    todo, frontier, found = pairs, 2 * top, []
    while True:
        limits = materialize(_limits(todo, frontier))
        reached = materialize(_reached(source, todo.join(limits, "lang"), least, percent))
        there = reached.groupBy("lang").agg(F.count(F.lit(1)).alias("there"))
        left = materialize(
            limits.filter("limit > 0").join(there, "lang", "left")
            .filter(F.coalesce("there", F.lit(0)) < top).select("lang"))
        if left.isEmpty():
            found.append(reached)
            break
        found.append(reached.join(left, "lang", "left_anti"))
        todo = materialize(todo.join(left, "lang", "left_semi"))
        frontier *= 4
    phrases = found[0]
    for more in found[1:]:
        phrases = phrases.unionByName(more)

    for k in ("k1", "k2", "k3"):
        text = words.filter(F.col("n") >= least).select(
            F.col("key").alias(k), F.col("word").alias(f"word_{k}"))
        phrases = phrases.join(text, k, "left")
    named = phrases.select(
        "lang", F.concat_ws(" ", "word_k1", "word_k2", "word_k3").alias("phrase"), "a", "l", "r",
        "score")
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = Window.partitionBy("lang", "_salt").orderBy(*order)
    whole = Window.partitionBy("lang").orderBy(*order)
    return (
        named.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
        .withColumn("_place", F.row_number().over(some)).filter(F.col("_place") <= top)
        .withColumn("rank", F.row_number().over(whole).cast("bigint"))
        .filter(F.col("rank") <= top).join(total, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def _pairs(source: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """``lang, k1, k2, a, l, r, score`` of all pairs of words with ``least`` occurrences."""
    often = words.filter(F.col("n") >= least)
    slot = F.col("key").bitwiseAND(F.lit((1 << WORD_BITS) - 1))
    frequent = _filter(often.select(
        F.shiftright(slot, 6).alias("at"),
        F.call_function("shiftleft", F.lit(1).cast("bigint"),
                        slot.bitwiseAND(F.lit(63)).cast("int")).alias("bits")),
        1 << (WORD_BITS - 6))
    counted = (
        source.mapInArrow(partial(_count_pairs, frequent=frequent), "k1 bigint, k2 bigint, n bigint")
        .groupBy("k1", "k2").agg(F.sum("n").alias("a")).filter(F.col("a") >= least))
    first = often.select("lang", F.col("key").alias("k1"), F.col("n").alias("l"))
    second = often.select(F.col("key").alias("k2"), F.col("n").alias("r"))
    return materialize(counted.join(first, "k1").join(second, "k2").select(
        "lang", "k1", "k2", "a", "l", "r", F.expr(_share("a", "l", "r")).alias("score")))


def _limits(pairs: DataFrame, frontier: int) -> DataFrame:
    """``lang, limit``: the score that ``frontier`` pairs of a language reach, 0 if it has
    fewer. Scores are at most a million different ones."""
    down = Window.partitionBy("lang").orderBy(F.desc("score"))
    return (
        pairs.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(down))
        .groupBy("lang").agg(F.coalesce(
            F.max(F.when(F.col("upto") >= frontier, F.col("score"))),
            F.lit(0).cast("bigint")).alias("limit")))


def _reached(source: DataFrame, pairs: DataFrame, least: int, percent: int) -> DataFrame:
    """``lang, k1, k2, k3, a, l, r, score`` of all phrases that reach their language's limit
    and are not dropped; ``pairs`` has the limits."""
    begins, ends = F.expr(_share("a", "l")), F.expr(_share("a", "r"))
    marks = pairs.select("k1", "k2", (
        F.when(begins >= F.col("limit"), BEGINS).otherwise(0)
        + F.when(ends >= F.col("limit"), ENDS_IT).otherwise(0)
        + F.when(F.col("score") >= F.col("limit"), PHRASE).otherwise(0)
        + FREQUENT).alias("flags"))
    filter_ = _filter(marks.mapInArrow(_slots, "at bigint, bits bigint"), 1 << (PAIR_BITS - 4))
    counted = (
        source.mapInArrow(partial(_count_triples, filter_=filter_),
                          "k1 bigint, k2 bigint, k3 bigint, n bigint")
        .groupBy("k1", "k2", "k3").agg(F.sum("n").alias("a")).filter(F.col("a") >= least))
    begin = pairs.select("lang", "limit", "k1", "k2", F.col("a").alias("a12"),
                         F.col("l").alias("f1"))
    end = pairs.select(F.col("k1").alias("k2"), F.col("k2").alias("k3"), F.col("a").alias("a23"),
                       F.col("r").alias("f3"))
    triples = materialize(
        counted.join(begin, ["k1", "k2"]).join(end, ["k2", "k3"])
        .withColumns({"s1": F.expr(_share("a", "f1", "a23")),
                      "s2": F.expr(_share("a", "a12", "f3"))}))
    later = F.col("s2") < F.col("s1")
    scored = triples.select(
        "lang", "limit", "k1", "k2", "k3", "a",
        F.when(later, F.col("a12")).otherwise(F.col("f1")).alias("l"),
        F.when(later, F.col("f3")).otherwise(F.col("a23")).alias("r"),
        F.least("s1", "s2").alias("score"))

    around = (
        triples.select("k1", "k2", "a").union(triples.select("k2", "k3", "a"))
        .groupBy("k1", "k2").agg(F.max("a").alias("longer")))
    alone = (
        pairs.filter(F.col("score") >= F.col("limit")).join(around, ["k1", "k2"], "left")
        .filter(100 * F.coalesce("longer", F.lit(0)) < percent * F.col("a"))
        .withColumn("k3", F.lit(None).cast("bigint")))
    kept = ["lang", "k1", "k2", "k3", "a", "l", "r", "score"]
    return alone.select(*kept).union(
        scored.filter(F.col("score") >= F.col("limit")).select(*kept))
