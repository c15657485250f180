"""Stupid-backoff scores of documents under the n-grams of the whole corpus.

A word's token is the 64-bit hash of its lower-case form, so the vocabulary is as large as
the corpus makes it. With c the counts over all documents and N the number of tokens, a
token scores ln c(h, w) / c(h) after the longest history h of at most ``order`` - 1 words
for which c(h, w) is at least ``least``, and ln c(w) / N if there is none; each word of
history given up costs ln of ``backoff``. The first token of a document has no history.
Written as the sum that gives up all histories plus a correction for each n-gram frequent
enough, a document's score is a sum over its n-grams, each looked up by itself:

- n-grams of every order are counted by a grouped sum into a stored table; words all stay,
  longer ones from ``least`` on;
- corrections come from joins of that table with the counts of the next lower order;
- documents are exploded into n-grams, joined to the corrections by hash partition and
  summed by document;
- heavy keys, each a ``heavy``-th of all tokens or more and so at most ``heavy`` an order,
  are broadcast and never a hot key of a join.

An n-gram's key is a hash of 64 bits too: among three billion keys a quarter of one pair is
expected to share one.

``supported_scores`` is the query's, of order 2, with each text scored ``apart``: what only the
scored text says is no evidence for it, so its own words and pairs are taken off all counts, and
a pair of which nothing is left is given up for the second word alone. Without ``apart`` the
counts cover all texts, and a pair is still given up if no other text has it. One exchange of
exploded words and pairs serves both the count table and its join; a row of it brings along how
often its text has the pair and its words. A pair that others have gains over its second word
alone by the counts of pair and words: those of frequent words are sent to every task, those of
others are looked up once for each such pair.

``seen_scores`` is the case ``least`` = 1. Counts cover the scored document, so
every n-gram has been seen and no history is given up. The counts of histories then cancel
but for one of every n-gram of ``order`` - 1 words inside a document, and a document of at
least that many words scores the sum of ln c over its n-grams of ``order`` words, less that
over its inner ones of ``order`` - 1 words, less ln N. One exchange of exploded n-grams by
hash serves both the count table and its join, and n-grams counted once, as ln 1 is 0, join
nothing.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.llm.tables import materialize
from opsmetrics.llm.text import WORD_FACTOR, mix, slices, texts_of, words

BITS = 64
ORDER = 2
HEAVY = 1000
FREQUENT = 1 << 20
SAMPLE = 16
GRAMS_PER_PART = 1 << 22
SLICE = 1 << 21
# In place of the second word of a pair: the row is of the first word alone, or of two
# frequent words, whose numbers are one number.
ALONE, NUMBERED = -1, -2

_GRAM_SQL = "size int, key bigint, pre bigint, suf bigint, n bigint"


def tokens(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The first ``bits`` bits of the hash of every word, and its text's number."""
    hashes, text = words(texts)
    return (hashes >> np.uint64(64 - bits)).view(np.int64), text


def grams(token: np.ndarray, text: np.ndarray, order: int):
    """For each order: keys of the n-grams, of them without their last and without their
    first word, and their text's number."""
    token = token.view(np.uint64)
    key = token
    yield key, np.zeros_like(key), np.zeros_like(key), text
    for size in range(2, order + 1):
        last = token[size - 1:]
        longer = mix(key[:len(last)] * WORD_FACTOR + last + np.uint64(size))
        inner = text[:len(last)] == text[size - 1:]
        yield longer[inner], key[:len(last)][inner], key[1:][inner], text[:len(last)][inner]
        key = longer


def _count(batches, bits: int, order: int):
    """N-grams of a slice with their counts."""
    for batch in slices(batches, chars=SLICE):
        found = grams(*tokens(texts_of(batch.column("text")), bits), order)
        for size, (key, pre, suf, _) in enumerate(found, 1):
            key, first, n = np.unique(key, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(key), size, np.int32)), pa.array(key.view(np.int64)),
                 pa.array(pre[first].view(np.int64)), pa.array(suf[first].view(np.int64)),
                 pa.array(n.astype(np.int64))], names=["size", "key", "pre", "suf", "n"])


def _explode(batches, bits: int, order: int, heavy: np.ndarray):
    """(doc_id, key) of every n-gram but the heavy ones."""
    for batch in slices(batches, chars=SLICE):
        ids = batch.column("_id").to_numpy(zero_copy_only=False)
        for key, _, _, text in grams(*tokens(texts_of(batch.column("text")), bits), order):
            rest = ~_among(heavy, key)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[text[rest]], pa.int64()), pa.array(key[rest].view(np.int64))],
                names=["doc_id", "key"])


def _among(heavy: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(heavy):
        return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
    place = np.minimum(np.searchsorted(heavy, key), len(heavy) - 1)
    return heavy[place] == key, place


def _without_join(batches, bits: int, order: int, heavy: np.ndarray, scores: np.ndarray,
                  backoff: float):
    """Words of each row, what giving up all histories costs it, and its heavy n-grams."""
    for batch in slices(batches, chars=SLICE):
        token, text = tokens(texts_of(batch.column("text")), bits)
        n = np.bincount(text, minlength=batch.num_rows)
        sums = sum(np.maximum(n - size + 1, 0) for size in range(2, order + 1)) * np.log(backoff)
        sums = np.zeros(len(n)) + sums
        for key, _, _, of in grams(token, text, order):
            there, place = _among(heavy, key)
            if there.any():
                sums += np.bincount(of[there], scores[place[there]], minlength=len(n))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array(n.astype(np.int64)), pa.array(sums)],
            names=["doc_id", "n_words", "total"])


def _looked_up(rows: DataFrame, on: str, table: DataFrame, value: str, hot: str) -> DataFrame:
    """``rows`` with ``value`` of the key ``on`` in ``table``. Keys for which ``hot`` holds are
    broadcast, and their rows spread over the join by a key of their own."""
    few = table.filter(hot).select(F.col("key").alias("_hot"), F.col(value).alias("_few"))
    cold = table.select(F.col("key").alias("_at"), F.col(value).alias("_many"))
    return (
        rows.join(F.broadcast(few), F.col(on) == F.col("_hot"), "left")
        .withColumn("_to", F.when(F.col("_hot").isNull(), F.col(on)).otherwise(F.col("key")))
        .hint("merge").join(cold, F.col("_to") == F.col("_at"), "left")
        .withColumn(f"{on}_{value}", F.coalesce("_few", "_many"))
        .drop("_hot", "_few", "_to", "_at", "_many"))


def corrections(counts: DataFrame, total: int, order: int, heavy: int,
                backoff: float) -> DataFrame:
    """``key, n, score, gain`` of the n-grams in ``counts``: ``score`` is the log share after
    the whole history, ``gain`` what that is above the score after one word less."""
    hot = f"n * {int(heavy)} >= {int(total)}"
    lower = materialize(counts.filter("size = 1").select(
        "key", "n", F.log(F.col("n") / total).alias("score")).withColumn("gain", F.col("score")))
    scored = lower
    for size in range(2, order + 1):
        rows = counts.filter(F.col("size") == size).select("key", "pre", "suf", "n")
        rows = _looked_up(_looked_up(rows, "pre", lower, "n", hot), "suf", lower, "score", hot)
        score = F.log(F.col("n") / F.col("pre_n"))
        lower = materialize(rows.select(
            "key", "n", score.alias("score"),
            (score - float(np.log(backoff)) - F.col("suf_score")).alias("gain")))
        scored = scored.union(lower)
    return scored


def weighted(token: np.ndarray, text: np.ndarray, order: int):
    """For each order: keys of the n-grams, how often the log of their count adds to the score
    of their text, and its number."""
    for size, (key, _, _, of) in enumerate(grams(token, text, order), 1):
        start = np.flatnonzero(text[:max(0, len(text) - size + 1)] == text[size - 1:])
        first = (start == 0) | (text[start - 1] != of)
        after = np.minimum(start + size, len(text) - 1)
        last = (start + size == len(text)) | (text[after] != of)
        if size == order:
            weight = np.ones(len(key), np.int32)
        elif size == order - 1:
            weight = first.astype(np.int32) + last - 1
        else:
            weight = (first & last).astype(np.int32)
        yield key, weight, of


def _frequent_counts(batches, bits: int, order: int, frequent: np.ndarray):
    """Counts of the frequent n-grams in the task, and its number of words under a null key."""
    n, total = np.zeros(len(frequent), np.int64), 0
    for batch in slices(batches, chars=SLICE):
        token, text = tokens(texts_of(batch.column("text")), bits)
        total += len(token)
        for key, _, _, _ in grams(token, text, order):
            there, place = _among(frequent, key)
            n += np.bincount(place[there], minlength=len(n))
    there = n > 0
    yield pa.RecordBatch.from_arrays(
        [pa.array([None, *frequent[there].view(np.int64).tolist()], pa.int64()),
         pa.array([total, *n[there].tolist()], pa.int64())], names=["key", "n"])


def _explode_rare(batches, bits: int, order: int, frequent: np.ndarray):
    """(doc_id, key, n, weight) of the n-grams of each row that are not frequent."""
    for batch in slices(batches, chars=SLICE):
        ids = batch.column("_id").to_numpy(zero_copy_only=False)
        for key, weight, of in weighted(*tokens(texts_of(batch.column("text")), bits), order):
            rest = ~_among(frequent, key)[0]
            key, weight, of = key[rest], weight[rest], of[rest]
            by = np.lexsort((key, of))
            key, weight, of = key[by], weight[by], of[by]
            start = np.flatnonzero(np.append(
                True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]))[:len(key)])
            if len(start):
                n = np.diff(np.append(start, len(key)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[of[start]], pa.int64()), pa.array(key[start].view(np.int64)),
                     pa.array(n.astype(np.int32)),
                     pa.array(np.add.reduceat(weight, start).astype(np.int32))],
                    names=["doc_id", "key", "n", "weight"])


def _frequent_sums(batches, bits: int, order: int, frequent: np.ndarray, logs: np.ndarray,
                   total: int):
    """Words of each row and what its frequent n-grams and the number of all words add."""
    for batch in slices(batches, chars=SLICE):
        token, text = tokens(texts_of(batch.column("text")), bits)
        n = np.bincount(text, minlength=batch.num_rows)
        sums = -np.log(total) * (n if order == 1 else np.minimum(n, 1))
        for key, weight, of in weighted(token, text, order):
            there, place = _among(frequent, key)
            sums += np.bincount(of[there], weight[there] * logs[place[there]],
                                minlength=len(n))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array(n.astype(np.int64)), pa.array(sums)],
            names=["doc_id", "n_words", "total"])


def seen_scores(docs: DataFrame, bits: int = BITS, frequent: int = FREQUENT,
                sample: int = SAMPLE, per_part: int = GRAMS_PER_PART,
                order: int = ORDER) -> DataFrame:
    """``corpus_scores`` for ``least`` = 1: the same columns, and the same results for nulls,
    empty texts, repeated ids and empty tables.

    N-grams that are a ``frequent``-th or more of those of their order in one ``sample``-th of
    the texts are counted over all texts and sent to every task; at most ``frequent`` an order
    are, so at most 32 MB at order 2. The choice moves work only: any choice gives the same
    scores. This runs jobs.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), "text").filter(
        "_id IS NOT NULL")
    some = materialize(
        rows.filter(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0).select("text")
        .mapInArrow(partial(_count, bits=bits, order=order), _GRAM_SQL)
        .groupBy("size", "key").agg(F.sum("n").alias("n")))
    words_of_some = some.filter("size = 1").agg(F.sum("n")).first()[0] or 0
    chosen = some.filter(F.col("n") * frequent >= words_of_some).select("key").toArrow()
    keys = np.unique(chosen.column("key").to_numpy().view(np.uint64))

    found = (rows.select("text").mapInArrow(
        partial(_frequent_counts, bits=bits, order=order, frequent=keys), "key bigint, n bigint")
        .groupBy("key").agg(F.sum("n").alias("n")).toArrow())
    counted = dict(zip(found.column("key").to_pylist(), found.column("n").to_pylist()))
    total = max(1, counted.pop(None, 0))
    keys = np.sort(np.array(list(counted), np.int64).view(np.uint64))
    logs = np.log(np.array([counted[k] for k in keys.view(np.int64).tolist()], float))

    parts = max(1, -(-total * order // per_part))
    exploded = rows.mapInArrow(
        partial(_explode_rare, bits=bits, order=order, frequent=keys),
        "doc_id bigint, key bigint, n int, weight int"
    ).filter("key IS NOT NULL").repartition(parts, "key")
    # Both sides of the join need all columns, so that one exchange serves them.
    counts = (exploded.groupBy("key").agg(
        F.sum("n").alias("n"), F.count("doc_id").alias("docs"),
        F.max(F.abs("weight")).alias("most"))
        .filter("n >= 2 AND docs >= 1 AND most >= 0")
        .select(F.col("key").alias("_key"), F.log("n").alias("log_n")))
    joined = exploded.join(
        counts.hint("shuffle_hash"), F.col("key") == F.col("_key"))
    rest = rows.mapInArrow(
        partial(_frequent_sums, bits=bits, order=order, frequent=keys, logs=logs, total=total),
        "doc_id bigint, n_words bigint, total double")
    return (
        joined.select("doc_id", F.lit(0).cast("bigint").alias("n_words"),
                      F.when(F.col("n") >= 1, F.col("weight") * F.col("log_n")).alias("total"))
        .union(rest).groupBy("doc_id")
        .agg(F.sum("n_words").alias("n_words"), F.sum("total").alias("total"))
        .withColumn("score", F.when(F.col("n_words") > 0, F.col("total") / F.col("n_words"))))


class Places:
    """Places of keys in a sorted array of hashes, found by their first bits."""

    def __init__(self, keys: np.ndarray):
        bits = len(keys).bit_length() + 1
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.start = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def of(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its place."""
        if not len(self.keys):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        last = len(self.keys) - 1
        place = np.minimum(self.start[key >> self.shift], last)
        found = self.keys[place]
        less = np.flatnonzero(found < key)
        while len(less):
            less = less[place[less] < last]
            place[less] += 1
            found[less] = self.keys[place[less]]
            less = less[found[less] < key[less]]
        return found == key, place


def pairs_of(token: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first words of all pairs, and the pairs' keys."""
    (_, _, _, _), (key, _, _, _) = grams(token, text, 2)
    return np.flatnonzero(text[:-1] == text[1:]), key


def _texts_with(batches, bits: int):
    """Words of a slice with their counts (size 1), pairs with how many texts have them (2)."""
    for batch in slices(batches, chars=SLICE):
        token, text = tokens(texts_of(batch.column("text")), bits)
        at, pair = pairs_of(token, text)
        pair, _, _ = _numbered(text[at], pair)
        for size, key in ((1, token.view(np.uint64)), (2, pair)):
            key, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(key), size, np.int32)), pa.array(key.view(np.int64)),
                 pa.array(n.astype(np.int64))], names=["size", "key", "n"])


def _numbered(text: np.ndarray, key: np.ndarray):
    """Each key of each text once, the place of one of it, and how often it is there."""
    by = np.lexsort((key, text))
    key, text = key[by], text[by]
    start = np.flatnonzero(np.append(
        True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]))[:len(key)])
    return key[start], by[start], np.diff(np.append(start, len(key)))


def _own(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each key is in its text; the texts are in order."""
    if not len(key):
        return np.zeros(0, np.int64)
    low, wide = len(key).bit_length(), int(key.max()).bit_length()
    if key.min() >= 0 and low + wide + int(text[-1]).bit_length() < 63:
        # Small keys: text, key and place in one number sort faster than places by text and key.
        packed = np.sort((text << (low + wide)) | (key << low) | np.arange(len(key)))
        by, packed = packed & ((1 << low) - 1), packed >> low
        other = packed[1:] != packed[:-1]
    else:
        by = np.argsort(key, kind="stable")
        key, text = key[by], text[by]
        other = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    group = np.cumsum(np.append(False, other))
    n = np.zeros(len(key), np.int64)
    n[by] = np.bincount(group)[group]
    return n


def _both(words_: Places, pairs: Places, token: np.ndarray, text: np.ndarray):
    """Whether each word is frequent and its number; for all pairs the places of their first
    words, their keys, whether they and both their words are frequent, and their numbers."""
    there, place = words_.of(token.view(np.uint64))
    at, key = pairs_of(token, text)
    seen, number = pairs.of(key)
    return there, place, at, key, seen & there[at] & there[at + 1], number


def _frequent_occurrences(batches, bits: int, words_: np.ndarray, pairs: np.ndarray):
    """How often the frequent words and pairs are in the task, by their number, pairs after
    words, and its number of words under a null one."""
    words_, pairs, total = Places(words_), Places(pairs), 0
    n = [np.zeros(len(of.keys), np.int64) for of in (words_, pairs)]
    for batch in slices(batches, chars=SLICE):
        token, text = tokens(texts_of(batch.column("text")), bits)
        total += len(token)
        for of, so_far, key in ((words_, n[0], token.view(np.uint64)),
                                (pairs, n[1], pairs_of(token, text)[1])):
            there, place = of.of(key)
            so_far += np.bincount(place[there], minlength=len(so_far))
    n = np.concatenate(n)
    there = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(there, -1), mask=np.append(np.zeros(len(there), bool), True)),
         pa.array(np.append(n[there], total))], names=["number", "n"])


def _explode_pairs(batches, bits: int, words_: np.ndarray, rank: np.ndarray, pairs: np.ndarray,
                   apart: bool):
    """(doc_id, words, first, own, second, n) of the pairs of each row that are not frequent, and
    of its words that are not. Frequent words go by their rank, others by their hash. If rows
    count ``apart``, ``words`` of a pair is the number of the row's words and ``own`` how often
    it has the first word, times ``words`` and one, and how often the second; else both are 0."""
    words_, pairs = Places(words_), Places(pairs)
    for batch in slices(batches, chars=SLICE):
        ids = batch.column("_id").to_numpy(zero_copy_only=False)
        token, text = tokens(texts_of(batch.column("text")), bits)
        there, place, at, key, seen, _ = _both(words_, pairs, token, text)
        name = token.copy()
        name[there] = rank[place[there]]
        size = np.bincount(text, minlength=batch.num_rows) * apart
        times = np.zeros(len(token), np.int64)
        for some, key_of in ((there, place), (~there, token)) if apart else ():
            times[some] = _own(text[some], key_of[some])
        at, key = at[~seen], key[~seen]
        _, one, n = _numbered(text[at], key)
        at = at[one]
        size = size[text[at]]
        own = times[at] * (size + 1) + times[at + 1]
        both = there[at] & there[at + 1]
        alone = np.flatnonzero(~there)
        _, one, n_alone = _numbered(text[alone], token[alone])
        alone = alone[one]
        # One kind after the other, as rows alike take less of the exchange.
        for of, size_, first, own_, second, of_n in (
                (at[both], size[both], name[at[both]] * len(rank) + name[at[both] + 1], own[both],
                 NUMBERED, n[both]),
                (at[~both], size[~both], name[at[~both]], own[~both], name[at[~both] + 1],
                 n[~both]),
                (alone, 0, name[alone], 0, ALONE, n_alone)):
            size_, own_, second = (np.broadcast_to(x, len(of)) for x in (size_, own_, second))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[text[of]], pa.int64()), pa.array(size_, pa.int64()),
                 pa.array(first), pa.array(own_, pa.int64()), pa.array(second),
                 pa.array(of_n.astype(np.int32))],
                names=["doc_id", "words", "first", "own", "second", "n"])


def _frequent_gains(batches, bits: int, words_: np.ndarray, n_words: np.ndarray,
                    pairs: np.ndarray, n_pairs: np.ndarray, total: int, backoff: float,
                    apart: bool):
    """Words of each row, and what it scores if every pair but the frequent ones is given up
    and words that are not frequent are there once."""
    words_, pairs = Places(words_), Places(pairs)
    for batch in slices(batches, chars=SLICE):
        token, text = tokens(texts_of(batch.column("text")), bits)
        n = np.bincount(text, minlength=batch.num_rows)
        log_all = np.log(np.maximum(total - n * apart, 1))
        sums = np.maximum(n - 1, 0) * np.log(backoff) - n * log_all
        there, place, at, _, seen, number = _both(words_, pairs, token, text)
        log = np.zeros(len(token))
        left = n_words[place[there]] - _own(text[there], place[there]) * apart
        log[there] = np.log(np.maximum(left, 1))
        at, number = at[seen], number[seen]
        left = n_pairs[number] - _own(text[at], number) * apart
        gain = np.log(left) - log[at] - log[at + 1] + log_all[text[at]] - np.log(backoff)
        sums = (sums + np.bincount(text, log, minlength=len(n))
                + np.bincount(text[at], gain, minlength=len(n)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("_id"), pa.array(n.astype(np.int64)), pa.array(sums)],
            names=["doc_id", "n_words", "total"])


def supported_scores(docs: DataFrame, bits: int = BITS, frequent: int = FREQUENT,
                     sample: int = SAMPLE, per_part: int = GRAMS_PER_PART,
                     backoff: float = 0.4, apart: bool = False) -> DataFrame:
    """``doc_id, n_words, total, score``: log score of each document and its mean by word.

    After the word before it, a word scores ln c(h, w) / c(h) if another row has the pair too,
    else ln of ``backoff`` and ln c(w) / N; the first word of a row scores ln c(w) / N. If rows
    count ``apart``, c and N are those of all other rows, and a word that none of them has
    counts as there once. Nulls, empty texts, repeated ids and empty tables are as in
    ``corpus_scores``.

    The words there most often in one ``sample``-th of the texts are counted over all texts and
    sent to every task, and so are the pairs of them that most texts there have; at most
    ``frequent`` pairs are, half as many words, and none that is there once. The choice
    moves work only: any choice gives the same scores. This runs jobs.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), "text").filter(
        "_id IS NOT NULL")
    some = materialize(
        rows.filter(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0).select("text")
        .mapInArrow(partial(_texts_with, bits=bits), "size int, key bigint, n bigint")
        .groupBy("size", "key").agg(F.sum("n").alias("n")).filter("n >= 2"))
    often = some.groupBy("size", "n").count().toArrow().sort_by(
        [("n", "descending")])
    least = []
    for size, room in ((1, frequent // 2), (2, frequent)):
        of_size = often.filter(pc.equal(often["size"], size))
        fit = np.cumsum(of_size["count"].to_numpy()) <= room
        least.append(int(of_size["n"].to_numpy()[fit].min(initial=2**62)))
    chosen = some.filter(F.col("n") >= F.when(F.col("size") == 1, least[0]).otherwise(least[1])
                         ).select("size", "key").toArrow()
    size, key = (chosen.column(c).to_numpy() for c in ("size", "key"))
    words_, pairs = (np.sort(key[size == s].view(np.uint64)) for s in (1, 2))

    found = (rows.select("text").mapInArrow(
        partial(_frequent_occurrences, bits=bits, words_=words_, pairs=pairs),
        "number bigint, n bigint").groupBy("number").agg(F.sum("n").alias("n")).toArrow())
    number = found.column("number").fill_null(len(words_) + len(pairs)).to_numpy()
    counted = np.zeros(len(words_) + len(pairs) + 1, np.int64)
    counted[number] = found.column("n").to_numpy()
    n_words, n_pairs, total = (
        counted[:len(words_)], counted[len(words_):-1], max(1, int(counted[-1])))

    # Frequent words by rank, as small numbers take less of the exchange.
    by_rank, many = np.argsort(-n_words, kind="stable"), max(1, len(n_words))

    parts = max(1, -(-total * 2 // per_part))
    exploded = rows.mapInArrow(
        partial(_explode_pairs, bits=bits, words_=words_, rank=np.argsort(by_rank), pairs=pairs,
                apart=apart),
        "doc_id bigint, words bigint, first bigint, own bigint, second bigint, n int"
    ).filter("first IS NOT NULL AND second IS NOT NULL").repartition(parts, "first", "second")
    # All uses of the exchange need all columns, so that one serves them. What is asked of a
    # maximum is the same for the column, and stays above the exchange. Without its own, the
    # only row that has a pair would find a count of 0.
    counts = (exploded.groupBy("first", "second").agg(
        F.sum("n").alias("n"), F.count("doc_id").alias("texts"), F.max("second").alias("_second"),
        F.max(F.col("words") + F.col("own")).alias("most"))
        .filter(f"n >= 2 AND (_second = {ALONE} OR texts >= 2) AND most >= 0")
        .drop("texts", "most"))
    numbered = F.col("second") == NUMBERED
    counts = counts.withColumns({
        "_first": F.when(numbered, F.expr(f"first div {many}")).otherwise(F.col("first")),
        "_last": F.when(numbered, F.expr(f"first % {many}")).otherwise(F.col("second"))})
    known = F.broadcast(rows.sparkSession.createDataFrame(pa.table(
        {"_name": pa.array(np.arange(len(n_words))), "_n": pa.array(n_words[by_rank])})))
    for side in ("_first", "_last"):
        counts = counts.join(known.withColumnRenamed("_n", f"{side}_n"),
                             F.col(side) == F.col("_name"), "left").drop("_name", side)
    pair = F.col("_second") != ALONE

    # Words that are not frequent, once for themselves and once for each pair they are in.
    rare = F.array_compact(F.array(F.when(F.col("_first_n").isNull(), F.col("first")), F.when(
        pair & F.col("_last_n").isNull(), F.col("second"))))
    of_word = Window.partitionBy("word")
    lent = (
        counts.select(F.explode(rare).alias("word"), "first", "second", "n")
        .withColumn("n", F.max(F.when(F.col("second") == ALONE, F.col("n"))).over(of_word))
        .filter(F.col("second") != ALONE)
        .select(F.col("first").alias("_1"), F.col("second").alias("_2"),
                F.when(F.col("word") == F.col("first"), F.col("n")).alias("_n_1"),
                F.when(F.col("word") == F.col("second"), F.col("n")).alias("_n_2"))
        .repartition(parts, "_1", "_2")
        .groupBy("_1", "_2").agg(F.max("_n_1").alias("_n_1"), F.max("_n_2").alias("_n_2")))
    known_counts = (
        counts.join(lent.hint("shuffle_hash"),
                    (F.col("first") == F.col("_1")) & (F.col("second") == F.col("_2")), "left")
        .select(F.col("first").alias("_first"), F.col("second").alias("_last"),
                F.col("n").alias("_n"), F.coalesce("_first_n", "_n_1").alias("_n_1"),
                F.coalesce("_last_n", "_n_2").alias("_n_2")))
    joined = exploded.join(
        known_counts.hint("shuffle_hash"),
        (F.col("first") == F.col("_first")) & (F.col("second") == F.col("_last")))
    left = F.col("_n") - F.col("n") * int(apart)
    step = F.col("words") + 1
    gain = F.when(F.col("second") == ALONE, F.log(F.greatest(left, F.lit(1)))).otherwise(
        F.log(left.cast("double") * (F.lit(total) - F.col("words"))
              / (F.col("_n_1") - F.call_function("div", F.col("own"), step)).cast("double")
              / (F.col("_n_2") - F.col("own") % step)) - float(np.log(backoff)))
    alone = rows.mapInArrow(
        partial(_frequent_gains, bits=bits, words_=words_, n_words=n_words, pairs=pairs,
                n_pairs=n_pairs, total=total, backoff=backoff, apart=apart),
        "doc_id bigint, n_words bigint, total double")
    return (
        joined.select("doc_id", F.lit(0).cast("bigint").alias("n_words"),
                      (F.col("n") * gain).alias("total"))
        .union(alone).groupBy("doc_id")
        .agg(F.sum("n_words").alias("n_words"), F.sum("total").alias("total"))
        .withColumn("score", F.when(F.col("n_words") > 0, F.col("total") / F.col("n_words"))))


def corpus_scores(docs: DataFrame, bits: int = BITS, heavy: int = HEAVY, least: int = 2,
                  backoff: float = 0.4, per_part: int = GRAMS_PER_PART,
                  order: int = ORDER) -> DataFrame:
    """``doc_id, n_words, total, score``: log score of each document and its mean by word.

    Counts cover all documents, the scored one too. Null and empty texts have 0 words, a
    total of 0 and a null score. Rows without a doc_id are left out; rows that repeat one are
    parts of one document, with no n-gram across them. No rows give none. Other columns are
    not read. The join has a partition for each ``per_part`` n-grams. This runs jobs.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), "text").filter(
        "_id IS NOT NULL")
    counts = materialize(
        rows.select("text").mapInArrow(partial(_count, bits=bits, order=order), _GRAM_SQL)
        .groupBy("size", "key", "pre", "suf").agg(F.sum("n").alias("n"))
        .filter((F.col("size") == 1) | (F.col("n") >= least)))
    total = max(1, counts.filter("size = 1").agg(F.sum("n")).first()[0] or 0)
    scored = corrections(counts, total, order, heavy, backoff)
    top = (scored.filter(F.col("n") * heavy >= total).select("key", "gain").toArrow())
    keys = top.column("key").to_numpy().view(np.uint64)
    by_key = np.argsort(keys)
    keys, gains = keys[by_key], top.column("gain").to_numpy()[by_key]

    parts = -(-total * order // per_part)
    gain = scored.filter(F.col("n") * heavy < total).select("key", "gain")
    exploded = rows.mapInArrow(partial(_explode, bits=bits, order=order, heavy=keys),
                               "doc_id bigint, key bigint")
    joined = exploded.repartition(parts, "key").join(
        gain.repartition(parts, "key").hint("shuffle_hash"), "key")
    first = rows.mapInArrow(
        partial(_without_join, bits=bits, order=order, heavy=keys, scores=gains, backoff=backoff),
        "doc_id bigint, n_words bigint, total double")
    return (
        joined.select("doc_id", F.lit(0).cast("bigint").alias("n_words"),
                      F.col("gain").alias("total"))
        .union(first).groupBy("doc_id")
        .agg(F.sum("n_words").alias("n_words"), F.sum("total").alias("total"))
        .withColumn("score", F.when(F.col("n_words") > 0, F.col("total") / F.col("n_words"))))
