"""Spelling variants grouped by pivotal grams.

Two words are near if one inserted, deleted or replaced character leads from one to the
other. The bigrams of a word are ordered rare ones first, by their number over all words;
its prefix is the bigrams up to its third one. An edit destroys at most one of two bigrams
without a character in common, so of two near words the one whose prefix ends first keeps
one of two disjoint bigrams of it, its pivots, and that bigram is in the prefix of the
other word too. Dynamic programming picks the two rarest disjoint ones.

Position limits: a pivot that survives has the edit wholly after it, and then all up to the
pivot's end is the same in both words, or wholly before it, and then all from its start is.
On the edited side, whose lengths differ by one at most, the edit is in the first half, and
then the end is the same, or it is not, and then the beginning is. Index and pivots meet on
a hash of what has to be the same, so the pairs to verify follow the words and not the
square of the words with a bigram. Each pair is then verified by its edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics.llm.tables import materialize
from opsmetrics.llm.text import slices, texts_of

# What a word is made of, and the grams.
RUN = re.compile("[a-zÀ-ÿ]+")
GRAM = 2
PREFIX = GRAM + 1

WORDS_KEPT = 1 << 19
ROWS_SENT = 1 << 15

_SIDED = pa.schema([("last", pa.int32()), ("stem", pa.string()), ("rest", pa.string()),
                    ("form", pa.int32())])


def lower_ascii(text: str) -> str:
    """A-Z in lower case, all else as it is."""
    return text.encode().lower().decode()


def damaged(run: str, seed: int, every: int) -> str:
    """The run without one of its characters if ``every`` divides its checksum."""
    sum_ = zlib.crc32(run.encode(), seed)
    if sum_ % every:
        return run
    at = sum_ % len(run)
    return run[:at] + run[at + 1:]


def _count(batches, shortest: int, every: int):
    """Words of a task with their numbers, sent on whenever many are kept."""
    total = Counter()
    for batch in slices(batches):
        for name, text in zip(batch.column("name").to_pylist(), texts_of(batch.column("text"))):
            seed = zlib.crc32(f"{name}:".encode())
            for run, n in Counter(RUN.findall(lower_ascii(text))).items():
                if len(run) >= shortest:
                    total[damaged(run, seed, every)] += n
        if len(total) > WORDS_KEPT:
            yield _counted(total, shortest)
            total = Counter()
    yield _counted(total, shortest)


def _counted(total: Counter, shortest: int) -> pa.RecordBatch:
    kept = {word: n for word, n in total.items() if len(word) >= shortest}
    return pa.RecordBatch.from_arrays(
        [pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())],
        names=["word", "n"])


def word_counts(docs: DataFrame, shortest: int = 5, least: int = 3,
                every: int = 97) -> DataFrame:
    """``word, n``: the words of all texts with at least ``shortest`` characters and
    ``least`` occurrences.

    A word is a longest run of A-Z, a-z and U+00C0-U+00FF, A-Z in lower case. Where
    ``every`` divides the crc32 of ``<doc_id>:<run>``, that run loses a character in that
    document. Null texts have no words, a null doc_id is named by an empty text, repeated
    rows count as often as they stand there, and other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), "text")
    return (rows.mapInArrow(partial(_count, shortest=shortest, every=every),
                            "word string, n bigint")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))


def pivots(prefix: list[tuple[int, int]]) -> list[int]:
    """Places of two grams without a common character, of the least total number, from
    ``(place, number)`` by place. Up to each gram the cheapest one far enough before it is
    known, so each gram is looked at once; the first of equally rare choices is taken."""
    best, chosen = None, []
    cheapest, waiting = None, 0
    for place, number in prefix:
        while prefix[waiting][0] + GRAM <= place:
            if cheapest is None or prefix[waiting][1] < cheapest[1]:
                cheapest = prefix[waiting]
            waiting += 1
        if cheapest and (best is None or cheapest[1] + number < best):
            best, chosen = cheapest[1] + number, [cheapest[0], place]
    return chosen


def _sides(word: str, place: int):
    """What stays the same if the edit is after, or before, the gram; and the other side."""
    yield "<" + word[:place + GRAM], word[place + GRAM:]
    yield ">" + word[place:], word[:place]


def _keys(word: str, place: int, probe: bool):
    """What has to be the same in two near words: the stem with the gram, the size of the
    edited side by twos, and one half of it. A side and one a character longer or shorter
    meet in one of two sizes."""
    for stem, side in _sides(word, place):
        sizes = {(len(side) - 1) // 2, (len(side) + 1) // 2} if probe else {len(side) // 2}
        for half in sizes:
            if half <= 0:
                yield stem, f"{half}"
            elif half <= len(side):
                yield stem, f"{half}<{side[:half]}"
                yield stem, f"{half}>{side[len(side) - half:]}"


def _described(batches, numbers: dict[str, int], order: dict[str, int], probe: bool):
    """Index rows, or pivot rows, of each word."""
    for batch in batches:
        columns = [], [], [], []
        words = batch.column("word").to_pylist()
        for row, word in enumerate(words):
            grams = sorted((order[word[i:i + GRAM]], i) for i in range(len(word) - 1))
            last = grams[min(PREFIX, len(grams)) - 1][0]
            places = sorted(i for rank, i in grams if rank <= last)
            if probe:
                places = pivots([(i, numbers[word[i:i + GRAM]]) for i in places])
            for place in places:
                for stem, rest in _keys(word, place, probe):
                    for column, value in zip(columns, (last, stem, rest, row)):
                        column.append(value)
            if len(columns[0]) >= ROWS_SENT:
                yield _sent(batch, columns)
                columns = [], [], [], []
        yield _sent(batch, columns)


def _sent(batch: pa.RecordBatch, columns) -> pa.RecordBatch:
    sided = pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, _SIDED.types)], schema=_SIDED)
    rows = sided.column("form")
    return pa.RecordBatch.from_arrays(
        [batch.column("word").take(rows), batch.column("n").take(rows),
         *sided.columns[:3]], names=["word", "n", "last", "stem", "rest"])


def _gram_numbers(words: DataFrame) -> dict[str, int]:
    """How often each gram stands in the words. Words are made of 90 characters, so there
    are at most 8,100 grams."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - GRAM + 1),
                        lambda i: F.substring(F.col("word"), i, F.lit(GRAM)))
    return {r.gram: r.n for r in words.select(F.explode(grams).alias("gram"))
            .groupBy("gram").agg(F.count(F.lit(1)).alias("n")).collect()}


def near_words(words: DataFrame) -> DataFrame:
    """``a, b, n_a, n_b``: each pair of the distinct words in ``word, n`` that one inserted,
    deleted or replaced character separates, once, as found by pivots. Words need three
    grams, so four characters. This runs a job."""
    numbers = _gram_numbers(words)
    order = {gram: k for k, gram in enumerate(sorted(numbers, key=lambda g: (numbers[g], g)))}

    def keyed(probe: bool, name: str) -> DataFrame:
        return (
            words.select("word", "n")
            .mapInArrow(partial(_described, numbers=numbers, order=order, probe=probe),
                        "word string, n bigint, last int, stem string, rest string")
            .select(F.xxhash64("stem", "rest").alias("key"), F.col("word").alias(name),
                    F.col("n").alias(f"n_{name}"), F.col("last").alias(f"last_{name}")))

    first = F.struct("last_a", "a") < F.struct("last_b", "b")
    return (
        keyed(True, "a").hint("merge").join(keyed(False, "b"), "key")
        .filter(first & (F.abs(F.length("a") - F.length("b")) <= 1)
                & (F.levenshtein("a", "b", 1) == 1))
        .select("a", "b", "n_a", "n_b"))


def spelling_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each of the distinct words in ``word, n``.

    ``n_near`` is the number of near words. ``form`` is the near word of the largest n, the
    first in code-point order of equally frequent ones, if that n (``form_n``) is at least
    ``times`` the word's own; else it is null. ``root`` is where the forms lead in the end,
    the word itself without one. No words give no rows. This runs jobs.
    """
    words = materialize(words.select("word", "n"))
    pairs = near_words(words)
    best = (
        pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"),
                                       F.col("n_b").alias("n_a"), F.col("n_a").alias("n_b")))
        .repartition("a").dropDuplicates(["a", "b"])
        .groupBy(F.col("a").alias("word")).agg(
            F.count(F.lit(1)).alias("n_near"),
            F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("form"))).alias("best")))
    led = F.col("form_n") >= times * F.col("n")
    formed = materialize(
        words.join(best, "word", "left")
        .withColumn("form_n", -F.col("best.n"))
        .select("word", F.when(led, F.col("best.form")).alias("form"), "n",
                F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                F.when(led, F.col("form_n")).alias("form_n")))
    roots = _roots(formed.filter("form IS NOT NULL").select("word", "form"))
    return (formed.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near",
                    "form_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: where the forms lead. The steps double in every round, and n at least
    doubles in every step, so a few rounds are enough."""
    led = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        on = led.select(F.col("word").alias("_via"), F.col("root").alias("_on"))
        further = led.join(on, F.col("root") == F.col("_via"), "left")
        if further.filter("_on IS NOT NULL").isEmpty():
            return led
        led = materialize(further.select("word", F.coalesce("_on", "root").alias("root")))
