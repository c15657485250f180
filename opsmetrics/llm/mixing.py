"""Mixing sources to target weights by exponential keys, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.llm.tables import materialize
from opsmetrics.operators.ordering import with_global_order

STEPS_PER_OCTAVE = 256


def word_count(text: str = "text") -> Column:
    """Runs of characters other than space and U+0009-U+000D; 0 for null."""
    marks = F.regexp_replace(F.col(text), r"[^\x20\x09-\x0D]+", "x")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("bigint")


def letter_weight(text: str = "text") -> Column:
    """Quality weight between 0.1 and 1: the squared share of the characters that are no
    ASCII digit or sign; 0.1 for null and empty texts."""
    kept = F.length(F.regexp_replace(F.col(text), r"[!-@\[-`{-~]+", ""))
    share = kept / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.1), F.coalesce(share * share, F.lit(0.0)))


def uniform(doc_id: str = "doc_id") -> Column:
    """A number above 0 and below 1 that depends on the id alone."""
    digits = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digits, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def exponential_key(weight: Column, doc_id: str = "doc_id") -> Column:
    """-ln(u) / weight: in ascending order of it, heavy documents tend to come first."""
    return -F.log(uniform(doc_id)) / weight


def source_targets(sizes: DataFrame, weights: list[int], percent: int,
                   epochs: int) -> DataFrame:
    """Per source: ``source, source_size, target``.

    Sources by code point, null last, weigh ``weights`` in turn and share ``percent`` of
    all sizes. A target stops at ``epochs`` times its source's size; what is above goes
    to the others by weight, until none is above. A round is one aggregate over the
    sources; it settles one at least, in practice nearly all.
    """
    totals = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = with_global_order(
        totals, [F.col("source").asc_nulls_last()], "_rank", stored=True)
    in_turn = F.element_at(F.array(*[F.lit(w) for w in weights]),
                           ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    table = materialize(ranked.select("source", "source_size", in_turn.alias("weight")))
    stop = (F.lit(epochs) * F.col("source_size")).cast("double")
    budget = (table.agg(F.sum("source_size")).first()[0] or 0) * percent / 100
    above, settled, target = F.lit(False), None, stop
    while True:
        row = table.agg(F.count_if(above).alias("n"),
                        F.sum(F.when(above, stop).otherwise(0)).alias("size"),
                        F.sum(F.when(above, 0).otherwise(F.col("weight"))).alias("weight")
                        ).first()
        if row.n == settled or not row.weight:
            break
        settled = row.n
        share = F.lit(budget - row.size) * F.col("weight") / F.lit(float(row.weight))
        target = F.when(above, stop).otherwise(share)
        above = above | (share >= stop)
    return table.select("source", "source_size", F.least(target, stop).alias("target"))


def _cuts(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source its targets, the whole ``_epochs`` and where the sample ends.

    Keys fall into steps of equal ratio, which hold about a thousandth of a source each.
    Sums of steps tell in which step the budget is used up; only that one is sorted.
    """
    targets = targets.withColumn(
        "_epochs", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))
    rest = F.col("target") - F.col("_epochs") * F.col("source_size")
    stepped = sizes.withColumn("_step", F.floor(F.log2("_key") * STEPS_PER_OCTAVE))
    so_far = Window.partitionBy("source").orderBy("_step")
    steps = (
        stepped.groupBy("source", "_step").agg(F.sum("size").alias("_sum"))
        .withColumn("_before", F.sum("_sum").over(so_far) - F.col("_sum")))
    ends = materialize(
        steps.withColumnRenamed("source", "_s")
        .join(targets, F.col("_s").eqNullSafe(F.col("source")))
        .withColumn("_rest", rest)
        .filter(F.col("_before") + F.col("_sum") >= F.col("_rest"))
        .groupBy("_s").agg(F.min(F.struct("_step", "_before", "_rest")).alias("_end"))
        .select(F.col("_s").alias("_source"), "_end.*"))
    in_order = (Window.partitionBy("source").orderBy("_key", "doc_id", "size")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = (
        stepped.withColumnRenamed("_step", "_at")
        .join(ends, F.col("source").eqNullSafe(F.col("_source"))
              & (F.col("_at") == F.col("_step")))
        .withColumn("_upto", F.col("_before") + F.sum("size").over(in_order))
        .filter(F.col("_upto") - F.col("size") / 2 <= F.col("_rest")))
    last = inside.groupBy(F.col("source").alias("_last_source")).agg(
        F.max(F.struct("_key", "doc_id", "size")).alias("_last"))
    return (
        targets
        .join(ends.select("_source", "_step"), F.col("source").eqNullSafe(F.col("_source")), "left")
        .join(last, F.col("source").eqNullSafe(F.col("_last_source")), "left")
        .select(F.col("source").alias("_source"), "source_size", "target", "_epochs",
                F.col("_step").alias("_end"), "_last"))


def _take(sized: DataFrame, cuts: DataFrame) -> DataFrame:
    """Add ``source_size, target, taken`` to rows with ``size`` and ``_key``."""
    step = F.floor(F.log2("_key") * STEPS_PER_OCTAVE)
    inside = ((step == F.col("_end"))
              & (F.struct("_key", "doc_id", "size") <= F.col("_last")))
    drawn = F.coalesce(F.col("_end").isNull() | (step < F.col("_end")) | inside, F.lit(False))
    times = F.col("_epochs") + F.when(
        drawn & (F.col("_epochs") * F.col("source_size") < F.col("target")), 1).otherwise(0)
    return (sized.join(cuts, F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("taken", (F.col("size") * times).cast("bigint")))


def mix(docs: DataFrame, weights: list[int], percent: int = 150, epochs: int = 2,
        weight: Column | None = None, texts: bool = True) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken``: the words the mix takes.

    A source first gives whole epochs, every document as often as its target holds its
    size. The rest is a weighted sample without replacement (Efraimidis and Spirakis):
    documents in ascending order of -ln(u) / weight, the last one where that comes nearer
    to the target. u depends on doc_id, so reruns agree; ties go by doc_id, then size,
    and rows equal in all three are taken together. ``weight`` is a column above 0.

    Null sources are a source of their own. Null and empty texts have size 0 and take 0.
    Rows that repeat a doc_id are rows of their own. No rows give none. Other columns
    stay, columns of the added names are replaced; without ``texts`` only
    ``doc_id, source`` and the added columns are returned. This runs jobs.
    """
    weight = letter_weight() if weight is None else weight
    added = ["size", "source_size", "target", "taken"]
    docs = docs.drop(*[c for c in docs.columns if c in added])
    sized = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source",
                        word_count().alias("size"), exponential_key(weight).alias("_key"))
    sizes = materialize(sized.select("doc_id", "source", "size", "_key"))
    targets = materialize(source_targets(sizes, weights, percent, epochs))
    cuts = materialize(_cuts(sizes, targets))
    if not texts:
        return _take(sizes, cuts).select("doc_id", "source", *added)
    return _take(sized, cuts).select("_row.*", *added)
