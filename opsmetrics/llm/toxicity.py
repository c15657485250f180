"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes ratios.

N-grams are hashed to buckets and counted once a document. The log-count ratio of a bucket
says how much likelier a toxic document has it. A document's features are the ratios of its
buckets, divided by the root of their number; logistic regression weighs them, and a fold
that taught neither ratios nor weights puts the decision on the scale of probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsmetrics import storage
from opsmetrics.llm.tables import fold, held_out, materialize
from opsmetrics.llm.text import (
    code_points, distinct, gram_hashes, is_space, slices, texts_of)

ORDERS = (5, 7)
BUCKETS = 1 << 20
MOST_FEATURES = 1 << 16
LEAST_DOCS = 3
SAMPLE_DOCS = 6000
BLOCK = 1 << 20
SCALE_FOLD = 1
PARTS_PER_COUNT = 4


def grams(texts: list[str], alive: np.ndarray | None = None,
          orders=ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of the distinct n-grams of each text, by text, then bucket;
    only buckets ``alive``, if given.

    Texts are lower-cased and runs of white space, also at both ends, count as one space.
    """
    points, offsets = code_points([f" {t.lower()} " for t in texts])
    space = is_space(points)
    points = np.where(space, np.uint32(32), points)
    keep = np.ones(len(points), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1]] = True
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(keep)])[offsets]
    values = points[keep]
    text = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offsets))
    found = []
    for size in orders:
        bucket = (gram_hashes(values, size) >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)
        used = text[:len(bucket)] == text[size - 1:]
        if alive is not None:
            used &= alive[bucket]
        found.append(text[:len(bucket)][used] * BUCKETS + bucket[used])
    pairs = distinct(np.concatenate(found))
    return pairs // BUCKETS, pairs % BUCKETS


@dataclass
class Model:
    """Weight times ratio of every bucket (0 where unused), the offset, the scale of the
    decision, and which buckets are selected: all of them count for the length of a text,
    those without weight too, as in the fit."""

    weights: np.ndarray
    bias: float
    scale: tuple[float, float]
    selected: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        text, bucket = grams(texts, self.selected)
        z = _decisions(text, self.weights[bucket], len(texts)) + self.bias
        return _logistic(self.scale[0] * z + self.scale[1])


def _decisions(text: np.ndarray, weights: np.ndarray, texts: int) -> np.ndarray:
    return (np.bincount(text, weights, minlength=texts)
            / np.sqrt(1 + np.bincount(text, minlength=texts)))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _count(batches):
    """Documents with each bucket, by label; a task's sums leave it once."""
    totals = np.zeros((2, BUCKETS), np.int64)
    documents = np.zeros(2, np.int64)
    for batch in slices(batches):
        labels = batch.column("_label").to_numpy()
        text, bucket = grams(texts_of(batch.column("text")))
        for label in (0, 1):
            totals[label] += np.bincount(bucket[labels[text] == label], minlength=BUCKETS)
        documents += np.bincount(labels, minlength=2)
    used = np.flatnonzero(totals.any(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(used, -1), pa.int32()),
         pa.array(np.append(totals[0, used], documents[0]), pa.int64()),
         pa.array(np.append(totals[1, used], documents[1]), pa.int64())],
        names=["bucket", "clean", "toxic"])


def _fit_batches(batches, used: np.ndarray, ratios: np.ndarray):
    """One row: the regression over the documents of use 0 (clean) and 1 (toxic), and by it
    decisions and labels of those of use 2, each in the order they come in."""
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    found, target = ([], [], []), ([], [], [])
    for batch in slices(batches):
        text, bucket = grams(texts_of(batch.column("text")), place >= 0)
        bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
        features = place[bucket]
        for use, label, x, y in zip(batch.column("_use").to_pylist(),
                                    batch.column("_label").to_pylist(), bounds[:-1], bounds[1:]):
            found[use].append(features[x:y].copy())
            target[use].append(label)
    weights, bias = fit_logistic(found[0] + found[1], np.array(target[0] + target[1], float), ratios)
    weights = weights * ratios
    z = [_decisions(np.zeros(len(x), np.int64), weights[x], 1)[0] + bias for x in found[2]]
    yield pa.RecordBatch.from_arrays(
        [pa.array([weights.tobytes()], pa.binary()), pa.array([bias], pa.float64()),
         pa.array([z], pa.list_(pa.float64())), pa.array([target[2]], pa.list_(pa.int32()))],
        names=["weights", "bias", "z", "target"])


def log_count_ratios(clean: np.ndarray, toxic: np.ndarray, sums: tuple[int, int]) -> np.ndarray:
    """ln of the smoothed shares of a bucket among toxic and among clean documents; ``sums``
    are those of clean + 1 and of toxic + 1 over all buckets, also over those not given."""
    return np.log((toxic + 1.0) / sums[1]) - np.log((clean + 1.0) / sums[0])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic",
                 sample_docs: int = SAMPLE_DOCS, most_features: int = MOST_FEATURES,
                 least_docs: int = LEAST_DOCS) -> Model | None:
    """Fit on labelled documents outside the held-out fold.

    Counts and ratios cover all of them but one fold, ``SCALE_FOLD``, which only sets the
    scale. The regression uses the ``most_features`` buckets that tell the labels apart
    best, of those in ``least_docs`` documents or more. It learns from a sample of at most
    ``sample_docs`` documents, half of them toxic where there are enough, in the order of a
    hash of the id; so does the scale, without regard to the label. Rows with a null label,
    id or text teach nothing. Without both labels there is no model (None).

    Counts are stored and the regression runs in a task: the driver gets the chosen buckets,
    their weights, and a decision for each document that sets the scale, no counts of all
    buckets and no documents. This runs jobs.
    """
    truth = (labels.filter(F.col(label).isin(0, 1) & ~held_out())
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("_label")))
    known = materialize(
        docs.select("doc_id", "text").filter("text IS NOT NULL")
        .hint("merge").join(truth, "doc_id")
        .select("doc_id", "text", "_label", (fold() == SCALE_FOLD).alias("_scale")))
    taught = known.filter("NOT _scale")
    # A task's counts are of nearly all buckets whatever it reads: fewer tasks write fewer.
    parts = taught.rdd.getNumPartitions()
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-parts // PARTS_PER_COUNT))
    total, whole = F.col("clean") + F.col("toxic"), F.col("bucket") == -1
    counts = storage.materialize(
        taught.select("text", "_label").coalesce(min(parts, tasks))
        .mapInArrow(_count, "bucket int, clean bigint, toxic bigint")
        .groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter(whole | (total >= least_docs)))
    found = counts.agg(*[F.sum(F.when(of, F.col(c) + more)) for of, more in ((whole, 0), (~whole, 1))
                         for c in ("clean", "toxic")]).first()
    documents, sums = [x or 0 for x in found[:2]], [x or 0 for x in found[2:]]
    if not all(documents):
        return None
    gap = F.abs(F.col("toxic") / documents[1] - F.col("clean") / documents[0])
    best = (counts.filter(~whole)
            .orderBy((gap / F.sqrt((total + 1) / sum(documents))).desc(), "bucket")
            .limit(most_features).toArrow())
    bucket, clean, toxic = (best.column(c).to_numpy() for c in ("bucket", "clean", "toxic"))
    ratios = log_count_ratios(clean, toxic, sums)

    order = F.xxhash64(F.col("doc_id").cast("string"))
    half = sample_docs // 2
    uses = [(taught.filter("_label = 0"), half), (taught.filter("_label = 1"), half),
            (known.filter("_scale"), sample_docs)]
    # The bound of a sample comes from hashes alone, so that only its own texts meet in a task.
    last = {r.use: r.last for r in reduce(DataFrame.unionAll, [
        rows.select(order.alias("order")).orderBy("order").limit(most)
        .agg(F.max("order").alias("last"), F.lit(use).alias("use"))
        for use, (rows, most) in enumerate(uses)]).collect()}
    fitted = (reduce(DataFrame.unionAll, [
        rows.filter(order <= F.lit(last[use])).orderBy(order, "doc_id").limit(most)
        .select("text", "_label", F.lit(use).alias("_use"))
        for use, (rows, most) in enumerate(uses)])
              .coalesce(1).mapInArrow(
                  partial(_fit_batches, used=bucket, ratios=ratios),
                  "weights binary, bias double, z array<double>, target array<int>").collect()[0])
    weights, bias = np.frombuffer(fitted.weights), fitted.bias
    scale = (1.0, float(np.log(documents[1] / documents[0])))
    if len(set(fitted.target)) == 2:
        scale = fit_scale(np.array(fitted.z), np.array(fitted.target, float))
    table = np.zeros(BUCKETS, np.float32)
    table[bucket] = weights
    selected = np.zeros(BUCKETS, bool)
    selected[bucket] = True
    return Model(table, bias, scale, selected)


def fit_scale(z: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make the decision the log odds of label 1 (Newton steps)."""
    x = np.stack([z / (z.std() + 1e-9), np.ones_like(z)], axis=1)
    at = np.zeros(2)
    for _ in range(50):
        p = _logistic(x @ at)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        at += np.clip(np.linalg.solve(hessian, x.T @ (target - p) - 1e-3 * at), -2, 2)
    return float(at[0] / (z.std() + 1e-9)), float(at[1])


def fit_logistic(found: list[np.ndarray], target: np.ndarray, ratios: np.ndarray,
                 ridge: float = 1e-4, steps: int = 200, rate: float = 0.05):
    """Logistic regression on sparse binary features scaled by ``ratios`` (Adam, full batch)."""
    sizes = np.array([len(x) for x in found])
    shrink = 1 / np.sqrt(1 + sizes)
    # Blocks of whole documents, so that only buckets and no products of all are held.
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(BLOCK, sizes.sum() + BLOCK, BLOCK)) + 1
    blocks = [(slice(x, y), np.concatenate(found[x:y])) for x, y in
              zip(np.append(0, cuts[:-1]), np.minimum(cuts, len(found))) if x < y]
    at = np.zeros(len(ratios) + 1)
    m, v = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, steps + 1):
        scaled, z, g = ratios * at[:-1], np.zeros(len(found)), np.zeros_like(at)
        for part, column in blocks:
            row = np.repeat(np.arange(part.stop - part.start), sizes[part])
            z[part] = np.bincount(row, scaled[column], minlength=part.stop - part.start)
        z = z * shrink + at[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(found)
        for part, column in blocks:
            g[:-1] += np.bincount(column, np.repeat((error * shrink)[part], sizes[part]),
                                  minlength=len(ratios))
        g[:-1] *= ratios
        g[-1] = error.sum()
        g[:-1] += ridge * at[:-1]
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        at -= (rate * (1 - step / (steps + 1)) * (m / (1 - 0.9 ** step))
               / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8))
    return at[:-1], at[-1]


def _score_batches(batches, model: Model):
    for batch in slices(batches):
        scores = model.scores(texts_of(batch.column("text")))
        yield batch.drop_columns(["text"]).append_column("score", pa.array(scores, pa.float64()))


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` but the text, and ``score``: 0 to 1, higher where toxic is
    likelier.

    Null and empty texts score by the offset alone. Without a model every score is 0. Rows
    stay rows, also repeated ones and those with a null id. No rows give none. A column
    named score is replaced.
    """
    docs = docs.drop("score")
    rest = docs.drop("text")
    if model is None:
        return rest.withColumn("score", F.lit(0.0))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return docs.select(*rest.columns, "text").mapInArrow(
        partial(_score_batches, model=model), f"{schema}, score double")


def drop_toxic(docs: DataFrame, model: Model | None, limit: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``limit``."""
    if model is None:
        return docs
    return docs.mapInArrow(partial(_drop_batches, model=model, limit=limit), docs.schema)


def _drop_batches(batches, model: Model, limit: float):
    for batch in slices(batches):
        stays = model.scores(texts_of(batch.column("text"))) < limit
        yield batch.filter(pa.array(stays, pa.bool_()))
