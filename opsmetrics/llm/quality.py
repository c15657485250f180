"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its emission scores come from counts on the line itself and on
the lines before and after it; transition scores tie neighbours together. A document's
quality is the mean marginal of "good" from the forward-backward recursion, weighted by
line length and put on the scale of the labels.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.llm.tables import held_out
from opsmetrics.llm.text import code_points, is_space, mix, run_hashes, runs, slices, texts_of

OWN = 16
FEATURES = 3 * OWN + 3
SAMPLE_DOCS = 3000
SAMPLE_LINES = 60_000
DOC_LINES = 1000

# Classes of code points below 128; all beyond count as letters.
_LETTER, _UPPER, _DIGIT, _MARK, _STOP = 1, 2, 4, 8, 16


def _class_table() -> np.ndarray:
    table = np.full(129, _LETTER, np.uint8)
    table[:128] = 0
    for code in range(33, 127):
        char = chr(code)
        if char.isalpha():
            table[code] = _LETTER | (_UPPER if char.isupper() else 0)
        elif char.isdigit():
            table[code] = _DIGIT
        else:
            table[code] = _STOP if char in ".,;:!?'\"()-" else _MARK
    return table


CLASSES = _class_table()


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[starts]


def _distinct(keys: np.ndarray, hashes: np.ndarray, groups: int) -> np.ndarray:
    """Number of distinct hashes under each key."""
    order = np.lexsort((hashes, keys))
    k, h = keys[order], hashes[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
    return np.bincount(k[new], minlength=groups)


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its weight (characters, at least 1) and its text's number.

    Lines are split at newlines and lines of white space alone are left out; a text
    without any other line has one empty line.
    """
    points, offsets = code_points(texts)
    n = len(texts)
    breaks = points == 10
    starts, ends, text = runs(~breaks, offsets)
    solid = ~is_space(points)
    filled = _sums(solid, starts, ends) > 0
    starts, ends, text = starts[filled], ends[filled], text[filled]
    missing = np.setdiff1d(np.arange(n), text)
    if len(missing):
        text = np.concatenate([text, missing])
        order = np.argsort(text, kind="stable")
        none = offsets[missing]
        starts = np.concatenate([starts, none])[order]
        ends = np.concatenate([ends, none])[order]
        text = text[order]

    size = (ends - starts).astype(float)
    kinds = CLASSES[np.minimum(points, 128)]
    letters, uppers, digits, marks, stops = (
        _sums((kinds & bit) > 0, starts, ends)
        for bit in (_LETTER, _UPPER, _DIGIT, _MARK, _STOP))
    bangs = _sums(points == 33, starts, ends)
    pipes = _sums(points == 124, starts, ends)

    word_start, word_end, _ = runs(solid, offsets)
    hashes = run_hashes(points, word_start, word_end)
    line = np.searchsorted(starts, word_start, "right") - 1
    lines = len(starts)
    count = np.bincount(line, minlength=lines) if len(line) else np.zeros(lines, np.int64)
    kinds_of_word = (_distinct(line, hashes, lines) if len(line)
                     else np.zeros(lines, np.int64))
    same = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    repeats = np.bincount(line[same], minlength=lines) if same.any() else np.zeros(lines, np.int64)
    ends_marked = np.zeros(lines, np.int64)
    if len(word_end):
        last = kinds[word_end - 1]
        ends_marked = np.bincount(line[(last & _MARK) > 0], minlength=lines)

    whole = np.zeros(lines, np.uint64)
    if len(hashes):
        first = np.searchsorted(line, np.arange(lines))
        place = np.arange(len(hashes)) - first[line]
        np.add.at(whole, line, mix(hashes + place.astype(np.uint64)))
    pairs = np.lexsort((whole, text))
    t, w = text[pairs], whole[pairs]
    new = np.ones(lines, bool)
    new[1:] = (t[1:] != t[:-1]) | (w[1:] != w[:-1])
    group = np.cumsum(new) - 1
    copies = np.empty(lines)
    copies[pairs] = np.bincount(group)[group]

    # Words of the whole text: distinct ones over all.
    word_text = text[line] if len(line) else np.zeros(0, np.int64)
    text_words = np.bincount(word_text, minlength=n)
    text_kinds = (_distinct(word_text, hashes, n) if len(word_text) else np.zeros(n, np.int64))
    variety = text_kinds / np.maximum(text_words, 1) * np.log1p(text_words) ** 0.5

    chars, number = np.maximum(size, 1), np.maximum(count, 1)
    own = np.stack([
        np.log1p(size) / 8, letters / chars, uppers / np.maximum(letters, 1), digits / chars,
        marks / chars, stops / chars, bangs / number, pipes / number, count / chars,
        np.log1p(count) / 8, kinds_of_word / number, repeats / number, ends_marked / number,
        np.log(copies), (letters / number) / 10, (count == 0).astype(float)], axis=1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    linked = text[1:] == text[:-1]
    before[1:][linked] = own[:-1][linked]
    after[:-1][linked] = own[1:][linked]
    per_text = np.bincount(text, minlength=n)
    features = np.concatenate([
        own, before, after, np.ones((lines, 1)), variety[text][:, None],
        (np.log1p(per_text)[text] / 8)[:, None]], axis=1)
    return features.astype(np.float32), np.maximum(size, 1), text


@dataclass
class Model:
    """Weights of the emission of "good" over "bad", the four transitions, and the scale of
    document scores."""

    center: np.ndarray
    spread: np.ndarray
    emission: np.ndarray
    transition: np.ndarray
    scale: tuple[float, float]


def _chains(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and number of lines of each run of equal text numbers."""
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    return first, np.diff(np.concatenate([first, [len(text)]]))


def _soft(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(emission: np.ndarray, transition: np.ndarray, text: np.ndarray):
    """Marginals of "good", the pair marginals summed by transition, and log partitions.

    All texts step through the recursions together, each as far as it has lines.
    """
    first, length = _chains(text)
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    alive = np.searchsorted(-length, -np.arange(1, length.max() + 1), "right")
    score = np.stack([np.zeros_like(emission), emission], axis=1)
    forward, backward = np.empty_like(score), np.zeros_like(score)
    for step, n in enumerate(alive):
        at = first[:n] + step
        if step == 0:
            forward[at] = score[at]
        else:
            last = forward[at - 1]
            for to in (0, 1):
                forward[at, to] = score[at, to] + _soft(last[:, 0] + transition[0, to],
                                                        last[:, 1] + transition[1, to])
    for step in range(len(alive) - 1, 0, -1):
        at = first[:alive[step]] + step
        later = score[at] + backward[at]
        for source in (0, 1):
            backward[at - 1, source] = _soft(later[:, 0] + transition[source, 0],
                                             later[:, 1] + transition[source, 1])
    ends = first + length - 1
    log_sum = np.empty(len(first))
    log_sum[:] = _soft(forward[ends, 0], forward[ends, 1])
    per_line = np.empty(len(text))
    for_text = np.repeat(np.arange(len(first)), length)
    lines = np.repeat(first, length) + np.arange(len(text)) - np.repeat(
        np.cumsum(length) - length, length)
    per_line[lines] = log_sum[for_text]
    good = np.exp(forward[:, 1] + backward[:, 1] - per_line)
    inner = np.flatnonzero(text[1:] == text[:-1]) + 1
    pairs = np.zeros((2, 2))
    for source in (0, 1):
        for to in (0, 1):
            pairs[source, to] = np.exp(
                forward[inner - 1, source] + transition[source, to] + score[inner, to]
                + backward[inner, to] - per_line[inner]).sum()
    return good, pairs, log_sum.sum()


def _scores(model: Model, texts: list[str]) -> np.ndarray:
    features, weight, text = line_features(texts)
    good = _line_marginals(model, features, text)
    return _document_scores(good, weight, text, len(texts), model.scale)


def _line_marginals(model: Model, features: np.ndarray, text: np.ndarray) -> np.ndarray:
    emission = ((features - model.center) / model.spread) @ model.emission
    return marginals(emission.astype(float), model.transition, text)[0]


def _document_scores(good, weight, text, n, scale) -> np.ndarray:
    mean = (np.bincount(text, good * weight, minlength=n)
            / np.bincount(text, weight, minlength=n))
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    logit = scale[0] * np.log(mean / (1 - mean)) + scale[1]
    return 1 / (1 + np.exp(-logit))


def _adam(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    at, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for step in range(1, steps + 1):
        g = gradient(at)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        at -= (rate * (1 - step / (steps + 1)) * (m / (1 - 0.9 ** step))
               / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8))
    return at


def fit_chain(features: np.ndarray, weight: np.ndarray, text: np.ndarray, labels: np.ndarray,
              steps: int = 150, ridge: float = 1e-3) -> Model:
    """Maximum likelihood of the line labels, all lines of a document taking its label.

    A document counts once whatever its number of lines, so that long ones do not drown
    the rest. Transitions are kept within +-2, as document labels alone would drive them
    apart without bound and make every line say what the whole says.
    """
    center, spread = features.mean(axis=0), features.std(axis=0) + 1e-3
    spread[3 * OWN], center[3 * OWN] = 1, 0
    x = ((features - center) / spread).astype(float)
    y = labels[text].astype(float)
    documents = len(labels)
    share = 1 / np.bincount(text, minlength=documents)[text]
    inner = np.flatnonzero(text[1:] == text[:-1]) + 1
    same = np.bincount(y[inner].astype(int), minlength=2)
    parameters = np.zeros(x.shape[1] + 4)

    def gradient(at):
        turn = np.clip(at[-4:].reshape(2, 2), -2, 2)
        good, pairs, _ = marginals(x @ at[:-4], turn, text)
        out = np.empty_like(at)
        out[:-4] = x.T @ ((good - y) * share) / documents + ridge * at[:-4]
        observed = np.diag(same)
        out[-4:] = ((pairs - observed) / max(1, len(inner))).ravel() + ridge * at[-4:]
        return out

    found = _adam(gradient, parameters, steps, 0.1)
    model = Model(center, spread, found[:-4], np.clip(found[-4:].reshape(2, 2), -2, 2), (1.0, 0.0))
    good = _line_marginals(model, features, text)
    raw = _document_scores(good, weight, text, documents, model.scale)
    logit = np.log(np.clip(raw, 1e-9, 1 - 1e-9) / np.clip(1 - raw, 1e-9, 1))

    def scale_gradient(at):
        error = 1 / (1 + np.exp(-(at[0] * logit + at[1]))) - labels
        return np.array([(error * logit).mean(), error.mean()]) + 1e-4 * at

    model.scale = tuple(_adam(scale_gradient, np.array([1.0, 0.0]), 400, 0.05))
    return model


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality",
                sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES,
                doc_lines: int = DOC_LINES) -> Model | None:
    """Fit on labelled documents outside the held-out fold.

    The fit is on a sample: at most ``sample_docs`` documents in the order of a hash of the
    id, and of them as many as together have ``sample_lines`` lines. A text of more than
    ``doc_lines`` lines teaches by so many neighbouring ones, from a place its hash gives,
    and texts that share an id as far as they have ``doc_lines`` together; equal ones teach
    once. So no document uses up the sample. Lines are counted first, and only the texts
    taken move on. Rows with a null label, id or text teach nothing. Without both labels
    there is no model (None).
    """
    doc_lines = min(doc_lines, sample_lines)
    truth = (labels.filter(F.col(label).isin(0, 1) & ~held_out())
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("_label")))
    so_far = (Window.unboundedPreceding, 0)
    of_id = Window.partitionBy("doc_id").orderBy("_key").rowsBetween(*so_far)
    of_all = Window.orderBy("_order", "doc_id", "_key").rowsBetween(*so_far)
    chosen = (truth.withColumn("_order", F.xxhash64(F.col("doc_id").cast("string")))
              .orderBy("_order", "doc_id").limit(sample_docs))
    texts = (
        docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
        .withColumn("_key", F.xxhash64("text"))
        .withColumn("_lines", F.length("text") - F.length(F.translate("text", "\n", "")) + 1))
    taken = (
        texts.select("doc_id", "_order", "_key", F.least("_lines", F.lit(doc_lines)).alias("_size"))
        .dropDuplicates(["doc_id", "_key"])
        .withColumn("_own", F.sum("_size").over(of_id)).filter(F.col("_own") <= doc_lines)
        .withColumn("_upto", F.sum("_size").over(of_all)).filter(F.col("_upto") <= sample_lines)
        .select("doc_id", "_key"))
    place = F.pmod(F.col("_key"), F.col("_lines") - doc_lines + 1).cast("int") + 1
    part = F.array_join(F.slice(F.split("text", "\n"), place, doc_lines), "\n")
    rows = (
        texts.join(F.broadcast(taken), ["doc_id", "_key"])
        .select("doc_id", "_key", "_label", F.when(F.col("_lines") > doc_lines, part)
                .otherwise(F.col("text")).alias("text"))
        .dropDuplicates(["doc_id", "_key"]).select("doc_id", "text", "_label"))
    described = rows.mapInArrow(
        _describe, "label int, size int, features binary, weight binary").collect()
    described.sort(key=lambda r: (bytes(r.features), r.label))
    labels_seen = np.array([r.label for r in described], float)
    if len(set(labels_seen)) < 2:
        return None
    features = np.concatenate(
        [np.frombuffer(r.features, np.float32).reshape(-1, FEATURES) for r in described])
    weight = np.concatenate([np.frombuffer(r.weight, np.float64) for r in described])
    text = np.repeat(np.arange(len(described)), [r.size for r in described])
    return fit_chain(features, weight, text, labels_seen)


def _describe(batches):
    for batch in slices(batches):
        features, weight, text = line_features(texts_of(batch.column("text")))
        bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
        spans = list(zip(bounds[:-1], bounds[1:]))
        yield pa.RecordBatch.from_arrays([
            batch.column("_label").cast(pa.int32()),
            pa.array([b - a for a, b in spans], pa.int32()),
            pa.array([features[a:b].tobytes() for a, b in spans], pa.binary()),
            pa.array([weight[a:b].tobytes() for a, b in spans], pa.binary())],
            names=["label", "size", "features", "weight"])


def _score_batches(batches, model: Model):
    for batch in slices(batches):
        scores = _scores(model, texts_of(batch.column("text")))
        yield batch.drop_columns(["text"]).append_column("score", pa.array(scores, pa.float64()))


def score_quality(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, score`` of every row: 0 to 1, higher where label 1 is likelier.

    Null and empty texts score as one empty line. Without a model every score is 0.5. Rows
    stay rows, also repeated ones and those with a null id. No rows give none. Other
    columns are not read.
    """
    if model is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"))
    of_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        partial(_score_batches, model=model), f"doc_id {of_id}, score double")
