"""Agent segmentation: K-means, its quality tables, projection, profile and labels."""

from __future__ import annotations

import operator
from dataclasses import dataclass, replace
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opsmetrics.functions.text import label
from opsmetrics.operators.features import FEATURES, with_rate_bin
from opsmetrics.storage import materialize

# Names of the three segments and the text of the map labels.
SEGMENT_LABELS = [
    ("1", "Offer Applied Rate: Low"),
    ("2", "Offer Applied Rate: Medium"),
    ("3", "Offer Applied Rate: High"),
]
SEGMENT_SHORT_LABEL_TEXT = "Agent: {agent_name}\nLead: {team_lead_name}\nCluster: {cluster}"
SEGMENT_LABEL_TEXT = SEGMENT_SHORT_LABEL_TEXT + "\n{cluster_label}"


# Agents compared at a time; agents in a stored file; tasks whose sums the driver adds up
# itself; iterations between two stored margins; the share of distances taken from which
# margins are stored anew, and the share of the fits they are of below which they are too.
POINTS = 1024
PER_FILE = 2048
FEW_TASKS = 16
FULL_STEPS = 3
REFRESH = 0.4
STILL = 0.5


@dataclass(frozen=True)
class SegmentFit:
    """The best of several K-means starts, run until no center moves."""

    k: int
    centers: np.ndarray
    within: float
    iterations: int
    clusters: int

    def segment_numbers(self, rank_by: int) -> list[int]:
        """Segment 1..k of each cluster id, ascending by one center coordinate and then
        by the whole center: the ids of a fit are arbitrary."""
        centers = self.centers.tolist()
        order = sorted(range(len(centers)),
                       key=lambda i: (centers[i][rank_by], centers[i]))
        return [order.index(i) + 1 for i in range(len(centers))]


def _vectors(features: DataFrame, columns: list[str], standardize: bool,
             invalid: str = "error") -> DataFrame:
    """Feature vectors from a stored table. Agents are laid out by hash in partitions of a
    size AQE picks, and sorted."""
    stored = materialize(features.hint("rebalance", "agent_name")
                         .sortWithinPartitions("agent_name"))
    vectors = VectorAssembler(inputCols=columns, outputCol="features",
                              handleInvalid=invalid).transform(stored)
    if standardize:
        scaler = StandardScaler(withMean=True, withStd=True,
                                inputCol="features", outputCol="scaled")
        vectors = (scaler.fit(vectors).transform(vectors)
                   .drop("features").withColumnRenamed("scaled", "features"))
    return vectors


def _starts(vectors: DataFrame, n_init: int, most: int) -> np.ndarray:
    """For each start the vectors of the ``most`` agents with the smallest
    md5(agent|start): the same on every engine and layout."""
    start = F.explode(F.sequence(F.lit(1), F.lit(n_init))).alias("start")
    drawn = vectors.select("agent_name", "v", start).withColumn(
        "draw", F.md5(F.concat_ws("|", "agent_name", "start").cast("binary")))
    by_draw = Window.partitionBy("start").orderBy("draw", "agent_name")
    rows = (drawn.withColumn("place", F.row_number().over(by_draw))
            .filter(F.col("place") <= most).orderBy("start", "place")
            .select("start", "v").collect())
    return [np.array([r.v for r in rows if r.start == s]) for s in range(1, n_init + 1)]


def _points(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column("v")
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _squares(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Squared distances of points (..., d) to their centers (..., k, d)."""
    return ((points[..., None, :] - centers) ** 2).sum(axis=-1)


def _nearest(points: np.ndarray,
             centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest center of each point (n, d) in each fit (fits, k, d), the first of equally
    near ones, no less than its distance and no more than that of the next one.

    Distances come from products of points and centers, whose rounding errors are below
    ``error``; points with two centers as near as that are compared by differences.
    """
    squares = (points ** 2).sum(axis=1)[:, None]
    sizes = (centers ** 2).sum(axis=-1)
    error = 4e-15 * (4 + points.shape[1]) * (squares + sizes.max())
    best = points @ (-2 * centers[:, 0].T) + sizes[:, 0]
    nearest, second = np.zeros(best.shape, np.int64), np.full(best.shape, np.inf)
    for j in range(1, centers.shape[1]):
        other = points @ (-2 * centers[:, j].T) + sizes[:, j]
        nearest[other < best] = j
        np.minimum(second, np.maximum(best, other), out=second)
        np.minimum(best, other, out=best)
    row, fit = np.nonzero(second - best <= 2 * error)
    for start in range(0, len(row), POINTS):
        r, f = row[start:start + POINTS], fit[start:start + POINTS]
        nearest[r, f] = _squares(points[r], centers[f]).argmin(axis=-1)
    return (nearest, np.sqrt(np.maximum(best + squares + error, 0)),
            np.sqrt(np.maximum(second + squares - error, 0)))


@dataclass(frozen=True)
class Fits:
    """Fits of equally many centers: their numbers and all their centers (fits, k, d). With
    an anchor also how far each center moved since margins were stored, and which of the
    stored columns are these fits'."""

    ids: np.ndarray
    centers: np.ndarray
    moved: np.ndarray | None = None
    place: np.ndarray | None = None

    def only(self, kept: np.ndarray) -> "Fits":
        return Fits(self.ids[kept], self.centers[kept])


@dataclass(frozen=True)
class Anchor:
    """Where the centers stood when each agent's nearest center, and its margin, how much
    farther the next one was, were stored with it; ``sums`` are the numbers and sums of the
    clusters then (fits, k, 1 + d), by number of centers."""

    fits: dict[int, Fits]
    sums: dict[int, np.ndarray]
    kind: type

    def since(self, k: int, fits: Fits) -> Fits:
        """The same fits with the moves of their centers."""
        at = np.searchsorted(self.fits[k].ids, fits.ids)
        moved = np.sqrt(((fits.centers - self.fits[k].centers[at]) ** 2).sum(axis=-1))
        before = sum(len(f.ids) for other, f in self.fits.items() if other < k)
        return Fits(fits.ids, fits.centers, moved, before + at)


def _sums(cells: np.ndarray, points: np.ndarray, size: int) -> np.ndarray:
    """Number and sums of the points of each cell."""
    return np.stack(
        [np.bincount(cells, minlength=size),
         *[np.bincount(cells, points[:, j], minlength=size) for j in range(points.shape[1])]],
        axis=1)


def _changes(points: np.ndarray, fits: Fits, nearest: np.ndarray | None,
             margin: np.ndarray | None) -> tuple[np.ndarray, int]:
    """What points add to the numbers and sums of clusters (fits, k, 1 + d), and how many
    distances that took.

    With margins these are the changes since they were stored. A center that moved by u is
    nearer or farther by u at most, so a point keeps its nearest center while its margin is
    above the moves of that center and of the farthest-moved one together; only points of
    smaller margins are compared with centers.
    """
    number, k, _ = fits.centers.shape
    size = number * k
    if margin is None:
        near, total = _nearest(points, fits.centers)[0], np.empty((number, k, 1 + points.shape[1]))
        ones = np.concatenate([np.ones((len(points), 1)), points], axis=1)
        for j in range(k):
            total[:, j] = (near == j).T.astype(float) @ ones
        return total, near.size * k
    nearest, margin = nearest[:, fits.place].astype(np.int64), margin[:, fits.place]
    limit = fits.moved[np.arange(number), nearest] + fits.moved.max(axis=1)
    fit, row = np.nonzero((margin <= limit * (1 + 1e-6) + 1e-9).T)
    after = np.empty(len(row), np.int64)
    ends = np.searchsorted(fit, np.arange(number + 1))
    for f in np.flatnonzero(np.diff(ends)):
        at = slice(ends[f], ends[f + 1])
        after[at] = _nearest(points[row[at]], fits.centers[f:f + 1])[0][:, 0]
    before = nearest[row, fit]
    other = after != before
    cells, moving = fit[other] * k, points[row[other]]
    return ((_sums(cells + after[other], moving, size) - _sums(cells + before[other], moving, size))
            .reshape(number, k, -1), row.size * k)


def _step(batches, width: int, running: list[Fits], ending: list[Fits], kind: type | None):
    """Numbers and sums by fit and cluster; for fits that end the sum of squared distances,
    in cluster -1; in fit -1 how many distances were taken and how many there are."""
    totals = [np.zeros((*f.centers.shape[:2], 1 + width)) for f in running]
    squares = [np.zeros(len(f.ids)) for f in ending]
    taken = there = 0
    for batch in batches:
        points, nearest, margin = _points(batch), None, None
        if kind:
            nearest, margin = [
                np.frombuffer(b"".join(batch.column(c).to_pylist()), t).reshape(len(points), -1)
                for c, t in (("nearest", kind), ("margin", np.float32))]
        for start in range(0, len(points), POINTS):
            at = slice(start, start + POINTS)
            for total, fits in zip(totals, running):
                sums, compared = _changes(points[at], fits, *(
                    (nearest[at], margin[at]) if kind else (None, None)))
                total += sums
                taken += compared
                there += len(points[at]) * fits.centers[..., 0].size
            for total, fits in zip(squares, ending):
                near = _nearest(points[at], fits.centers)[0]
                for f, centers in enumerate(fits.centers):
                    total[f] += ((points[at] - centers[near[:, f]]) ** 2).sum()
    ids, clusters = [np.array([-1])], [np.array([-1])]
    sums = [np.array([[taken, there, *[0] * (width - 1)]], float)]
    for fits, total in zip(running, totals):
        fit, cluster = np.nonzero(total.any(axis=-1))
        ids.append(fits.ids[fit])
        clusters.append(cluster)
        sums.append(total[fit, cluster])
    for fits, total in zip(ending, squares):
        ids.append(fits.ids)
        clusters.append(np.full(len(total), -1))
        sums.append(np.pad(total[:, None], ((0, 0), (0, width))))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(ids), pa.int32()), pa.array(np.concatenate(clusters), pa.int32()),
         *map(pa.array, np.concatenate(sums).T)],
        names=["fit", "cluster", *[f"s{i}" for i in range(1 + width)]])


def _anchored(batches, running: list[Fits], kind: type):
    """Each agent with its nearest center and margin in every fit, as bytes in fit order."""
    for batch in batches:
        points = _points(batch)
        nearest, margin = [], []
        for fits in running:
            found = [_nearest(points[start:start + POINTS], fits.centers)
                     for start in range(0, len(points), POINTS)]
            near, best, second = (np.concatenate(x) for x in zip(*found))
            nearest.append(near.astype(kind))
            margin.append(((second - best) * (1 - 1e-6)).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [batch.column("v"),
             *[pa.array([row.tobytes() for row in np.concatenate(x, axis=1)], pa.binary())
               for x in (nearest, margin)]], names=["v", "nearest", "margin"])


def _summed(table: DataFrame, width: int, running: dict[int, Fits], ending: list[Fits],
            kind: type | None,
            few: bool) -> tuple[dict[int, np.ndarray], dict[int, float], np.ndarray]:
    """The rows of ``_step`` over all tasks: numbers and sums of clusters by k (fits, k,
    1 + d), sums of squares by fit, and the distances taken and there. Rows of ``few`` tasks
    are added up here, which saves a shuffle in each iteration; else Spark adds them up."""
    columns = [f"s{i}" for i in range(1 + width)]
    rows = (
        table.select("v", *(["nearest", "margin"] if kind else []))
        .mapInArrow(partial(_step, width=width, running=list(running.values()), ending=ending,
                            kind=kind),
                    "fit int, cluster int, " + ", ".join(f"{c} double" for c in columns)))
    if not few:
        rows = rows.groupBy("fit", "cluster").agg(*[F.sum(c).alias(c) for c in columns])
    found = rows.toArrow()
    fit, cluster = (found.column(c).to_numpy() for c in ("fit", "cluster"))
    values = np.stack([found.column(c).to_numpy() for c in columns], axis=1)
    sums = {}
    for k, fits in running.items():
        own = np.isin(fit, fits.ids) & (cluster >= 0)
        sums[k] = np.zeros((len(fits.ids), k, 1 + width))
        np.add.at(sums[k], (np.searchsorted(fits.ids, fit[own]), cluster[own]), values[own])
    squares = {}
    for of, x in zip(fit[cluster < 0].tolist(), values[cluster < 0, 0].tolist()):
        squares[of] = squares.get(of, 0.0) + x
    squares.pop(-1)
    return sums, squares, values[fit < 0].sum(axis=0)[:2]


def _best_fits(vectors: DataFrame, ks: list[int], n_init: int,
               work: list | None = None) -> dict[int, SegmentFit]:
    """Lloyd's iterations for every k and start, one job for all of them at a time, each
    until its centers stand still. An empty cluster keeps its center. The best of a k has
    the smallest within sum of squares, then the smaller start.

    The first iterations move centers far and compare all agents with all centers. Then each
    agent's nearest center and margin are stored with it, and iterations compare only agents
    whose margin the moves since then have used up; when those are many, or most of the fits
    have ended, margins are stored anew. Centers and counts are the same either way. What the driver holds is bounded by the
    parameters: k centers and sums for each start and k. ``work`` gets the numbers of
    distances taken and there, for each iteration.
    """
    starts = _starts(vectors, n_init, max(ks))
    width = starts[0].shape[1]
    running = {}
    for k in sorted(ks):
        by_size: dict[int, list[int]] = {}
        for s, centers in enumerate(starts):
            by_size.setdefault(len(centers[:k]), []).append(s)
        for size, of in by_size.items():
            ids = np.array([k * n_init + s for s in of])
            before = running.get(size)
            centers = np.stack([starts[s][:k] for s in of])
            running[size] = Fits(ids, centers) if before is None else Fits(
                np.concatenate([before.ids, ids]), np.concatenate([before.centers, centers]))
    few = vectors.rdd.getNumPartitions() <= FEW_TASKS
    table, anchor, last, share = vectors, None, 0, 1.0
    ending, ended, step = [], {}, 0
    while running or ending:
        step += 1
        if running and step > FULL_STEPS and step - last > FULL_STEPS and (
                share > REFRESH or _number(running) < STILL * _number(anchor.fits)):
            table, anchor = _with_anchor(vectors, running, width, few)
            last, share = step, 0.0
        moved = {k: anchor.since(k, f) for k, f in running.items()} if anchor else running
        sums, squares, (taken, there) = _summed(table, width, moved, ending,
                                                anchor and anchor.kind, few)
        share = taken / max(there, 1)
        if work is not None:
            work.append((int(taken), int(there)))
        for fit, within in squares.items():
            ended[fit] = replace(ended[fit], within=within)
        ending, still = [], {}
        for k, fits in running.items():
            total = sums[k]
            if anchor:
                total = total + anchor.sums[k][np.searchsorted(anchor.fits[k].ids, fits.ids)]
            number = total[..., :1]
            new = np.where(number > 0.5, total[..., 1:] / np.maximum(number, 1), fits.centers)
            stands = np.isclose(new, fits.centers, rtol=1e-12, atol=1e-15).all(axis=(1, 2))
            if stands.any():
                ending.append(fits.only(stands))
            for i in np.flatnonzero(stands):
                there_ = number[i, :, 0] > 0.5
                ended[int(fits.ids[i])] = SegmentFit(
                    int(fits.ids[i]) // n_init, fits.centers[i][there_], np.nan, step,
                    int(there_.sum()))
            if not stands.all():
                still[k] = Fits(fits.ids[~stands], new[~stands])
        running = still
    return {k: min((ended[k * n_init + s] for s in range(n_init)),
                   key=lambda f: (round(f.within, 12),)) for k in ks}


def _number(fits: dict[int, Fits]) -> int:
    return sum(len(f.ids) for f in fits.values())


def _with_anchor(vectors: DataFrame, running: dict[int, Fits],
                 width: int, few: bool) -> tuple[DataFrame, Anchor]:
    """The stored table of agents with their margins, and what the driver keeps of it."""
    kind = np.uint8 if max(running) <= 256 else np.uint32
    table = materialize(vectors.mapInArrow(
        partial(_anchored, running=list(running.values()), kind=kind),
        "v array<double>, nearest binary, margin binary"))
    sums, _, _ = _summed(vectors, width, running, [], None, few)
    return table, Anchor(dict(running), sums, kind)


def _assign(batches, centers: np.ndarray, numbers: list[int]):
    for batch in batches:
        nearest = _squares(_points(batch), centers).argmin(axis=-1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("agent_name"), pa.array([str(numbers[i]) for i in nearest], pa.string())],
            names=["agent_name", "cluster"])


def _as_arrays(vectors: DataFrame) -> DataFrame:
    """Stored once, as every iteration reads it, in files by number of agents: an iteration's
    work is many times their bytes, by which they would all be one task's."""
    vectors = vectors.select("agent_name", vector_to_array("features").alias("v"))
    return materialize(vectors.repartition(max(1, -(-vectors.count() // PER_FILE)), "agent_name"))


def segment_kmeans(features: DataFrame, k: int = 3, n_init: int = 100,
                   columns: list[str] | None = None,
                   rank_by: str = "calls_offer_applied_rate",
                   standardize: bool = False, invalid: str = "error") -> DataFrame:
    """Assign each agent to a segment "1".."k", numbered by ascending ``rank_by``.

    The best of ``n_init`` repeatable starts by within-cluster sum of squares. ``invalid``
    says what a missing feature does, as for ``VectorAssembler``. Duplicate points may leave
    fewer than k segments, and fewer agents than k do.
    """
    columns = columns or FEATURES
    vectors = _vectors(features, columns, standardize, invalid)
    vectors = _as_arrays(vectors)
    best = _best_fits(vectors, [k], n_init)[k]
    numbers = best.segment_numbers(columns.index(rank_by))
    return materialize(vectors.mapInArrow(
        partial(_assign, centers=best.centers, numbers=numbers),
        "agent_name string, cluster string"))


def kmeans_sweep(features: DataFrame, ks: list[int] | None = None, n_init: int = 100,
                 columns: list[str] | None = None,
                 standardize: bool = False, invalid: str = "error") -> DataFrame:
    """Elbow table: sums of squares of the best fit for each number of centers.

    One center needs no fit: its within sum of squares is the total. ``converged`` says that
    the fit ran until its centers stood still; no cap stops one, so it always does.
    """
    columns = columns or FEATURES
    ks = ks or list(range(1, 11))
    vectors = _vectors(features, columns, standardize, invalid)
    vectors = _as_arrays(vectors)
    axes = vectors.select(*[F.col("v")[i].alias(f"v{i}") for i in range(len(columns))])
    total = axes.agg(_sum_of_squares(axes.columns).alias("ss")).first()["ss"]
    several = [k for k in ks if k > 1]
    fits = _best_fits(vectors, several, n_init) if several else {}
    rows = [(k, total, total, 0.0, 1, 1, True) if k == 1 else
            (k, total, fits[k].within, total - fits[k].within, fits[k].iterations,
             fits[k].clusters, True)
            for k in ks]
    return features.sparkSession.createDataFrame(
        rows, "centers int, totss double, tot_withinss double, betweenss double, "
              "iter int, clusters_found int, converged boolean")


def _sum_of_squares(columns: list[str]):
    """Squared distances to the group's own center, in one stable pass. A missing value
    adds nothing, and is not counted among its feature's values either."""
    return reduce(operator.add, [
        F.coalesce(F.var_pop(c) * F.count(c), F.lit(0.0)) for c in columns])


def segment_quality(features: DataFrame, assignment: DataFrame,
                    columns: list[str] | None = None) -> DataFrame:
    """Center, size and within sum of squares of each cluster of any assignment."""
    columns = columns or FEATURES
    return (
        features.join(assignment.select("agent_name", "cluster"), "agent_name")
        .groupBy("cluster")
        .agg(F.count(F.lit(1)).alias("size"),
             _sum_of_squares(columns).alias("withinss"),
             *[F.avg(c).alias(f"center_{c}") for c in columns]))


def segment_totals(features: DataFrame, assignment: DataFrame,
                   columns: list[str] | None = None) -> DataFrame:
    """Total, within and between sums of squares of an assignment, in one pass.

    The rollup's grand-total row has the total sum of squares.
    """
    columns = columns or FEATURES
    levels = (
        features.join(assignment.select("agent_name", "cluster"), "agent_name")
        .rollup("cluster")
        .agg(F.grouping("cluster").alias("is_total"), _sum_of_squares(columns).alias("ss")))
    sums = levels.agg(
        F.sum(F.when(F.col("is_total") == 1, F.col("ss"))).alias("totss"),
        F.sum(F.when(F.col("is_total") == 0, F.col("ss"))).alias("tot_withinss"),
        F.sum(F.when(F.col("is_total") == 0, 1).otherwise(0)).alias("clusters"))
    return sums.withColumn("betweenss", F.col("totss") - F.col("tot_withinss"))


def agent_projection(features: DataFrame, columns: list[str] | None = None,
                     invalid: str = "error") -> DataFrame:
    """Two principal components of the centered features per agent: (x, y, agent_name).

    The sign of each axis makes its largest loading positive.
    """
    columns = columns or FEATURES
    vectors = _vectors(features, columns, False, invalid)
    scaler = StandardScaler(withMean=True, withStd=False,
                            inputCol="features", outputCol="centered")
    centered = scaler.fit(vectors).transform(vectors)
    model = PCA(k=2, inputCol="centered", outputCol="axes").fit(centered)
    loadings = model.pc.toArray().T
    signs = [1.0 if max(axis, key=abs) >= 0 else -1.0 for axis in loadings]
    axes = vector_to_array("axes")
    points = model.transform(centered).select(
        *[axes.getItem(i) * F.lit(sign) for i, sign in enumerate(signs)], "agent_name")
    return materialize(points.toDF("x", "y", "agent_name"))


def agent_lead_bridge(df: DataFrame) -> DataFrame:
    """Distinct (agent, lead) pairs; an agent under two leads has two."""
    return df.select("agent_name", "team_lead_name").distinct()


def natural_left_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on every column name the two sides share."""
    shared = sorted(set(left.columns) & set(right.columns))
    if not shared:
        raise ValueError("no shared columns to join on")
    return left.join(right, shared, "left")


def segment_profile(features: DataFrame, assignment: DataFrame, bridge: DataFrame,
                    limits: list[tuple[float, str]] | None = None) -> DataFrame:
    """Mean applied rate per cluster, lead, agent, other rates and applied-rate bin.

    Each agent appears once per lead.
    """
    joined = natural_left_join(
        features, assignment.select("agent_name", "cluster").join(bridge, "agent_name", "left"))
    keys = ["cluster", "team_lead_name", "agent_name", "calls_with_offer_rate",
            "calls_with_accept_rate", "call_transfer_rate", "call_breakage_rate",
            "call_regen_rate", "calls_offer_applied_rate_bin"]
    return (
        with_rate_bin(joined, limits)
        .groupBy(*keys)
        .agg(F.avg("calls_offer_applied_rate").alias("avg_offer_applied_rate")))


def segment_members(profile: DataFrame, cluster: str | int) -> DataFrame:
    """Profile rows of one cluster, best applied rate first."""
    return (profile.filter(F.col("cluster") == str(cluster))
            .orderBy(F.desc("avg_offer_applied_rate"), "agent_name", "team_lead_name"))


def segment_label_table(spark, labels: list[tuple[str, str]] | None = None) -> DataFrame:
    """The names of the segments as a literal table."""
    return spark.createDataFrame(labels or SEGMENT_LABELS, "cluster string, cluster_label string")


def segment_labels(projection: DataFrame, assignment: DataFrame, bridge: DataFrame,
                   labels: list[tuple[str, str]] | None = None) -> DataFrame:
    """The segment map: projected agents with cluster, lead, segment name, and labels with
    and without that name."""
    names = segment_label_table(projection.sparkSession, labels)
    placed = (projection.join(assignment, "agent_name", "left")
              .join(bridge, "agent_name", "left"))
    return (natural_left_join(placed, F.broadcast(names))
            .withColumns({"short_label_text": label(SEGMENT_SHORT_LABEL_TEXT),
                          "label_text": label(SEGMENT_LABEL_TEXT)}))
