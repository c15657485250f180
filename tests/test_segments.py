import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsmetrics.operators import segments
from opsmetrics.operators.features import FEATURES


def points(spark, *values):
    return spark.createDataFrame([(f"a{i}", float(v)) for i, v in enumerate(values)],
                                 "agent_name string, v double")


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(11)
    centers = rng.uniform(0.1, 0.9, size=(3, 6))
    rows = [(f"agent{i:03d}", *[float(v) for v in centers[i % 3] + rng.normal(0, 0.01, 6)])
            for i in range(90)]
    return spark.createDataFrame(rows, "agent_name string, "
                                 + ", ".join(f"{f} double" for f in FEATURES))


@pytest.fixture(scope="module")
def bridge(spark):
    rows = [(f"agent{i:03d}", f"L{i % 3}") for i in range(90)] + [("agent000", "L9")]
    return spark.createDataFrame(rows, "agent_name string, team_lead_name string")


def test_quality_and_totals_golden(spark):
    df = points(spark, 0, 1, 10, 11)
    halves = df.select("agent_name", (F.col("v") > 5).cast("string").alias("cluster"))
    quality = segments.segment_quality(df, halves, ["v"]).orderBy("cluster").collect()
    assert [(r["size"], r.withinss, r.center_v) for r in quality] == [(2, 0.5, 0.5), (2, 0.5, 10.5)]
    totals = segments.segment_totals(df, halves, ["v"]).first()
    assert (totals.totss, totals.tot_withinss, totals.betweenss, totals.clusters) == (101, 1, 100, 2)


def test_sweep_golden(spark):
    rows = segments.kmeans_sweep(points(spark, 0, 1, 10, 11), [1, 2], columns=["v"]).collect()
    assert [(r.centers, r.tot_withinss, r.betweenss) for r in rows] == [(1, 101, 0), (2, 1, 100)]


def test_sweep_finds_the_optimum_of_small_inputs(spark):
    """Against every assignment of nine points to up to three clusters."""
    rng = np.random.default_rng(2)
    data = rng.uniform(size=(9, 2))
    df = spark.createDataFrame([(f"a{i}", *map(float, p)) for i, p in enumerate(data)],
                               "agent_name string, u double, v double")

    def within(assignment):
        groups = np.array(assignment)
        return sum(((data[groups == g] - data[groups == g].mean(axis=0)) ** 2).sum()
                   for g in set(assignment))

    rows = segments.kmeans_sweep(df, [2, 3], n_init=25, columns=["u", "v"]).collect()
    for r in rows:
        best = min(within(a) for a in itertools.product(range(r.centers), repeat=9))
        assert r.tot_withinss == pytest.approx(best, abs=1e-9)


def test_fewer_clusters_than_asked(spark):
    rows = segments.kmeans_sweep(points(spark, 1, 1, 2), [3], columns=["v"]).collect()
    assert rows[0].clusters_found <= 2 and rows[0].tot_withinss == pytest.approx(0)


def test_sweep_identities(features):
    rows = segments.kmeans_sweep(features, list(range(1, 6)), n_init=3).collect()
    within = [r.tot_withinss for r in rows]
    assert all(b <= a * 1.0001 for a, b in zip(within, within[1:]))
    assert all(r.totss == pytest.approx(r.tot_withinss + r.betweenss) for r in rows)


def test_segments_repeat_and_are_ordered(features):
    runs = [{r.agent_name: r.cluster for r in
             segments.segment_kmeans(features.repartition(n)).collect()} for n in (1, 3, 5)]
    assert runs[0] == runs[1] == runs[2]
    assert set(runs[0].values()) == {"1", "2", "3"}
    rates = {}
    for r in features.collect():
        rates.setdefault(runs[0][r.agent_name], []).append(r.calls_offer_applied_rate)
    assert np.mean(rates["1"]) < np.mean(rates["2"]) < np.mean(rates["3"])
    assert sorted(map(len, rates.values())) == [30, 30, 30]


def test_kmeans_quality_agrees_with_the_fit(features):
    assignment = segments.segment_kmeans(features)
    totals = segments.segment_totals(features, assignment).first()
    sweep = segments.kmeans_sweep(features, [3]).first()
    assert totals.tot_withinss == pytest.approx(sweep.tot_withinss, rel=1e-6)
    assert totals.totss == pytest.approx(sweep.totss)


def test_missing_feature_is_an_error_or_skipped(spark):
    df = points(spark, 0, 1, 10).union(spark.createDataFrame([("x", None)], "a string, v double"))
    with pytest.raises(Exception):
        segments.segment_kmeans(df, 2, columns=["v"], rank_by="v")
    kept = segments.segment_kmeans(df, 2, columns=["v"], rank_by="v", invalid="skip")
    assert kept.count() == 3


def test_standardize(features):
    scaled = segments.segment_kmeans(features, standardize=True)
    assert scaled.select("cluster").distinct().count() == 3


def test_projection_against_numpy(features):
    got = {r.agent_name: (r.x, r.y) for r in segments.agent_projection(features).collect()}
    rows = features.collect()
    data = np.array([[r[f] for f in FEATURES] for r in rows])
    data -= data.mean(axis=0)
    axes = np.linalg.svd(data, full_matrices=False)[2][:2]
    for axis in axes:
        axis *= np.sign(axis[np.abs(axis).argmax()])
    expected = data @ axes.T
    for r, point in zip(rows, expected):
        assert got[r.agent_name] == pytest.approx(tuple(point), abs=1e-9)


def test_profile_fans_out_by_lead(features, bridge):
    assignment = bridge.filter("team_lead_name <> 'L9'").select(
        "agent_name", F.substring("team_lead_name", 2, 1).alias("cluster"))
    profile = segments.segment_profile(features, assignment, bridge)
    assert profile.count() == 91
    assert profile.filter("agent_name = 'agent000'").count() == 2
    members = segments.segment_members(profile, 0).collect()
    rates = [r.avg_offer_applied_rate for r in members]
    assert len(members) == 31 and rates == sorted(rates, reverse=True)


def test_labels(spark, features, bridge):
    projection = segments.agent_projection(features)
    assignment = segments.segment_kmeans(features)
    rows = segments.segment_labels(projection, assignment, bridge).collect()
    assert len(rows) == 91
    names = dict(segments.SEGMENT_LABELS)
    for r in rows:
        assert r.cluster_label == names[r.cluster]
        assert r.label_text == (f"Agent: {r.agent_name}\nLead: {r.team_lead_name}\n"
                                f"Cluster: {r.cluster}\n{r.cluster_label}")


def test_natural_join_needs_a_shared_column(spark):
    with pytest.raises(ValueError):
        segments.natural_left_join(spark.range(1).toDF("a"), spark.range(1).toDF("b"))


def plain_lloyd(data, centers):
    """Every distance in every iteration; iterations until the centers stand still."""
    steps = 0
    while True:
        steps += 1
        nearest = ((data[:, None, :] - centers) ** 2).sum(axis=-1).argmin(axis=1)
        new = np.array([data[nearest == c].mean(axis=0) if (nearest == c).any() else centers[c]
                        for c in range(len(centers))])
        if np.allclose(new, centers, rtol=1e-12, atol=1e-15):
            return ((data - centers[nearest]) ** 2).sum(), steps
        centers = new


@pytest.mark.parametrize("few", [0, 16])
def test_margins_skip_most_distances_and_change_nothing(spark, monkeypatch, few):
    rng = np.random.default_rng(5)
    data = np.concatenate([c + rng.normal(0, 0.08, (150, 3)) for c in rng.uniform(size=(5, 3))])
    df = spark.createDataFrame([(f"a{i:04d}", [float(x) for x in p]) for i, p in enumerate(data)],
                               "agent_name string, v array<double>").repartition(4)
    monkeypatch.setattr(segments, "FEW_TASKS", few)
    work = []
    fits = segments._best_fits(df, [2, 5, 7], 6, work)
    for k, fit in fits.items():
        ends = [plain_lloyd(data, start[:k]) for start in segments._starts(df, 6, 7)]
        within, steps = min(ends, key=lambda e: round(e[0], 12))
        assert fit.within == pytest.approx(within, rel=1e-12) and fit.iterations == steps
    later = work[segments.FULL_STEPS:]
    assert all(taken == there for taken, there in work[:segments.FULL_STEPS])
    assert sum(taken for taken, _ in later) < 0.4 * sum(there for _, there in later)


def test_each_margin_is_a_lower_bound(spark):
    """One anchor, then centers moved at random: all assignments as if compared in full."""
    rng = np.random.default_rng(6)
    data = rng.uniform(size=(200, 2))
    df = spark.createDataFrame([(f"a{i}", [float(x) for x in p]) for i, p in enumerate(data)],
                               "agent_name string, v array<double>")
    first = {4: segments.Fits(np.arange(3), rng.uniform(size=(3, 4, 2)))}
    table, anchor = segments._with_anchor(df, first, 2, True)
    for scale in (0, 0.01, 0.1, 1):
        fits = segments.Fits(np.array([0, 2]), first[4].centers[[0, 2]]
                             + rng.normal(0, scale, (2, 4, 2)))
        sums, _, (taken, there) = segments._summed(
            table, 2, {4: anchor.since(4, fits)}, [], anchor.kind, True)
        for i, centers in enumerate(fits.centers):
            nearest = ((data[:, None, :] - centers) ** 2).sum(axis=-1).argmin(axis=1)
            number = (sums[4] + anchor.sums[4][[0, 2]])[i, :, 0]
            assert number.round().tolist() == np.bincount(nearest, minlength=4).tolist()
        assert there == 200 * 2 * 4 and (taken == 0 if scale == 0 else taken <= there)


def test_agents_are_stored_by_number_and_not_by_bytes(spark, monkeypatch):
    """Few bytes and much work: a table of a few hundred kB is read by several tasks."""
    monkeypatch.setattr(segments, "PER_FILE", 500)
    df = spark.range(2000).select(F.concat(F.lit("a"), "id").alias("agent_name"),
                                  F.rand(1).alias("u"), F.rand(2).alias("v"))
    stored = segments._as_arrays(segments._vectors(df, ["u", "v"], False))
    assert stored.count() == 2000 and len(stored.inputFiles()) == 4
    assert stored.rdd.getNumPartitions() == 4


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_products_find_the_center_that_differences_find(offset):
    """Also where centers are equally near, or nearer than products can tell."""
    rng = np.random.default_rng(8)
    data = np.concatenate([rng.integers(0, 4, (400, 2)), rng.uniform(0, 4, (400, 2))]) + offset
    centers = np.concatenate([rng.integers(0, 4, (20, 5, 2)), data[rng.integers(0, 800, (20, 5))],
                              rng.uniform(0, 4, (1, 5, 2)) + [[[0, 0]] * 4 + [[1e-13, 0]]]])
    centers[:20] += offset
    nearest, best, second = segments._nearest(data, centers)
    exact = np.sqrt(((data[:, None, None, :] - centers) ** 2).sum(axis=-1))
    assert (nearest == exact.argmin(axis=-1)).all()
    two = np.sort(exact, axis=-1)
    assert (best >= two[..., 0]).all() and (second <= two[..., 1]).all()
