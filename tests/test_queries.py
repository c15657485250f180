"""Registered queries against their SQL, on default and on forced large-scale plans."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from opsmetrics.operators import ordering
from opsmetrics.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()
SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "date": "DATE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(type(v)), 0 if v is None else v)
                                            for v in r))


def compare(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    relation = duck.sql(entry_points.oracle_sql()[name])
    assert columns == sorted(relation.columns)
    spark_types = {c: SQL_TYPES[t] for c, t in df.dtypes}
    assert spark_types == dict(zip(relation.columns, map(str, relation.types)))
    expected = relation.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    got = [tuple(r) for r in df.select(columns).collect()]
    assert len(got) > 0
    for a, b in zip(ordered(got), ordered(expected), strict=True):
        for x, y in zip(a, b):
            assert x == y or (isinstance(x, float) and math.isclose(x, y, abs_tol=1.1e-8))


@pytest.mark.parametrize("name", sorted(set(entry_points.oracle_sql()) & set(QUERIES)))
def test_matches_sql(spark, duck, name):
    compare(spark, duck, name)


@pytest.mark.parametrize("name", ["agent_daily_fact", "agent_period_summary_selected",
                                  "top_agents", "agent_metric_long", "rate_quantiles",
                                  "filter_choices", "segment_profile_by_lead"])
def test_matches_sql_without_small_side_shortcuts(spark, duck, name, monkeypatch):
    """No automatic broadcast, and the global order cut into ranges that AQE does not join."""
    monkeypatch.setattr(ordering.with_global_order, "__defaults__", (None, False, 3))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        compare(spark, duck, name)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_names_and_entry(spark):
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() == 1


def test_queries_without_sql(spark):
    agents = QUERIES["agent_features"](spark, FOLDER).count()
    assert QUERIES["segment_kmeans"](spark, FOLDER).count() == agents
    assert QUERIES["agent_projection"](spark, FOLDER).columns == ["x", "y", "agent_name"]
    assert QUERIES["segment_profile"](spark, FOLDER).count() == agents
    assert QUERIES["segment_labels"](spark, FOLDER).filter("cluster_label IS NULL").count() == 0
    members = QUERIES["segment_members"](spark, FOLDER)
    assert {r.cluster for r in members.collect()} == {"3"}


def test_sweep_first_row_matches_sql(spark, duck):
    from opsmetrics.plans.oracle import FEATURES, _SQUARES
    rows = QUERIES["kmeans_sweep"](spark, FOLDER).collect()
    total = duck.sql(f"WITH {FEATURES} SELECT {_SQUARES} FROM features").fetchall()[0][0]
    assert rows[0].tot_withinss == pytest.approx(total, abs=1e-8)
    assert [r.centers for r in rows] == list(range(1, 11))


def test_measures_nest(spark):
    fact = QUERIES["agent_daily_fact"](spark, FOLDER)
    broken = fact.filter("NOT (calls_offer_applied <= calls_with_accept AND "
                         "calls_with_accept <= calls_with_offer AND calls_with_offer <= calls) "
                         "OR call_breakage_count <> calls_with_accept - calls_offer_applied")
    assert broken.count() == 0
    last = QUERIES["top_agents"](spark, FOLDER).orderBy(F.desc("agent_order")).first()
    assert last.cum_pct == 1.0
