"""Exact joins with metric pruning: the rows of the plain search, for a part of its work."""

import numpy as np
import pytest
from pyspark.sql import Observation

from nearloom.operators import joins, policies, search, shards


def make(spark, x, first=0):
    rows = [(first + i, [float(c) for c in v], i % 7 if i % 5 else None, i % 11 == 0) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "label long, vector array<double>, doc_id long, deleted boolean")


def ask(spark, q):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(q)], "query_id long, vector array<double>")


def clustered(rng, n, dim, clusters, spread=0.1):
    return rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dim))


def same(a, b):
    key = lambda df: [(r["query_id"], r["rank"], r["label"], r["doc_id"], round(r["distance"], 9)) for r in sorted(df.collect())]
    one, two = key(a), key(b)
    assert one == two
    return one


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(21)
    x = clustered(rng, 4000, 8, 40)
    return make(spark, x).repartition(6).cache(), ask(spark, np.concatenate([x[:50] + 0.01, rng.normal(size=(10, 8)) * 3]))


@pytest.mark.parametrize("space,epsilon", [("l2", 0.3), ("cosine", 0.01)])
def test_joins_equal_the_plain_search(spark, data, space, epsilon, monkeypatch):
    base, asked = data
    pivots = joins.pivoted(base, space, block_rows=100)
    assert pivots.total == base.where("NOT deleted").count()
    near, all_ = Observation(), Observation()
    assert same(joins.knn_join(pivots, asked, 10, near), search.knn(base, asked, 10, space))
    assert same(joins.radius_join(pivots, asked, epsilon, metrics=all_), search.search(base, asked, space, policies.Radius(epsilon)))
    joins.knn_join(pivots, asked, 10, near := Observation()).collect()
    # Clustered vectors: under half of the pairs of the plain search.
    assert near.get["computed"] < 0.5 * 60 * pivots.total and all_.get["computed"] < 0.5 * 60 * pivots.total
    assert same(joins.radius_join(pivots, asked, epsilon, most=3), search.search(base, asked, space, policies.Radius(epsilon, most=3)))
    monkeypatch.setattr(shards, "SENT_QUERIES", 7)
    monkeypatch.setattr(shards, "LANE", 9)
    assert same(joins.knn_join(pivots, asked, 3), search.knn(base, asked, 3, space))


def test_joins_of_few_repeated_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.zeros((300, 3)), np.ones((200, 3)), rng.normal(size=(20, 3)), [[np.nan, 0, 0], [np.inf, 0, 0]]])
    base, asked = make(spark, x), ask(spark, [[0, 0, 0], [1, 1, 1], [5, 5, 5], [0.5, 0.5, 0.5], [np.nan, 0, 0]])
    fine = base.where("label < 520")
    pivots = joins.pivoted(base, block_rows=50)
    for k in (1, 7, 250, 600):
        same(joins.knn_join(pivots, asked, k), search.knn(fine, asked.where("query_id < 4"), k))
    for epsilon in (0.0, 0.75, 3.0, 1e9):
        same(joins.radius_join(pivots, asked, epsilon), search.search(fine, asked.where("query_id < 4"), "l2", policies.Radius(epsilon)))
    none = joins.pivoted(base.where("false"))
    assert joins.knn_join(none, asked, 3).count() == joins.radius_join(none, asked, 1.0).count() == 0
    assert joins.knn_join(pivots, asked.where("false"), 3).count() == 0
    with pytest.raises(ValueError):
        joins.pivoted(base, "ip")
    with pytest.raises(ValueError):
        joins.knn_join(pivots, asked, 0)


def test_blocks_are_read_where_they_lie(spark, data):
    base, asked = data
    plan = joins.radius_join(joins.pivoted(base, block_rows=100), asked, 0.3)._jdf.queryExecution().executedPlan().toString()
    assert all("query_id" in line for line in plan.splitlines() if "Exchange" in line)


def test_a_query_goes_to_a_piece_once_however_many_rings_it_visits(spark):
    """Vectors without clusters: every ring is within reach, yet a query is sent to as many pieces as hold the base, not to each ring."""
    x = np.random.default_rng(4).normal(size=(2000, 24))
    base, asked = make(spark, x), ask(spark, x[:200])
    pivots = joins.pivoted(base, block_rows=20)
    assert len(pivots.own) > 60 and pivots.blocks.count() == 1
    sent = joins._visits(joins._asked(asked).selectExpr("*", "100D AS reach"), pivots, None)
    assert {len(r["shards"]) for r in sent.collect()} == {1}
    same(joins.knn_join(pivots, asked, 10), search.knn(base, asked, 10))
    same(joins.radius_join(pivots, asked, 25.0), search.search(base, asked, "l2", policies.Radius(25.0)))
