"""Routed shards: recall against work, insertion and repair, and vectors that are not finite."""

import re

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from nearloom.functions import distances
from nearloom.operators import ann, policies, search, shards
from nearloom.operators.graph import Graph, levels_of
from nearloom.operators.index import VectorIndex
from nearloom.operators.snapshots import Store


def make(spark, x, first=0, docs=None):
    rows = [(first + i, [float(c) for c in v], None if docs is None else int(docs[i]), False) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "label long, vector array<double>, doc_id long, deleted boolean")


def ask(spark, q):
    return make(spark, q).select(F.col("label").alias("query_id"), "vector")


def clustered(rng, n, dim, clusters):
    return rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] + 0.25 * rng.normal(size=(n, dim))


def rate(found, truth):
    return search.recall(found, truth).first()["recall"]


@pytest.fixture(scope="module")
def large(spark):
    rng = np.random.default_rng(11)
    x = clustered(rng, 20_000, 16, 200)
    q = x[rng.integers(0, len(x), 60)] + 0.05 * rng.normal(size=(60, 16))
    base = make(spark, x).repartition(8)
    return base, ask(spark, q), shards.build(base, ef_construction=60, shard_rows=500)


def test_a_query_visits_a_fifth_of_the_shards(spark, large, tmp_path):
    base, asked, graph = large
    sizes = [r["n"] for r in graph.blocks.rows.select("n").collect()]
    assert len(sizes) >= 20 and sum(sizes) == 20_000 and max(sizes) <= 1000
    truth, seen = search.knn(base, asked, 10), Observation()
    found = shards.knn(graph, asked, 10, ef=40, metrics=seen)
    assert rate(found, truth) >= 0.95
    assert seen.get["visits"] <= 60 * -(-len(sizes) // 5)
    assert seen.get["hops"] < seen.get["computed"] <= 60 * 20_000 / 4
    store = Store(spark, str(tmp_path / "g"))
    store.commit(0, {"graph": shards.save(store, graph)})
    back = shards.load(store, store.read()["graph"])
    again = shards.knn(back, asked, 10, ef=40)
    assert sorted(again.collect()) == sorted(found.collect())
    plan = again._jdf.queryExecution().executedPlan().toString()
    # What is shuffled are answers, by query; the blocks are read where they lie, and only those that are visited.
    assert all("query_id" in line for line in plan.splitlines() if "Exchange" in line)
    assert re.search(r"In\(shard|shard#\d+ IN", plan)


def test_shards_are_balanced_whatever_the_vectors(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(900, 4)) * 0.01, rng.normal(size=(300, 4)) * 5, np.zeros((700, 4))])
    graph = shards.build(make(spark, x), ef_construction=20, shard_rows=100)
    sizes = [r["n"] for r in graph.blocks.rows.select("n").collect()]
    assert sum(sizes) == 1900 and max(sizes) <= 300
    labels = [r["label"] for r in shards.rows(graph).select("label").collect()]
    assert sorted(labels) == list(range(1900))


def test_many_queries_and_hidden_labels_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = clustered(rng, 1500, 8, 20)
    base, asked = make(spark, x, docs=np.arange(1500) % 9), ask(spark, x[:70] + 0.01)
    graph = shards.build(base, ef_construction=40, shard_rows=100)
    hidden = base.where("label % 3 = 0")
    runs = lambda: [sorted(shards.search(graph, asked, p, 30, probes=6, hidden=hidden).collect()) for p in (policies.TopK(5), policies.Radius(1.0), policies.Documents(3))]
    want = runs()
    assert all(r["label"] % 3 for rows in want for r in rows) and all(want)
    monkeypatch.setattr(shards, "SENT_LABELS", 0)
    assert runs() == want
    monkeypatch.setattr(shards, "SENT_QUERIES", 5)
    monkeypatch.setattr(shards, "LANE", 3)
    assert runs() == want
    exact = search.knn(base, asked, 5, where=F.col("label") % 3 != 0)
    assert rate(shards.knn(graph, asked, 5, ef=50, probes=10, hidden=hidden), exact) >= 0.97


@pytest.mark.parametrize("space", ["l2", "cosine", "ip"])
def test_changes_are_as_good_as_a_fresh_build(spark, space):
    """5 % moved, 5 % new, 5 % gone: recall within 0.01 of a fresh build, at a fraction of its distances."""
    rng = np.random.default_rng(5)
    x, new = clustered(rng, 3000, 12, 30), clustered(rng, 300, 12, 30)
    graph = shards.build(make(spark, x), space, ef_construction=60, shard_rows=600)
    moved = rng.choice(3000, 150, replace=False)
    gone = np.setdiff1d(rng.choice(3000, 150, replace=False), moved)
    y = x.copy()
    y[moved] = new[:150]
    written = make(spark, new[150:], first=5000).unionByName(spark.createDataFrame([(int(i), [float(c) for c in y[i]], None, False) for i in moved], "label long, vector array<double>, doc_id long, deleted boolean"))
    before = {r["shard"]: r["computed"] for r in graph.blocks.rows.collect()}
    after = shards.changed(graph, written, spark.createDataFrame([(int(i),) for i in gone], "label long"))
    stay = np.setdiff1d(np.arange(3000), gone)
    rows = make(spark, y).where(F.col("label").isin(stay.tolist())).unionByName(make(spark, new[150:], first=5000))
    fresh = shards.build(rows, space, ef_construction=60, shard_rows=600)
    asked, k = ask(spark, y[rng.choice(stay, 80)] + 0.02), 10
    truth = search.knn(rows, asked, k, space)
    got, best = (rate(shards.knn(g, asked, k, ef=60, probes=len(before)), truth) for g in (after, fresh))
    assert got >= best - 0.01 and got >= 0.97
    work = sum(r["computed"] for r in after.blocks.rows.collect())
    assert work < 0.35 * sum(r["computed"] for r in fresh.blocks.rows.collect())  # 15 % of the vectors changed
    checks = ann.graph_integrity(shards.edges(after)).first()
    assert checks["nodes"] == rows.count() and checks["loops"] == checks["repeated"] == checks["strangers"] == 0
    assert {r["label"] for r in shards.rows(after).collect()} == {r["label"] for r in rows.collect()}


def test_few_changes_touch_few_blocks(spark):
    rng = np.random.default_rng(6)
    x = clustered(rng, 3000, 12, 30)
    graph = shards.build(make(spark, x), ef_construction=60, shard_rows=150)
    after = shards.changed(graph, make(spark, x[:1] + 0.001, first=9999))
    assert after.blocks.delta_rows == 1
    whole = sum(r["computed"] for r in graph.blocks.rows.collect())
    assert after.blocks.deltas[0].rows.first()["computed"] < whole / 100
    assert shards.knn(after, ask(spark, x[:1] + 0.001), 1, ef=20).first()["label"] == 9999
    assert shards.changed(graph).blocks == graph.blocks


def test_5_percent_of_updates_cost_a_tenth_of_a_build():
    rng = np.random.default_rng(8)
    x = clustered(rng, 2000, 16, 20)
    g = Graph(x, "l2", 16, 100, levels_of(np.arange(2000), 16, 100))
    built = g.computed
    nodes = rng.choice(2000, 100, replace=False)
    y = x.copy()
    y[nodes] = clustered(rng, 100, 16, 20)
    g.update(nodes, y[nodes])
    assert g.computed - built < built / 10, (g.computed - built, built)
    hits = sum(g.search(q, 50)[0] == i for i, q in enumerate(y))
    assert hits >= 0.99 * 2000
    stay = g.remove(nodes)
    assert len(g.x) == 1900 and g.search(y[stay[0]], 50)[0] == 0
    assert sum(g.search(y[i], 50)[0] == n for n, i in enumerate(stay)) >= 0.99 * 1900
    g.unlink(np.arange(1900))
    assert g.top is None and len(g.search(x[0], 5)) == 0
    g.insert(x[:5], np.zeros(5, int))
    assert g.search(x[3], 5)[0] == 1903


def test_all_is_updated_many_times(spark, monkeypatch):
    """Every vector is written anew in several rounds; recall stays at the floor of a fresh graph."""
    monkeypatch.setattr(shards, "SHARD", 250)
    rng = np.random.default_rng(9)
    x = rng.random((1000, 10))
    index = VectorIndex(spark, "l2", 10)
    index.init_index(1200, ef_construction=100, strategy="graph", probes=4)
    index.add_items(make(spark, rng.random((1000, 10))), ids="label")
    index.set_ef(100)
    index.graph()
    for part in np.array_split(rng.permutation(1000), 4):
        index.add_items(spark.createDataFrame([(int(i), [float(c) for c in x[i]]) for i in part], "label long, vector array<double>"), ids="label")
        index.graph()
    asked = ask(spark, rng.random((100, 10)))
    assert rate(index.knn_query(asked, k=10), search.knn(make(spark, x), asked, 10)) >= 0.99


def test_an_overfull_shard_is_split(spark):
    rng = np.random.default_rng(10)
    x = clustered(rng, 400, 6, 4)
    graph = shards.build(make(spark, x), ef_construction=30, shard_rows=100)
    more = x[:1] + 0.1 * rng.normal(size=(500, 6))
    after = shards.changed(graph, make(spark, more, first=1000))
    assert max(r["n"] for r in after.blocks.rows.select("n").collect()) <= 300 and len(after.held) > len(graph.held)
    every = make(spark, x).unionByName(make(spark, more, first=1000))
    asked = ask(spark, more[:20])
    assert rate(shards.knn(after, asked, 5, ef=60, probes=len(after.held)), search.knn(every, asked, 5)) >= 0.97
    later = shards.changed(after, make(spark, more[:3] + 0.01, first=5000))
    assert {r["label"] for r in shards.rows(later).collect()} == {r["label"] for r in every.collect()} | {5000, 5001, 5002}


def test_empty_graphs(spark):
    none = shards.build(make(spark, np.zeros((0, 3))))
    assert shards.knn(none, ask(spark, np.ones((2, 3))), 3).count() == 0 and shards.edges(none).count() == 0
    one = shards.changed(none, make(spark, np.ones((1, 3))))
    assert shards.knn(one, ask(spark, np.ones((2, 3))), 3).count() == 2
    gone = shards.changed(one, gone=make(spark, np.ones((1, 3))))
    assert shards.knn(gone, ask(spark, np.ones((2, 3))), 3).count() == 0
    back = shards.changed(gone, make(spark, np.ones((1, 3)), first=5))
    assert shards.knn(back, ask(spark, np.ones((1, 3))), 3).first()["label"] == 5


ODD = [float("nan"), float("inf"), float("-inf")]


def test_vectors_that_are_not_finite_are_left_out(spark, monkeypatch):
    rng = np.random.default_rng(12)
    x = rng.random((60, 4))
    for i, bad in enumerate(ODD):
        x[7 * i + 3, i] = bad
    x[50] = 1e200  # finite, though its squares are not
    base, q = make(spark, x), np.concatenate([rng.random((5, 4)), [[np.nan, 0, 0, 0]]])
    fine = make(spark, x).where(~F.col("label").isin(3, 10, 17))
    want = {(r["query_id"], r["rank"], r["label"]) for r in search.knn(fine, ask(spark, q[:5]), 7, distances.l2).collect()}
    key = lambda df: {(r["query_id"], r["rank"], r["label"]) for r in df.collect()}
    assert key(search.knn(base, ask(spark, q), 7)) == want == key(search.knn(base, ask(spark, q), 7, distances.l2))
    assert key(search.knn(base, ask(spark, q), 60)) == key(search.knn(fine, ask(spark, q[:5]), 60))
    for space in ("ip", "cosine", distances.l1):
        assert key(search.knn(base.where("label <> 50"), ask(spark, q), 7, space)) == key(search.knn(fine.where("label <> 50"), ask(spark, q[:5]), 7, space))
    inside = policies.Radius(0.4)
    assert key(search.search(base, ask(spark, q), "l2", inside)) == key(search.search(fine, ask(spark, q[:5]), "l2", inside))
    assert key(ann.ivf_knn(base.where("label <> 50"), ask(spark, q), 5, cells=4, probes=4)) == key(search.knn(fine.where("label <> 50"), ask(spark, q[:5]), 5))
    graph = shards.build(base.where("label <> 50"), shard_rows=100)
    assert key(shards.knn(graph, ask(spark, q[:5]), 5, ef=60)) == key(search.knn(fine, ask(spark, q[:5]), 5))
    monkeypatch.setattr(search, "SENT_QUERIES", 0)
    assert key(search.knn(base, ask(spark, q), 7)) == want
    with pytest.raises(RuntimeError, match="contiguous"):
        search.knn(base, ask(spark, q), 58, strict=True)
    index = VectorIndex(spark, "l2", 4)
    index.init_index(100)
    with pytest.raises(RuntimeError, match="finite"):
        index.add_items(base, ids="label")
    assert index.rows.count() == 0


def test_two_queries_of_one_id_raise(spark):
    index = VectorIndex(spark, "l2", 2)
    index.init_index(10)
    index.add_items(make(spark, np.ones((3, 2))), ids="label")
    twice = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0])], "query_id long, vector array<double>")
    with pytest.raises(RuntimeError, match="query_id"):
        index.knn_query(twice)
    assert index.knn_query(twice.select("vector")).count() == 2


def test_many_queries_are_scanned_together_and_go_to_a_piece_once(spark, monkeypatch):
    rng = np.random.default_rng(17)
    x = clustered(rng, 1200, 8, 20)
    base, asked = make(spark, x), ask(spark, x[:90] + 0.01)
    graph = shards.build(base, ef_construction=40, shard_rows=200)
    probes, truth = len(graph.held), sorted(search.knn(base, asked, 5).collect())
    seen = Observation()
    assert sorted(shards.search(graph, asked, policies.TopK(5), 10, probes=probes, metrics=seen).collect()) == truth
    assert seen.get["hops"] == 0 and seen.get["visits"] == 90 * probes and seen.get["computed"] == 90 * 1200
    monkeypatch.setattr(shards, "SENT_QUERIES", 5)
    left, choose, seen = [], policies.TopK.choose, Observation()
    monkeypatch.setattr(policies.TopK, "choose", lambda self, ranked: left.append(ranked.count()) or choose(self, ranked))
    assert sorted(shards.search(graph, asked, policies.TopK(5), 10, probes=probes).collect()) == truth
    assert left == [90 * 5]  # a prefix of each query, not one of each visit
    monkeypatch.setattr(policies.TopK, "choose", choose)
    few = sorted(shards.search(graph, asked, policies.TopK(5), 10, probes=2, metrics=seen).collect())
    assert few and seen.get["visits"] == 90 * 2
    monkeypatch.setattr(shards, "SENT_QUERIES", 500)
    assert sorted(shards.search(graph, asked, policies.TopK(5), 40, probes=2).collect()) == few
