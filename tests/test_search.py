"""Search, policies, spaces and approximate strategies."""

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from nearloom.functions import distances
from nearloom.operators import ann, policies, search, shards


def make(spark, x, docs=None, deleted=()):
    rows = [(i, [float(c) for c in v], None if docs is None else docs[i], i in deleted) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "label long, vector array<double>, doc_id long, deleted boolean")


def ask(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "query_id long, vector array<double>")


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["label"])
    return out


def slow(x, queries, space, k, allowed=None):
    out = {}
    for i, q in enumerate(queries):
        d = distances.exact(space, q, x)
        order = [j for j in np.lexsort((np.arange(len(x)), d)) if allowed is None or j in allowed]
        out[i] = order[:k]
    return out


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(47)
    return rng.random((300, 16)), rng.random((25, 16))


@pytest.mark.parametrize("space", ["l2", "ip", "cosine"])
def test_golden_spaces(spark, space):
    rows = [[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 0, 1], [1, 1, 1]]
    want = {"l2": [0, 1, 2, 2, 2], "ip": [-2, -1, 0, 0, 0], "cosine": [0, 0.1835, 0.4226, 0.4226, 0.4226]}
    for before, after in ((0, 0), (3, 1), (8, 16), (16, 17)):
        x = [[0] * before + r + [0] * after for r in rows]
        found = search.knn(make(spark, x), ask(spark, [x[-1]]), 5, space).orderBy("rank").collect()
        assert np.allclose([r["distance"] for r in found], want[space], atol=1e-3)


@pytest.mark.parametrize("space", ["l2", "ip", "cosine"])
def test_both_routes_and_the_column_form_agree(spark, data, space, monkeypatch):
    x, q = data
    want = slow(x, q, space, 10)
    assert got(search.knn(make(spark, x), ask(spark, q), 10, space)) == want
    assert got(search.knn(make(spark, x), ask(spark, q), 10, distances.COLUMNS[space])) == want
    for name, size in (("SENT_QUERIES", 3), ("BLOCK", 70), ("BATCH", 6), ("LANE", 10)):
        monkeypatch.setattr(search, name, size)
    assert got(search.knn(make(spark, x), ask(spark, q), 10, space)) == want
    assert got(search.knn(make(spark, x), ask(spark, q), 10, distances.COLUMNS[space])) == want


def test_filters_ties_deletes_and_small_bases(spark, data):
    x, q = data
    assert got(search.knn(make(spark, x), ask(spark, q), 10, where=F.col("label") % 7 == 0)) == slow(x, q, "l2", 10, set(range(0, 300, 7)))
    assert got(search.knn(make(spark, x, deleted=set(range(0, 300, 2))), ask(spark, q), 4)) == slow(x, q, "l2", 4, set(range(1, 300, 2)))
    assert search.knn(make(spark, x), ask(spark, q), 10, where=F.lit(False)).count() == 0
    same = np.ones((30, 4))
    assert got(search.knn(make(spark, same), ask(spark, same[:1]), 5)) == {0: [0, 1, 2, 3, 4]}
    assert len(got(search.knn(make(spark, x[:3]), ask(spark, q), 10))[0]) == 3
    assert search.knn(make(spark, x[:0]), ask(spark, q), 10).count() == 0
    assert search.knn(make(spark, x), ask(spark, q[:0]), 10).count() == 0
    with pytest.raises(RuntimeError):
        search.knn(make(spark, x[:3]), ask(spark, q), 10, strict=True)
    with pytest.raises(ValueError):
        search.knn(make(spark, x), ask(spark, q), 1, "l3")
    with pytest.raises(Exception, match="dimensionality"):
        search.knn(make(spark, x), ask(spark, q[:, :5]), 1).collect()


def test_radius_and_documents(spark, data):
    x, q = data
    docs = [int(i) % 9 for i in range(300)]
    near = {i: [j for j in slow(x, [v], "l2", 300)[0] if ((x[j] - v) ** 2).sum() <= 1.2] for i, v in enumerate(q)}
    base = make(spark, x, docs)
    assert got(search.search(base, ask(spark, q), "l2", policies.Radius(1.2))) == {i: v for i, v in near.items() if v}
    assert got(search.search(base, ask(spark, q), "l2", policies.Radius(1.2, most=2))) == {i: v[:2] for i, v in near.items() if v}
    self_only = search.search(base, ask(spark, x[:5]), "l2", policies.Radius(1e-4))
    assert got(self_only) == {i: [i] for i in range(5)}
    for i, labels in got(search.search(base, ask(spark, q), "l2", policies.Documents(3))).items():
        order = slow(x, [q[i]], "l2", 300)[0]
        n = next(n for n in range(301) if n == 300 or len({docs[j] for j in order[: n + 1]}) > 3)
        assert labels == order[:n]


def slow_documents(order, docs, count):
    n = next(n for n in range(len(order) + 1) if n == len(order) or len({docs[j] for j in order[: n + 1]}) > count)
    return order[:n]


@pytest.mark.parametrize("parts", [1, 2, 4])
def test_document_prefixes_over_many_batches_and_tasks(spark, data, parts):
    x, q = data
    docs = [int(i) * 7 % 11 for i in range(300)]
    base = make(spark, x, docs).repartition(parts)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = got(search.search(base, ask(spark, q), "ip", policies.Documents(4)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == {i: slow_documents(slow(x, [v], "ip", 300)[0], docs, 4) for i, v in enumerate(q)}


def test_own_distance_with_a_kernel_or_without(spark, data):
    x, q = data
    by_kernel = got(search.knn(make(spark, x), ask(spark, q), 10, distances.l1))
    assert by_kernel == got(search.knn(make(spark, x), ask(spark, q), 10, distances.l1.column))
    assert by_kernel[0] == np.lexsort((np.arange(300), np.abs(x - q[0]).sum(axis=1)))[:10].tolist()


def test_beam_filters_deletes_and_stops(spark):
    rng = np.random.default_rng(5)
    x, q = rng.random((900, 8)), rng.random((20, 8))
    docs = [int(i) % 40 for i in range(900)]
    base, asked = make(spark, x, docs, deleted=set(range(0, 900, 3))), ask(spark, q)
    graph = shards.build(base, links=12, ef_construction=60, shard_rows=450)
    hidden = base.where("deleted OR label % 2 = 0")
    where = F.col("label") % 2 == 1
    for policy, ef in ((policies.TopK(8), 60), (policies.Radius(0.25), 30), (policies.Radius(0.25, most=4), 40), (policies.Documents(5), 25)):
        truth = search.search(base, asked, "l2", policy, where)
        seen = Observation("beam")
        found = shards.search(graph, asked, policy, ef, hidden=hidden, metrics=seen)
        assert found.where("label % 3 = 0 OR label % 2 = 0").count() == 0
        assert search.recall(found, truth).first()["recall"] >= 0.95, policy
        assert seen.get["computed"] > seen.get["hops"] > 0
    assert shards.search(graph, asked, policies.TopK(3), hidden=base).count() == 0


def test_metrics_count_candidates(spark, data):
    x, q = data
    seen = Observation("search")
    search.search(make(spark, x, deleted={1, 2}), ask(spark, q), "l2", policies.TopK(3), F.col("label") < 100, metrics=seen).collect()
    assert seen.get == {"candidates": 98}


def test_recall_and_wide(spark, data):
    x, q = data
    truth = search.knn(make(spark, x), ask(spark, q), 10)
    assert tuple(search.recall(truth.where("rank <= 5"), truth).first()) == (125, 250, 0.5)
    row = search.wide(truth).orderBy("query_id").first()
    assert row["labels"] == slow(x, q, "l2", 10)[0] and row["distances"] == sorted(row["distances"])


def test_approximate_strategies_reach_the_recall_floor(spark):
    rng = np.random.default_rng(1)
    x, q = rng.random((1200, 12)), rng.random((40, 12))
    base, asked = make(spark, x), ask(spark, q)
    truth = search.knn(base, asked, 10)
    assert search.recall(ann.ivf_knn(base, asked, 10, cells=16, probes=10), truth).first()["recall"] >= 0.95
    graph = shards.build(base, links=16, ef_construction=60, shard_rows=500)
    found = shards.knn(graph, asked, 10, ef=80)
    assert search.recall(found, truth).first()["recall"] >= 0.95
    sweep = ann.recall_sweep(graph, asked, truth, 10, [10, 80])
    assert sweep[0]["recall"] <= sweep[1]["recall"] and sweep[1]["recall"] >= 0.95
    edges = shards.edges(graph)
    checks = ann.graph_integrity(edges).first()
    assert checks["nodes"] == 1200 and checks["loops"] == checks["repeated"] == checks["strangers"] == 0
    assert edges.where("level = 0 AND size(dst) > 32 OR level > 0 AND size(dst) > 16").count() == 0


def test_column_distances(spark):
    a, b, zero = [3.0, 4.0], [0.0, 1.0], [0.0, 0.0]
    row = spark.createDataFrame([(a, b, zero)], "a array<double>, b array<double>, z array<double>")
    c = F.col
    got_ = row.select(distances.l2(c("a"), c("b")), distances.ip(c("a"), c("b")), distances.cosine(c("a"), c("b")), distances.cosine(c("a"), c("z")), distances.euclid(c("a"), c("b")), distances.l1(c("a"), c("b"))).first()
    assert np.allclose(list(got_), [18, -3, 0.2, 1, 18**0.5, 6])
    assert row.select(distances.normalize(c("a")), distances.normalize(c("z"))).first() == ([0.6, 0.8], [0.0, 0.0])
    assert row.select(distances.to_u8(c("b"))).first()[0] == [127, 255]
    with pytest.raises(Exception, match="dimensionality"):
        row.select(distances.euclid(c("a"), F.array(F.lit(1.0)))).collect()


def test_the_squared_distance_of_pairs_runs_on_blocks(spark):
    """As columns, a window would sort all pairs; by its kernel only the nearest of a block leave a task."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(300, 16)), np.ones((40, 16))])
    found = search.knn(make(spark, x), ask(spark, x), 10, distances.l2)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    key = lambda df: sorted((r["query_id"], r["rank"], r["label"]) for r in df.collect())
    assert key(found) == key(search.knn(make(spark, x), ask(spark, x), 10))
    column = search.knn(make(spark, x), ask(spark, x), 10, lambda a, b: distances.l2(a, b))
    assert key(found) == key(column)
