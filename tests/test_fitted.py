"""Vectors without any structure: the shards to visit are measured, and each vector has a link that leads to it."""

import numpy as np
from pyspark.sql import functions as F

from nearloom.operators import search, shards
from nearloom.operators.graph import Graph
from nearloom.operators.index import VectorIndex

X = np.random.default_rng(3).normal(size=(1_500, 48))


def test_an_index_visits_as_many_shards_as_its_recall_needs(spark, monkeypatch):
    monkeypatch.setattr(shards, "SHARD", 100)
    rows = spark.createDataFrame([(i, x.tolist(), i % 7) for i, x in enumerate(X)], "label long, vector array<double>, doc_id long")
    asked = rows.where("label % 5 = 0").select(F.col("label").alias("query_id"), "vector")
    index = VectorIndex(spark, "l2", 48)
    index.init_index(1_500, ef_construction=40, strategy="graph")
    index.add_items(rows, ids="label")
    index.set_ef(40)
    assert search.recall(index.knn_query(asked, k=10), search.knn(index.rows, asked, 10)).first()["recall"] >= 0.95


def test_links_lead_to_every_node():
    g = Graph(X[:700] / np.linalg.norm(X[:700], axis=1, keepdims=True), "l2", 4, 20)
    _, heads, ends = g.pack()
    heads = np.frombuffer(heads, np.int32).reshape(-1, 3)
    ground = np.frombuffer(ends, np.int32)[: heads[heads[:, 0] == 0][:, 2].sum()]
    assert (np.bincount(ground, minlength=700) > 0).all()
    for node, links in g.out[0].items():
        assert len(links) <= 8 and node not in links and len(set(links.tolist())) == len(links)
