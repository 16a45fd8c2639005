"""Approximate search by an inverted file of k-means cells, and measures of it and of graphs.

Graphs themselves are in :mod:`nearloom.operators.shards`.  What is found is
rescored exactly, so only recall is approximate; measure it with
:func:`nearloom.operators.search.recall` against the exact answer.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from nearloom.functions import distances
from nearloom.operators import shards
from nearloom.operators.policies import TopK
from nearloom.operators.search import BATCH, BLOCK, FOUND, LANE, _docs, _Kept, _rows, _scan, matrix, recall
from nearloom.session import ship
from nearloom.shared import stored

#: Vectors that cells are fitted on, at most: those with the smallest hashes of their labels.
SAMPLE = 50_000


def fit_cells(base: DataFrame, cells: int, rounds: int = 12, seed: int = 100, sample: int = SAMPLE) -> np.ndarray:
    """Centres of ``cells`` cells by Lloyd's algorithm on a bounded sample."""
    rows = base.where(~F.col("deleted")).orderBy(F.xxhash64("label"), "label").limit(sample).select("vector").toArrow()
    x = matrix(rows.column("vector"), None)
    if not len(x):
        return np.zeros((0, 0))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        own = distances.block("l2", x, centres).argmin(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(axis=0)
    return centres


def _nearest_cells(df: DataFrame, key: str, centres: np.ndarray, probes: int) -> DataFrame:
    """``df (key, vector, ...)`` with a row per one of the ``probes`` nearest ``cell``s."""
    sent = df.sparkSession.sparkContext.broadcast(centres)
    schema = df.withColumn("cell", F.lit(0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            near = np.argsort(distances.block("l2", matrix(b.column("vector"), sent.value.shape[1]), sent.value), axis=1, kind="stable")[:, :probes]
            rows = np.repeat(np.arange(b.num_rows), near.shape[1])
            out = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(near.ravel().astype(np.int32))], [*out.schema.names, "cell"])

    return df.mapInArrow(run, schema)


def ivf_knn(base: DataFrame, queries: DataFrame, k: int, space: str = "l2", cells: int = 32, probes: int = 8, seed: int = 100) -> DataFrame:
    """``(query_id, rank, label, doc_id, distance)`` of the ``k`` nearest in the ``probes`` cells nearest to each query.

    A cell with more than a block of rows is split, and its queries are sent
    to each part, so that no task holds a whole cell.
    """
    ship(base.sparkSession)
    live = base.where(~F.col("deleted")).where(distances.finite("vector")).select("label", "vector", "doc_id")
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").where(distances.finite("vector"))
    if space == "cosine":
        live, asked = (df.withColumn("vector", distances.normalize(F.col("vector"))) for df in (live, asked))
    centres = fit_cells(live.withColumn("deleted", F.lit(False)), cells, seed=seed)
    if not len(centres):
        return base.sparkSession.createDataFrame([], "query_id long, rank int, label long, doc_id long, distance double")
    placed = stored(_nearest_cells(live, "label", centres, 1), "cells")
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}
    parts = F.create_map(*[F.lit(x) for c, n in sizes.items() for x in (c, -(-n // BLOCK))])
    left = placed.withColumn("part", F.pmod(F.xxhash64("label"), parts[F.col("cell")]).cast("int"))
    wanted = _nearest_cells(asked, "query_id", centres, probes).where(F.col("cell").isin(list(sizes)))
    batches = max(1, -(-asked.count() // LANE))
    wanted = wanted.withColumns({"part": F.explode(F.sequence(F.lit(0), parts[F.col("cell")] - 1)), "batch": F.pmod(F.xxhash64("query_id"), F.lit(batches)).cast("int")})
    left = left.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    policy = TopK(k)

    def run(own: pa.Table, ask: pa.Table) -> pa.Table:
        ids = ask.column("query_id").to_numpy()
        kept = [_Kept() for _ in ids]
        if own.num_rows and ask.num_rows:
            q = matrix(ask.column("vector"), None)
            x = matrix(own.column("vector"), q.shape[1])
            for i in range(0, len(q), BATCH):
                _scan(kept[i : i + BATCH], q[i : i + BATCH], own.column("label").to_numpy(), _docs(own.column("doc_id")), x, space, policy, None)
        return pa.Table.from_batches([_rows(ids, kept)])

    keys = ["cell", "part", "batch"]
    found = left.groupBy(*keys).cogroup(wanted.groupBy(*keys)).applyInArrow(run, FOUND)
    return policy.choose(found).select("query_id", "rank", "label", "doc_id", "distance")


def recall_sweep(graph: shards.Shards, queries: DataFrame, truth: DataFrame, k: int, efs: Sequence[int], probes: int | None = None) -> list[dict[str, float]]:
    """``ef``, ``recall``, ``seconds_per_query`` and ``computed`` distances a query of a graph for each beam width, to choose one by."""
    out = []
    asked = max(1, queries.count())
    for ef in efs:
        began, seen = time.perf_counter(), Observation()
        share = recall(shards.knn(graph, queries, k, ef, probes=probes, metrics=seen), truth).first()["recall"]
        out.append({"ef": ef, "recall": share, "seconds_per_query": (time.perf_counter() - began) / asked, "computed": seen.get["computed"] / asked})
    return out


def graph_integrity(edges: DataFrame) -> DataFrame:
    """One row ``(nodes, links, loops, repeated, strangers, without_inbound, least_inbound, most_inbound)`` over level 0."""
    ground = edges.where("level = 0")
    links = ground.select("shard", "src", F.explode("dst").alias("dst"))
    inbound = links.groupBy("shard", "dst").agg(F.count("*").alias("n"))
    both = ground.select("shard", "src").join(inbound.withColumnRenamed("dst", "src"), ["shard", "src"], "full")
    nodes = ground.agg(F.count("*").alias("nodes"), F.coalesce(F.sum(F.size("dst")), F.lit(0)).alias("links"), F.coalesce(F.sum(F.size("dst") - F.size(F.array_distinct("dst"))), F.lit(0)).alias("repeated"))
    loops = links.agg(F.count_if(F.col("src") == F.col("dst")).alias("loops"))
    known = ground.select("shard", F.col("src").alias("dst"))
    strangers = links.join(known, ["shard", "dst"], "left_anti").agg(F.count("*").alias("strangers"))
    seen = both.agg(F.count_if(F.col("n").isNull()).alias("without_inbound"), F.coalesce(F.min(F.coalesce("n", F.lit(0))), F.lit(0)).alias("least_inbound"), F.coalesce(F.max("n"), F.lit(0)).alias("most_inbound"))
    one = lambda df: df.withColumn("_1", F.lit(1))
    return one(nodes).join(one(loops), "_1").join(one(strangers), "_1").join(one(seen), "_1").drop("_1")
