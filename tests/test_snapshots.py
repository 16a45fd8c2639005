"""Layered tables, committed versions, and indexes that are saved over what they were read from."""

import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearloom.operators import persist, shards, snapshots
from nearloom.operators.index import FlatIndex, VectorIndex
from nearloom.operators.snapshots import GONE, Conflict, Layer, Layered, Store


def table(spark, x, first=0, docs=None):
    rows = [(first + i, [float(c) for c in v], None if docs is None else docs[i]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "label long, vector array<double>, doc_id long")


def state(index):
    return {r["label"]: (r["vector"], r["deleted"], r["slot"]) for r in index.rows.collect()}


def test_layers_match_a_dictionary(spark):
    rng = random.Random(4)
    want, now = {}, Layered("k", Layer(spark.createDataFrame([], "k long, v long"), 0))
    for step in range(14):
        change = {rng.randrange(60): rng.choice([step, None]) for _ in range(rng.choice([0, 1, 3, 20]) if step else 50)}
        rows = [(k, v, v is None) for k, v in change.items()]
        now = now.changed(spark.createDataFrame(rows, f"k long, v long, {GONE} boolean"))
        want |= change
        want = {k: v for k, v in want.items() if v is not None}
        assert {r["k"]: r["v"] for r in now.rows.collect()} == want and now.rows.count() == len(want)
    assert now.folded().deltas == () and {r["k"]: r["v"] for r in now.folded().rows.collect()} == want


def test_a_change_writes_as_many_rows_as_it_has(spark, monkeypatch):
    written = []
    keep = snapshots.stored
    monkeypatch.setattr(snapshots, "stored", lambda df, what: (written.append(df.count()), keep(df, what))[1])
    index = VectorIndex(spark, "l2", 2)
    index.init_index(max_elements=20_000)
    index.add_items(spark.range(10_000).select(F.col("id").alias("label"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector")), ids="label")
    assert written == [10_000]
    for i in range(8):
        index.add_items(table(spark, np.ones((100, 2)), first=10_000 + 100 * i), ids="label")
    index.mark_deleted([1, 2, 3])
    assert sum(written) < 10_000 + 803 * 5 and index.rows.count() == 10_800 and index.deleted_count() == 3
    plan = index.rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # only keys are sent


def test_saving_over_the_own_path(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "SHARD", 100)
    rng = np.random.default_rng(2)
    x = rng.random((250, 4))
    for kind, change in ((FlatIndex, None), (VectorIndex, "exact"), (VectorIndex, "graph")):
        path = str(tmp_path / f"{kind.__name__}-{change}")
        index = kind(spark, "l2", 4)
        index.init_index(300, **({"strategy": change, "ef_construction": 40} if change else {}))
        index.add_items(table(spark, x), ids="label")
        index.save_index(path)
        for step in range(4):
            back = kind(spark, "l2", 4)
            back.load_index(path)
            if step == 1 and change:
                back.resize_index(400)
                back.mark_deleted([3, 5])
            if step == 2:
                back.add_items(table(spark, x[:2] + 1, first=7), ids="label")
            want = state(back)
            back.save_index(path)
            back.save_index(path)
            again = kind(spark, "l2", 4)
            again.load_index(path)
            assert state(again) == state(back) == want
            asked = table(spark, x[:20]).withColumnRenamed("label", "query_id")
            assert sorted(again.knn_query(asked, k=3).collect()) == sorted(back.knn_query(asked, k=3).collect())
        first = kind(spark, "l2", 4)
        first.load_index(path, version=0)
        assert state(first) == state(index) and len(Store(spark, path).versions()) == 9
        # What did not change was not written again: one folder of vectors, and the two small changes.
        folders = {f for n in range(9) for f in snapshots._folders(Store(spark, path).read(n)["vectors"])}
        assert len(folders) <= 3


def test_a_crash_leaves_the_last_version(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "i")
    index = VectorIndex(spark, "l2", 2)
    index.init_index(10)
    index.add_items(table(spark, np.ones((4, 2))), ids="label")
    index.save_index(path)
    want = state(index)
    index.add_items(table(spark, np.zeros((2, 2)), first=2), ids="label")

    def crash(*_):
        raise OSError("lost")

    for name in ("write", "save", "commit", "_appear"):
        with monkeypatch.context() as m:
            m.setattr(Store, name, crash)
            with pytest.raises(OSError):
                index.save_index(path)
        back = VectorIndex(spark, "l2", 2)
        back.load_index(path)
        assert state(back) == want and Store(spark, path).versions() == [0]
    index.save_index(path)
    back.load_index(path)
    assert state(back) == state(index) != want


def test_of_two_writers_one_wins(spark, tmp_path):
    path = str(tmp_path / "i")
    index = VectorIndex(spark, "l2", 2)
    index.init_index(10)
    index.add_items(table(spark, np.ones((4, 2))), ids="label")
    index.save_index(path)
    one, two = VectorIndex(spark, "l2", 2), VectorIndex(spark, "l2", 2)
    one.load_index(path)
    two.load_index(path)
    one.mark_deleted(1)
    two.mark_deleted(2)
    one.save_index(path)
    with pytest.raises(Conflict):
        two.save_index(path)
    two.load_index(path)
    assert two.rows.where("deleted").first()["label"] == 1
    two.mark_deleted(2)
    two.save_index(path)
    store = Store(spark, path)
    # At once: a version is given to one of many.
    manifest = store.read()
    with ThreadPoolExecutor(8) as pool:
        tries = [pool.submit(Store(spark, path).commit, 3, manifest) for _ in range(8)]
    assert sum(t.exception() is None for t in tries) == 1
    assert all(isinstance(t.exception(), Conflict) for t in tries if t.exception())
    assert store.versions() == [0, 1, 2, 3] and store.expire(2) == [0, 1] and store.versions() == [2, 3]
    fresh = VectorIndex(spark, "l2", 2)
    fresh.load_index(path)
    assert fresh.deleted_count() == 2
    with pytest.raises(FileNotFoundError):
        fresh.load_index(path, version=0)
    with pytest.raises(Conflict):  # its version is gone, another stands in its place
        one.save_index(path)
    with pytest.raises(ValueError):
        store.expire(0)
    with pytest.raises(FileNotFoundError):
        fresh.load_index(str(tmp_path / "none"))


def test_a_distance_of_ones_own_is_not_saved(spark, tmp_path):
    from nearloom.functions import distances

    index = VectorIndex(spark, distances.l1, 2)
    index.init_index(10)
    with pytest.raises(ValueError):
        index.save_index(str(tmp_path / "i"))
    assert persist.HEADER == 96
