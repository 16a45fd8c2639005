"""Index handles: mutation, lookup, persistence, errors; sources and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearloom.operators import mutations, search, shards
from nearloom.operators.index import FlatIndex, LazyIndex, ObjectIndex, VectorIndex
from nearloom.operators.rows import numbered
from nearloom.operators.snapshots import Store
from nearloom.sources import matrices, vecs
from nearloom.streaming import maintain


def frame(spark, labels, shift=0.0):
    return spark.createDataFrame([(i, [float(i) + shift, 1.0]) for i in labels], "label long, vector array<double>")


def state(index):
    return {r["label"]: (r["vector"][0], r["deleted"], r["slot"]) for r in index.rows.collect()}


@pytest.fixture
def index(spark):
    out = VectorIndex(spark, "l2", 2)
    out.init_index(max_elements=8, allow_replace_deleted=True)
    out.add_items(frame(spark, range(6)), ids="label")
    return out


def test_add_overwrite_and_default_ids(spark):
    index = VectorIndex(spark, "l2", 2)
    index.init_index(max_elements=10)
    index.add_items(frame(spark, range(3)).select("vector"))
    index.add_items(frame(spark, range(3), 10).select("vector"))
    assert {k: v[0] for k, v in state(index).items()} == {0: 0, 1: 1, 2: 2, 3: 10, 4: 11, 5: 12}
    index.add_items(frame(spark, [1, 1, 7], 0.5), ids="label")
    assert state(index)[1] == (1.5, False, 1) and state(index)[7] == (7.5, False, 6)
    assert index.get_current_count() == index.element_count == 7 and index.get_max_elements() == 10


def test_delete_restore_and_errors(spark, index):
    index.mark_deleted([1, 4])
    assert index.deleted_count() == 2 and index.get_ids_list().count() == 6
    found = index.knn_query(frame(spark, [1]), k=4).collect()
    assert {r["label"] for r in found} == {0, 2, 3, 5}
    for call, text in ((lambda: index.mark_deleted(1), "already deleted"), (lambda: index.unmark_deleted(0), "not deleted"), (lambda: index.mark_deleted(99), "Label not found"), (lambda: index.get_items([1]), "Label not found")):
        with pytest.raises(RuntimeError, match=text):
            call()
    with pytest.raises(RuntimeError, match="deleted element"):
        index.add_items(frame(spark, [1]), ids="label")
    index.unmark_deleted(1)
    assert state(index)[1][1] is False and index.get_items([1]).count() == 1
    assert index.get_items().count() == 0
    with pytest.raises(ValueError):
        index.get_items(3)
    with pytest.raises(ValueError):
        index.get_items([1], return_type="tuple")


def test_replace_deleted_takes_the_lowest_slots(spark, index):
    index.mark_deleted([4, 1])
    index.add_items(frame(spark, [20, 30, 40, 2], 0.5), ids="label", replace_deleted=True)
    now = state(index)
    assert {k: v[2] for k, v in now.items()} == {0: 0, 20: 1, 2: 2, 3: 3, 30: 4, 5: 5, 40: 6}
    assert now[2][0] == 2.5 and not any(v[1] for v in now.values()) and index.element_count == 7
    with pytest.raises(RuntimeError, match="exceeds"):
        index.add_items(frame(spark, [100, 101]), ids="label")
    index.resize_index(9)
    index.add_items(frame(spark, [100, 101]), ids="label")
    with pytest.raises(RuntimeError, match="resize"):
        index.resize_index(3)
    plain = VectorIndex(spark, "l2", 2)
    plain.init_index(4)
    with pytest.raises(RuntimeError, match="disabled"):
        plain.add_items(frame(spark, [1]), ids="label", replace_deleted=True)
    with pytest.raises(RuntimeError, match="already initiated"):
        plain.init_index(4)


def test_undelete_by_upsert_without_replacement(spark):
    index = VectorIndex(spark, "l2", 2)
    index.init_index(4)
    index.add_items(frame(spark, [1, 2]), ids="label")
    index.mark_deleted(1)
    index.add_items(frame(spark, [1], 0.25), ids="label")
    assert state(index)[1][:2] == (1.25, False)


def test_wrong_vectors_and_ids(spark, index):
    bad = spark.createDataFrame([(1, [1.0])], "label long, vector array<double>")
    with pytest.raises(RuntimeError, match="dimensionality"):
        index.add_items(bad, ids="label")
    with pytest.raises(RuntimeError, match="dimensionality"):
        index.knn_query(bad)
    with pytest.raises(RuntimeError):
        index.add_items(frame(spark, [-1]), ids="label")
    with pytest.raises(ValueError):
        VectorIndex(spark, "hamming", 2)
    with pytest.raises(RuntimeError, match="contiguous"):
        index.knn_query(frame(spark, [1]), k=7)


def test_save_load_clone_and_stats(spark, index, tmp_path):
    index.set_ef(30)
    index.mark_deleted(5)
    index.save_index(str(tmp_path / "i"))
    back = VectorIndex(spark, "ip", 2)
    back.load_index(str(tmp_path / "i"), max_elements=50)
    assert state(back) == state(index) and back.max_elements == 50 and back.space == "ip" and back.ef == 30
    assert tuple(back.stats().select("element_count", "deleted_count", "live_count", "dim", "m").first()) == (6, 1, 5, 2, 16)
    copy = index.clone()
    index.mark_deleted(0)
    assert copy.deleted_count() == 1 and index.deleted_count() == 2 and repr(copy) == "<VectorIndex(space='l2', dim=2)>"
    assert index.index_file_size() > 96 + 6 * (2 * 4 + 8 + 132)
    with pytest.raises(RuntimeError, match="dimension"):
        VectorIndex(spark, "l2", 3).load_index(str(tmp_path / "i"))
    folder = Store(spark, str(tmp_path / "i")).read()["vectors"]["base"]["folder"]
    spark.createDataFrame([], index.rows.schema).write.mode("overwrite").parquet(str(tmp_path / "i" / "data" / folder))
    with pytest.raises(RuntimeError, match="corrupted"):
        VectorIndex(spark, "l2", 2).load_index(str(tmp_path / "i"))


def test_flat_lazy_and_object_indexes(spark):
    flat = FlatIndex(spark, "cosine", 2)
    flat.init_index(5)
    flat.add_items(frame(spark, range(1, 5)), ids="label")
    flat.delete_vector([2, 77])
    assert sorted(state(flat)) == [1, 3, 4] and flat.get_current_count() == 3
    top = flat.knn_query(frame(spark, [3]), k=9).orderBy("rank").collect()
    assert [r["label"] for r in top] == [3, 4, 1] and abs(top[0]["distance"]) < 1e-12
    lazy = LazyIndex(spark, "l2", 2, max_elements=4)
    lazy.set_ef(77)
    assert lazy.knn_query(frame(spark, [1]), k=3).count() == 0
    lazy.add_items(frame(spark, [5]), ids="label")
    assert lazy.ef == 77 and lazy.knn_query(frame(spark, [1])).first()["label"] == 5
    named = ObjectIndex(lazy)
    named.add_items(frame(spark, [8, 9]).select(F.concat(F.lit("n"), "label").alias("name"), "vector"), ids="name")
    assert named.knn_query(frame(spark, [9])).first()["external_id"] == "n9"


def test_numbers_do_not_depend_on_how_jobs_partition(spark):
    rows = spark.range(50_000).select(((F.col("id") * 7919) % 50_000).alias("label"), F.transform(F.sequence(F.lit(1), F.lit(24)), lambda i: (F.col("id") * i).cast("double")).alias("vector"))
    keep = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "400k")
        index = VectorIndex(spark, "l2", 24)
        index.init_index(max_elements=60_000, allow_replace_deleted=True)
        index.add_items(rows, ids="label")
        dense = lambda df, c: tuple(df.agg(F.min(c), F.max(c), F.count_distinct(c), F.count("*")).first())
        assert dense(index.rows, "slot") == (0, 49_999, 50_000, 50_000) and index.rows.where("slot <> label").count() == 0
        index.mark_deleted(rows.where("label % 5 = 0").select("label"))
        index.add_items(rows.where("label < 15000").withColumn("label", F.col("label") + 100_000), ids="label", replace_deleted=True)
        assert dense(index.rows, "slot") == (0, 54_999, 55_000, 55_000) and index.rows.where("deleted").count() == 0
        assert dense(index.rows, "label")[2:] == (55_000, 55_000) and index.rows.where("label >= 100000 AND slot < 50000").count() == 10_000
        plain = VectorIndex(spark, "l2", 24)
        plain.init_index(max_elements=60_000)
        plain.add_items(rows.select("vector").repartition(40))
        assert dense(plain.rows, "label") == (0, 49_999, 50_000, 50_000)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_graph_strategy_answers_saves_and_repairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "SHARD", 200)
    rng = np.random.default_rng(8)
    x = rng.random((600, 8))
    table = lambda ids, x: spark.createDataFrame([(int(i), [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "label long, vector array<double>")
    asked = table(range(30), rng.random((30, 8))).withColumnRenamed("label", "query_id")
    index = VectorIndex(spark, "l2", 8)
    index.init_index(max_elements=700, ef_construction=60, strategy="graph", allow_replace_deleted=True)
    index.add_items(table(range(600), x), ids="label")
    exact = lambda i: search.knn(i.rows, asked, 5)
    recall = lambda i: search.recall(i.knn_query(asked, k=5), exact(i)).first()["recall"]
    index.set_ef(5)
    low = recall(index)
    index.set_ef(80)
    assert low <= recall(index) and recall(index) >= 0.95
    index.mark_deleted(list(range(0, 600, 4)))
    assert recall(index) >= 0.95 and index.knn_query(asked, k=5).where("label % 4 = 0").count() == 0
    before = {(r["shard"], r["level"], r["src"]): r["dst"] for r in index.edges().collect()}
    index.add_items(table(range(1000, 1030), rng.random((30, 8))), ids="label", replace_deleted=True)
    assert recall(index) >= 0.95
    nodes = {r["src"] for r in index.edges().where("level = 0").collect()}
    assert nodes == {r["label"] for r in index.rows.collect()} and set(range(1000, 1030)) <= nodes
    index.add_items(table([2], x[2:3] + 0.5), ids="label")
    now = {(r["shard"], r["level"], r["src"]): r["dst"] for r in index.edges().collect()}
    assert len({k[0] for k in now}) == len({k[0] for k in before}) == 3
    size = index.index_file_size()
    assert size == 96 + 600 * (8 * 4 + 8 + 132 + 4) + 68 * sum(1 for k in now if k[1] > 0)
    index.save_index(str(tmp_path / "g"))
    back = VectorIndex(spark, "l2", 8)
    back.load_index(str(tmp_path / "g"))
    assert sorted(map(str, back.edges().collect())) == sorted(map(str, index.edges().collect()))
    assert sorted(back.knn_query(asked, k=5).collect()) == sorted(index.knn_query(asked, k=5).collect())
    assert index.clone().index_file_size() == size
    flat = VectorIndex(spark, "l2", 8)
    flat.init_index(max_elements=600)
    flat.add_items(table(range(600), x), ids="label")
    with pytest.raises(ValueError):
        VectorIndex(spark, "l2", 8).init_index(5, strategy="tree")


def test_python_filter(spark, index):
    found = index.knn_query(frame(spark, [0, 5]), k=2, filter=lambda label: label % 2 == 1).collect()
    assert {r["label"] for r in found} == {1, 3, 5}


def test_log_state(spark):
    log = [(1, "add", 1, [1.0]), (2, "add", 2, [2.0]), (3, "delete", 1, None), (4, "undelete", 1, None), (5, "add", 2, [5.0]), (6, "delete", 2, None), (7, "delete", 3, None)]
    rows = spark.createDataFrame(log, "seq long, op string, label long, vector array<double>")
    assert {r["label"]: (r["vector"], r["deleted"]) for r in mutations.from_log(rows).collect()} == {1: ([1.0], False), 2: ([5.0], True)}


def test_row_numbers(spark):
    df = spark.range(0, 1000, numPartitions=7).where("id % 3 = 0")
    assert [r["n"] for r in numbered(df, "n", 5).orderBy("id").collect()] == list(range(5, 5 + 334))
    assert numbered(df.where("false"), "n").count() == 0


@pytest.mark.parametrize("kind", sorted(vecs.KINDS))
def test_vector_files(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (500, 12)) if kind != "fvecs" else rng.random((500, 12)).astype("f4")
    (tmp_path / "d").mkdir()
    for i, part in enumerate(np.split(x, [200, 201])):
        (tmp_path / "d" / f"p{i}.{kind}").write_bytes(vecs.encode(part, kind))
    rows = vecs.read(spark, str(tmp_path / "d"), kind, dim=12, split=1000).orderBy("row").collect()
    assert [r["row"] for r in rows] == list(range(500)) and np.allclose([r["vector"] for r in rows], x)
    if not kind.startswith("raw"):
        with pytest.raises(Exception, match="components"):
            vecs.read(spark, str(tmp_path / "d"), kind, dim=13).collect()
    (tmp_path / "bad").write_bytes(b"\x0c\0\0\0" + b"123")
    with pytest.raises(Exception, match="multiple"):
        vecs.read(spark, str(tmp_path / "bad"), kind, dim=12).collect()


def test_csv_matrices(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1,2.5,x,-3e2\n\n 4 ,5,,6\n")
    assert [r["vector"] for r in matrices.read_csv(spark, str(tmp_path / "m.csv")).collect()] == [[1, 2.5, -300], [4, 5, 6]]
    (tmp_path / "r.csv").write_text("1,2\n3\n")
    with pytest.raises(Exception, match="columns"):
        matrices.read_csv(spark, str(tmp_path / "r.csv")).collect()
    matrices.write_csv(spark.createDataFrame([([1.26, -0.5],)], "vector array<double>"), str(tmp_path / "o"), precision=1)
    assert matrices.read_csv(spark, str(tmp_path / "o")).first()["vector"] == [1.3, -0.5]
    (tmp_path / "c.txt").write_text("100 3 1000 8 5\n")
    assert matrices.read_numbers(spark, str(tmp_path / "c.txt")) == [100, 3, 1000, 8, 5]


def test_a_batch_that_runs_twice_writes_the_same_version(spark, tmp_path):
    log = spark.createDataFrame([(1, "add", 1, [1.0]), (2, "add", 2, [2.0])], "seq long, op string, label long, vector array<double>")
    assert maintain.read_version(spark, str(tmp_path), -1).count() == 0
    for _ in range(2):
        maintain.apply_batch(log, str(tmp_path), 0)
    more = spark.createDataFrame([(3, "delete", 2, None), (4, "add", 3, [3.0])], log.schema)
    for _ in range(2):
        maintain.apply_batch(more, str(tmp_path), 1)
    state = lambda n: sorted((r["label"], r["deleted"], r["seq"]) for r in maintain.read_version(spark, str(tmp_path), n).collect())
    assert state(1) == state(9) == [(1, False, 1), (2, True, 3), (3, False, 4)]
    assert state(0) == [(1, False, 1), (2, False, 2)] and Store(spark, str(tmp_path)).versions() == [0, 1]
