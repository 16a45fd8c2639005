"""Restartable blocks, trial coding and the data source that stores them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearloom.operators.codecs import blocks, encoder, series
from nearloom.operators.codecs.bits import BitWriter, to_bits
from nearloom.shared import stored
from nearloom.sources import series_blocks

NAN, INF = float("nan"), float("inf")
KINDS = {
    "steps": [float(i // 50) for i in range(900)],
    "prices": [round(100 + math.sin(i / 9) * 20, 2) for i in range(900)],
    "noise": [random.Random(i).random() for i in range(900)],
    "odd": [NAN, INF, -INF, 0.0, -0.0, 5e-324, 1e300, 0.1] * 30,
    "one": [2.5],
}


def table(spark):
    rows = [(k, 3 * i, v) for k, vs in KINDS.items() for i, v in enumerate(vs)] + [("steps", None, 1.0), (None, 1, 1.0), ("steps", 5, None)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "series_id string, pos long, value double").repartition(5)


def tidy(df):
    out = {}
    for r in df.select("series_id", "pos", "value").collect():
        out.setdefault(r["series_id"], []).append((r["pos"], to_bits(r["value"])))
    return {k: sorted(v) for k, v in out.items()}


WANT = {k: [(3 * i, to_bits(v)) for i, v in enumerate(vs)] for k, vs in KINDS.items()}


def size(codec, config, values):
    coder, out = encoder(codec, config), BitWriter()
    for v in values:
        coder.encode(v, out)
    return out.n_bits


@pytest.mark.parametrize("rows,tasks", [(1, 3), (7, 4), (100, 2), (16_384, None)])
def test_blocks_round_trip_whatever_their_cuts(spark, rows, tasks):
    found = blocks.compress(table(spark), rows, tasks=tasks).cache()
    assert tidy(blocks.decompress(found.repartition(3))) == WANT
    assert found.agg(F.max("n_values")).first()[0] <= rows
    assert blocks.compress(table(spark).where("false")).count() == 0
    found.unpersist()


def test_each_block_is_decoded_by_itself_and_is_the_smallest(spark):
    found = [r.asDict() for r in blocks.compress(table(spark), 128, tasks=4).collect()]
    random.Random(2).shuffle(found)
    used = set()
    for row in found:
        pos, values = blocks.opened(row)
        assert (pos[0], pos[-1], len(values)) == (row["first_pos"], row["last_pos"], row["n_values"])
        sizes = [size(codec, config, values.tolist()) for codec, config in blocks.TRIED]
        assert row["n_bits"] == min(sizes)
        used.add(row["codec"])
    assert len(used) >= 3
    # Never larger than the best single codec over the same blocks; what restarting costs is a start a block.
    whole = sum(r["n_bits"] for r in found)
    single = {(c, str(g)): sum(size(c, g, blocks.opened(r)[1].tolist()) for r in found) for c, g in blocks.TRIED}
    assert whole <= min(single.values())


def test_restarts_cost_little(spark):
    rows = table(spark).where("series_id = 'prices'")
    one = [("DeXOR", None)]
    through = series.compress(rows, "DeXOR").agg(F.sum("n_bits")).first()[0]
    cut = blocks.compress(rows, 100, one, tasks=1)
    n, bits = cut.agg(F.count("*"), F.sum("n_bits")).first()
    assert n == 9 and through < bits <= through + n * 64


def test_one_series_keeps_all_tasks_busy(spark):
    rows = spark.range(200_000).select(F.lit("s").alias("series_id"), F.col("id").alias("pos"), F.round(F.sin(F.col("id") / 50) * 10, 1).alias("value"))
    coded = blocks.compress(rows, 4096, [("Gorilla", None)], tasks=4).withColumn("task", F.spark_partition_id())
    by = [r["n"] for r in coded.groupBy("task").agg(F.sum("n_values").alias("n")).collect()]
    assert len(by) == 4 and max(by) < 100_000 and sum(by) == 200_000


def test_a_range_reads_the_blocks_that_it_needs(spark):
    found = stored(blocks.compress(table(spark), 50, tasks=3), "blocks")
    for bounds in ({"first": 300, "last": 600}, {"least": 110.0}, {"greatest": -1.0}, {"first": 2600, "least": 0.5, "greatest": 0.6}, {}):
        lo, hi, least, most = (bounds.get(k) for k in ("first", "last", "least", "greatest"))
        beyond = lambda v, m: math.isnan(v) or v > m
        want = {k: [(p, to_bits(v)) for i, v in enumerate(vs) for p in [3 * i] if (lo is None or p >= lo) and (hi is None or p <= hi) and (least is None or math.isnan(v) or v >= least) and (most is None or not beyond(v, most))] for k, vs in KINDS.items()}
        assert tidy(blocks.read_range(found, **bounds)) == {k: v for k, v in want.items() if v}
    assert found.where(blocks.within(first=300, last=600)).where("series_id = 'steps'").count() <= 4 < found.where("series_id = 'steps'").count()


def test_the_data_source_stores_and_prunes(spark, tmp_path):
    path = str(tmp_path / "s")
    series_blocks.write(table(spark), path, rows=50, tasks=4)
    back = series_blocks.read(spark, path)
    assert tidy(back) == WANT
    assert tidy(back.where("series_id = 'prices' AND pos BETWEEN 300 AND 600")) == {"prices": [x for x in WANT["prices"] if 300 <= x[0] <= 600]}
    assert back.where("value > 1e299").count() == 30 * 3  # infinities, 1e300 and NaN, which is greater than any number
    assert back.where("pos IN (0, 2697)").count() == 8 and back.where("value = -1e9 OR pos = 3").count() == 4

    def touched(*conditions):
        reader = series_blocks.Reader({"path": path})
        reader.conditions = list(conditions)
        return sum(1 for part in reader.partitions() for _ in reader.chosen(part))

    every = touched()
    assert every >= 18 * 3
    assert touched(("series_id", "=", ["prices"]), ("pos", ">=", [300]), ("pos", "<=", [600])) <= 4
    assert touched(("value", ">", [1e299])) <= 6 and touched(("pos", "<", [0])) == 0 and touched(("series_id", "=", ["none"])) == 0
    # More is added, or put in its place.
    more = spark.createDataFrame([("prices", 10**6, 1.5)], "series_id string, pos long, value double")
    series_blocks.write(more, path)
    assert series_blocks.read(spark, path).count() == sum(map(len, KINDS.values())) + 1
    series_blocks.write(more, path, mode="overwrite")
    assert tidy(series_blocks.read(spark, path)) == {"prices": [(10**6, to_bits(1.5))]}
    series_blocks.write(more.where("false"), path)
    assert series_blocks.read(spark, path).count() == 1


def test_files_of_a_failed_write_do_not_count(spark, tmp_path):
    path = str(tmp_path / "s")
    good = spark.createDataFrame([("a", 1, 1.0)], "series_id string, pos long, value double")
    series_blocks.write(good, path)

    @F.udf("double")
    def fails(pos):
        if pos == 900:
            raise ValueError("lost")
        return 1.0

    bad = spark.range(1000).select(F.lit("b").alias("series_id"), F.col("id").alias("pos")).withColumn("value", fails("pos"))
    with pytest.raises(Exception, match="lost"):
        bad.write.format(series_blocks.NAME).mode("append").save(path)
    assert tidy(series_blocks.read(spark, path)) == {"a": [(1, to_bits(1.0))]}
    assert series_blocks.read(spark, str(tmp_path / "none")).count() == 0


def test_bounds():
    held = {"series_id": ["a", "c"], "pos": [3, 9], "value": [-1.0, NAN]}
    yes = [("pos", "=", [1, 5]), ("pos", ">", [8]), ("pos", ">=", [9]), ("pos", "<", [4]), ("pos", "<=", [3]), ("value", ">", [INF]), ("value", "=", [NAN]), ("series_id", "=", ["b"])]
    no = [("pos", "=", [1, 10]), ("pos", ">", [9]), ("pos", ">=", [10]), ("pos", "<", [3]), ("pos", "<=", [2]), ("value", "<", [-1.0]), ("value", ">", [NAN]), ("series_id", ">", ["c"]), ("pos", "=", [])]
    assert all(series_blocks.may_hold(held, [c]) for c in yes) and not any(series_blocks.may_hold(held, [c]) for c in no)
    assert series_blocks.may_hold(held, yes) and not series_blocks.may_hold(held, [yes[0], no[0]])
    assert blocks.ranges(np.array([NAN])) [0] != blocks.ranges(np.array([1.0]))[0]


def test_files_hold_a_bounded_number_of_blocks(spark, tmp_path):
    """Many short series: a task's blocks are dealt to files, so that no footer grows with the input."""
    import pyarrow.parquet as pq

    path = str(tmp_path / "s")
    rows = spark.range(6000).select(F.concat(F.lit("s"), F.col("id") % 3000).alias("series_id"), F.col("id").alias("pos"), (F.col("id") / 4).alias("value"))
    series_blocks.write(rows, path, tasks=1)
    files = series_blocks.committed(path)
    groups = [pq.ParquetFile(f"{path}/{f['name']}").num_row_groups for f in files]
    assert len(files) == 3 and max(groups) <= 1024 and sum(groups) == 3000
    back = series_blocks.read(spark, path)
    assert back.count() == 6000 and back.where("pos = 4000").collect()[0]["series_id"] == "s1000"
