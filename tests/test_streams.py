"""Streams whose rows come late: coded in order of time behind a watermark."""

import math
import random

import pytest
from pyspark.sql import functions as F

from nearloom.operators.codecs import series
from nearloom.streaming import maintain

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


def run(spark, rows, path, parts, **more):
    """``rows`` in files in the order given, one a micro-batch; all results, in order of batches."""
    schema = "series_id string, pos long, value double, ts timestamp"
    for i in range(parts):
        spark.createDataFrame(rows[len(rows) * i // parts : len(rows) * (i + 1) // parts], schema).coalesce(1).write.mode("append").parquet(f"{path}/rows")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/rows")
    sizes = maintain.codec_sizes_in_order(stream, "Gorilla", **more)
    sink = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/out/batch={n}")
    sizes.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start().awaitTermination()
    return [r for r in spark.read.parquet(f"{path}/out").orderBy("batch").collect()]


def at(spark, seconds):
    return spark.sql(f"SELECT timestamp_seconds({seconds})").first()[0]


def test_a_shuffled_stream_gives_the_sizes_of_the_ordered_series(rocks, tmp_path):
    rng = random.Random(5)
    rows = [(sid, i, round(math.sin(i / 7) * 10, 2), at(rocks, 1_000_000 + 10 * i)) for sid in "ab" for i in range(120)]
    # Late by up to 20 places, within the delay; a row far ahead moves the watermark past all.
    late = sorted(rows, key=lambda r: r[1] + rng.random() * 20) + [("end", 0, 1.0, at(rocks, 3_000_000))]
    found = run(rocks, late, str(tmp_path), 4, delay="10 minutes")
    last = {r["series_id"]: (r["n_values"], r["n_bits"]) for r in found}
    want = series.compress(rocks.createDataFrame(rows, "series_id string, pos long, value double, ts timestamp"), "Gorilla").groupBy("series_id").agg(F.sum("n_values"), F.sum("n_bits")).collect()
    assert {k: last[k] for k in "ab"} == {r[0]: (r[1], r[2]) for r in want}
    assert not any(r["closed"] for r in found) and "end" not in last


def test_idle_series_are_closed(rocks, tmp_path):
    rows = [("a", i, 1.0, at(rocks, 1_000_000 + i)) for i in range(10)] + [("b", 0, 2.0, at(rocks, 2_000_000)), ("a", 99, 5.0, at(rocks, 2_000_001)), ("c", 0, 2.0, at(rocks, 3_000_000)), ("d", 0, 2.0, at(rocks, 4_000_000))]
    found = [(r["series_id"], r["n_values"], r["closed"]) for r in run(rocks, rows, str(tmp_path), 7, delay="1 second", idle="1 hour")]
    own = [f[1:] for f in found if f[0] == "a"]
    # Ten values, closed; what comes much later begins a series of its own, which is closed in turn.
    assert (10, True) in own and own[-1] == (1, True) and max(n for n, _ in own) == 10


def test_streamed_sizes_take_bounded_batches(spark, monkeypatch):
    """A long series comes in many micro-batches, in order, and has the sizes of one that is coded at once."""
    from nearloom.plans import catalog

    monkeypatch.setattr(catalog, "STREAMED", 500)
    d = "/root/testdata/sf0.001"
    found = catalog.QUERIES["stream_elf_bits"](spark, d)
    assert len({r[0] for r in found.sparkSession.read.parquet(found.inputFiles()[0].split("/sizes/")[0] + "/sizes").select("batch").distinct().collect()}) >= 5
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, catalog.QUERIES["elf_bits"](spark, d).collect()))


def test_gorilla_sizes_sort_no_whole_series(spark, monkeypatch):
    monkeypatch.setattr(series, "SEGMENT", 200)
    monkeypatch.setattr(series, "SAMPLED", 4)
    rows = spark.range(3000).selectExpr("'s' AS series_id", "id AS pos", "round(sin(id) * 50, 2) AS value")
    found = series.gorilla_bits(rows)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert tuple(found.first()) == tuple(series.compress(rows, "Gorilla").groupBy("series_id").agg(F.sum("n_values"), F.sum("n_bits")).first())


def test_many_series_share_the_state_of_few_groups(spark, tmp_path, monkeypatch):
    """Series that come and go over micro-batches, one without a name, have the sizes of ones coded at once; and there are no more states than groups."""
    monkeypatch.setattr(maintain, "GROUPS", 3)
    rows = spark.range(3000).selectExpr("nullif('s' || id % 40, 's7') AS series_id", "id AS pos", "CAST(round(sin(id) * 50, 2) AS double) AS value")
    for i in range(3):
        rows.where(f"pos >= {i * 1000} AND pos < {i * 1000 + 1000} AND ({i} <> 1 OR pos % 40 < 20)").coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/rows")
    sink = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    run = maintain.codec_sizes(stream, "DeXOR", {"buffer_bits": 1}).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] == 3
    found = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r["count"] for r in found.groupBy("batch").count().collect()) == [20, 40, 40]
    last = {r[0]: tuple(r[1:]) for r in found.groupBy("series_id").agg(F.max("n_values"), F.max("n_bits")).collect()}
    seen = spark.read.parquet(f"{tmp_path}/rows").selectExpr("coalesce(series_id, 'none') AS series_id", "pos", "value")
    want = series.compress(seen, "DeXOR", {"buffer_bits": 1}).groupBy("series_id").agg(F.sum("n_values"), F.sum("n_bits")).collect()
    assert {k or "none": v for k, v in last.items()} == {r[0]: tuple(r[1:]) for r in want}
