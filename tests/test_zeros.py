"""Negative zeros: coded to their bits, in as many bits as the SQL of the sizes counts for a zero."""

import math

import pytest

import __spark_entry__ as entry_points
from nearloom.operators.codecs import decoder, encoder
from nearloom.operators.codecs.bits import BitReader, BitWriter, to_bits
from nearloom.plans.catalog import SIZE_SQL, SIZED

VALUES = [1.5, -0.0, -0.0, 0.0, -0.0, 0.7, -0.3, -0.0, 123.25, -0.0, 99999.99, -0.0, -5.0, 0.0, 0.5]


@pytest.mark.parametrize("codec,config", [("Camel", None), ("DeXOR", None), ("DeXOR", {"buffer_bits": 3}), ("DeXOR", {"skip_available": 2})])
def test_a_negative_zero_is_as_long_as_a_zero(codec, config):
    def coded(values):
        out, coder = BitWriter(), encoder(codec, config)
        for v in values:
            coder.encode(v, out)
        return out.take()

    data, bits = coded(VALUES)
    assert bits == coded([v or 0.0 for v in VALUES])[1]
    reader, coder = BitReader(data, bits), decoder(codec, config)
    assert [to_bits(coder.decode(reader)) for _ in VALUES] == [to_bits(v) for v in VALUES]
    assert math.copysign(1, VALUES[1]) == -1


@pytest.mark.parametrize("name", sorted(SIZE_SQL))
def test_sizes_with_negative_zeros_equal_their_sql(spark, tmp_path, name):
    import duckdb

    con = duckdb.connect()
    tables = {"orders": ("o_orderkey long, o_totalprice double", 1), "customer": ("c_custkey long, c_acctbal double", 3), "events": ("event_id long, value double, user_id long", 7)}
    for table, (schema, step) in tables.items():
        rows = [(i, VALUES[i * step % 15], i % 4)[: schema.count(",") + 1] for i in range(60)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    want = con.execute(entry_points.oracle_sql()[f"{name}_bits"]).fetchall()
    own = entry_points.queries()[f"{name}_bits"](spark, str(tmp_path)).select("series_id", "n_values", "n_bits").collect()
    assert sorted(map(tuple, own)) == sorted(want)
    assert name in SIZED
