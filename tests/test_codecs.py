"""Codecs: exact bit counts where the layout states them, and round trips of any doubles."""

import math
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearloom.operators.codecs import CODECS, copied, decoder, encoder, parse_config, series
from nearloom.operators.codecs.bits import BitReader, BitWriter, decimal, from_decimal, leading_zeros, to_bits, trailing_zeros

VARIANTS = [("Gorilla", None), ("Elf", None), ("Camel", None), ("DeXOR", None), ("DeXOR", {"buffer_bits": 3}), ("DeXOR", {"skip_available": 2}), ("DeXOR", {"rho": 2})]
EDGE = [0.0, -0.0, 1.0, 1.0, float("nan"), float("nan"), float("inf"), -float("inf"), 5e-324, 1.7976931348623157e308, -2.5, 0.1, 0.3, 1e-5, 1e-12, 123456.789, 1e22, 1e300, 100.0, 65536.5, -0.0001, 12.3456, 0.1 + 0.2, -7.0, 1e-10, 0.001]


def bits_of(values):
    return [to_bits(v) for v in values]


def run(codec, config, values):
    enc, out = encoder(codec, config), BitWriter()
    for v in values:
        enc.encode(v, out)
    data, n = out.take()
    assert len(data) == -(-n // 8)
    dec, reader = decoder(codec, config), BitReader(data, n)
    back = [dec.decode(reader) for _ in values]
    assert bits_of(back) == bits_of(values)
    with pytest.raises(EOFError):
        reader.get(1)
    return n


@pytest.mark.parametrize("codec,config", VARIANTS)
def test_edge_values(codec, config):
    for values in (EDGE, EDGE[::-1], [v for v in EDGE for _ in range(2)], [0.0], [], [float("nan")] * 4):
        run(codec, config, values)


@pytest.mark.parametrize("codec,config", VARIANTS)
@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.floats(width=64), st.decimals(-(10**6), 10**6, places=2).map(float), st.integers(-(10**5), 10**5).map(float)), max_size=40))
def test_any_values(codec, config, values):
    run(codec, config, values)


def test_sizes_follow_the_layouts():
    assert run("Gorilla", None, [1.5, 1.5, 1.5]) == 66
    assert run("Gorilla", None, [1.0, 1.5]) == 64 + 2 + 64  # the first change fits the initial window
    assert run("Camel", None, [10.0, 10.5]) == 64 + 2 + 2 + 1 + 1 + 3
    assert run("Camel", None, [10.25, 19.25]) == 64 + 4 + 16 + 2 + 1 + 2 + 1 + 3
    assert run("Camel", None, [10.5, 8.25]) == 64 + 4 + 3 + 2 + 1 + 2 + 1 + 3 - 0
    assert run("Camel", None, [0.5, 1e6 + 0.5]) == 64 + 20 + 64
    assert run("Elf", None, [2.0, 2.0]) == 64 + 1 + 2
    # 12.3: new place (-1), three digits and a sign; 12.4: the same place, one digit past the shared 12.
    assert run("DeXOR", None, [12.3]) == 2 + 5 + 4 + 1 + 10
    assert run("DeXOR", None, [12.3, 12.4]) == 22 + 2 + 4 + 4
    assert run("DeXOR", None, [12.3, 12.4, 12.5]) == 32 + 2 + 4
    assert run("DeXOR", {"buffer_bits": 2}, [12.3, 12.4]) == 22 + 10 + 4


def test_helpers():
    assert [leading_zeros(x) for x in (0, 1, 1 << 63)] == [64, 63, 0] and [trailing_zeros(x) for x in (0, 1, 1 << 63)] == [64, 0, 63]
    assert decimal(-120.50) == (-1205, -1) and decimal(0.0) == (0, 0) and decimal(math.inf) is None and from_decimal(*decimal(1e22)) == 1e22
    assert parse_config("{buffer_bits:3, rho:8}") == {"buffer_bits": 3, "rho": 8} and parse_config(None) == parse_config("{}") == {}
    with pytest.raises(ValueError):
        encoder("Zip")
    with pytest.raises(ValueError):
        encoder("Gorilla", None, "Int")
    assert set(CODECS) == {"Gorilla", "Elf", "Camel", "DeXOR"}


def table(spark):
    rows = [("a", i, v) for i, v in enumerate(EDGE * 40)] + [("b", 10 - i, float(i)) for i in range(5)] + [("c", 1, None), (None, 1, 2.0)]
    return spark.createDataFrame(rows, "series_id string, pos long, value double").repartition(6)


@pytest.mark.parametrize("codec,config", VARIANTS)
def test_tables_round_trip_in_blocks(spark, codec, config):
    blocks = series.compress(table(spark), codec, config, block_bits=3000)
    assert blocks.where("series_id = 'a'").count() > 1
    back = {}
    for r in series.decompress(blocks.repartition(5), codec, config).orderBy("series_id", "idx").collect():
        back.setdefault(r["series_id"], []).append(r["value"])
    assert {k: bits_of(v) for k, v in back.items()} == {"a": bits_of(EDGE * 40), "b": bits_of([4.0, 3.0, 2.0, 1.0, 0.0])}
    assert series.compress(table(spark).where("false"), codec, config).count() == 0


def test_window_form_counts_what_the_encoder_writes(spark):
    coded = series.compress(table(spark), "Gorilla").groupBy("series_id").agg(F.sum("n_values").alias("n_values"), F.sum("n_bits").alias("n_bits"))
    counted = series.gorilla_bits(table(spark))
    assert sorted(map(tuple, coded.collect())) == sorted(map(tuple, counted.collect()))


def test_double_bits_keep_signs_and_nulls(spark):
    rows = spark.createDataFrame([(v,) for v in (0.0, -0.0, 1.5, float("nan"), None)], "x double")
    want = [None if v is None else struct.unpack(">q", struct.pack(">d", v))[0] for v in (0.0, -0.0, 1.5, float("nan"), None)]
    assert [r[0] for r in rows.select(series.double_bits(F.col("x"))).collect()] == want


@pytest.mark.parametrize("codec,config", VARIANTS)
def test_a_copied_encoder_codes_on_trial(codec, config):
    own, out = encoder(codec, config), BitWriter()
    for v in (1.25, 1.5, 100.75):
        own.encode(v, out)
    trial, spare = copied(own), BitWriter()
    for v in (7.0, 8.25, -3.5):
        trial.encode(v, spare)
    own.encode(101.5, out)
    again, whole = encoder(codec, config), BitWriter()
    for v in (1.25, 1.5, 100.75, 101.5):
        again.encode(v, whole)
    assert out.take() == whole.take() and spare.n_bits


def test_total_sizes_in_one_pass(spark):
    names = {"a": ("Gorilla", None), "b": ("Elf", None), "c": ("DeXOR", {"buffer_bits": 3})}
    got = {r["algorithm"]: (r["n_values"], r["n_bits"]) for r in series.total_bits(table(spark), names).collect()}
    want = {k: tuple(series.compress(table(spark), *v).agg(F.sum("n_values"), F.sum("n_bits")).first()) for k, v in names.items()}
    assert got == want
    assert {tuple(r) for r in series.total_bits(table(spark).where("false"), names).collect()} == {(k, 0, 0) for k in names}


@pytest.mark.parametrize("codec,config", VARIANTS)
def test_segments_of_a_long_series_are_coded_as_one_stream(spark, codec, config, monkeypatch):
    """Also where what leads up to a cut does not tell the coder's state: long runs of one value, exceptions long ago."""
    monkeypatch.setattr(series, "SEGMENT", 96)
    monkeypatch.setattr(series, "SAMPLED", 4)
    monkeypatch.setattr(series, "LEAD", 2)
    values = [0.1 + 0.2, 1e-300, 7.25, 7.5] + [7.5] * 400 + [round(math.sin(i) * 50, 2) for i in range(500)] + EDGE * 4 + [2.5] * 30
    rows = [("long", 3 * i, v) for i, v in enumerate(values)] + [("short", i, v) for i, v in enumerate(EDGE)]
    blocks = series.compress(spark.createDataFrame(rows, "series_id string, pos long, value double").repartition(5), codec, config)
    assert blocks.where("series_id = 'long'").count() > 3
    sizes = {r[0]: (r[1], r[2]) for r in blocks.groupBy("series_id").agg(F.sum("n_values"), F.sum("n_bits")).collect()}
    assert sizes == {"long": (len(values), run(codec, config, values)), "short": (len(EDGE), run(codec, config, EDGE))}
    back = [r["value"] for r in series.decompress(blocks.repartition(3), codec, config).where("series_id = 'long'").orderBy("idx").collect()]
    assert bits_of(back) == bits_of(values)


@pytest.mark.parametrize("codec,config", VARIANTS)
def test_segments_of_ordinary_values_are_coded_once(spark, codec, config, monkeypatch):
    monkeypatch.setattr(series, "SEGMENT", 400)
    monkeypatch.setattr(series, "SAMPLED", 4)
    calls, own = [], series._coded
    monkeypatch.setattr(series, "_coded", lambda *a: calls.append(a) or own(*a))
    values = [round(math.sin(i) * 50, 2) for i in range(3000)]
    blocks = series.compress(spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], "series_id string, pos long, value double"), codec, config)
    assert len(calls) == 1 and blocks.count() > 4 and blocks.agg(F.sum("n_bits")).first()[0] == run(codec, config, values)
