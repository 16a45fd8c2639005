"""Codecs over arrays: bit for bit what the encoders write, and without them for ordinary values."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearloom.operators.codecs import CODECS, blocks, bulk, encoder
from nearloom.operators.codecs.bits import BitWriter, decimal, to_bits
from nearloom.operators.codecs.registry import stated

NAN, INF = float("nan"), float("inf")
TRIED = [*blocks.TRIED, ("DeXOR", {"buffer_bits": 1, "rho": 2}), ("DeXOR", {"skip_available": 2}), ("DeXOR", {"buffer_bits": 5})]
EDGE = [0.0, -0.0, 1.0, 1.0, NAN, NAN, INF, -INF, 5e-324, 1.7976931348623157e308, -2.5, 0.1, 0.3, 1e-5, 1e-12, 123456.789, 1e22, 1e300, 100.0, 65536.5, -0.0001, 12.3456, 0.1 + 0.2, -7.0, 1e-10, 0.99, 0.0099, 100.01, 999999999999999.0, 1e15, 12345678901234.5, 4503599627370496.5]
PRICES = [round(math.sin(i) * 50000, 2) for i in range(500)]


def coded(values, codec, config):
    coder, out = encoder(codec, config), BitWriter()
    for v in values:
        coder.encode(v, out)
    return out.take()


def check(held):
    values, starts = np.array([v for own in held for v in own]), np.cumsum([0, *map(len, held)])[:-1]
    want = [[coded(own, *one) for one in TRIED] for own in held]
    m, q = bulk.Rows(values, starts).decimals
    assert list(zip(m.tolist(), q.tolist(), strict=True)) == [decimal(v) or (0, 0) for v in values.tolist()]
    assert bulk.sizes(values, starts, TRIED).tolist() == [[n for _, n in own] for own in want]
    for at, one in enumerate(TRIED):
        assert [(data, n) for _, data, n in bulk.smallest(values, starts, [one])] == [own[at] for own in want]
    for (at, data, n), own in zip(bulk.smallest(values, starts, TRIED), want, strict=True):
        assert at == min(range(len(TRIED)), key=lambda k: own[k][1]) and (data, n) == own[at]


def test_edge_values():
    check([EDGE, EDGE[::-1], [v for v in EDGE for _ in range(2)], [0.0], [NAN] * 4, PRICES[:60]])
    for v in EDGE:
        check([[v, w] for w in EDGE])


def test_powers_of_ten_and_their_neighbours():
    tens = [float(f"{m}e{q}") for q in range(-16, 4) for m in (1, -1, 2, 9, 99, 101, 999_999, 1_000_001)]
    check([tens, [v for p in (1, 10, 1000) for v in (p, p - 0.01, p + 0.01, 0.1 / p)] * 5])


decimals = st.decimals(-(10**6), 10**6, places=2).map(float)
some = st.one_of(st.lists(decimals, min_size=1, max_size=60), st.lists(st.one_of(st.floats(width=64), decimals, st.integers(-(10**16), 10**16).map(float), st.sampled_from(EDGE)), min_size=1, max_size=30))


@settings(max_examples=150, deadline=None)
@given(st.lists(some, min_size=1, max_size=4))
def test_any_values(held):
    check(held)


def batches(rows, size):
    for i in range(0, len(rows), size):
        sid, pos, value = zip(*rows[i : i + size], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(pos, pa.int64()), pa.array(value, pa.float64())], ["series_id", "pos", "value"])


def test_ordinary_values_do_not_go_through_the_encoders_one_by_one(monkeypatch):
    def refuse(*_):
        raise AssertionError("coded by itself")

    for coder, _ in CODECS.values():
        monkeypatch.setattr(coder, "encode", refuse)
    rows = [("a", i, v) for i, v in enumerate(PRICES)] + [(f"b{i:03}", 1, v) for i, v in enumerate(PRICES)]
    found = list(blocks.cut(batches(rows, 70), 200))
    assert [r["n_values"] for r in found] == [200, 200, 100] + [1] * 500
    assert np.concatenate([blocks.opened(r)[1] for r in found]).tolist() == PRICES * 2
    assert bulk.sizes(np.array(PRICES), np.array([0, 200]), blocks.TRIED).shape == (2, 5)


@pytest.mark.parametrize("size,group", [(1, 1), (7, 30), (1000, 64), (64, 10**6)])
def test_blocks_do_not_depend_on_their_group(monkeypatch, size, group):
    monkeypatch.setattr(blocks, "GROUP", group)
    rows = [(f"s{i}", j, random.Random(i * 99 + j).choice(EDGE + PRICES)) for i in range(12) for j in range(5 * i + 1)]
    found = list(blocks.cut(batches(rows, size), 20))
    assert [(r["series_id"], r["n_values"]) for r in found] == [(f"s{i}", min(20, 5 * i + 1 - j)) for i in range(12) for j in range(0, 5 * i + 1, 20)]
    back = [(r["series_id"], p, to_bits(v)) for r in found for p, v in zip(*blocks.opened(r), strict=True)]
    assert back == [(s, p, to_bits(v)) for s, p, v in rows]
    assert all(r["n_bits"] == min(coded(blocks.opened(r)[1].tolist(), *one)[1] for one in blocks.TRIED) for r in found)


def test_sizes_are_what_each_codec_alone_takes(spark):
    rows = [("a", i, v) for i, v in enumerate(EDGE * 6)] + [("b", i, v) for i, v in enumerate(PRICES)]
    made = blocks.compress(spark.createDataFrame(rows, "series_id string, pos long, value double"), 50, tasks=2).cache()
    want = sorted((len(v), r["n_bits"], [coded(v, *one)[1] for one in blocks.TRIED]) for r in made.collect() for v in [blocks.opened(r.asDict())[1].tolist()])
    assert sorted((r["n_values"], r["n_bits"], list(r["each"])) for r in blocks.sizes(made).collect()) == want
    assert blocks.sizes(made.where("false")).count() == 0
    made.unpersist()


def test_exceptions_do_not_go_through_the_encoders_either(monkeypatch):
    """A few odd values, or none of a short decimal form: still in arrays."""
    odd = [v if i % 50 else EDGE[i // 50] for i, v in enumerate(PRICES)]
    noise = [random.Random(i).random() / 10 ** (i % 4) for i in range(500)]
    wide = [float(f"{i + 1}e{i * 7 % 28 - 18}") for i in range(200)]
    check([odd, noise, wide, noise[::-1] + odd])
    want = bulk.sizes(np.array(odd + noise + wide), np.array([0, 500, 1000]), blocks.TRIED).tolist()
    monkeypatch.setattr(bulk, "_alone", lambda *_: pytest.fail("coded by itself"))
    every = [one for one in blocks.TRIED if one[0] != "Camel"]
    found = bulk.sizes(np.array(odd + noise + wide), np.array([0, 500, 1000]), every).tolist()
    assert found == [[n for n, one in zip(own, blocks.TRIED, strict=True) if one[0] != "Camel"] for own in want]


def _series(kind):
    rng = np.random.default_rng(8)
    prices = np.round(np.cumsum(rng.normal(size=3_000)) * 3 + 100_000, 2)
    odd = prices.copy()
    odd[1_500:1_560:7] = [np.nan, -0.0, 1e300, np.inf, 0.1 + 0.2, 5e-324, -1e-9, 1e15, 3.0]
    flat = np.where(np.arange(3_000) < 1_700, prices, 7.25)
    return {"prices": prices, "odd": odd, "flat": flat, "raw": rng.normal(size=3_000), "whole": rng.integers(-9, 9, 3_000) * 1.0, "nan": np.full(3_000, np.nan), "1e-30": prices * 1e-30}[kind]


@pytest.mark.parametrize("kind", ["prices", "odd", "flat", "raw", "whole", "nan", "1e-30"])
@pytest.mark.parametrize("codec, config", [("Gorilla", None), ("Elf", None), ("Camel", None), ("DeXOR", None), ("DeXOR", {"buffer_bits": 3}), ("DeXOR", {"skip_available": 4})])
def test_sizes_carry_on_in_arrays(kind, codec, config):
    values, one, many, bits = _series(kind), encoder(codec, config), encoder(codec, config), 0
    for part in np.split(values, [300, 310, 1_000, 1_900, 2_500]):
        many, more = bulk.carried(many, part, codec, config)
        out = BitWriter()
        for v in part.tolist():
            one.encode(v, out)
        assert more == out.n_bits and stated(many) == stated(one)


def test_sizes_of_prices_are_not_coded_one_by_one(monkeypatch):
    values, coded = np.tile(_series("prices"), 3), []
    for codec, config in (("Gorilla", None), ("Elf", None), ("Camel", None), ("DeXOR", {"buffer_bits": 3})):
        state, _ = bulk.carried(encoder(codec, config), values, codec, config)
        monkeypatch.setattr(type(state), "encode", lambda self, v, out, own=type(state).encode: coded.append(v) or own(self, v, out))
        bulk.carried(state, values, codec, config)
    assert 0 < len(coded) <= 4 * 3 * bulk.LED  # of 36,000
