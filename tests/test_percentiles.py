"""Percentiles by rank selection against sorted values."""

import math
import random

import pytest

from quarry.operators import percentiles


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    out = [("hot", float(rng.choice([1, 1, 1, 2, 1e12, -5, 3.25, rng.random()]))) for _ in range(3000)]
    out += [("one", 4.0), ("two", 1.0), ("two", 2.0), (None, 7.0), (None, 9.0), (None, 8.0), ("none", None), ("nan", float("nan")), ("nan", 2.5)]
    out += [("close", 1.0 + i * 2**-52) for i in range(40)] + [("wide", v) for v in (-1.7e308, 1.7e308, 0.0)]
    return spark.createDataFrame(out, "k string, v double")


def groups(rows):
    out = {}
    for r in rows.collect():
        if r["v"] is not None and not math.isnan(r["v"]):
            out.setdefault(r["k"], []).append(r["v"])
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize(("bins", "few"), [(3, 2), (1024, 4), (1024, 16384)])
def test_nearest_ranks(rows, bins, few, monkeypatch):
    monkeypatch.setattr(percentiles.select_ranks, "__defaults__", (bins, few))
    some = rows.filter("k IS NULL OR k <> 'wide'")
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["k"]: tuple(r[c] for c in ("n", *shares)) for r in percentiles.nearest_ranks(some, ["k"], "v", shares).collect()}
    want = {k: (len(v), *[v[max(0, math.ceil(len(v) * q) - 1)] for q in shares.values()]) for k, v in groups(some).items()}
    assert got == want


def test_without_keys_and_of_whole_numbers(spark):
    rows = spark.createDataFrame([(i * i % 97,) for i in range(1000)], "v int")
    values = sorted(r["v"] for r in rows.collect())
    got = percentiles.nearest_ranks(rows, [], "v", {"a": 0.5, "b": 0.99}).collect()
    assert [tuple(r) for r in got] == [(1000, values[499], values[989])]
    assert percentiles.nearest_ranks(rows.limit(0), [], "v", {"a": 0.5}).count() == 0


def test_interpolated(rows):
    some = rows.filter("k IN ('one', 'two', 'hot')")
    got = {r["k"]: (r["a"], r["b"]) for r in percentiles.interpolated(some, ["k"], "v", {"a": 0.25, "b": 0.5}).collect()}
    for k, v in groups(some).items():
        for x, q in zip(got[k], (0.25, 0.5), strict=True):
            at = (len(v) - 1) * q
            low = math.floor(at)
            assert x == pytest.approx(v[low] + (v[min(low + 1, len(v) - 1)] - v[low]) * (at - low))
