"""Shared helpers: the join that keeps hot keys apart, and code shipping."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import _store


@pytest.mark.parametrize("least", [1, 30, 10**6])
def test_join_skewed_is_a_left_join(spark, monkeypatch, least):
    monkeypatch.setattr(_store, "HOT_LEAST", least)
    monkeypatch.setattr(_store, "HOT_SHARE", 0)
    rng = random.Random(3)
    rows = [(i, 7 if i % 3 else rng.randint(0, 40), rng.randint(0, 1)) for i in range(600)] + [(600, None, 0)]
    frame = spark.createDataFrame(rows, "id long, a long, b int")
    counted = frame.filter("a IS NOT NULL").groupBy("a", "b").agg(F.count("*").alias("n")).filter("a % 5 <> 4")
    facts = counted.withColumns({"x": F.col("a") * 2, "s": F.struct("b", "a")})
    got = _store.join_skewed(spark, frame, facts, ["a", "b"], "n")
    want = frame.join(facts.drop("n"), ["a", "b"], "left").select("id", "a", "b", "x", "s")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_join_skewed_without_facts(spark):
    frame = spark.createDataFrame([(1, 2)], "a long, v int")
    facts = spark.createDataFrame([], "a long, n long, x int")
    assert [tuple(r) for r in _store.join_skewed(spark, frame, facts, ["a"], "n").collect()] == [(1, 2, None)]


def test_shared_dir_is_the_sessions(spark):
    path = _store.scratch(spark, "x")
    assert path.startswith(_store.shared_dir(spark).rstrip("/"))


def test_code_is_shipped_once(spark):
    _store.ship(spark)
    before = spark.sparkContext._jsc.sc().listFiles().size()
    _store.ship(spark)
    assert spark.sparkContext._jsc.sc().listFiles().size() == before


def test_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    sizes = spark.range(0, 5000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
    with _store.small_batches(spark, 700):
        inside = [r["n"] for r in sizes.collect()]
    assert sum(inside) == 5000 and max(inside) == 700
    assert spark.conf.get(name) == before
    with pytest.raises(ValueError), _store.small_batches(spark):
        raise ValueError
    assert spark.conf.get(name) == before


def test_hot_values_are_those_with_many_rows(spark, monkeypatch):
    monkeypatch.setattr(_store, "HOT_LEAST", 20)
    rows = [(None,)] * 300 + [(5,)] * 200 + [(6,)] * 30 + [(i,) for i in range(100, 570)]
    frame = spark.createDataFrame(rows, "a long").repartition(7)
    assert _store.hot_values(frame, "a", 8) == [None, 5]
    assert _store.hot_values(frame, "a", 100) == [None, 5, 6]
    assert _store.hot_values(frame.filter("a >= 100"), "a", 8) == []
    assert _store.hot_values(frame.limit(0), "a", 8) == []
    assert _store.hot_values(frame.select(F.col("a").cast("string")), "a", 8) == [None, "5"]
