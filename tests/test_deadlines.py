"""Tools and statements under deadlines."""

import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import deadlines


@pytest.fixture(scope="module")
def slow(spark):
    """A plan that takes minutes if nobody stops it."""

    def wait(values):
        time.sleep(100)
        return values

    return lambda: spark.range(0, 8, 1, 1).select(F.pandas_udf(wait, "long")("id").alias("id"))


def test_a_slow_tool_is_a_timeout_and_others_go_on(spark, slow):
    began = time.monotonic()
    got = deadlines.call_all(
        spark,
        {
            "get_product_spec": (slow, ("analyst",), None),
            "search_knowledge": (lambda: spark.range(5), ("support",), None),
            "search_inventory": (lambda: spark.range(5), ("analyst",), None),
            "read_uploaded_file": (lambda: spark.range(5), ("viewer",), None),
            "get_evidence_detail": (lambda: spark.range(5).select(F.raise_error(F.lit("x"))), ("analyst",), None),
            "other": (lambda: spark.range(5), ("analyst",), None),
        },
    )
    assert {n: o.status for n, o in got.items()} == {"get_product_spec": "timeout", "search_knowledge": "ok", "search_inventory": "market_required", "read_uploaded_file": "role_denied", "get_evidence_detail": "error", "other": "tool_not_registered"}
    assert got["search_knowledge"].result.count() == 5
    assert time.monotonic() - began < 30
    assert spark.range(3).count() == 3  # nothing is left cancelled


def test_statements(spark):
    assert deadlines.statement(spark, "SELECT 1 AS x", 30_000).result.collect()[0]["x"] == 1
    late = deadlines.statement(spark, "SELECT count(*) FROM range(0, 1000000000000) a WHERE hash(id) = 7", 300)
    assert late.status == "timeout" and late.seconds < 20
    for bad in (0, 30_001):
        with pytest.raises(ValueError):
            deadlines.statement(spark, "SELECT 1", bad)


def test_between_jobs(spark):
    def body():
        while True:
            spark.range(3).count()

    got = deadlines.run_within(spark, 0.5, body)
    assert got.status == "timeout" and got.seconds < 15
