"""Operator 4: recall against brute force, exact scores and order, odd rows."""

import math
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string"


def brute(vectors, queries, k):
    out = {}
    for q in queries:
        d = sorted((float(np.sqrt(((np.array(v, np.float64) - np.array(vectors[q], np.float64)) ** 2).sum())), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out[q] = d[:k]
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    out = {i: (centres[i % 8] + 0.5 * rng.normal(size=16)).astype(np.float32).tolist() for i in range(1500)}
    for i in range(1500, 1900):
        out[i] = out[7]  # one very frequent vector
    return out


def run(spark, rows, shard=400, k=10):
    table = spark.createDataFrame(rows, SCHEMA)
    index = ann._store.cut(spark, ann.build_index(spark, table, shard=shard))
    return index, ann.search(spark, index, table.filter("vec_id % 100 = 0"), k).collect()


def test_recall_and_scores(spark, vectors):
    index, got = run(spark, [(i, v, 0, "a", "b") for i, v in vectors.items()])
    assert index.count() >= 4
    queries = [i for i in vectors if i % 100 == 0]
    want = brute(vectors, queries, 10)
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by[r["query_id"]].append((r["score"], r["vec_id"]))
    assert set(by) == set(queries)
    hit = 0
    for q, found in by.items():
        assert len(found) == 10 and found == sorted(found) and q not in [i for _, i in found]
        for s, i in found:
            assert s == pytest.approx(math.dist(vectors[q], vectors[i]), abs=1e-12)
        hit += len({i for _, i in found} & {i for _, i in want[q]})
    assert hit / (10 * len(queries)) >= 0.95
    assert [i for _, i in by[1500]] == [i for _, i in want[1500]]  # copies: smallest ids first


def test_every_row_is_indexed(spark, vectors):
    index, _ = run(spark, [(i, v, 0, "a", "b") for i, v in vectors.items()])
    ids = np.concatenate([np.frombuffer(r["ids"], "<i8") for r in index.select("ids").collect()])
    assert sorted(ids.tolist()) == sorted(vectors)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (100, [0.0, 0.0]), (200, [2.0, 0.0]), (300, [0.0, 0.0, 2.0])]
    _, got = run(spark, [(i, v, 1, "x", "y") for i, v in rows])
    found = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in got)
    assert found == [(0, 1, 200, 1.0), (0, 2, 1, 1.414214), (200, 1, 0, 1.0), (200, 2, 1, 2.236068), (300, 1, 8, 2.236068)]


def test_empty(spark):
    assert run(spark, [])[1] == []
