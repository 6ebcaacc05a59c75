"""Nearest rows by products of matrices, and one lexical search for queries that ask the same."""

import math
import random
from functools import reduce

import numpy as np
import pyarrow as pa
import pytest

from quarry.operators import retrieval
from quarry.operators.lexical_index import LexicalIndex


def cosine(a, b):
    # one after the other, as the JVM does; sum() compensates
    dot, na, nb = (reduce(lambda s, x: s + x[0] * x[1], zip(u, v, strict=True), 0.0) for u, v in ((a, b), (a, a), (b, b)))
    return 1 - dot / (math.sqrt(na) * math.sqrt(nb))


@pytest.mark.parametrize("block", [2048, 3])
def test_dense_topk_is_exact(spark, monkeypatch, block):
    monkeypatch.setattr(retrieval, "COLUMNS", block)
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(60)]  # copies: ties go to the smaller id
    asked = rows[:12]
    odd = [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] * 6), (503, [0.0, 1.0])]
    found = retrieval.dense_topk(spark.createDataFrame(rows + odd, "chunk_id long, embedding array<double>").repartition(5), spark.createDataFrame(asked, "query_id long, q array<double>"), 20)
    got = sorted((r["query_id"], r["rank"], r["chunk_id"], r["distance"]) for r in found.collect())
    want = [(q, n, i, s) for q, v in asked for n, (s, i) in enumerate(sorted((cosine(x, v), i) for i, x in rows)[:20], 1)]
    assert got == want


def test_rows_without_a_distance_come_last(spark):
    rows = [(1, None), (2, [float("nan"), 1.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])]
    found = retrieval.dense_topk(spark.createDataFrame(rows, "chunk_id long, embedding array<float>"), spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "query_id string, q array<float>"), 9)
    got = [(r["query_id"], r["chunk_id"], str(r["distance"])) for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"]))]
    assert got == [("a", 3, "0.0"), ("a", 4, "1.0"), ("a", 2, "nan"), ("a", 1, "None"), ("b", 1, "None"), ("b", 2, "None"), ("b", 3, "None"), ("b", 4, "None")]


def test_distances_closer_than_single_precision_are_told_apart(monkeypatch):
    monkeypatch.setattr(retrieval, "COLUMNS", 2)
    rng = random.Random(4)
    rows = [(i, [c, math.sqrt(1 - c * c)]) for i, c in enumerate(rng.sample([0.5 + n * 1e-11 for n in range(3000)], 400))]
    asked = [[1.0, 0.0], [1.0, 1e-9], [0.0, -1.0], [0.5, 0.8], [0.6, 0.8]]
    best = retrieval._Nearest(pa.array(asked), 20, None)
    for at in range(0, 400, 50):
        best.take(np.arange(at, at + 50), pa.array([v for _, v in rows[at : at + 50]]), None)
    assert list(zip(*[x.tolist() for x in best.found()], strict=True)) == [(q, s, i) for q, v in enumerate(asked) for s, i in sorted((cosine(x, v), i) for i, x in rows)[:20]]


def test_only_queries_that_a_batch_improves_are_sorted(monkeypatch):
    monkeypatch.setattr(retrieval, "COLUMNS", 10)
    rng = np.random.default_rng(3)
    asked, others, k = rng.normal(size=(400, 16)), rng.normal(size=(300, 16)), 5
    best = retrieval._Nearest(pa.array(asked.tolist()), k, None)
    best.take(np.arange(2000), pa.array(np.repeat(asked, k, axis=0).tolist()), None)
    sizes, real = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys, axis=-1: (sizes.append(np.size(keys[0])), real(keys, axis=axis))[1])
    best.take(np.arange(2000, 2300), pa.array(others.tolist()), None)
    best.take(np.array([-1]), pa.array([asked[7].tolist()]), None)
    assert sum(sizes) <= 2 * k  # not 400 * k for each block of queries and rows
    at, _, ids = best.found()
    assert ids[at == 7].tolist() == [-1, 35, 36, 37, 38] and ids[at == 8].tolist() == [40, 41, 42, 43, 44]


def test_queries_of_the_same_terms_are_searched_once(spark, tmp_path):
    chunks = spark.createDataFrame([(i, "common " * (i % 7 + 1) + ("rare" if i % 5 == 0 else "")) for i in range(300)], "chunk_id long, body string")
    queries = spark.createDataFrame([(q, [["common"], ["rare", "common"], ["common", "rare", "rare"], ["none"], None][q % 5]) for q in range(200)], "query_id long, terms array<string>")
    index = LexicalIndex(spark, f"file://{tmp_path}/i")
    index.update(chunks, 0)
    status = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False)
    size = lambda: sum(status().apply(i).totalShuffleWrite() for i in range(status().size()))
    for search in (lambda: index.search(queries, 9), lambda: retrieval.lexical_topk(chunks, queries, 9)):
        before = size()
        got = sorted((r["query_id"], r["rank"], r["chunk_id"]) for r in search().collect())
        took = size() - before
        want = []
        for q in range(200):
            n = {i: (i % 7 + 1) + (i % 5 == 0 and q % 5 in (1, 2)) for i in range(300)} if q % 5 < 3 else {}
            want += [(q, r, i) for r, i in enumerate(sorted(n, key=lambda i: (-n[i], i))[:9], 1)]
        assert got == want
        assert took < 120 * 300 * 8  # a pair of query and chunk takes more than 8 bytes
