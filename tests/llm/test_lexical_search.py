"""Operator 13 against plain scoring."""

import math
import random
import re
from collections import Counter

import pytest

from quarry.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, most):
    held = [(d, Counter(terms_of(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c in held:
            m = 50 + 50 * sum(c.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:most])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["now", "changed", "It's", "don", "t", "ABC", "a", "b", "中文", "é", "two", "words!"]) for _ in range(rng.randint(1, 9))), "x") for i in range(12)]
    rows += [(20, rows[0][1], "y"), (0, "other words", "z"), (None, "one", "n"), (30, None, "n"), (31, " .,;", "n"), (32, "unknownterm", "n")]
    return spark.createDataFrame(rows, "item_id long, text string, k string")


def both(spark, docs, items, **how):
    got = lexical_search.search(spark, docs, items, **how)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=str), plain([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], how.get("most", 50))


@pytest.mark.parametrize("how", [{}, {"most": 3, "window": 64}, {"most": 7, "window": 100, "block_bytes": 400}])
def test_search(spark, docs, items, how):
    odd = docs.unionByName(spark.createDataFrame([(None, "one two now", "en", None, 0, "x", "y"), (None, "one two now", "en", None, 0, "x", "y"), (-70, "changed now ABC", "en", None, 0, "x", "y")], docs.schema))
    got, want = both(spark, odd, items, **how)
    assert got == want


def test_one_key_for_many_rows(spark, items):
    rng = random.Random(2)
    rows = [(i if i % 3 else 7, " ".join(rng.choice("now changed a b one filler more rest".split()) for _ in range(rng.randint(1, 30)))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got, want = both(spark, docs, items, most=20, window=50)
    assert got == want


def test_empty(spark, docs, no_docs, items):
    assert lexical_search.search(spark, no_docs, items).count() == 0
    assert lexical_search.search(spark, docs, items.limit(0)).count() == 0


def test_long_lengths_do_not_overflow():
    import numpy as np

    w = lexical_search.Weights(10**12, 10**14, np.zeros(1, np.int64))
    heaps = lexical_search.Heaps(lexical_search.Block([], np.zeros(1, np.uint64), []), w, 64, 5)
    n = np.array([10**6, 10**9, 3])
    assert heaps._length_norm(n).tolist() == [50 + 50 * int(x) * 10**12 // 10**14 for x in n]


def test_query_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(lexical_search.SQL)
    got = lexical_search.query(spark, sf)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
