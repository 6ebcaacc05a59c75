"""Operator 12 against a plain audit."""

import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import _bytes as B
from quarry.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LIMITS = filter_audit.Limits(words=6, distinct=80, capitals=10)


def fails(rows, limits):
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, t, p in rows:
        t = t or ""
        words = WORD.findall(t)
        out.append(
            (
                p or "",
                d,
                "".join(
                    x
                    for x, bad in zip(
                        "ABCDE",
                        (
                            len(words) < limits.words,
                            100 * len(set(words)) < limits.distinct * len(words),
                            100 * len(re.findall("[A-Z]", t)) > limits.capitals * len(t),
                            bool(re.search(r"[#$%&*|]", t)),
                            d is not None and d > least[t],
                        ),
                        strict=True,
                    )
                    if bad
                ),
            )
        )
    return out


def plain(rows, labels, limits):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    bad, out = fails(rows, limits), []
    for part in {p for p, *_ in bad}:
        mine = [(d, f) for p, d, f in bad if p == part]
        removed_of = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for i, x in enumerate(order):
                gone = [r for r in left if x in r[1]]
                left = [r for r in left if x not in r[1]]
                removed_of[x] += len(gone)
                steps.append((part, order, i + 1, len(left), len(gone), sum(x in f for _, f in mine) - len(gone), sum(f == x for _, f in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)))
        out += [(*s, removed_of[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


SPICE = ["ABC DEF GHI", "a a a a a a a a", "cost: 5 % & more", "Ein Satz ohne alles und noch etwas mehr hier", "x" * 400 + " " + "x" * 400, "x" * 399 + "y " + "x" * 399 + "z", "#", "ÄÖ Ü"]


@pytest.fixture(scope="module")
def odd(spark, docs):
    extra = [(5000 + i, t, ["en", None, "", "fr"][i % 4], None, 0, "x", "y") for i, t in enumerate(SPICE * 2)]
    extra += [(None, "ABC DEF GHI", "en", None, 0, None, None), (None, None, None, None, None, None, None), (5000, "a b c", "en", None, 0, None, None)]
    return docs.unionByName(spark.createDataFrame(extra, docs.schema))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 3 if i % 7 else None, int(i % 4 == 0)) for i in range(0, 1009, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1), (5000, 1, 1)], "doc_id long, quality int, toxic int")


def test_audit(spark, odd, labels):
    got = sorted(tuple(r) for r in filter_audit.audit(spark, odd, labels, LIMITS).collect())
    want = plain([(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()], [tuple(r) for r in labels.collect()], LIMITS)
    assert got == want and len(got) == 600 * len({g[0] for g in got})


def test_measures(odd):
    for r in filter_audit.measures(odd).select("n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols", "k", "h", "n_bytes").collect():
        assert r["n_distinct"] <= r["n_words"] and r["n_chars"] <= r["n_bytes"]


@given(st.lists(st.text(alphabet=st.sampled_from("ab \n\tAé#%😀\u0085"), max_size=40), max_size=6))
@settings(max_examples=150, deadline=None)
def test_scan(texts):
    got = filter_audit.scan(pa.array([*texts, None], pa.string()), "#%")
    for i, t in enumerate(texts):
        words = WORD.findall(t)
        assert [int(c[i]) for c in got] == [len(words), len(set(words)), len(re.findall("[A-Z]", t)), len(t), len(re.findall("[#%]", t))]
    assert [int(c[-1]) for c in got] == [0] * 5


def test_collisions_are_verified():
    text = " ".join(["abc", "abd", "abc", "abcdefghijkl", "abcdefghijkm", "abcdefghijkl", "abc"])
    data, off = B.flat(pa.array([text, "abc abc"], pa.string()))
    start, end, first = B.words(data, off)
    for hashes in (None, np.zeros(len(start), np.uint64)):
        assert filter_audit.distinct_words(data, start, end, first, hashes).tolist() == [4, 1]


def test_no_rows(spark, no_docs, labels):
    assert filter_audit.audit(spark, no_docs, labels).count() == 0


def test_no_labels(spark, docs):
    rows = filter_audit.audit(spark, docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), LIMITS).collect()
    assert rows and not any(r["good_lost"] or r["toxic_lost"] for r in rows)


def test_query_equals_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(filter_audit.SQL)
    got = filter_audit.query(spark, sf)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
