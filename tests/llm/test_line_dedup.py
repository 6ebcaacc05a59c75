"""Operator 9 against all pairs of lines."""

import random
import re
import time

import pytest

from quarry.llm import line_dedup


def within_one(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute(rows, least):
    lines = sorted(((d is not None, d or 0), i, x) for d, t in rows if t is not None for i, x in enumerate(t.split("\n")) if x.strip(" "))
    gone = set()
    for a, (d, i, x) in enumerate(lines):
        for e, j, y in lines[:a]:
            if (e, j) < (d, i) and (x == y or (len(x) >= least and len(y) >= least and within_one(x, y))):
                gone.add((d[1] if d[0] else None, i))
                break
    return gone


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    base = ["".join(rng.choice("ab éß") for _ in range(rng.choice([5, 20, 21, 40, 41, 90]))) for _ in range(50)]
    out = [(900, None), (901, ""), (902, "\n\n  \n"), (None, base[0] + "\nnull key line that is long enough")]
    for d in range(80):
        some = []
        for _ in range(rng.randint(1, 6)):
            x = rng.choice(base)
            kind, p = rng.randrange(6), rng.randrange(len(x))
            if kind == 1:
                x = x[:p] + "X" + x[p + 1 :]
            elif kind == 2:
                x = x[:p] + x[p + 1 :]
            elif kind == 3:
                x = x[:p] + "Y" + x[p:]
            elif kind == 4:
                x = x[:p] + "ZZ" + x[p + 2 :]
            some.append(x)
        out.append(((d * 37) % 83, "\n".join(some)))
    return out


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_against_all_pairs(spark, rows, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", broadcast)
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, h int, line string")
    got = line_dedup.dedup_lines(spark, docs).collect()
    want = brute(rows, 20)
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        lost = sorted(i for d, i in want if d == r["doc_id"])
        assert r["removed"] == lost and r["n_removed"] == len(lost)
        t = texts[r["doc_id"]]
        if t is not None:
            assert r["kept"] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in lost)
    assert len(want) > 60


@pytest.mark.parametrize("long", [1, 20, 41])
def test_long_lines_hash_alike(spark, rows, monkeypatch, long):
    monkeypatch.setattr(line_dedup, "LONG", long)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["k"], r["i"]) for r in line_dedup.repeated_lines(spark, docs).collect()}
    assert got == brute(rows, 20)


def test_very_long_lines(spark):
    rng = random.Random(2)
    line = "".join(rng.choice("abc é") for _ in range(100_000))
    at = [0, 1, 256, 50_000, 99_999]
    rows = [(0, line)] + [(1 + i, line[:p] + "Q" + line[p + 1 :]) for i, p in enumerate(at)] + [(20 + i, line[:p] + line[p + 1 :]) for i, p in enumerate(at)]
    rows += [(40, "Q" + line), (41, line + "Q"), (42, line[:70] + "QQ" + line[70:]), (43, line[:9] + "Q" + line[10:20] + "Q" + line[21:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.time()
    got = {r["k"] for r in line_dedup.repeated_lines(spark, docs).collect()}
    assert got == {d for d, _ in rows} - {0, 42, 43}
    assert time.time() - began < 60


def test_empty_repeated_and_native(spark, no_docs):
    assert line_dedup.dedup_lines(spark, no_docs).count() == 0
    twice = spark.createDataFrame([(1, "same line"), (1, "same line"), (2, "same line")], "doc_id long, text string")
    got = line_dedup.dedup_lines(spark, twice)
    assert sorted((r["doc_id"], r["n_removed"]) for r in got.collect()) == [(1, 0), (1, 0), (2, 1)]
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())
