"""Operator 10 against all pairs."""

import random
import re

import numpy as np
import pytest

from quarry.llm import _components, near_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w)} - {()} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows, percent=85):
    sets = [(d, shingle_set(t)) for d, t in rows]
    comp = {d: d for d, _ in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, u in sets[:i]:
            if s and u and 100 * len(s & u) >= percent * len(s | u):
                a, b = root(d), root(e)
                comp[max(a, b)] = min(a, b)
    return sorted((d, len(s), root(d), root(d) == d) for d, s in sets)


def family(seed, n, words, edits):
    """A base text and copies with a few words changed."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(words)]
    out = [" ".join(base)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"x{rng.randint(0, 9)}"
        out.append(" ".join(copy))
    return out


@pytest.fixture(scope="module")
def rows(texts):
    out = [*texts, "A B c D e", "a b C d E", "a b c d e f g h i j k", "a b c d e f g h i j", "a b c d e f g h i"]
    for k, (n, words, edits) in enumerate([(30, 150, 3), (30, 60, 2), (40, 400, 12), (20, 30, 1), (5, 3000, 40)]):
        out += family(k, n, words, edits)
    order = list(range(len(out)))
    random.Random(1).shuffle(order)
    return [(d, out[i]) for d, i in enumerate(order)]


def test_against_all_pairs(spark, rows):
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, k string")
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(spark, docs).collect())
    assert got == brute(rows)


def test_below_the_default_threshold(spark, rows):
    words = [f"s{i}" for i in range(9)]
    some = [*rows, (5000, " ".join(words)), (5001, " ".join(words[:8])), (5002, " ".join(words[:7]))]  # 5, 4 and 3 shingles
    docs = spark.createDataFrame(some, "doc_id long, text string")
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(spark, docs, percent=80).collect())
    assert got == brute(some, 80)


@pytest.mark.parametrize(("percent", "size", "width"), [(85, 6, 8), (80, 4, 4), (60, 2, 2)])
def test_layout_follows_the_threshold(percent, size, width):
    assert (near_dedup.least(percent), near_dedup.band_width(percent)) == (size, width)
    assert 100 * size >= percent * (size + 1) and 100 * (size - 1) < percent * size


def test_blocks_of_large_components(spark, rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(spark, docs).collect())
    assert got == brute(rows)


def test_empty_and_repeated(spark, no_docs):
    assert near_dedup.near_duplicates(spark, no_docs).count() == 0
    twice = spark.createDataFrame([(4, "a b c d e f g"), (4, "a b c d e f g"), (9, None), (3, "  ")], "doc_id long, text string")
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(spark, twice).collect())
    assert got == [(3, 0, 3, True), (4, 3, 4, True), (4, 3, 4, True), (9, 0, 9, True)]


def test_an_id_with_several_texts_loses_no_link(spark):
    rng = random.Random(4)
    a, b = ([f"{x}{rng.randint(0, 9999)}" for _ in range(40)] for x in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*b, "more"])), (3, " ".join([*a, "word"])), (3, "something else altogether that nobody has"), (9, " ".join(f"c{i}" for i in range(30)))]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(3)
        got = sorted((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(spark, docs).collect())
        assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (9, 9)]


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(2)
    for n in (7, 60, 3000):
        errors = []
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            keep = a[rng.random(len(a)) < 0.85]
            r = near_dedup.registers([a, keep])
            errors.append((r[0] == r[1]).mean() - len(keep) / len(a))
        assert abs(np.mean(errors)) < 0.03


@pytest.mark.parametrize("small", [0, 20, 10**6])
@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (3, 4), (9, 8)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)] + [(100, 39), (100, 101)]])
def test_components(spark, edges, small, monkeypatch):
    monkeypatch.setattr(_components, "SMALL", small)
    got = dict(tuple(r) for r in _components.components(spark, spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {x: x for e in edges for x in e}
    for _ in range(len(edges)):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == {k: v for k, v in parent.items() if k != v}
