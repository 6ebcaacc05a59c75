"""Word paths against all ways to split a run."""

import math
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import segment


def splits(run):
    if not run:
        yield []
    for i in range(1, len(run) + 1):
        for rest in splits(run[i:]):
            yield [run[:i], *rest]


@given(st.dictionaries(st.text("abc", min_size=1, max_size=4), st.integers(1, 50), max_size=12), st.text("abcd", max_size=9))
@settings(max_examples=300, deadline=None)
def test_path_is_the_best_of_all_splits(table, run):
    words = segment.Words(table)
    total = math.log(max(1, sum(table.values())))
    weight = lambda w: math.log(table[w]) - total if w in table else -total if len(w) == 1 else None
    scores = [sum(map(weight, s)) for s in splits(run) if all(weight(w) is not None for w in s)]
    got = words.path(run)
    assert "".join(got) == run
    assert math.isclose(sum(map(weight, got)), max(scores), abs_tol=1e-9)


def test_search_tokens():
    words = segment.Words({"中华人民共和国": 10, "中华": 5, "人民": 8, "共和国": 4, "华人": 1, "和国": 0, "国": 3})
    assert list(words.search_tokens("中华人民共和国国")) == ["中华", "华人", "人民", "共和国", "中华人民共和国", "国"]
    pieces = re.compile(rf"(?P<cut>[{segment.CJK}]+)|[^\W{segment.CJK}]+")
    assert segment.tokens("Die Ｓｔｒａßｅ 中华人民! x_1 ___ 外", words, pieces) == ["die", "strasse", "中华", "人民", "x_1", "外"]


def test_columns(spark):
    table = spark.createDataFrame([("中华", 5), ("人民", 8), ("人民", 1), (None, 3), ("x", 0)], "word string, n long")
    rows = spark.createDataFrame([(1, "中华人民"), (2, None), (3, ""), (4, "abc 人民")], "k long, t string")
    got = {r["k"]: r["s"] for r in rows.select("k", segment.segmented(F.col("t"), table).alias("s")).collect()}
    assert got == {1: ["中华", "人民"], 2: None, 3: [], 4: ["abc", "人民"]}
    assert [r["s"] for r in rows.filter("k = 1").select(segment.segmented(F.col("t"), table.limit(0)).alias("s")).collect()] == [["中", "华", "人", "民"]]


def test_too_many_words(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(segment, "MOST_WORDS", 2)
    with pytest.raises(ValueError):
        segment.segmented(F.lit("x"), spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "word string, n long"))
