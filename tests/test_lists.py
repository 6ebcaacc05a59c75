"""Ranks over ranges, ranked lists in blocks, and indexes that follow their tables."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import ranking
from quarry.plans import indexes, views


@pytest.mark.parametrize("partitions", [1, 7])
def test_positions(spark, partitions):
    rows = spark.createDataFrame([(i * 7919 % 500, "x" if i % 3 else None) for i in range(500)], "k long, v string").repartition(partitions)
    got = ranking.positions(rows, [F.desc("k")]).collect()
    assert sorted((r["rank"], r["k"]) for r in got) == [(i + 1, 499 - i) for i in range(500)]
    same = ranking.positions(rows.withColumn("k", F.lit(1)), [F.col("k")])
    assert sorted(r["rank"] for r in same.collect()) == list(range(1, 501))
    assert ranking.positions(rows.limit(0), [F.col("k")]).count() == 0


@pytest.mark.parametrize("name", ["golden", "ranked"])
def test_ranked_lists_equal_their_sql(spark, sf, name, monkeypatch):
    want = sorted(map(tuple, views.sql(spark, sf, views.VIEWS[name]).collect()))
    assert sorted(map(tuple, views.view(spark, sf, name).collect())) == want
    monkeypatch.setattr(views, "QUERY_BYTES", 50)
    assert sorted(map(tuple, views.view(spark, sf, name).collect())) == want


def test_an_index_follows_its_table(spark, tmp_path):
    folder = f"file://{tmp_path}"
    write = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    asked = spark.createDataFrame([(1, ["new"])], "query_id long, terms array<string>")
    write([(1, "old words"), (2, "new words")])
    first = indexes.lexical(spark, folder)
    assert [r["chunk_id"] for r in first.search(asked, 5).collect()] == [2]
    assert indexes.lexical(spark, folder).root == first.root
    write([(1, "new new words"), (3, "new")])
    second = indexes.lexical(spark, folder)
    assert second.root != first.root and [r["chunk_id"] for r in second.search(asked, 5).orderBy("rank").collect()] == [1, 3]
