"""Stored indexes: the same rows as a scan, what is read, updates by version, recall and bounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import lexical_index, retrieval, vector_index


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["the"] * 40
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))) for i in range(300)] + [(900, None), (901, "")]
    return spark.createDataFrame(rows, "chunk_id long, body string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, ["w1", "w2", "w2"]), (2, ["the"]), (3, ["nothing"]), (4, [f"w{i}" for i in range(40)])], "query_id long, terms array<string>")


def scan(chunks, queries, k=7):
    return rows_of(retrieval.lexical_topk(chunks, queries, k), "query_id", "chunk_id", "rank", "score")


def test_index_equals_a_scan_after_updates(spark, chunks, queries, tmp_path):
    index = lexical_index.LexicalIndex(spark, f"file://{tmp_path}/index", 8)
    assert index.version() == 0 and index.search(queries, 7).count() == 0
    assert index.update(chunks, 0) == 1
    assert rows_of(index.search(queries, 7), "query_id", "chunk_id", "rank", "score") == scan(chunks, queries)
    changed = spark.createDataFrame([(5, "w1 w1 w1 w1 w1 w1 w1"), (950, "the the w2")], "chunk_id long, body string")
    removed = spark.createDataFrame([(7,), (8,), (9,)], "chunk_id long")
    assert index.update(changed, 1, removed) == 2
    now = chunks.filter(~F.col("chunk_id").isin(5, 7, 8, 9)).unionByName(changed)
    assert rows_of(index.search(queries, 7), "query_id", "chunk_id", "rank", "score") == scan(now, queries)
    assert index.update(changed.filter("chunk_id = 5").withColumn("body", F.lit(None).cast("string")), 2) == 3
    assert index.compact(3) == 4
    later = now.filter("chunk_id <> 5")
    assert rows_of(index.search(queries, 7), "query_id", "chunk_id", "rank", "score") == scan(later, queries)
    allowed = later.filter("chunk_id % 3 = 0").select("chunk_id")
    assert rows_of(index.search(queries, 7, allowed), "query_id", "chunk_id", "rank", "score") == scan(later.filter("chunk_id % 3 = 0"), queries)
    with pytest.raises(RuntimeError):
        index.update(changed, 2)
    with pytest.raises(RuntimeError):
        index._activate(3, [])


def test_words_are_grouped_where_their_chunk_lies(spark, chunks, tmp_path):
    rows = lexical_index.postings_of(chunks)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    want = {}
    for c, body in chunks.collect():
        for at, w in enumerate((body or "").split()):
            want.setdefault((w, c), []).append(at)
    assert {(r["term"], r["chunk_id"]): r["positions"] for r in rows.collect()} == want
    assert all(r["n"] == len(r["positions"]) for r in rows.collect())
    index = lexical_index.LexicalIndex(spark, f"file://{tmp_path}/index", 4)
    index.update(chunks, 0)
    # the hot word's postings lie in several files, each in order of term
    files = index.postings().filter("term = 'the'").select(F.input_file_name()).distinct().count()
    assert files > 1


def test_a_word_of_some_chunks_is_shuffled_as_one_row(spark, chunks, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "GROUPED", 50)
    packs = lexical_index.packs_of(chunks.coalesce(1))
    assert packs.count() < lexical_index.postings_of(chunks).count() / 2
    held = packs.collect()
    assert all(len(r["ids"]) == len(r["ends"]) <= 50 and r["ends"][-1] == len(r["places"]) for r in held)
    written = []
    monkeypatch.setattr(lexical_index, "unpacked", lambda rows, real=lexical_index.unpacked: written.append(rows) or real(rows))
    index = lexical_index.LexicalIndex(spark, f"file://{tmp_path}/index", 4)
    index.update(chunks, 0)
    assert "RepartitionByExpression" in written[-1]._jdf.queryExecution().logical().toString()  # they are unpacked behind the shuffle
    want = {(r["term"], r["chunk_id"]): (r["n"], r["positions"]) for r in lexical_index.postings_of(chunks).collect()}
    assert {(r["term"], r["chunk_id"]): (r["n"], r["positions"]) for r in index.postings().collect()} == want
    index.compact(1)
    assert {(r["term"], r["chunk_id"]): (r["n"], r["positions"]) for r in index.postings().collect()} == want


def test_only_asked_buckets_and_columns_are_read(spark, chunks, queries, tmp_path):
    index = lexical_index.LexicalIndex(spark, f"file://{tmp_path}/index", 32)
    index.update(chunks, 0)
    some = queries.filter("query_id = 2")
    plan = index.search(some, 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "positions" not in plan.split("ReadSchema")[1].splitlines()[0]
    assert "PushedFilters: [" in plan and "term" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_more_terms_than_are_pushed(spark, chunks, queries, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical_index, "PUSHED", 3)
    index = lexical_index.LexicalIndex(spark, f"file://{tmp_path}/index", 4)
    index.update(chunks, 0)
    assert rows_of(index.search(queries, 7), "query_id", "chunk_id", "rank", "score") == scan(chunks, queries)


def test_phrases(spark, tmp_path):
    index = lexical_index.LexicalIndex(spark, f"file://{tmp_path}/index", 4)
    index.update(spark.createDataFrame([(1, "a b a b a"), (2, "b a"), (3, "A, b; c"), (4, "a a b")], "chunk_id long, body string"), 0)
    assert rows_of(index.phrase(["a", "b"]), "chunk_id", "starts") == [(1, [0, 2]), (3, [0]), (4, [1])]
    assert rows_of(index.phrase(["a", "b", "a"]), "chunk_id", "starts") == [(1, [0, 2])]
    assert rows_of(index.phrase(["a", "a"]), "chunk_id", "starts") == [(4, [0])]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(25, 16))
    rows = [(i, [float(x) for x in centres[i % 25] + 0.4 * rng.normal(size=16)]) for i in range(2000)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, rows[3][1]), (5003, [float("nan")] * 16)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<double>")


def test_vector_index(spark, vectors, tmp_path):
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/vectors")
    assert 1 < index.build(vectors) <= 45
    asked = vectors.filter("chunk_id % 100 = 0 AND chunk_id < 2000").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    usable = vectors.filter("chunk_id NOT IN (5000, 5001, 5003)")
    true = rows_of(retrieval.dense_topk(usable, asked, 10), "query_id", "rank", "chunk_id")
    assert rows_of(index.search(asked, 10, probes=2, exact=True), "query_id", "rank", "chunk_id") == true
    near = {(q, c) for q, _, c in rows_of(index.search(asked, 10, probes=6), "query_id", "rank", "chunk_id")}
    assert len(near & {(q, c) for q, _, c in true}) >= 0.9 * len(true)
    allowed = vectors.filter("chunk_id % 7 = 0").select("chunk_id")
    assert rows_of(index.search(asked, 10, probes=2, exact=True, allowed=allowed), "query_id", "rank", "chunk_id") == rows_of(retrieval.dense_topk(usable.join(allowed, "chunk_id", "left_semi"), asked, 10), "query_id", "rank", "chunk_id")
    few = allowed.limit(3)
    assert index.search(asked, 10, probes=1, exact=True, allowed=few).count() == 3 * asked.count()


def test_probed_cells_alone_are_read(spark, vectors, tmp_path):
    index = vector_index.VectorIndex(spark, f"file://{tmp_path}/vectors")
    index.build(vectors)
    one = vectors.filter("chunk_id = 100").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    plan = index.search(one, 5, probes=1)._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters: [")[-1].split("]")[0] or any("cell" in p.split("]")[0] for p in plan.split("PartitionFilters: [")[1:])


def test_recall_over_the_given_table(spark, sf):
    from quarry import registry

    rows = registry.queries()["a23_index_recall"](spark, sf).collect()
    assert sum(r["found"] for r in rows) >= 0.9 * sum(r["expected"] for r in rows)
