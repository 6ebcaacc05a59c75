"""B11, H22, A23, F01 and M02 over stored indexes: built once for a state of a table's files, then searched."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import retrieval
from quarry.operators.lexical_index import LexicalIndex
from quarry.operators.vector_index import VectorIndex
from quarry.plans.relational import COSINE
from quarry.registry import query
from quarry.session import shared_dir, stamp, table


def _root(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, bool]:
    """The folder of the index over a table as it is now, and whether it is new; a session keeps what it has built."""
    held = spark.sparkContext.__dict__.setdefault("_quarry_indexes", {})
    key = (name, stamp(spark, f"{sf_dir}/{name}.parquet"))
    root = held.get(key)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root) if root else None
    if path is not None and path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return root, False
    held[key] = f"{shared_dir(spark).rstrip('/')}/quarry-index-{name}-{uuid.uuid4().hex}"
    return held[key], True


def lexical(spark: SparkSession, sf_dir: str) -> LexicalIndex:
    """The index of all documents' texts, a chunk each."""
    root, new = _root(spark, sf_dir, "documents")
    index = LexicalIndex(spark, root)
    if new or index.version() == 0:
        index.update(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("body")), 0)
    return index


def dense(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The index of all embeddings."""
    root, new = _root(spark, sf_dir, "embeddings")
    index = VectorIndex(spark, root)
    if new:
        index.build(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"))
    return index


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0")
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


NEAREST = f"SELECT query_id, vec_id, round(dist, 6) + 0.0 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS r FROM (SELECT x.vec_id AS query_id, e.vec_id, {COSINE} AS dist FROM embeddings e, embeddings x WHERE x.vec_id % 100 = 0)) WHERE r <= 30"
WORDS = r"(SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS terms FROM benchmark)"


@query("f01_indexed_topk", NEAREST)
def _(spark, d):
    """f01 by the stored index: cells in order of their bound, as many as it takes to be exact."""
    near = dense(spark, d).search(asked(spark, d), 30, exact=True)
    return near.select("query_id", F.col("chunk_id").alias("vec_id"), (F.round("distance", 6) + 0.0).alias("distance"))


@query("a23_index_recall")
def _(spark, d):
    """How many of each query's ten nearest the index finds by probing the cells nearest to it."""
    found = dense(spark, d).search(asked(spark, d), 10).select("query_id", "chunk_id")
    true = retrieval.dense_topk(table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding"), asked(spark, d), 10).select("query_id", "chunk_id")
    hits = found.withColumn("hit", F.lit(1))
    return true.join(hits, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("*").alias("expected"), F.count("hit").alias("found"))


@query("b11_indexed_match", rf"""
SELECT item_id, chunk_id, rank, round(score, 6) AS score FROM (SELECT item_id, chunk_id, 0.1::DOUBLE * n / (0.1::DOUBLE * n + 1) AS score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY n DESC, chunk_id) AS INT) AS rank FROM (
  SELECT i.item_id, w.doc_id AS chunk_id, count(*) AS n FROM (SELECT item_id, unnest(terms) AS term FROM {WORDS}) i JOIN (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM documents) w ON w.term = i.term GROUP BY i.item_id, w.doc_id)) WHERE rank <= 10
""")
def _(spark, d):
    """Every benchmark item's words against the stored index of all documents."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), text.tokens(F.col("text")).alias("terms"))
    found = lexical(spark, d).search(items, 10)
    return found.select(F.col("query_id").alias("item_id"), "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("b11_indexed_phrase", r"""
SELECT doc_id AS chunk_id, CAST(n AS INT) AS places FROM (SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'all' AND w[i + 1] = 'rights')) AS n FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents)) WHERE n > 0
""")
def _(spark, d):
    """A phrase by the positions in the index; no text is read."""
    return lexical(spark, d).phrase(["all", "rights"]).select("chunk_id", F.size("starts").alias("places"))
