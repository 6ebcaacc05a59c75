"""A training-data pipeline over the documents table, each stage one operator of quarry.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last
return the columns of documents; the last returns the digest of the token files it wrote.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import _store, decontamination, mixing, near_dedup, quality, token_output

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the compression classifier rejects go."""
    model = quality.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, keep=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10 at a similarity of 0.8: one document of each group stays, the one with the smallest id.

    A row is judged by its id and text, so rows that share an id go or stay each for itself, equal rows of
    one id stay or go together, and rows without id stay.
    """
    gone = near_dedup.near_duplicates(spark, docs, percent=80, mark=True).filter(~F.col("kept")).select(F.col("doc_id").alias("k"), F.col("text_hash").alias("h")).distinct()
    same = (F.col("docs.doc_id").cast("long") == F.col("gone.k")) & (F.xxhash64(F.col("docs.text").cast("string")) == F.col("gone.h"))
    return docs.alias("docs").join(gone.alias("gone"), same, "left_anti")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold a benchmark item go."""
    return decontamination.drop_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: a document stands as often as the mix takes it, not at all or up to twice."""
    return mixing.take(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: token ids in its file format; what is returned is read back from the files."""
    return token_output.token_digests(spark, docs, TOKENIZER)


STAGES = [
    ("quality classifier", filter_quality),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token output", write_tokens),
]

#: The classifier and the tokenizer have no SQL form; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = _store.scratch(spark, f"stage{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
