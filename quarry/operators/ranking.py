"""Ranking metrics and rank fusion over DataFrames; every ranked list is (query, candidate, rank from 1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut

CUTOFFS = (1, 3, 5, 8, 10, 20)


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def top_k(df: DataFrame, key: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k of each group; the plan keeps only k rows a group before the shuffle."""
    return numbered(df, key, order).filter(F.col("rank") <= k)


def positions(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """All rows numbered from 1 in one order, without a task that sees them all: ranges are sorted apart and numbered from their sizes.

    The order is total; rows that it does not tell apart are numbered as they come.
    """
    spark = df.sparkSession
    nth = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut(spark, df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_nth": nth}))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_nth") + 1).cast("int")).drop("_part", "_nth", "_before")  # a row a partition


def fuse(routes: Sequence[DataFrame], key: Sequence[str], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (k + rank) over the routes that have the candidate."""
    parts = [r.select(*key, (1 / (F.lit(k) + F.col("rank"))).alias("part"), F.lit(i).alias("route"), "rank") for i, r in enumerate(routes)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    ranks = [F.min(F.when(F.col("route") == i, F.col("rank"))).alias(f"rank_{i}") for i in range(len(routes))]
    # summed in order of route, so the same inputs give the same bits
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("route", "part"))), F.lit(0.0), lambda s, x: s + x["part"])
    return rows.groupBy(*key).agg(total.alias("rrf"), *ranks)


def ranking_suite(ranked: DataFrame, golden: DataFrame, cutoffs: Sequence[int] = CUTOFFS) -> DataFrame:
    """Per query and cutoff: precision (over the cutoff), recall of evidence, hit; first relevant rank and reciprocal rank.

    A candidate is relevant if it is golden evidence. Queries without any relevant candidate score 0.
    """
    expected = golden.groupBy("query_id").agg(F.countDistinct("evidence_id").alias("expected"))
    hits = ranked.join(golden.select("query_id", F.col("evidence_id").alias("candidate_id")).distinct(), ["query_id", "candidate_id"])
    at = [F.count_if(F.col("rank") <= c).alias(f"h{c}") for c in cutoffs]
    per = expected.join(hits.groupBy("query_id").agg(*at, F.min("rank").alias("first_rank")), "query_id", "left").na.fill(0, [f"h{c}" for c in cutoffs])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("cutoff"), F.col(f"h{c}").alias("hits")) for c in cutoffs])).alias("x")
    per = per.select("query_id", "expected", "first_rank", rows)
    return per.select(
        "query_id", "x.cutoff", (F.col("x.hits") / F.col("x.cutoff")).alias("precision"), (F.col("x.hits") / F.col("expected")).alias("recall"), F.when(F.col("x.hits") > 0, 1.0).otherwise(0.0).alias("hit"),
        "first_rank", F.when(F.col("first_rank") <= 10, 1 / F.col("first_rank")).otherwise(0.0).alias("reciprocal_rank"),
    )


def novelty_ndcg(found: DataFrame, golden: DataFrame, cutoff: int) -> DataFrame:
    """found: query_id, evidence_id, rank. Evidence counts where it is first seen, so gains need only its best rank."""
    best = found.filter(F.col("rank") <= cutoff).groupBy("query_id", "evidence_id").agg(F.min("rank").alias("rank"))
    dcg = best.groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("expected", F.lit(cutoff)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    want = golden.groupBy("query_id").agg(F.countDistinct("evidence_id").alias("expected")).withColumn("ideal", ideal)
    return want.join(dcg, "query_id", "left").select("query_id", F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)).alias("ndcg"))


def evidence_gate(scores: DataFrame, floor: float, ratio: float, most: int, high: float, gap: float) -> DataFrame:
    """query_id, rank, score, descending -> query_id, outcome, retained: an absolute floor, a share of the best, then ambiguity."""
    s = F.col("s")
    per = scores.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("a")).select("query_id", F.transform("a", lambda x: x["score"]).alias("s"))
    top = F.element_at(s, 1)
    least = F.greatest(F.lit(floor), top * ratio)
    kept = F.least(F.size(F.filter(s, lambda x: x >= least)), F.lit(most))
    kept = F.when(top < floor, 0).otherwise(kept)
    unsure = (kept >= 2) & (top < high) & (top - F.element_at(s, 2) <= gap)
    return per.select("query_id", kept.alias("retained"), F.when(kept == 0, "unsupported").when(unsure, "uncertain").otherwise("supported").alias("outcome"))


def nearest_rank(column: str, q: float) -> Column:
    """The smallest whole value with at least the share q of rows at or below it."""
    return F.expr(f"CAST(percentile_disc({q}) WITHIN GROUP (ORDER BY {column}) AS LONG)")


def ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """a / b, or `empty` where b is 0."""
    out = a / F.nullif(b, F.lit(0))
    return out if empty is None else F.coalesce(out, F.lit(empty))
