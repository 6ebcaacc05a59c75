"""Join operators that Spark has no single word for: guarded neighbours, containment, readiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(df: DataFrame, generation: Sequence[str], index: str, value: str) -> DataFrame:
    """previous and next value of each row, null where the neighbouring index is missing."""
    w = Window.partitionBy(*generation).orderBy(index)
    guard = lambda f, step: F.when(f(index).over(w) == F.col(index) + step, f(value).over(w))
    return df.withColumn("previous", guard(F.lag, -1)).withColumn("next", guard(F.lead, 1))


def merge_ranked(a: DataFrame, b: DataFrame, key: Sequence[str], facts: Sequence[str]) -> DataFrame:
    """Two ranked lists as one row per key with both ranks; conflict marks keys whose facts differ."""
    tagged = a.withColumn("route", F.lit("a")).unionByName(b.withColumn("route", F.lit("b")))
    fact = F.struct(*facts)
    return tagged.groupBy(*key).agg(
        F.min(F.when(F.col("route") == "a", F.col("rank"))).alias("rank_a"), F.min(F.when(F.col("route") == "b", F.col("rank"))).alias("rank_b"),
        (F.min(fact) != F.max(fact)).alias("conflict"), F.min(fact).alias("facts"),
    )


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length that two half-open ranges share."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def covered_spans(spans: DataFrame, chunks: DataFrame, document: str, cell: int) -> DataFrame:
    """Pairs of an expected span (s0, s1) and a chunk (c0, c1) of its document that share characters.

    Both sides are cut into cells of fixed width, so the range condition becomes an equality on
    (document, cell) and a long document's pairs never meet in one task.
    """
    def cells(df: DataFrame, start: str, end: str) -> DataFrame:
        return df.withColumn("cell", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor((F.col(end) - 1) / cell))))

    met = cells(spans, "s0", "s1").join(cells(chunks, "c0", "c1"), [document, "cell"])
    # a pair meets in every cell it shares; the first of them speaks for it
    first = F.floor(F.greatest("s0", "c0") / cell)
    return met.filter((F.col("cell") == first) & (F.col("s0") < F.col("c1")) & (F.col("c0") < F.col("s1"))).drop("cell")


def ready_tasks(tasks: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """Pending tasks whose dependencies are all completed: one per worker of a plan, `most` per plan."""
    status = tasks.select(F.col("task_id").alias("depends_on"), F.col("status").alias("dependency_status"))
    blocked = edges.join(status, "depends_on", "left").filter(~F.col("dependency_status").eqNullSafe(F.lit("completed"))).select("task_id")
    free = tasks.filter("status = 'pending'").join(blocked, "task_id", "left_anti")
    free = free.withColumn("r", F.row_number().over(Window.partitionBy("plan_id", "worker").orderBy("task_id"))).filter("r = 1")
    return free.withColumn("r", F.row_number().over(Window.partitionBy("plan_id").orderBy("task_id"))).filter(F.col("r") <= most).drop("r")
