"""Connected components by alternating large-star and small-star steps, all in Spark, until what is left
is small enough for one task.

Every step takes a minimum per node (combined before the shuffle) and joins it back over `SALTS`
salted keys, so a node with many neighbours never has them gathered in one task; each round ends in
checkpoint files. A graph of at most `SMALL` edges (16 bytes each), at the start or after some rounds, is
finished by one task; its size is checked before, and the result is the same either way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import _store

SALTS = 16
SMALL = 250_000


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges (a, b) of a small graph to node, root."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    found = [(x, root(x)) for x in list(parent)]
    found = [(x, r) for x, r in found if x != r]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], ["node", "root"])


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (a, b) with the minimum m of their a; a hub's edges are dealt over SALTS tasks."""
    salted = least.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(salted, ["a", "salt"]).drop("salt")


def components(spark: SparkSession, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node it reaches) of every node that is not its own root; edges: a, b."""
    now = _store.cut(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen["n"] == 0 or (seen["n"], seen["h"]) == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        if seen["n"] <= SMALL:
            return now.repartition(1).mapInArrow(_whole, "node long, root long")
        mark = (seen["n"], seen["h"])
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _with_least(both, least).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(large, least).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).distinct()
        now = _store.cut(spark, small)
    raise RuntimeError("components did not settle")
