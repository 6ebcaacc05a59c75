"""Operator 3: mixing sources to target weights by systematic sampling. Built-in functions only.

A document's size is its number of words. Sources, by code point with null last, weigh
`weights`, repeating, and share `share` times all sizes; no target passes `most` times its
source's size, and what that cuts off is shared again by weight. That fixpoint has a closed
form: with sources in order of limit over weight, the first ones stand at their limits and the
rest get one common rate times their weight.

Every document of a source expects the same number of copies, target / source size, at most
`most`. The copies are prefix-summed along the source in order of size, one offset drawn per
source is added, and a document is emitted once for each integer the sum crosses. Neighbours in
that order have nearly equal sizes, so the words taken come near the target too.

The prefix sum never gathers a source in one task: a document's place is the number of documents
of smaller size in its source (a sum over distinct sizes), plus those of its size with a smaller
`key mod 1024` (a sum over 1024 rows), plus its row number among the rest. Null or empty texts
have size 0 and are taken 0 words; rows with equal keys are sampled each for itself; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import _store

WORD = "[^\\x20\\x09-\\x0D]+"
SALTS = 1024


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target from rows of source, size: one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    nth = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (nth + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rest = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    per = per.withColumn("rate", rest / F.sum("weight").over(after))
    # The rate that holds is the first one within its source's own limit: it rises up to there and falls after.
    level = F.max(F.when(F.col("rate") * F.col("weight") <= F.col("cap"), F.col("rate"))).over(everything)
    return per.withColumn("level", level).select("source", "source_size", "source_docs", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _rows(docs: DataFrame, key: str, text: str, source: str, *more) -> DataFrame:
    rows = docs.select(F.col(key).alias("k"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *more)
    return rows.withColumn("salt", F.coalesce(F.pmod(F.col("k"), F.lit(SALTS)), F.lit(-1)).cast("int"))


def _copies(rows: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int, order: list) -> DataFrame:
    """The rows with source_size, target, copies."""
    salted = rows.groupBy("source", "size", "salt").agg(F.count("*").alias("n"))
    sized = salted.groupBy("source", "size").agg(F.sum("n").alias("m"))
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("base", F.coalesce(F.sum("m").over(smaller), F.lit(0)))
    same = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    salted = salted.withColumn("ahead", F.coalesce(F.sum("n").over(same), F.lit(0)))
    goal = targets(sized.select("source", (F.col("size") * F.col("m")).alias("size")), weights, share, most)
    goal = goal.withColumn("offset", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 3), 16, 10).cast("double") / 4096)
    # `sized` and `goal` hold a row per distinct size and per source; AQE broadcasts them while they are small.
    place = salted.alias("a").join(sized.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.size") == F.col("b.size"))).select(F.col("a.source").alias("source"), F.col("a.size").alias("size"), "salt", (F.col("base") + F.col("ahead")).alias("base"))
    place = place.alias("a").join(goal.alias("g"), F.col("a.source").eqNullSafe(F.col("g.source"))).select("a.*", "source_size", "target", "offset")
    # a null source by a column of its own: rank and join then share one shuffle of the rows
    named = {"name": F.coalesce("source", F.lit("")), "unnamed": F.col("source").isNull()}
    group = [*named, "size", "salt"]
    ranked = rows.withColumns(named).withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    full = ranked.join(place.withColumns(named).drop("source"), group)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("base") + F.col("r")
    full = full.withColumn("copies", (F.floor(at * rate + F.col("offset")) - F.floor((at - 1) * rate + F.col("offset"))).cast("int"))
    return full.select(*rows.columns, "source_size", "target", "copies")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, size, source_size, target, copies, taken of each row. Reruns agree."""
    rows = _store.cut(docs.sparkSession, _rows(docs, key, text, source))  # the texts are read once; from here on a row is a few numbers
    full = _copies(rows, weights, share, most, seed, ["k"])
    return full.select(F.col("k").alias(key), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it.

    Rows are carried whole, so null and repeated keys lose and add nothing. Rows of one key are ranked by a
    hash of the whole row, so reruns agree.
    """
    rows = _rows(docs, key, text, source, F.struct(*docs.columns).alias("row"))
    full = _copies(rows, weights, share, most, seed, ["k", F.xxhash64("row")]).filter("copies > 0")
    return full.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source
), weighed AS (
  SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM per
), rated AS (
  SELECT *, ((SELECT sum(source_size) FROM per) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM weighed
), goal AS (
  SELECT source, source_size, least(cap, coalesce((SELECT max(rate) FROM rated WHERE rate * weight <= cap) * weight, cap)) AS target,
    CAST('0x' || substr(md5('7:' || coalesce(source, '')), 1, 3) AS INT) / 4096.0::DOUBLE AS shift FROM rated
), placed AS (
  SELECT r.*, g.source_size, g.target, g.shift, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate,
    row_number() OVER (PARTITION BY r.source ORDER BY r.size, r.doc_id % 1024, r.doc_id) AS pos
  FROM rows r JOIN goal g ON r.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(pos * rate + shift) - floor((pos - 1) * rate + shift)) AS BIGINT) AS taken FROM placed
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_mix_sources": query}
ORACLES: dict[str, str] = {"op3_mix_sources": SQL}
