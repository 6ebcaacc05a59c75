"""Exact percentiles of groups of any size: the rank's place is narrowed over histograms, so no group meets in one task.

Values are counted per group first. Each pass then cuts the range that still holds a rank into `BINS` bins, adds up the counts a
bin (combined before the shuffle) and goes on with the bin the rank lies in, until no range has more than `FEW` different
values; these are counted up. Both ends of a range are values of the group, so every pass parts them. Nulls and NaN don't count; a group without values has a null result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut

BINS = 1024
#: Different values of a group that are counted up in one window.
FEW = 16_384


def select_ranks(df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, Column], bins: int = BINS, few: int = FEW) -> DataFrame:
    """keys, n and, under each name of `wanted`, the value of that rank (from 1, as a Column of the group's size n)."""
    spark = df.sparkSession
    group = list(keys) or ["_all"]
    rows = df.select(*([F.lit(1).alias("_all")] if not keys else keys), F.col(value).alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan(F.col("_v").cast("double")))
    counted = rows.groupBy(*group, "_v").agg(F.count("*").alias("_c"))
    total = counted.groupBy(*group).agg(F.sum("_c").alias("n"), F.count("*").alias("_d"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    marks = F.explode(F.array(*[F.struct(F.lit(name).alias("_name"), F.greatest(F.lit(1), F.least(rank, F.col("n"))).cast("long").alias("_rank")) for name, rank in wanted.items()])).alias("_x")
    about = [*group, "n", "_name"]
    state = total.select(*group, "n", "_d", "_low", "_high", marks).select(*about[:-1], "_x._name", "_x._rank", "_d", "_low", "_high")

    def ranges(open_: DataFrame) -> DataFrame:
        """The values that still are in question, with what is sought among them."""
        same = [F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}")) for k in group]
        met = counted.alias("c").join(open_.alias("s"), [*same, F.col("c._v").between(F.col("s._low"), F.col("s._high"))])
        return met.select(*[F.col(f"s.{c}") for c in (*about, "_rank", "_low", "_high")], "c._v", "c._c")

    def holder(sums: DataFrame, order: str) -> DataFrame:
        """Of counts in order, at most `bins` or `few` a rank, the one that the rank lies in; the rank becomes its place there."""
        upto = F.sum("_m").over(Window.partitionBy(*group, "_name").orderBy(order))
        hit = sums.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_m") < F.col("_rank")))
        return hit.select(*about, (F.col("_rank") - (F.col("_upto") - F.col("_m"))).alias("_rank"), "_d", "_low", "_high")

    def widest() -> int:
        return state.agg(F.max(F.when(F.col("_low") < F.col("_high"), F.col("_d"))).alias("d")).first()["d"] or 0

    if (left := widest()) > few:  # what is read more than twice is kept
        counted, state = cut(spark, counted), cut(spark, state)
    while left > few:
        met = ranges(state.filter("_low < _high"))
        low, high, v = F.col("_low").cast("double"), F.col("_high").cast("double"), F.col("_v").cast("double")
        # the largest value has a bin of its own, whatever rounding says, so every pass parts a range
        place = F.greatest(F.lit(0), F.least(F.lit(bins - 2), F.floor((v - low) / (high - low) * bins).cast("int")))
        sums = met.withColumn("_bin", F.when(F.col("_v") == F.col("_high"), bins - 1).otherwise(place)).groupBy(*about, "_rank", "_bin")
        sums = sums.agg(F.sum("_c").alias("_m"), F.count("*").alias("_d"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        state = cut(spark, state.filter("_low >= _high").unionByName(holder(sums, "_bin")))
        left = widest()
    few = ranges(state.filter("_low < _high")).select(*about, "_rank", F.col("_c").alias("_m"), F.lit(1).cast("long").alias("_d"), F.col("_v").alias("_low"), F.col("_v").alias("_high"))
    state = state.filter("_low >= _high").unionByName(holder(few, "_low"))
    out = state.groupBy(*group, "n").agg(*[F.max(F.when(F.col("_name") == name, F.col("_low"))).alias(name) for name in wanted])
    return out if keys else out.drop("_all")


def nearest_ranks(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, n and the smallest value with at least each share of the group's values at or below it."""
    return select_ranks(df, keys, value, {name: F.ceil(F.round(F.col("n") * q, 9)) for name, q in shares.items()})


def interpolated(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, n and the percentiles that interpolate between the two nearest values."""
    place = {name: (F.col("n") - 1) * q for name, q in shares.items()}
    both = select_ranks(df, keys, value, {f"{name}_{end}": (F.floor(p) if end == "a" else F.ceil(p)) + 1 for name, p in place.items() for end in "ab"})
    mixed = [(F.col(f"{name}_a") + (F.col(f"{name}_b") - F.col(f"{name}_a")) * (p - F.floor(p))).cast("double").alias(name) for name, p in place.items()]
    return both.select(*keys, "n", *mixed)
