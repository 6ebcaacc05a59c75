"""Relational operators: access control, existence, latest rows, cardinality, previews, seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import percentiles


def as_csv_line(df: DataFrame) -> Column:
    """Values joined by commas without quoting; null prints None."""
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in df.columns])


def joined_in_order(value: Column, order: str, by: str) -> Column:
    """Values of a group joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"]), by)


def adapt_blocks(texts: DataFrame, pages: DataFrame) -> DataFrame:
    """Parsed sources as one table of blocks: text blocks by line, one table block per page."""
    lines = texts.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("i", "body")).filter(F.trim("body") != "")
    text = lines.select("document_id", (F.col("i") + 1).alias("position"), F.lit("text").alias("kind"), "body", F.lit(None).cast("int").alias("rows"))
    tables = pages.select((-F.col("page_id") - 1).alias("document_id"), F.lit(1).alias("position"), F.lit("table").alias("kind"), F.lit(None).cast("string").alias("body"), F.size(F.split("html", "\n")).alias("rows"))
    return text.unionByName(tables)


def upload_status(extension: str, content: str, magic: dict[str, str], most: int) -> Column:
    """The first rule an upload breaks: extension, emptiness, size, leading bytes."""
    size = F.octet_length(content)
    wrong = F.lit(False)
    for ext, head in magic.items():
        if head:
            wrong = wrong | ((F.col(extension) == ext) & (F.substring(F.col(content), 1, len(head)) != F.lit(head.encode())))
    return F.when(~F.col(extension).isin(*magic), "extension_not_allowed").when(size == 0, "empty").when(size > most, "too_large").when(wrong, "content_mismatch").otherwise("ok")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and interpolated quartiles of each column; no column's values meet in one task."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("x")
    long = df.select(values).select("x.*")
    stats = long.groupBy("name").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
    quartiles = percentiles.interpolated(long, ["name"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}).drop("n")
    return stats.join(quartiles, "name", "left").select("name", "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def seed_outcome(seed: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What loading a seed again does to each row: inserted, unchanged, or in conflict with what is stored."""
    body = [c for c in seed.columns if c not in keys]
    had = stored.select(*keys, F.struct(*body).alias("had"))
    full = seed.join(had, list(keys), "left")
    return full.withColumn("outcome", F.when(F.col("had").isNull(), "inserted").when(F.struct(*body).eqNullSafe(F.col("had")), "unchanged").otherwise("conflict")).drop("had")


def insert_absent(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows and those new ones whose key is not there; of several new ones the first by all columns."""
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*new.columns))).filter("_n = 1").drop("_n")
    return stored.unionByName(first.join(stored.select(*keys), list(keys), "left_anti"))


def accessible(docs: DataFrame, acl: DataFrame, user: str, roles: Sequence[str], markets: Sequence[str], company_owner: bool = False) -> DataFrame:
    """Documents a user may read: the owner's, those granted to the user, a role or a market, or all for a company owner.

    Grants are reduced to document ids first, so a document with many matching grants is joined once.
    """
    if company_owner:
        return docs
    t, s = F.col("subject_type"), F.col("subject_id")
    granted = acl.filter(((t == "user") & (s == user)) | ((t == "role") & s.isin(*roles)) | ((t == "market") & s.isin(*markets))).select("document_id").distinct().withColumn("granted", F.lit(True))
    return docs.join(granted, "document_id", "left").filter((F.col("owner_id").cast("string") == user) | F.coalesce("granted", F.lit(False))).drop("granted")


def latest(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """The rows of each group that stand at its latest time, ties included.

    The maximum is combined before the shuffle and joined back, so a group with many rows is not sorted.
    """
    top = df.groupBy(*keys).agg(F.max(by).alias(by))
    return df.join(top, [*keys, by])


def cardinality(df: DataFrame, keys: Sequence[str], names: str) -> DataFrame:
    """One row per key with its number of matches, their names in order, and found or ambiguous."""
    out = df.groupBy(*keys).agg(F.count("*").alias("matches"), F.array_join(F.array_sort(F.collect_set(names)), ",").alias("names"))
    return out.withColumn("status", F.when(F.col("matches") > 1, "ambiguous").otherwise("found"))


def available(df: DataFrame) -> DataFrame:
    """on_hand - reserved - unsellable; less than nothing breaks the contract, zero does not."""
    left = F.col("on_hand") - F.col("reserved") - F.col("unsellable")
    return df.withColumn("available", left).withColumn("status", F.when(left < 0, "contract_violation").otherwise("ok"))


def by_priority(df: DataFrame, keys: Sequence[str], priority: str) -> DataFrame:
    """Of each group only the rows of its best (smallest) priority."""
    best = df.groupBy(*keys).agg(F.min(priority).alias(priority))
    return df.join(best, [*keys, priority])


def first_failure(rules: Sequence[tuple[Column, str]], otherwise: str = "allowed") -> Column:
    """The reason of the first rule that does not hold."""
    out = F.lit(otherwise)
    for holds, reason in reversed(rules):
        out = F.when(~holds, F.lit(reason)).otherwise(out)
    return out


def cohort_relation(df: DataFrame, keys: Sequence[str], first: Column, second: Column) -> DataFrame:
    """Per group, how the rows of the first cohort stand to those of the second: equal, subset, superset or overlapping."""
    per = df.groupBy(*keys).agg(F.count_if(first & ~second).alias("a"), F.count_if(~first & second).alias("b"))
    a, b = F.col("a") == 0, F.col("b") == 0
    return per.select(*keys, F.when(a & b, "equal").when(a, "subset").when(b, "superset").otherwise("overlapping").alias("relation"))
