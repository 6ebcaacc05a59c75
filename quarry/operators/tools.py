"""The tools a caller may run: what each needs, and the shape of its result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Tool:
    name: str
    timeout_s: int
    market_scoped: bool
    roles: tuple[str, ...] = ("analyst", "support")
    version: str = "1"


# Tools, seconds they may take, whether a market must be named.
TOOLS = (Tool("get_product_spec", 3, False), Tool("search_inventory", 3, True), Tool("search_knowledge", 8, False), Tool("read_uploaded_file", 3, False), Tool("get_evidence_detail", 3, False))


def registry_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t.name, t.timeout_s, t.market_scoped) for t in TOOLS], "tool string, timeout_s int, market_scoped boolean")


def envelope(status: Column, has_data: Column) -> Column:
    """A success carries data and an error none."""
    return F.when((status == "succeeded") == has_data, "valid").otherwise("invalid")


def call(name: str, run: Callable[[], DataFrame], roles: tuple[str, ...], market: str | None = None) -> tuple[str, DataFrame | None]:
    """Status and result of a tool: registered, then permitted, then run."""
    tool = next((t for t in TOOLS if t.name == name), None)
    if tool is None:
        return "tool_not_registered", None
    if not set(roles) & set(tool.roles):
        return "role_denied", None
    if tool.market_scoped and not market:
        return "market_required", None
    return "ok", run()


def until_stalled(results: DataFrame, keys: list[str], order: str, progress: Column, most: int = 1) -> DataFrame:
    """The results a worker gives until more than `most` in a row show no progress; `stopped` marks the one that ends it.

    A null progress is none. Later results of the key are left out, since the worker no longer runs. `order` is unique in a key.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    sofar = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = results.withColumn("_n", F.row_number().over(w))
    streak = F.col("_n") - F.coalesce(F.max(F.when(progress, F.col("_n"))).over(sofar), F.lit(0))
    rows = rows.withColumn("_over", (streak > most).cast("int"))
    rows = rows.withColumn("_overs", F.sum("_over").over(sofar))
    return rows.filter((F.col("_overs") == 0) | ((F.col("_overs") == 1) & (F.col("_over") == 1))).withColumn("stopped", F.col("_over") == 1).drop("_n", "_over", "_overs")


def repeated_handoffs(handoffs: DataFrame, keys: list[str], order: str, signature: Column, most: int = 1) -> DataFrame:
    """Handoffs with `refused`: whether the same signature was handed off `most` times before under the same key."""
    earlier = F.row_number().over(Window.partitionBy(*keys, "_signature").orderBy(order)) - 1
    return handoffs.withColumn("_signature", F.sha2(signature, 256)).withColumn("refused", earlier >= most).drop("_signature")
