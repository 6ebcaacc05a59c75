"""State transitions as new tables: claims, completions, failures, pointer switches, deletions.

Parquet has no row locks, so a transition is a function from the old rows to the new ones and one
writer publishes the result as a new generation (`sources.generations`). A caller learns from
`changed` whether its expectation held, as from the number of updated rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Legal transitions of files and versions.
FILE_STATES = (("uploaded", "parsing"), ("parsing", "ready"), ("parsing", "failed"), ("failed", "parsing"), ("ready", "parsing"), ("uploaded", "soft_deleted"), ("ready", "soft_deleted"), ("failed", "soft_deleted"))


def claim(rows: DataFrame, wanted: Column, free: Sequence[str] = ("pending", "failed"), working: str = "processing") -> DataFrame:
    """Compare and set: wanted rows in a free state start working, with one attempt more."""
    take = F.coalesce(wanted, F.lit(False)) & F.col("status").isin(*free)
    return rows.withColumns({"status": F.when(take, working).otherwise(F.col("status")), "attempt_count": F.col("attempt_count") + take.cast("int"), "changed": take})


def complete(rows: DataFrame, results: DataFrame, keys: Sequence[str], working: str = "processing") -> DataFrame:
    """Rows still claimed at the attempt of a result, with the counts it should have, become ready.

    results: keys, expected_attempt, expected_count, actual_count.
    """
    full = rows.join(results, list(keys), "left")
    fits = F.coalesce((F.col("status") == working) & (F.col("attempt_count") == F.col("expected_attempt")) & (F.col("expected_count") == F.col("actual_count")), F.lit(False))
    return full.withColumns({"status": F.when(fits, "ready").otherwise(F.col("status")), "changed": fits}).drop("expected_attempt", "expected_count", "actual_count")


def fail(rows: DataFrame, failed: Column, had_active: Column, working: str = "processing") -> DataFrame:
    """A failed attempt: a generation that was active stays ready, otherwise the row has failed."""
    hit = F.coalesce(failed, F.lit(False)) & (F.col("status") == working)
    return rows.withColumns({"status": F.when(hit, F.when(had_active, "ready").otherwise("failed")).otherwise(F.col("status")), "changed": hit})


def drop_generation(chunks: DataFrame, failed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Chunks without those of failed generations."""
    return chunks.join(failed.select(*keys).distinct(), list(keys), "left_anti")


def soft_delete(rows: DataFrame, chosen: Column, at: Column) -> DataFrame:
    gone = F.coalesce(chosen, F.lit(False)) & F.col("deleted_at").isNull()
    return rows.withColumns({"deleted_at": F.when(gone, at).otherwise(F.col("deleted_at")), "changed": gone})


def delete_subtree(rows: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """Rows without those under the given roots."""
    return rows.join(roots.select(key).distinct(), key, "left_anti")


def transitions(rows: DataFrame, legal: Sequence[tuple[str, str]] = FILE_STATES, old: str = "old_status", new: str = "new_status") -> DataFrame:
    """Adds legal: is the step in the table of legal ones (or no step at all)."""
    table = rows.sparkSession.createDataFrame(list(legal), f"{old} string, {new} string").withColumn("_l", F.lit(True))
    full = rows.join(F.broadcast(table), [old, new], "left")  # a fixed table of a few rows
    return full.withColumn("legal", F.coalesce("_l", F.lit(False)) | (F.col(old) == F.col(new))).drop("_l")


def switch_pointer(docs: DataFrame, ready: DataFrame) -> DataFrame:
    """Active pointers move to newly ready versions (document_id, version_id, version_no), the highest of each document."""
    best = ready.groupBy("document_id").agg(F.max_by("version_id", "version_no").alias("_v"))
    return docs.join(best, "document_id", "left").withColumn("active_version_id", F.coalesce("_v", "active_version_id")).drop("_v")
