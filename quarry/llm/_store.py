"""Where operators put intermediate tables, and helpers they share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import ship as ship


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where it is unset and all is one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/quarry-{name}-{uuid.uuid4().hex}"


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The same rows from checkpoint files: lineage ends here and lost executors don't matter."""
    shared_dir(spark)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch table once nothing reads it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def give_back() -> None:
    """Return what the allocators of this process keep though it is free."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim is not None:
        trim(0)


@functools.lru_cache(1)
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same for mapInArrow, giving back free memory after each batch: workers outlive their tasks."""

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            give_back()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(fed(batches))
        give_back()

    return whole


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs run inside send at most `rows` rows a batch to Python: Arrow's buffers in the executor's JVM stay small.

    Only for actions that end inside: a plan that is returned runs with the session's own setting.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows if int(before) <= 0 else min(rows, int(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_values(rows: DataFrame, key: str, parts: int) -> list:
    """Values of a column, None among them, that more than half of an even share of the rows have: at most 2 * parts.

    Candidates come from one pass that keeps a bounded number of values and misses none of those; a second pass
    counts them. Both read the column alone and shuffle no values but the candidates.
    """
    share = max(1 / (2 * parts), 1e-4)
    column = rows.select(F.col(key).alias("v"))
    n, known = column.agg(F.count("*"), F.count("v")).first()
    least = max(n * share, HOT_LEAST)
    if n < least:
        return []
    found = column.filter("v IS NOT NULL").stat.freqItems(["v"], share).first()[0]
    counted = column.filter(F.col("v").isin(found)).groupBy("v").count().filter(F.col("count") > least).collect() if found else []
    return ([None] if n - known > least else []) + sorted(r["v"] for r in counted)


#: A key is hot from this share of the rows on, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 2000
HOT_LEAST = 200


def join_skewed(spark: SparkSession, rows: DataFrame, facts: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Left join of rows to facts (one row per key, with the key's number of rows in `count`), hot keys apart.

    Facts of hot keys are at most 1 / HOT_SHARE rows, whatever the data, so they are broadcast. Rows that
    found theirs get scattered keys and pass the shuffled join without meeting in one task.
    """
    values = [c for c in facts.columns if c not in keys and c != count]
    facts = cut(spark, facts)
    total = facts.agg(F.sum(count).alias("n")).first()["n"] or 0
    least = max(HOT_LEAST, int(total * HOT_SHARE) + 1)
    hot = facts.filter(F.col(count) >= least).select(*keys, F.struct(*values).alias("_hot"))
    tagged = rows.join(F.broadcast(hot), keys, "left")
    # the first key stands in for all: scattered, it matches nothing that the others would confirm
    scattered = tagged.withColumn("_key", F.when(F.col("_hot").isNotNull(), F.xxhash64(*[F.col(c) for c in rows.columns])).otherwise(F.col(keys[0]).cast("long")))
    cold = facts.filter(F.col(count) < least).select(F.col(keys[0]).cast("long").alias("_key"), *keys[1:], F.struct(*values).alias("_cold"))
    full = scattered.join(cold, ["_key", *keys[1:]], "left").withColumn("_cold", F.when(F.col("_hot").isNull(), F.col("_cold")))
    return full.select(*[F.col(c) for c in rows.columns], *[F.coalesce(F.col(f"_hot.{v}"), F.col(f"_cold.{v}")).alias(v) for v in values])
