"""Versioned state in the stream: updates that say which version they expect, refused where another one stands.

Each key has a version, the hash of its state and the time of its last update in the state store, so what an earlier
batch decided holds in a later one and after a restart. An update counts if it expects the current version and is not older
than the last one; the answer to every update is a row, so a caller knows what became of it.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

UPDATES = "key long, seq long, expected long, state string, ts timestamp"
ANSWERS = "key long, seq long, status string, version long, sha256 string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def decide(current: tuple | None, expected: int | None, state: str | None, ts) -> tuple[str, int, str | None]:
    """Status, version and hash after an update. current: version, hash, time of the last one; None for a new key.

    A late update is older than the last one. The same state sent again with the version it had expected then is `repeated`
    and changes nothing. A missing state or version is `invalid`.
    """
    version, digest, last = current or (0, None, None)
    if state is None or expected is None or ts is None or expected < 0:
        return "invalid", version, digest
    sent = hashlib.sha256(state.encode()).hexdigest()
    if expected == version - 1 and sent == digest:
        return "repeated", version, digest
    if expected != version:
        return "conflict", version, digest
    if last is not None and ts < last:
        return "late", version, digest
    return "accepted", version + 1, sent


class Versions(StatefulProcessor):
    """Decides the updates of a key in order of seq; a micro-batch bounds how many there are at once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "version long, sha256 string, ts long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        current = tuple(self.held.get()) if self.held.exists() else None
        before = current
        for r in sorted(rows, key=lambda r: (r["seq"] is None, r["seq"] or 0)):
            status, version, digest = decide(current, r["expected"], r["state"], r["ts"])
            if status == "accepted":
                current = (version, digest, r["ts"])
            yield Row(key=r["key"], seq=r["seq"], status=status, version=version, sha256=digest)
        if current is not None and current != before:
            self.held.update(current)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which versioned state needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def versioned(updates: DataFrame) -> DataFrame:
    """ANSWERS to a stream of UPDATES. Null keys are updates of one key that nobody owns: leave them out before."""
    timed = updates.filter("key IS NOT NULL").withColumn("ts", F.unix_micros("ts"))  # numbers alone compare alike in store and input
    return timed.groupBy("key").transformWithState(statefulProcessor=Versions(), outputStructType=ANSWERS, outputMode="Append", timeMode="None")


def run(spark: SparkSession, folder: str, out: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Answers all updates that lie in a folder of Parquet files and were not answered before; returns when done."""
    stream = spark.readStream.schema(UPDATES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    with state_store(spark):
        started = versioned(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            started.awaitTermination()
        finally:
            started.stop()


def latest(answers: DataFrame) -> DataFrame:
    """key, version, sha256: what is in force."""
    return answers.filter("status = 'accepted'").groupBy("key").agg(F.max("version").alias("version"), F.max_by("sha256", "version").alias("sha256"))
