"""Session and table access shared by every query."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def get_session(app: str = "quarry", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table; Parquet carries the schema, so nothing is inferred from values."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES) -> None:
    """Expose tables as temporary views for `spark.sql`."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a local one where it is unset and all is one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = known.get() if known.isDefined() else None
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that they share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The same rows from checkpoint files: what follows more than once is computed once, and lost executors don't matter."""
    shared_dir(spark)
    return df.checkpoint(eager=True)


def stamp(spark: SparkSession, path: str) -> str:
    """What tells one state of a table's files from another: their names, sizes and times."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, files = [], fs.listFiles(root, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr(sorted(found)).encode()).hexdigest()


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores if the scan has fewer partitions than there are; a larger scan stays as it is.

    For Python stages over a few files: the check is on the plan alone, and at scale nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Give executors this package's code, once a session; they may have no copy of it."""
    context = spark.sparkContext
    if getattr(context, "_quarry_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="quarry-code-"), "quarry_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "quarry")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(target)
    context._quarry_shipped = True
