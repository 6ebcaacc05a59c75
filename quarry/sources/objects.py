"""Objects and generations: content-addressed artifacts, and tables that are replaced as a whole."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

KEY = re.compile(r"^(?!.*(?:^|/)\.{1,2}(?:/|$))[a-z0-9][a-z0-9._-]*(?:/[a-z0-9][a-z0-9._-]*)*$")


def valid_key(key: str) -> bool:
    """Relative, lower case, without empty, dot or parent parts, at most 512 characters."""
    return len(key) <= 512 and KEY.match(key) is not None


class ObjectStore:
    """Bytes under validated keys of any file system that Hadoop reaches; publishing is atomic by rename."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm

    def _path(self, key: str):
        if not valid_key(key):
            raise ValueError("invalid object key")
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def put(self, key: str, content: bytes) -> str:
        """Writes a new object and returns its SHA-256; an existing key is an error."""
        fs, path = self._path(key)
        if fs.exists(path):
            raise FileExistsError(key)
        part = path.suffix(".part")
        out = fs.create(part, True)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        if not fs.rename(part, path):
            raise FileExistsError(key)
        return hashlib.sha256(content).hexdigest()

    def open(self, key: str) -> bytes:
        _, path = self._path(key)
        return bytes(self.spark.read.format("binaryFile").load(path.toString()).select("content").first()[0])

    def exists(self, key: str) -> bool:
        fs, path = self._path(key)
        return fs.exists(path)

    def delete(self, key: str) -> bool:
        fs, path = self._path(key)
        return fs.delete(path, False)


class Generations:
    """A table kept as numbered folders and a pointer; readers see the old or the new one, never a mixture."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> int:
        root = self.jvm.org.apache.hadoop.fs.Path(self.root)
        if not self.fs.exists(root):
            return 0
        done = [s.getPath().getName() for s in self.fs.listStatus(root)]
        return max((int(n[7:]) for n in done if re.fullmatch(r"active-\d+", n)), default=0)

    def read(self) -> DataFrame | None:
        n = self.current()
        return self.spark.read.parquet(f"{self.root}/generation-{n}") if n else None

    def publish(self, rows: DataFrame, expected: int) -> int:
        """Writes the next generation if `expected` is still the current one, then points to it."""
        if self.current() != expected:
            raise RuntimeError("another generation was published")
        rows.write.mode("overwrite").parquet(f"{self.root}/generation-{expected + 1}")
        mark = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/active-{expected + 1}")
        if not self.fs.createNewFile(mark):
            raise RuntimeError("another generation was published")
        return expected + 1


def write_artifacts(rows: DataFrame, out: str) -> None:
    """Artifacts (identity, body as JSON text) as JSON lines in order of identity."""
    rows.repartitionByRange("identity").sortWithinPartitions("identity").write.mode("errorifexists").option("ignoreNullFields", "false").json(out)


def read_artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
