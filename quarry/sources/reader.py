"""Files as a Spark source: spark.read.format("quarry").load(folder), a partition for each group of files.

Columns that are not asked for are not made: name them in the option `columns` (a select alone cannot tell a Python source).
A filter on `extension` or `path` keeps files from being read at all. Options: `groupBytes` (files that one task reads,
16 MB by default), `columns`. Files are read through Arrow's file systems, which know local, S3, GCS, HDFS and Azure addresses;
for others `files.read_files` goes through Spark's own readers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from quarry.sources import files

SCHEMA = f"extension string, {files.BLOCKS}"
GROUP_BYTES = 16 << 20
_KINDS = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


@dataclass
class Group(InputPartition):
    """Files of one task, (path, size) each."""

    files: list[tuple[str, int]]


def columns_of(options: dict) -> list[tuple[str, str]]:
    known = [tuple(f.split(" ")) for f in SCHEMA.split(", ")]
    asked = [c.strip() for c in options.get("columns", "").split(",") if c.strip()]
    if unknown := set(asked) - {n for n, _ in known}:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return [(n, k) for n, k in known if not asked or n in asked]


def grouped(found: list[tuple[str, int]], most: int) -> list[Group]:
    """Files in order of path, as many a group as stay within its bytes; a larger file is a group of its own."""
    out: list[Group] = []
    size = most + 1
    for path, n in sorted(found):
        if size + n > most:
            out.append(Group([]))
            size = 0
        out[-1].files.append((path, n))
        size += n
    return out


class Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.most = options["path"], int(options.get("groupbytes", options.get("groupBytes", GROUP_BYTES)))
        self.columns = columns_of(options)
        self.kept: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps equality and lists on a file's path and extension for itself; Spark applies the others."""
        for f in filters:
            name = ".".join(f.attribute) if isinstance(f, EqualTo | In) else ""
            if name in ("path", "extension"):
                values = {str(v) for v in (f.value if isinstance(f, In) else (f.value,)) if v is not None}
                self.kept[name] = self.kept[name] & values if name in self.kept else values
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        about = {"path": path, "extension": path.rpartition(".")[2].lower()}
        return all(about[name] in values for name, values in self.kept.items())

    def partitions(self) -> list[Group]:
        system, root = fs.FileSystem.from_uri(self.root)
        about = system.get_file_info(root)
        listed = [about] if about.is_file else system.get_file_info(fs.FileSelector(root, recursive=True))
        # as in other sources, names that begin with a dot or an underscore are no data
        return grouped([(f.path, f.size) for f in listed if f.is_file and f.base_name[0] not in "._" and self._wanted(f.path)], self.most)

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.root)
        schema = pa.schema([(n, _KINDS[k]) for n, k in self.columns])
        for path, size in partition.files:
            extension = path.rpartition(".")[2].lower()
            try:
                if size > files.MAX_BYTES:
                    raise files.FileError("limit")
                with system.open_input_stream(path) as source:
                    found = files.parse(extension, source.read())
            except files.FileError as e:
                found = [{"kind": "error", "error": str(e)}]
            rows = [{"path": path, "extension": extension, "position": n} | b for n, b in enumerate(found, 1)]
            for at in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in schema.names} for r in rows[at : at + 10_000]], schema)


class QuarryFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quarry"

    def schema(self) -> str:
        return ", ".join(f"{n} {k}" for n, k in columns_of(self.options))

    def reader(self, schema: StructType) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(QuarryFiles)
