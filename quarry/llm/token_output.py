"""Operator 2: token ids as Parquet list columns that can be read selectively.

File format: a folder of Parquet files, `part` by `part` in ascending key order. A row is one
document: its key, `part`, `offset` (ids before it within its part), `n_tokens` and `ids`
(list<int>, the end id included). Ids are dictionary-encoded (delta-encoded where a dictionary
gets too large: writer version 2), in row groups and pages of the given sizes; the writer adds
column and offset indexes. So token counts and positions are read without touching ids, and
ids of one document or span of the stream without the rest.

The texts are dealt out by key range once, then encoded and written where they are. Null and
empty texts give the end id alone; rows with equal keys stand side by side, shorter text first (a key
of many rows fills several parts, by length and a hash of the text; only equal rows must share one);
null keys come first; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import _bpe, _store


def write_tokens(spark: SparkSession, docs: DataFrame, out: str, path: str, end_id: int = 0, key: str = "doc_id", text: str = "text", row_group: int = 32 << 20, page: int = 64 << 10) -> None:
    """Encode every text with the tokenizer's file at `path` and write the format above to `out`."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, done = _bpe.Coder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                rows = batch.slice(i, 1000)
                n, ids = coder.encode(rows.column(1))
                edge = np.zeros(len(n) + 1, np.int64)
                np.cumsum(n + 1, out=edge[1:])
                full = np.full(edge[-1], end_id, np.int32)
                keep = np.ones(edge[-1], bool)
                keep[edge[1:] - 1] = False
                full[keep] = ids
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(full))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(done + edge[:-1]), pa.array(n + 1), lists], ["k", "part", "offset", "n_tokens", "ids"]
                )
                done += int(edge[-1])
                del rows, ids, full, keep, lists
                _store.give_back()

    _store.ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    parts, order = _store.partitions(spark), [F.col("k"), F.octet_length("t")]
    # Ranges are drawn from the keys alone, unless keys repeat so often that one would fill a range.
    hot = _store.hot_values(rows, "k", parts)
    if hot:
        often = F.when(F.col("k").isNull(), F.lit(None in hot)).otherwise(F.col("k").isin([v for v in hot if v is not None]))
        order = [F.col("k"), F.when(often, F.octet_length("t")), F.when(often, F.xxhash64("t")), F.octet_length("t")]
    dealt = rows.repartitionByRange(parts, *(order[:3] if hot else order[:1])).sortWithinPartitions(*order, "t")
    coded = dealt.mapInArrow(_store.lean(encode), f"k {kind}, part int, offset long, n_tokens long, ids array<int>").withColumnRenamed("k", key)
    options = {"parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.block.size": row_group, "parquet.page.size": page, "parquet.dictionary.page.size": 1 << 20, "parquet.page.write-checksum.enabled": "true", "compression": "zstd"}
    with _store.small_batches(spark):
        coded.write.options(**{k: str(v) for k, v in options.items()}).mode("errorifexists").parquet(out)


def read_tokens(spark: SparkSession, out: str, key: str = "doc_id") -> DataFrame:
    """key, start (ids of all documents before it), n_tokens, ids; only selected columns are read.

    Parts are as many as the writer's tasks, so their totals are a small table.
    """
    rows = spark.read.parquet(out)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("s"))
    before = parts.select("part", F.coalesce(F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(before), "part").select(key, (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids")


def read_span(spark: SparkSession, out: str, start: int, length: int, key: str = "doc_id") -> DataFrame:
    """Documents of the id stream that touch [start, start + length), with the ids that lie in it.

    The parts' totals, a small table read from token counts alone, tell which parts the span touches and
    where; only their files, and of them only row groups with such offsets, are read for ids.
    """
    rows, end = spark.read.parquet(out), start + length
    totals = sorted((r["part"], r["s"]) for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("s")).collect())
    base, wanted, near = 0, [], F.lit(False)
    for part, total in totals:
        if base < end and base + total > start:
            wanted.append((part, base))
            near = near | ((F.col("part") == part) & (F.col("offset") < end - base) & (F.col("offset") + F.col("n_tokens") > start - base))
        base += total
    first = F.col("offset") + F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in wanted for x in pair]), F.col("part").cast("long")) if wanted else F.lit(0).cast("long")
    some = rows.filter(F.col("part").isin([p for p, _ in wanted]) & (F.col("offset") < end) & near).withColumn("start", first)
    skip = F.greatest(F.lit(start) - F.col("start"), F.lit(0)).cast("int")
    take = F.least(F.col("n_tokens"), F.lit(end) - F.col("start")).cast("int") - skip
    return some.select(key, "start", F.slice("ids", skip + 1, take).alias("ids"))


def digest(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, and crc32 of the ids as little-endian unsigned 32-bit integers."""
    import zlib

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            values = pc.list_flatten(ids).to_numpy(zero_copy_only=False).astype("<u4")
            edge = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))])
            out = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int64())], ["k", "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema[key].dataType.simpleString()
    return tokens.select(F.col(key).alias("k"), "start", "n_tokens", "ids").mapInArrow(_store.lean(crc), f"k {kind}, start long, n_tokens long, ids_crc32 long").withColumnRenamed("k", key)


def token_digests(spark: SparkSession, docs: DataFrame, path: str, out: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files, to a scratch folder unless `out` is given, read them back and digest them."""
    out = out or _store.scratch(spark, "tokens")
    write_tokens(spark, docs, out, path, key=key, text=text)
    return digest(read_tokens(spark, out, key), key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_token_output": query}
ORACLES: dict[str, str] = {}
