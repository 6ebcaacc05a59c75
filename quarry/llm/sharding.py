"""Operator 11: shards of near-equal bytes from indivisible groups, by Karmarkar-Karp differencing.

Rows with equal texts are one group and stay in one shard. A partial partition is a tuple of `shards` sums; at first each
group is one of its own. The two with the largest spread are combined oppositely ordered, the largest sum of
one with the smallest of the other, until one is left (`difference`).

That is done in levels, so nothing sees all groups. Groups from `1 / (shards * 256)` of all bytes on (at most so many by
definition) and `fine` others, chosen by hash, go to the last level as they are: the first since they
leave room for little else in their shard, the others as small change. The rest meet in chunks of about 4,096, each
differenced into 64 bundles, and bundles again into bundles, until at most `top` are left. Large groups, fine ones and bundles are
then differenced into shards on the driver, which holds `top + fine + shards * 256` pairs of numbers at most, whatever the table.

A slot is a row's place in its shard in order of key, null keys first: rows are ordered by (shard, key, hash) in range partitions,
counted a partition, and numbered from the counts, so a shard or key of any size is many tasks' work.

A row's size is its UTF-8 bytes and `overhead`. A null text counts as empty and is in the group of empty texts. A group larger than
a shard's share stays whole: its shard then is that group alone, or nearly. Rows with equal keys are rows of their own. An empty
table gives no rows; other columns are ignored, or kept by `write_shards`, whatever their names. Texts are compared by 128
bits of hash and their length. Reruns agree.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import _store

CHUNK, BUNDLES = 4096, 64
#: Groups of at least this part of a shard's share are large.
PARTS = 256


def difference(sizes: list[int], shards: int) -> list[int]:
    """The bin, from 0, of each size: Karmarkar-Karp differencing over tuples of `shards` sums."""
    n = len(sizes)
    # a partial partition: (sum, node) pairs, largest first, without empty bins; a node is a size or a pair of nodes
    held: list[list[tuple[int, int]]] = [[(s, i)] for i, s in enumerate(sizes)]
    pairs: list[tuple[int, int]] = []
    heap = [(-s, i) for i, s in enumerate(sizes)] if shards > 1 else [(0, i) for i in range(n)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i = heapq.heappop(heap)
        _, j = heapq.heappop(heap)
        a, b = held[i], held[j]
        both = len(a) + len(b) - shards  # bins that are full on both sides
        if both <= 0:
            out = a + b
        else:
            alone = len(a) - both
            out = a[:alone]
            for (x, p), (y, q) in zip(a[alone:], reversed(b[len(b) - both :]), strict=True):
                out.append((x + y, n + len(pairs)))
                pairs.append((p, q))
            out += b[: len(b) - both]
        out.sort(reverse=True)
        held[i], held[j] = out, []
        heapq.heappush(heap, ((out[-1][0] if len(out) == shards else 0) - out[0][0], i))
    bins = [0] * n
    for b, (_, root) in enumerate(held[heap[0][1]] if heap else []):
        stack = [root]
        while stack:
            node = stack.pop()
            if node < n:
                bins[node] = b
            else:
                stack += pairs[node - n]
    return bins


def _bundled(chunks: pd.DataFrame) -> pd.DataFrame:
    chunks = chunks.sort_values(["size", "h", "g"], ignore_index=True)
    return chunks[["h", "g", "size", "chunk"]].assign(bundle=pd.Series(difference(chunks["size"].tolist(), BUNDLES), dtype="int32"))


def _bundle(items: DataFrame, count: int) -> DataFrame:
    """h, g, size, chunk, bundle: items (h, g, size) in chunks, each differenced into bundles."""
    chunk = F.pmod(F.xxhash64("h", "g"), F.lit(-(-count // CHUNK)))
    return items.select("h", "g", "size", chunk.alias("chunk")).groupBy("chunk").applyInPandas(_bundled, "h long, g long, size long, chunk long, bundle int")


def place_groups(spark: SparkSession, groups: DataFrame, shards: int, top: int = 8192, fine: int = 16384) -> DataFrame:
    """h, g, shard from h, g, size of each group."""
    groups = groups.select("h", "g", "size")
    known = groups.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    count, total = known["n"], known["bytes"] or 0
    unit = 1 << 30
    change = F.pmod(F.xxhash64(F.lit(11), "h", "g"), F.lit(unit)) < int(unit * min(1.0, fine / max(1, count)))
    as_is = change | (F.col("size") * (shards * PARTS) >= total)
    last = [(r["h"], r["g"], r["size"]) for r in groups.filter(as_is).collect()]  # about `fine`, and at most shards * PARTS large ones
    rest, levels = groups.filter(~as_is), []
    left = rest.count()
    while left > (0 if not levels else max(top, BUNDLES)):
        made = _store.cut(spark, _bundle(rest, left))
        levels.append(made)
        rest = made.groupBy(F.col("chunk").alias("h"), F.col("bundle").cast("long").alias("g")).agg(F.sum("size").alias("size"))
        left = rest.count()
    bundles = [(r["h"], r["g"], r["size"]) for r in rest.collect()] if levels else []  # at most `top`, or one level's
    everything = sorted([(s, 1, h, g) for h, g, s in last] + [(s, 2, h, g) for h, g, s in bundles])
    bins = difference([s for s, *_ in everything], shards)
    placed = {kind: spark.createDataFrame([(h, g, b) for (_, k, h, g), b in zip(everything, bins, strict=True) if k == kind], "h long, g long, shard int") for kind in (1, 2)}
    found = placed[2]
    for made in reversed(levels):
        found = made.join(found.select(F.col("h").alias("chunk"), F.col("g").cast("int").alias("bundle"), "shard"), ["chunk", "bundle"]).select("h", "g", "shard")
    return placed[1].unionByName(found)


def shard(spark: SparkSession, docs: DataFrame, shards: int = 40, overhead: int = 16, top: int = 8192, fine: int = 16384, key: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """key, size, text_crc32, shard, slot of each row, and the columns of docs named in `more`, in a struct `row`."""
    _store.ship(spark)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kept = [F.struct(*[F.col(c) for c in more]).alias("row")] if more else []
    rows = docs.select(F.col(key).alias("k"), (F.octet_length(whole) + overhead).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.xxhash64(whole).alias("h"), F.xxhash64(F.lit(14), whole, F.octet_length(whole)).alias("g"), *kept)
    rows = _store.cut(spark, rows)  # the texts are read once; from here on a row is a few numbers
    groups = _store.cut(spark, rows.groupBy("h", "g").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    placed = place_groups(spark, groups, shards, top, fine).join(groups.select("h", "g", "n"), ["h", "g"])
    rows = _store.cut(spark, _store.join_skewed(spark, rows, placed, ["h", "g"], "n"))
    # a range may end within a shard, a key or equal rows, so none of them is one task's
    order = [F.col("shard"), F.asc_nulls_first("k"), F.col("h")]
    place = F.monotonically_increasing_id()
    ordered = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie").sortWithinPartitions(*order)
    ordered = _store.cut(spark, ordered.withColumns({"part": F.spark_partition_id(), "at": place.bitwiseAND(F.lit((1 << 33) - 1))}).drop("tie", "h", "g"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    per = ordered.groupBy("part", "shard").agg(F.count("*").alias("n"))
    # a row for each partition and shard in it: at most partitions + shards, broadcast below
    per = per.withColumn("ahead", F.coalesce(F.sum("n").over(before.orderBy("part", "shard")), F.lit(0)) - F.coalesce(F.sum("n").over(before.partitionBy("part").orderBy("shard")), F.lit(0)))
    begins = per.groupBy("shard").agg(F.sum("n").alias("n")).withColumn("begin", F.coalesce(F.sum("n").over(before.orderBy("shard")), F.lit(0))).select("shard", "begin")
    base = per.join(F.broadcast(begins), "shard").select("part", "shard", (F.col("ahead") - F.col("begin")).alias("base"))
    out = ordered.join(F.broadcast(base), ["part", "shard"])
    return out.select(F.col("k").alias(key), "size", "text_crc32", "shard", (F.col("base") + F.col("at")).alias("slot"), *(["row"] if more else []))


def write_shards(spark: SparkSession, docs: DataFrame, path: str, shards: int = 40, overhead: int = 16, key: str = "doc_id", text: str = "text") -> None:
    """The rows of docs, all columns and `slot`, in folders shard=0 and on, in order of slot."""
    placed = shard(spark, docs, shards, overhead, 8192, 16384, key, text, *docs.columns)
    rows = placed.select("row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows.repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_sharding": query}
ORACLES: dict[str, str] = {}
