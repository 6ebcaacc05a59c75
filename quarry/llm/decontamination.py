"""Operator 8: benchmark decontamination by greedy string tiling.

Every window of `seed` words of the benchmark is indexed by its Karp-Rabin hash; a scan hashes all
windows of every whole document and joins them to that index. Pairs of a document and an item with
enough shared windows are tiled: equal windows on one diagonal form a match, the longest match of
unmarked words is marked, what marked words cut off goes back if it is still `seed` words long, and
so on until none is left. An item leaks if tiles cover at least `threshold` of its words, in
whatever order the document has them.

The index is broadcast; a benchmark of more than `block_bytes` of text is taken block by block, a scan
and a job each, so one block is in memory at a time, and only the hashes of leaking texts are kept
between scans. Documents are never shuffled for one block; for more they meet the leaks by the hash of
their text. Tiling looks for the longest common run by halving its length over Karp-Rabin hashes of
both sides, so its memory is that of a document and an item, however often their words repeat. Words are runs of ASCII letters, digits and
non-ASCII bytes, with A-Z lower-cased, so punctuation doesn't hide a leak. An item with fewer words
than `seed` must occur whole; one without words never leaks. Null and empty texts are clean; rows
with equal keys are judged each for itself; repeated items are separate items; items without an id count
and are reported with a null item_id; empty tables give
empty results or no leaks; extra columns, clashing or not, are kept where rows are passed on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import _bytes as B
from quarry.llm import _store
from quarry.session import spread


@dataclass
class Index:
    """Words of the items of a block and, for each width, sorted hashes of its windows: one row for each
    hash and item, with the number of places."""

    ids: list[int | None]
    hashes: np.ndarray
    first: np.ndarray
    by_width: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _hashed(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = B.lower(data)
    begin, end, first = B.words(data, off, B.PLAIN)
    return B.span_hash(data, begin, end), first


def build_index(ids: list[int | None], texts: list[str | None], seed: int) -> Index:
    data, off = B.flat(pa.array(texts, pa.string()))
    hashes, first = _hashed(data, off)
    sizes = np.diff(first)
    row = np.repeat(np.arange(len(ids)), sizes)
    by_width = {}
    for width in sorted({min(seed, int(n)) for n in sizes if n}):
        ok = np.flatnonzero(B.inside(first, width))
        ok = ok[(sizes[row[ok]] == width) if width < seed else (sizes[row[ok]] >= seed)]
        h, item = B.window_hash(hashes, width)[ok], row[ok]
        order = np.lexsort((item, h))
        h, item = h[order], item[order]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(item) != 0) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
        by_width[width] = (h[new], item[new], np.diff(np.append(new, len(h))))
    return Index(ids, hashes, first, by_width)


def _common(item: np.ndarray, doc: np.ndarray, free_i: np.ndarray, free_d: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of unmarked windows of `size` words in the item and in the document that have an equal one on the other side."""
    open_i = np.flatnonzero(free_i >= size)
    open_d = np.flatnonzero(free_d >= size)
    hi, hd = B.window_hash(item, size)[open_i], B.window_hash(doc, size)[open_d]
    both = np.intersect1d(hi, hd)
    at_i, at_d = np.isin(hi, both), np.isin(hd, both)
    return open_i[at_i], hi[at_i], open_d[at_d], hd[at_d]


def _run(marked: np.ndarray) -> np.ndarray:
    """How many unmarked words stand from each place on."""
    n = len(marked)
    stop = np.where(marked, np.arange(n), n)
    return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)


def tile(item: np.ndarray, doc: np.ndarray, width: int, apart: np.ndarray | None = None) -> int:
    """Words of an item covered by greedy tiling with matches of at least `width` words; both as word hashes.

    apart: places of the document that no match may cover. The longest match of unmarked words goes first,
    of equal ones the first in the item, then in the document.
    """
    mark_i, mark_d = np.zeros(len(item), bool), np.zeros(len(doc), bool)
    if apart is not None:
        mark_d[apart] = True
    most = min(len(item), len(doc))
    while True:
        free_i, free_d = _run(mark_i), _run(mark_d)
        low, high, best = width, min(most, int(free_i.max(initial=0)), int(free_d.max(initial=0))), None
        while low <= high:  # a common run of some length holds one of every smaller length
            middle = (low + high + 1) // 2 if best is not None else low
            found = _common(item, doc, free_i, free_d, middle)
            if len(found[0]):
                best, size, low = found, middle, middle + 1
            else:
                high = middle - 1
        if best is None:
            return int(mark_i.sum())
        places = best[2][np.argsort(best[3], kind="stable")]
        values = np.sort(best[3], kind="stable")
        next_: dict[int, int] = {}
        for a, h in zip(best[0].tolist(), best[1].tolist(), strict=True):
            if mark_i[a : a + size].any():
                continue
            at = next_.get(h, int(np.searchsorted(values, np.uint64(h))))
            while at < len(values) and values[at] == np.uint64(h) and mark_d[places[at] : places[at] + size].any():
                at += 1
            next_[h] = at
            if at < len(values) and values[at] == np.uint64(h):
                mark_i[a : a + size] = True
                mark_d[places[at] : places[at] + size] = True
        most = size


def _near(hit: np.ndarray, width: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that windows starting at `hit` cover, run by run with a gap between, and the places of the gaps."""
    runs = np.flatnonzero(np.diff(hit) > width) + 1
    parts, gaps, n = [], [], 0
    for a, b in zip([0, *runs.tolist()], [*runs.tolist(), len(hit)], strict=True):
        part = hashes[hit[a] : hit[b - 1] + width]
        parts += [part, np.zeros(1, np.uint64)]
        n += len(part) + 1
        gaps.append(n - 1)
    return np.concatenate(parts), np.array(gaps)


def leaks(column: pa.Array, index: Index, threshold: float) -> list[list[tuple[int | None, float]]]:
    """For each text its leaked items with the covered part of each, by item, null first."""
    data, off = B.flat(column)
    sizes = np.diff(index.first)
    out: list[list[tuple[int | None, float]]] = []
    for i, j in B.pieces(off):
        hashes, first = _hashed(data[off[i] : off[j]], off[i : j + 1] - off[i])
        found: list[list[tuple[int | None, float]]] = [[] for _ in range(j - i)]
        for width, (keys, items, places) in index.by_width.items():
            windows = B.window_hash(hashes, width)
            if not len(windows) or not len(keys):
                continue
            left = np.searchsorted(keys, windows)
            hit = np.flatnonzero((keys[np.minimum(left, len(keys) - 1)] == windows) & B.inside(first, width))
            edge = np.searchsorted(hit, first)
            for row in np.flatnonzero(np.diff(edge)).tolist():
                mine = hit[edge[row] : edge[row + 1]]
                lo = np.unique(left[mine])  # a window that repeats in the document counts once
                hi = np.searchsorted(keys, keys[lo], "right")
                n = hi - lo
                pick = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                which, back = np.unique(items[pick], return_inverse=True)
                # a window adds at most its own width to what tiles can cover
                reach = np.bincount(back, places[pick]) * width
                some = which[reach >= threshold * sizes[which]]
                if not len(some):
                    continue
                words, gaps = _near(mine, width, hashes)
                for x in some.tolist():
                    item = index.hashes[index.first[x] : index.first[x + 1]]
                    covered = tile(item, words, width, gaps) / int(sizes[x])
                    if covered >= threshold:
                        found[row].append((index.ids[x], covered))
        out += [sorted(f, key=lambda x: (x[0] is not None, x)) for f in found]
    return out


def _blocks(spark: SparkSession, bench: DataFrame, block_bytes: int, item: str, text: str) -> list[DataFrame]:
    """The benchmark in blocks of about half of `block_bytes` of text each; a block is what the driver holds at once.

    Rows are dealt by where they stand, not by what they say, so copies of one item don't meet in a block;
    the blocks are written, so each is read alone and stays what it was. An item larger than a block is one.
    """
    rows = bench.select(F.col(item).cast("long").alias("i"), F.col(text).cast("string").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    if total <= block_bytes:
        return [rows]
    path, n = _store.scratch(spark, "items"), -(-2 * total // block_bytes)
    rows.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))).repartition("block").write.partitionBy("block").parquet(path)
    dealt = spark.read.schema("i long, t string, block long").parquet(path)
    return [dealt.filter(F.col("block") == b).select("i", "t") for b in range(n)]


def _index(spark: SparkSession, part: DataFrame, seed: int):
    got = sorted(((r["i"], r["t"]) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    return spark.sparkContext.broadcast(build_index([i for i, _ in got], [t for _, t in got], seed))


ITEMS = "array<struct<item_id:bigint,coverage:double>>"
_ITEMS = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64())]))


def _as_items(found: list[list[tuple[int | None, float]]]) -> pa.Array:
    return pa.array([[{"item_id": i, "coverage": c} for i, c in f] for f in found], _ITEMS)


def _leaking_texts(spark: SparkSession, docs: DataFrame, blocks: list[DataFrame], seed: int, threshold: float, text: str) -> DataFrame:
    """h, g (128 bits of a text), items of the texts that leak, over all blocks: a job and an index at a time."""
    rows = spread(docs.select(F.col(text).cast("string").alias("t"))).select(F.xxhash64("t").alias("h"), F.xxhash64(F.lit(8), "t").alias("g"), "t").filter("t IS NOT NULL")

    def scan(index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = leaks(batch.column(2), index.value, threshold)
                full = pa.array([bool(f) for f in found], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _as_items(found)], ["h", "g", "items"]).filter(full)

        return run

    parts = []
    for part in blocks:
        index = _index(spark, part, seed)
        path = _store.scratch(spark, "leaks")
        rows.mapInArrow(_store.lean(scan(index)), f"h long, g long, items {ITEMS}").dropDuplicates(["h", "g"]).write.parquet(path)
        index.destroy()
        parts.append(path)
    found = spark.read.parquet(*parts)
    return found.groupBy("h", "g").agg(F.flatten(F.collect_list("items")).alias("items"))


def find_leaks(spark: SparkSession, docs: DataFrame, bench: DataFrame, seed: int = 5, threshold: float = 0.8, block_bytes: int = 16 << 20, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """key, contaminated, items (array<struct<item_id, coverage>>) of each row."""
    _store.ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    blocks = _blocks(spark, bench, block_bytes, item, "text")
    if len(blocks) > 1:
        found = _leaking_texts(spark, docs, blocks, seed, threshold, text)
        rows = docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text).cast("string")).alias("h"), F.xxhash64(F.lit(8), F.col(text).cast("string")).alias("g"))
        rows = rows.join(found, ["h", "g"], "left").withColumn("items", F.coalesce("items", F.array().cast(ITEMS)))
    else:
        index = _index(spark, blocks[0], seed)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), _as_items(leaks(batch.column(1), index.value, threshold))], ["k", "items"])

        rows = spread(docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))).mapInArrow(_store.lean(scan), f"k {kind}, items {ITEMS}")
    return rows.select(F.col("k").alias(key), (F.size("items") > 0).alias("contaminated"), F.array_sort("items").alias("items"))


def drop_leaks(spark: SparkSession, docs: DataFrame, bench: DataFrame, seed: int = 5, threshold: float = 0.8, block_bytes: int = 16 << 20, text: str = "text", item: str = "item_id") -> DataFrame:
    """The clean rows of docs, all columns."""
    _store.ship(spark)
    blocks = _blocks(spark, bench, block_bytes, item, "text")
    if len(blocks) > 1:
        found = _leaking_texts(spark, docs, blocks, seed, threshold, text).select(F.col("h").alias("_leak_h"), F.col("g").alias("_leak_g"))
        whole = F.col(text).cast("string")
        return docs.join(found, (F.xxhash64(whole) == F.col("_leak_h")) & (F.xxhash64(F.lit(8), whole) == F.col("_leak_g")), "left_anti")
    index, place = _index(spark, blocks[0], seed), docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not x for x in leaks(batch.column(place).cast(pa.string()), index.value, threshold)], pa.bool_()))

    return docs.mapInArrow(_store.lean(scan), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "contaminated", F.transform("items", lambda x: x["item_id"]).alias("item_ids"), F.array_max(F.transform("items", lambda x: x["coverage"])).alias("coverage"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_decontamination": query}
ORACLES: dict[str, str] = {}
