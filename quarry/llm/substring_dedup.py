"""Operator 1: substring dedup by Rabin-Karp hashes of every window of `width` words.

Documents are dealt into batches of consecutive keys, once. Each batch hashes all its windows,
drops repeats within itself, and sends the sorted hashes to buckets as packed differences (about
six bytes a window). A bucket counts hashes over all batches and answers each batch with one bit
per hash: an earlier batch has it too. Back with its texts, a batch merges the windows that start
earlier elsewhere or in itself into maximal intervals and removes their words. However often a
passage repeats, a batch sends its hash once, so no task gets more than (batches x its share).

Words are maximal runs of bytes outside 09-0D and 20. "Earlier" goes by key, then place; rows
with equal keys count as separate documents in order of text; null keys come first. Null, empty and
short texts have no windows and lose nothing. Texts are compared by 64-bit hashes: among n
distinct windows a false repeat has probability about n**2 / 2**65 (below 0.001 at 10**8).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import _bytes as B
from quarry.llm import _store


def key_ranges(docs: DataFrame, key: str, parts: int) -> np.ndarray:
    """At most parts - 1 bounds that cut the keys into ranges of about equal numbers of rows."""
    if parts < 2:
        return np.zeros(0, np.int64)
    found = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()["q"]
    return np.unique(np.array(found or [], np.int64))


def with_batch(docs: DataFrame, key: str, bounds: np.ndarray) -> DataFrame:
    """Adds the number of each row's key range; null keys go to the first."""

    def place(keys: pa.Array) -> pa.Array:
        k = keys.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(bounds, k, "right").astype(np.int32))

    # Evaluated on the key alone; the texts stay in the JVM.
    return docs.withColumn("batch", F.arrow_udf(place, "int")(F.col(key)))


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by([("k", "ascending"), ("t", "ascending")]) if table.num_rows > 1 else table


def _windows(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first word of each window of a sorted batch, and the first word of each row (n + 1)."""
    data, off = B.flat(table.column("t"))
    hashes, starts, firsts, seen = [], [], [np.zeros(1, np.int64)], 0
    for i, j in B.pieces(off):
        part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        begin, end, first = B.words(part, o)
        h = B.window_hash(B.span_hash(part, begin, end), width)
        ok = np.flatnonzero(B.inside(first, width))
        hashes.append(h[ok])
        starts.append(ok + seen)
        firsts.append(first[1:] + seen)
        seen += int(first[-1])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *hashes]), np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate(firsts), data


def _edges(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted hashes; a bucket is a range of values."""
    step = (1 << 64) // buckets
    cuts = np.array([step * i for i in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, cuts), [len(hashes)]])


def pack(hashes: np.ndarray) -> bytes:
    """Sorted distinct hashes as the first one and differences of as few bytes as the largest needs."""
    gaps = np.diff(hashes)
    size = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([size]) + hashes[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    size = blob[0]
    gaps = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, size)
    wide = np.zeros((len(gaps) + 1, 8), np.uint8)
    wide[0] = np.frombuffer(blob, np.uint8, 8, 1)
    wide[1:, :size] = gaps
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def remove_repeats(spark: SparkSession, docs: DataFrame, width: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, removed (intervals of word places, end excluded), kept (text), kept_sha256."""
    _store.ship(spark)
    parts = _store.partitions(spark)
    buckets = parts
    bounds = key_ranges(docs, key, 2 * parts)
    rows = with_batch(docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")), "k", bounds).repartition(parts, "batch")

    def send(group: pa.Table) -> pa.Table:
        batch = group.column("batch")[0].as_py()
        hashes = np.unique(_windows(group, width)[0])
        edge = _edges(hashes, buckets)
        full = np.flatnonzero(np.diff(edge))
        return pa.table({"bucket": pa.array(full, pa.int32()), "batch": pa.array([batch] * len(full), pa.int32()), "blob": pa.array([pack(hashes[edge[b] : edge[b + 1]]) for b in full], pa.binary())})

    def count(group: pa.Table) -> pa.Table:
        group = group.sort_by("batch")
        lists = [unpack(x.as_py()) for x in group.column("blob")]
        every = np.concatenate(lists)
        order = np.argsort(every, kind="stable")  # equal hashes stay in order of batch
        ordered = every[order]
        later = np.zeros(len(every), bool)
        later[order[1:]] = ordered[1:] == ordered[:-1]
        out, at = ([], [], []), 0
        for b, x in zip(group.column("batch").to_pylist(), lists, strict=True):
            bits = later[at : at + len(x)]
            at += len(x)
            if bits.any():
                for to, v in zip(out, (b, group.column("bucket")[0].as_py(), zlib.compress(np.packbits(bits).tobytes(), 1)), strict=True):
                    to.append(v)
        return pa.table({"batch": pa.array(out[0], pa.int32()), "bucket": pa.array(out[1], pa.int32()), "bits": pa.array(out[2], pa.binary())})

    def finish(group: pa.Table, answers: pa.Table) -> pa.Table:
        group = _sorted(group)
        hashes, start, first, data = _windows(group, width)
        distinct, once, back = np.unique(hashes, return_index=True, return_inverse=True)
        later = np.zeros(len(distinct), bool)
        edge = _edges(distinct, buckets)
        for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
            n = edge[b + 1] - edge[b]
            later[edge[b] : edge[b + 1]] = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), count=n)
        drop = later[back]
        drop[np.setdiff1d(np.arange(len(hashes)), once, assume_unique=True)] = True
        total = int(first[-1])
        delta = np.zeros(total + 1, np.int64)
        np.add.at(delta, start[drop], 1)
        np.add.at(delta, start[drop] + width, -1)
        gone = np.cumsum(delta[:-1]) > 0
        flips = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        opens, shuts = np.flatnonzero(flips == 1), np.flatnonzero(flips == -1)
        texts = group.column("t")
        n_words, n_removed, removed, kept, digest = [], [], [], [], []
        for i in range(group.num_rows):
            a, b = int(first[i]), int(first[i + 1])
            value = texts[i].as_py()
            found = (value or "").encode().split()
            lost = int(gone[a:b].sum())
            spans = []
            if lost:
                mask = gone[a:b].tolist()
                found = [w for w, m in zip(found, mask, strict=True) if not m]
                # an interval may run on into the next row; it ends with this one
                for j in range(int(np.searchsorted(shuts, a, "right")), len(opens)):
                    if opens[j] >= b:
                        break
                    spans.append({"start": max(int(opens[j]), a) - a, "end": min(int(shuts[j]), b) - a})
            whole = b" ".join(found)
            n_words.append(b - a)
            n_removed.append(lost)
            removed.append(spans)
            kept.append(whole.decode())
            digest.append(hashlib.sha256(whole).hexdigest())
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"k": group.column("k"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "removed": pa.array(removed, span), "kept": pa.array(kept, pa.string()), "kept_sha256": pa.array(digest, pa.string())})

    sent = rows.groupBy("batch").applyInArrow(send, "bucket int, batch int, blob binary")
    answers = sent.groupBy("bucket").applyInArrow(count, "batch int, bucket int, bits binary")
    done = rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(finish, "k long, n_words long, n_removed long, removed array<struct<start:bigint,end:bigint>>, kept string, kept_sha256 string")
    return done.withColumnRenamed("k", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remove_repeats(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_substring_dedup": query}
ORACLES: dict[str, str] = {}
