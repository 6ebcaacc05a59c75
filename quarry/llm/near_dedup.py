"""Operator 10: MinHash near-dedup with HyperMinHash registers.

A document's set is its distinct 5-word shingles as 64-bit Rabin-Karp hashes. Each set is reduced to
`BUCKETS` registers: a shingle falls into a bucket, the bucket's smallest remaining hash is stored as
its count of leading zeros and the `MANTISSA` bits after them. While a small set leaves buckets
empty, all its shingles are thrown again by the next hash function, so equal registers estimate the
Jaccard index for sets of any size and no bucket stays empty.

1. Documents with equal sets (128-bit fingerprint) form a class; its smallest key stands for it.
2. Registers are banded; a representative that shares a band with others is linked to the band's
   smallest one. Tasks take a smallest one with texts of those linked to it, compare registers, correct
   the estimate for accidental collisions and confirm on the full sets. Most copies are found here, at
   one text a link; a smallest one with many links is dealt over tasks of `BYTES` of text.
3. What is left are bands of three or more representatives that step 2 did not bring together. Their
   members go to tasks, component by component of these bands, and pairs across step 2's groups are
   compared, best estimate first, leaving out pairs that are connected by then. A component of more
   than `BLOCK` members or `BYTES` of text is split into blocks, one task for each pair of blocks, so a
   task's size is bounded; a pair that step 2 has connected, directly or not, costs nothing.
4. The components of the confirmed links, plus the classes, are the result.

No link is lost but by the registers: a pair at the threshold shares no band with probability below
`MISSED`, and its estimate lies below the cut, 0.15 under the threshold, with probability below 1e-8 from 80 % on
(256 registers; 1e-6 at 50 %).

The threshold sets the least size that another set than an equal one can match (6 shingles at 85, 4 at
80) and the bands: 32 of 8 registers at 85, 64 of 4 at 80, as wide as lets a pair at the threshold share
no band with probability below 0.00004. A-Z are lower-cased; words are
runs of bytes outside 09-0D and 20. With fewer than 5 words the whole sequence is the one shingle.
Null, empty and blank texts have an empty set and are linked with nothing. Repeated rows get the same
component each; a null key is linked with nothing, its component is null and it is kept; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import _bytes as B
from quarry.llm import _components, _store
from quarry.session import spread

SHINGLE = 5
BUCKETS = 256
#: Chance that a pair at the threshold shares no band.
MISSED = 0.00004
MANTISSA = 10
#: Chance that two different hashes give the same register, of about equal sets.
COLLISION = 1 / (3 * 2**MANTISSA)
BLOCK = 1024
#: Text of a task's documents, but for a single longer one.
BYTES = 8 << 20
U64 = np.uint64
_THROW = B.mix(np.arange(1, 2 * BUCKETS + 1, dtype=U64) * U64(0xA0761D6478BD642F))


def shingles(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, off = B.flat(column)
    out = []
    for i, j in B.pieces(off):
        part = B.lower(data[off[i] : off[j]])
        begin, end, first = B.words(part, off[i : j + 1] - off[i])
        hashes = B.span_hash(part, begin, end)
        windows = B.window_hash(hashes, SHINGLE)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                out.append(np.unique(windows[a : b - SHINGLE + 1]))
            else:  # other widths hash differently, so a short sequence equals only its like
                out.append(B.window_hash(hashes[a:b], b - a) ^ U64(b - a) if b > a else np.zeros(0, U64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """BUCKETS registers of 16 bits for each nonempty set: leading zeros and mantissa of a minimum."""
    n = len(sets)
    top = np.iinfo(np.uint64).max
    best = np.full((n, BUCKETS), top, U64)
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets) if n else np.zeros(0, U64)
    row = np.repeat(np.arange(n), sizes)
    for r in range(2 * BUCKETS):
        h = B.mix(every ^ _THROW[r])
        bucket = (h & U64(BUCKETS - 1)).astype(np.int64) if r < BUCKETS else np.full(len(h), r - BUCKETS)
        fresh = np.full(n * BUCKETS, top, U64)
        np.minimum.at(fresh, row * BUCKETS + bucket, h >> U64(8))
        fresh = fresh.reshape(n, BUCKETS)
        np.copyto(best, fresh, where=best == top)
        open_rows = (best == top).any(1) & (sizes > 0)
        if not open_rows.any():
            break
        keep = open_rows[row]
        if not keep.all():
            every, row = every[keep], row[keep]
    fraction, exponent = np.frexp(best.astype(np.float64))
    zeros = np.clip(56 - exponent, 0, 63).astype(np.uint16)
    return (zeros << MANTISSA) | ((fraction * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)


def least(percent: int) -> int:
    """The smallest set that can reach the threshold with a set other than its equal: n of n + 1 shingles."""
    return -(-percent // (100 - percent)) if percent < 100 else np.iinfo(np.int64).max


def band_width(percent: int) -> int:
    """Registers of a band: the widest that misses no more than `MISSED` of the pairs at the threshold."""
    return next((w for w in (8, 4, 2) if (1 - (percent / 100) ** w) ** (BUCKETS // w) < MISSED), 1)


def band_keys(regs: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit key of each band of registers."""
    bands = BUCKETS // width
    words = np.ascontiguousarray(regs).view(f"u{2 * min(width, 4)}").reshape(len(regs), bands, -1).astype(U64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * U64(B.BASE), words.shape[:2])
    for i in range(words.shape[2]):
        h = B.mix(h ^ words[:, :, i]) + U64(i)
    return h.view(np.int64)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits that depend on the set alone."""
    a = np.add.reduce(B.mix(s + U64(1)), dtype=U64) if len(s) else U64(0)
    b = np.bitwise_xor.reduce(B.mix(s ^ U64(B.BASE))) if len(s) else U64(0)
    return int(np.array(a).view(np.int64)), int(np.array(b).view(np.int64))


def _describe(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """k, h, n, bytes, f, g and, from the least size that can be similar to another, bands; from k, t, h."""
    small, width = least(percent), band_width(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = batch.slice(i, 500)
                sets = shingles(rows.column(1))
                size = np.diff(B.flat(rows.column(1))[1])
                prints = [fingerprint(s) for s in sets]
                large = [r for r, s in enumerate(sets) if len(s) >= small]
                bands: list[np.ndarray | None] = [None] * len(sets)
                for r, x in zip(large, band_keys(registers([sets[r] for r in large]), width) if large else [], strict=True):
                    bands[r] = x
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(size, pa.int64()), pa.array([f for f, _ in prints], pa.int64()), pa.array([g for _, g in prints], pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                    ["k", "h", "n", "bytes", "f", "g", "bands"],
                )

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exactly, on full sets in order."""
    small, big = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(big, small)
    both = int((big[np.minimum(at, len(big) - 1)] == small).sum())
    return 100 * both >= percent * (len(small) + len(big) - both)


def estimated(regs: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Jaccard estimates of rows of registers with another, corrected for accidental collisions."""
    return ((regs == one).mean(1) - COLLISION) / (1 - COLLISION)


def links(keys: np.ndarray, sets: list[np.ndarray], percent: int, group: np.ndarray | None = None, other: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A forest of confirmed links among the sets; sets of one `group` are connected already, and with
    `other` (0 or 1 each) only pairs across count.

    Every pair whose corrected estimate may reach the threshold is confirmed on the full sets,
    unless links found before connect it already.
    """
    regs = registers(sets)
    sizes = np.array([len(s) for s in sets])
    group = np.arange(len(sets)) if group is None else np.unique(group, return_inverse=True)[1]
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first, second, score = [], [], []
    cut = percent / 100 - 0.15
    for i in range(len(sets) - 1):
        rest = slice(i + 1, len(sets))
        near = (group[rest] != group[i]) & (100 * np.minimum(sizes[rest], sizes[i]) >= percent * np.maximum(sizes[rest], sizes[i]))
        if other is not None:
            near &= other[rest] != other[i]
        at = np.flatnonzero(near) + i + 1
        if not len(at):
            continue
        share = estimated(regs[at], regs[i])
        good = share >= cut
        first.append(np.full(int(good.sum()), i, np.int32))
        second.append(at[good].astype(np.int32))
        score.append(share[good].astype(np.float32))
    if not first:
        return []
    a, b, s = np.concatenate(first), np.concatenate(second), np.concatenate(score)
    out = []
    for x in np.argsort(-s, kind="stable").tolist():
        i, j = int(a[x]), int(b[x])
        ri, rj = root(int(group[i])), root(int(group[j]))
        if ri != rj and similar(sets[i], sets[j], percent):
            parent[ri] = rj
            out.append((int(keys[i]), int(keys[j])))
    return out


def _representatives(group: pa.Table) -> tuple[list[np.ndarray], list[int]]:
    """Sets of all rows and the rows that stand for their class: a key may stand for other texts as well."""
    sets = shingles(group.column("t").combine_chunks())
    prints = zip(group.column("f").to_pylist(), group.column("g").to_pylist(), strict=True)
    return sets, [x for x, (s, p) in enumerate(zip(sets, prints, strict=True)) if fingerprint(s) == p]


def _pairs(out: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _confirm_stars(percent: int) -> Callable[[pa.Table], pa.Table]:
    """low, k, f, g, t: links of each low's members with it; the row of the low itself has k = low."""

    def run(group: pa.Table) -> pa.Table:
        keys, lows = group.column("k").to_numpy(), group.column("low").to_numpy()
        sets, right = _representatives(group)
        order = sorted(right, key=lambda x: (lows[x], keys[x] != lows[x], keys[x]))
        out, i = [], 0
        while i < len(order):
            j = i
            while j < len(order) and lows[order[j]] == lows[order[i]]:
                j += 1
            some = order[i:j]
            heads = int((keys[some] == lows[some]).sum())  # more than one where the low's id has several texts
            regs = registers([sets[x] for x in some]) if heads else None
            found: set[int] = set()
            for head in range(heads):
                good = np.flatnonzero(estimated(regs[heads:], regs[head]) >= percent / 100 - 0.15) + heads
                found.update(x for x in good.tolist() if x not in found and similar(sets[some[x]], sets[some[head]], percent))
            out += [(int(keys[some[x]]), int(lows[some[0]])) for x in sorted(found)]
            i = j
        return _pairs(out)

    return run


def _confirm_rest(percent: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        keys, comp = group.column("k").to_numpy(), group.column("comp").to_numpy()
        block, known = group.column("block").to_numpy(), group.column("known").to_numpy()
        sets, right = _representatives(group)
        f, g = group.column("f").to_numpy(), group.column("g").to_numpy()
        chosen = {(comp[x], keys[x], f[x], g[x]): x for x in reversed(right)}  # each text of an id once
        order = sorted(chosen.values(), key=lambda x: (comp[x], keys[x]))
        out: list[tuple[int, int]] = []
        i = 0
        while i < len(order):
            j = i
            while j < len(order) and comp[order[j]] == comp[order[i]]:
                j += 1
            some = order[i:j]
            two = len({block[x] for x in some}) > 1
            out += links(keys[some], [sets[x] for x in some], percent, known[some], block[some] if two else None)
            i = j
        return _pairs(out)

    return run


def _star_links(stars: DataFrame, reps: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The stars (a, low) that hold on the full sets; a low's members are dealt over tasks by their bytes."""
    load = stars.groupBy("low").agg(F.sum("bytes").alias("load"))
    bins = max(1, int((stars.agg(F.sum("bytes")).first()[0] or 0) // (BYTES // 4)))
    parts = F.ceil(F.col("load") / BYTES).cast("int")
    place = F.when(parts > 1, F.col("low")).otherwise(F.pmod(F.xxhash64("low"), F.lit(bins)))
    many = load.select("low", parts.alias("parts"), place.alias("bin"), (parts > 1).alias("own"))
    members = stars.join(many, "low").select("low", F.col("a").alias("k"), "f", "g", "bin", "own", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    heads = many.join(reps, F.col("low") == F.col("rep")).select("low", F.col("low").alias("k"), "f", "g", "bin", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    texts = members.unionByName(heads).join(rows, "k").select("bin", "own", "part", "low", "k", "f", "g", "t")
    return texts.groupBy("bin", "own", "part").applyInArrow(_confirm_stars(percent), "a long, b long")


def _rest_links(spark: SparkSession, banded: DataFrame, edges: DataFrame, reps: DataFrame, rows: DataFrame, percent: int) -> DataFrame | None:
    """Links that the confirmed stars (a, b) leave to be found, in bands of three or more; None if there are no such bands.

    A representative's group is its smallest confirmed star's. Two groups may be one after all, that costs comparisons only.
    """
    groups = edges.groupBy("a").agg(F.min("b").alias("known"))
    grouped = banded.join(groups.withColumnRenamed("a", "rep"), "rep", "left").withColumn("known", F.coalesce("known", "rep"))
    open_ = grouped.groupBy("key").agg(F.min("known").alias("x"), F.max("known").alias("y"), F.count("*").alias("n"), F.min("rep").alias("least")).filter("x <> y AND n > 2").select("key", "least")
    left = _store.cut(spark, grouped.join(open_, "key").select("rep", "known", "least").distinct())
    if left.isEmpty():
        return None
    comps = _components.components(spark, left.filter("rep > least").select(F.col("rep").alias("a"), F.col("least").alias("b")))
    members = left.select(F.col("rep").alias("node"), "known").distinct().join(comps.withColumnRenamed("root", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    members = _store.cut(spark, members.join(reps.withColumnRenamed("rep", "node"), "node"))
    sizes = members.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("bytes") / BYTES)).cast("int").alias("blocks"))
    # a component's blocks: every member meets every block once, in the pair's task
    placed = members.join(sizes, "comp").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    bins = max(1, int(members.agg(F.sum("bytes")).first()[0] // (BYTES // 4)))
    alone = F.col("blocks") == 1
    meets = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = meets.select(
        F.col("node").alias("k"), "comp", "known", "f", "g", F.when(alone, F.pmod(F.xxhash64("comp"), F.lit(bins))).otherwise(F.col("comp")).alias("bin"),
        F.when(alone, -1).otherwise(F.least("own", "with")).alias("x"), F.when(alone, -1).otherwise(F.greatest("own", "with")).alias("y"), F.when(F.col("own") <= F.col("with"), 0).otherwise(1).alias("block"),
    )
    texts = tasks.join(rows, "k").select("bin", "x", "y", "block", "comp", "known", "k", "f", "g", "t")
    return texts.groupBy("bin", "x", "y").applyInArrow(_confirm_rest(percent), "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text", mark: bool = False) -> DataFrame:
    """key, n_shingles, component_id, kept of each row; links need 100 * intersection >= percent * union.

    With mark also `text_hash`, the 64-bit hash of the row's text (null for null).
    """
    _store.ship(spark)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t"))
    hashed = rows.withColumn("h", F.when(F.col("t").isNotNull(), F.xxhash64("t")))
    with _store.small_batches(spark):
        described = _store.cut(spark, spread(hashed).mapInArrow(_store.lean(_describe(percent)), "k long, h long, n long, bytes long, f long, g long, bands array<long>"))
    full = described.filter("n > 0 AND k IS NOT NULL")
    classes = full.groupBy("n", "f", "g").agg(F.min("k").alias("rep"), F.count("*").alias("copies"), F.min_by(F.struct("bands", "bytes"), "k").alias("x"))
    classes = _store.cut(spark, classes.select("n", "f", "g", "rep", "copies", "x.bands", "x.bytes"))
    reps = classes.filter("bands IS NOT NULL").select("rep", "f", "g", "bytes")
    banded = classes.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low < high").select("key", "low")
    banded = _store.cut(spark, banded.join(shared, "key"))
    stars = banded.filter("rep > low").select("rep", "low").distinct().join(reps, "rep").withColumnRenamed("rep", "a")
    stars = _store.cut(spark, stars)
    moved = classes.withColumn("root", F.lit(None).cast("long"))
    if not stars.isEmpty():
        edges = _store.cut(spark, _star_links(stars, reps, rows, percent))
        rest = _rest_links(spark, banded.select("rep", "key"), edges, reps, rows, percent)
        roots = _components.components(spark, edges if rest is None else edges.unionByName(rest))
        moved = classes.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    # what differs from the row's own key: copies of a class, and classes linked to a smaller one
    moved = moved.filter("copies > 1 OR root IS NOT NULL").select("n", "f", "g", "copies", F.coalesce("root", "rep").alias("root"))
    out = _store.join_skewed(spark, described.select("k", "h", "n", "f", "g"), moved, ["n", "f", "g"], "copies").withColumnRenamed("root", "found")
    component = F.when(F.col("k").isNotNull(), F.coalesce("found", "k"))
    marks = [F.col("h").alias("text_hash")] if mark else []
    return out.select(F.col("k").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), (component.eqNullSafe(F.col("k"))).alias("kept"), *marks)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_near_dedup": query}
ORACLES: dict[str, str] = {}
