"""Operator 12: how filters act together, over every order in which they could run.

Five filters look at a whole text (null counts as empty; words are maximal runs without 09-0D and 20): A too
few words, B too few distinct words, C too many capitals, D a symbol, E the same text as a row with a smaller
key. What A to D need is counted in one scan of Arrow buffers: byte classes by table lookup, prefix sums read
at the rows' edges, and distinct words from each document's sorted word hashes. Equal neighbours among them are
compared byte by byte, so a collision costs time and never a count.

A document then is a mask of five bits. Equal rows are added up before anything is joined; labels join by key;
copies meet as one row per text, part, mask and label, so a text that a third of the rows have is a few rows.
Per part 32 masks are left, from which each filter's counts after each set of earlier filters follow, and from those
all orders and steps.

Null keys have no label, never fail E and make nobody fail it. Rows with equal keys are documents of their own;
a key is good or toxic if any of its label rows says so. A null part counts as the empty string. Empty tables give no
rows; columns other than those named are ignored, whatever their names. Texts are compared by 128 bits of hash
and their length (below 1e-15 for a false copy among 1e11 texts).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import _bytes as B
from quarry.llm import _store
from quarry.session import spread

FILTERS = "ABCDE"


@dataclass(frozen=True)
class Limits:
    """A fails below `words` words, B below `distinct` % distinct words, C above `capitals` % capitals, D with any of `symbols`."""

    words: int = 100
    distinct: int = 80
    capitals: int = 10
    symbols: str = "#$%&*|"


def _per_row(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many bytes of each row are marked: a prefix sum read at the rows' edges."""
    prefix = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=prefix[1:])
    return np.diff(prefix[off])


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the span of n bytes at a is the one of m bytes at b, for each pair, eight bytes a step."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.arange(8)
    out = n == m
    left, at = np.flatnonzero(out), 0
    while len(left):
        rest = np.minimum(n[left] - at, 8)
        differ = padded[(a[left] + at)[:, None] + eight] != padded[(b[left] + at)[:, None] + eight]
        bad = (differ & (eight < rest[:, None])).any(axis=1)
        out[left[bad]] = False
        left, at = left[~bad & (n[left] - at > 8)], at + 8
    return out


def distinct_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """The number of distinct words of each row: its sorted hashes, equal neighbours verified."""
    sizes = np.diff(first)
    if not len(start):
        return sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    bits = np.uint64(max(1, len(sizes).bit_length()))
    key = (row.astype(np.uint64) << (np.uint64(64) - bits)) | ((B.span_hash(data, start, end) if hashes is None else hashes) >> bits)
    order = np.argsort(key)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    a, b = order[same], order[same + 1]
    length = end - start
    good = _equal(data, start[a], start[b], length[a], length[b])
    out = sizes - np.bincount(row[b], minlength=len(sizes))
    for r in np.unique(row[b[~good]]).tolist():  # a collision: this row by its words
        out[r] = len({data[s:e].tobytes() for s, e in zip(start[first[r] : first[r + 1]].tolist(), end[first[r] : first[r + 1]].tolist(), strict=True)})
    return out


COUNTS = ("n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols")


def scan(column: pa.Array, symbols: str) -> list[np.ndarray]:
    """COUNTS of each text."""
    data, off = B.flat(column)
    marked = np.zeros(256, bool)
    marked[list(symbols.encode("ascii"))] = True
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in COUNTS]
    for i, j in B.pieces(off):
        d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        start, end, first = B.words(d, o)
        found = (np.diff(first), distinct_words(d, start, end, first), _per_row((d >= 65) & (d <= 90), o), _per_row((d & 0xC0) != 0x80, o), _per_row(marked[d], o))
        for part, x in zip(parts, found, strict=True):
            part.append(x.astype(np.int64))
    return [np.concatenate(p) for p in parts]


def measures(docs: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """k, part, h, g, n_bytes (a text's identity), COUNTS and mask (bits 0 to 3 for A to D) of each row."""
    _store.ship(docs.sparkSession)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), whole.alias("t"))
    rows = spread(rows).select("k", "part", F.xxhash64("t").alias("h"), F.xxhash64(F.lit(12), "t").alias("g"), F.octet_length("t").alias("n_bytes"), "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [pa.array(c) for c in scan(batch.column(5), limits.symbols)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *counts], ["k", "part", "h", "g", "n_bytes", *COUNTS])

    got = rows.mapInArrow(_store.lean(count), "k long, part string, h long, g long, n_bytes int, " + ", ".join(f"{c} long" for c in COUNTS))
    fails = (
        F.col("n_words") < limits.words,
        F.col("n_distinct") * 100 < F.col("n_words") * limits.distinct,
        F.col("n_capitals") * 100 > F.col("n_chars") * limits.capitals,
        F.col("n_symbols") > 0,
    )
    return got.withColumn("mask", sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)))


def mask_counts(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, mask (five bits), n, n_good, n_toxic: what all documents come down to."""
    rows = measures(docs, limits, key, text, part).groupBy("k", "part", "h", "g", "n_bytes", "mask").agg(F.count("*").alias("c"))
    known = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("join_key")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    # null keys would meet in one task: they get keys of their own, apart from the labels' by `has_key`
    rows = rows.withColumns({"has_key": F.col("k").isNotNull(), "join_key": F.coalesce("k", F.xxhash64("h", "part"))})
    rows = rows.join(known.withColumn("has_key", F.lit(True)), ["join_key", "has_key"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    text_id = ["h", "g", "n_bytes"]
    met = rows.groupBy(*text_id, "part", "mask", "good", "toxic").agg(
        F.sum("c").alias("n"),
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("c"))), F.lit(0)).alias("no_key"),
        F.min(F.when(F.col("k").isNotNull(), F.struct("k", "c"))).alias("least"),
    )
    met = met.withColumn("original", F.min("least.k").over(Window.partitionBy(*text_id)))
    copies = F.col("n") - F.col("no_key") - F.when(F.col("least.k") == F.col("original"), F.col("least.c")).otherwise(0)
    both = F.explode(F.array(F.struct((F.col("mask") + 16).alias("mask"), "copies"), F.struct("mask", (F.col("n") - F.col("copies")).alias("copies")))).alias("x")
    split = met.withColumn("copies", copies).select("part", "good", "toxic", both).select("part", "good", "toxic", "x.mask", F.col("x.copies").alias("n")).filter("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(f"n_{c}") for c in ("good", "toxic")])


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: for each part all orders and steps."""
    counts = mask_counts(docs, labels, limits, key, text, part)
    n = len(FILTERS)
    cases = [(f, s) for f in range(n) for s in range(1 << n) if not s >> f & 1]
    each = counts.withColumn("case", F.explode(F.array(*[F.struct(F.lit(1 << f).alias("own"), F.lit(s).alias("before")) for f, s in cases]))).select("*", "case.own", "case.before")
    fails, passed = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) == 0

    def total(when, column: str = "n"):
        return F.sum(F.when(when, F.col(column)).otherwise(0))

    by_case = each.groupBy("part", "own", "before").agg(
        total(passed & ~fails).alias("kept"),
        total(passed & fails).alias("removed"),
        total(~passed & fails).alias("redundant"),
        total(F.col("mask") == F.col("own")).alias("unique_fails"),
        total(passed & fails, "n_good").alias("good_lost"),
        total(passed & fails, "n_toxic").alias("toxic_lost"),
    )
    steps = [("".join(FILTERS[f] for f in p), i + 1, 1 << f, sum(1 << x for x in p[:i])) for p in permutations(range(n)) for i, f in enumerate(p)]
    orders = spark.createDataFrame(steps, "filter_order string, step int, own int, before int")  # 600 rows, whatever the tables
    rows = by_case.join(F.broadcast(orders), ["own", "before"]).withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own")))
    return rows.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = """
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), masked AS (
  SELECT x.part, coalesce(k.good, 0) AS good, coalesce(k.toxic, 0) AS toxic,
    CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN x.doc_id > min(x.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM texts x LEFT JOIN known k ON x.doc_id = k.doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, sum(good) AS n_good, sum(toxic) AS n_toxic FROM masked GROUP BY part, mask
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), steps AS (
  SELECT filter_order, CAST(step AS INT) AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), summed AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & own <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n_good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & own <> 0 THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM summed
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_filter_audit": query}
ORACLES: dict[str, str] = {"op12_filter_audit": SQL}
