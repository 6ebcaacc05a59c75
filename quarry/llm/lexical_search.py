"""Operator 13: ranked lexical search by windowed bucket scoring.

Queries are the items' distinct terms. A first scan turns each document into its length and the query terms it
holds, with their counts, as term numbers: texts are read once and never shuffled. Document frequencies and the
corpus' size come from that table. It is then ordered by key in range partitions, and each task walks its postings in
fixed windows of `window` keys: the window's postings are put in order of term, an item's terms are scatter-added
into an array of `window` integers that stays in cache, a bitset tells which slots were touched, and these are harvested into
the item's heap of `most`. Each task returns a heap per item; heaps are merged in two steps.

All scores are 64-bit integers, so a result doesn't depend on the order of additions. Terms are maximal runs of ASCII
letters, digits and non-ASCII characters with only A-Z lower-cased, compared by 64-bit hashes (1e-7 for one false
match among 1e9 distinct words and 4,000 asked ones). An item may have any number of terms and items any number of copies: equal
term sets are scored once. Query terms are broadcast, `block_bytes` of query text at a time; a larger set of items is scored block by block,
a pass over the documents each.

Null or empty texts and texts without terms are no documents: they count nowhere. Items without terms get no rows.
Rows with equal keys are documents of their own and rows with equal item ids items of their own, each with its own ranks. Documents without
key rank behind equal scores that have one. Windows of one repeated key are cut at `window` rows. Empty tables give no rows;
columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import _bytes as B
from quarry.llm import _store
from quarry.session import spread

TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Heaps of tasks are merged by so many groups first; an item's rows then are at most MERGE * most.
MERGE = 64
SPREAD_ITEMS = 16
LAST = np.iinfo(np.int64).max


@dataclass
class Block:
    """Term sets that are scored together. vocabulary: sorted hashes; terms: each set's numbers in it."""

    names: list[tuple[int, int]]
    vocabulary: np.ndarray
    terms: list[np.ndarray]


@dataclass
class Weights:
    """What scoring needs of the corpus: documents, terms with repeats, and a weight for each number of the vocabulary."""

    documents: int
    length: int
    weight: np.ndarray


def term_sets(items: DataFrame, item: str, text: str) -> DataFrame:
    """i, terms (distinct, sorted), h, g (128 bits of the set) of each item that has terms."""
    terms = F.array_sort(F.array_distinct(F.regexp_extract_all(F.translate(F.col(text).cast("string"), UPPER, LOWER), F.lit(TERM), F.lit(0))))
    rows = items.select(F.col(item).alias("i"), terms.alias("terms")).filter(F.size("terms") > 0)
    joined = F.concat_ws(" ", "terms")
    return rows.select("i", "terms", F.xxhash64(joined).alias("h"), F.xxhash64(F.lit(13), joined).alias("g"))


def build_block(rows: list) -> Block:
    """From rows of h, g, terms; what a block holds is bounded by the caller."""
    rows = sorted(rows, key=lambda r: (r["h"], r["g"]))
    data, off = B.flat(pa.array([t for r in rows for t in r["terms"]], pa.string()))
    hashes = B.span_hash(data, off[:-1], off[1:])
    vocabulary, number = np.unique(hashes, return_inverse=True)
    ends = np.cumsum([len(r["terms"]) for r in rows])
    return Block([(r["h"], r["g"]) for r in rows], vocabulary, np.split(number.astype(np.int32), ends[:-1]))


def _postings(column: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n (terms with repeats) of each text, offsets into the query terms it holds, their numbers and counts."""
    data, off = B.flat(column)
    lengths, sizes, terms, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in B.pieces(off):
        d, o = B.lower(data[off[i] : off[j]]), off[i : j + 1] - off[i]
        start, end, first = B.words(d, o, B.PLAIN)
        lengths.append(np.diff(first))
        hashes = B.span_hash(d, start, end)
        at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
        hit = np.flatnonzero(vocabulary[at] == hashes)
        row = np.searchsorted(first, hit, "right") - 1
        pair, n = np.unique(row * len(vocabulary) + at[hit], return_counts=True)
        sizes.append(np.bincount(pair // len(vocabulary), minlength=j - i))
        terms.append(pair % len(vocabulary))
        counts.append(n)
    off = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
    return np.concatenate(lengths), off, np.concatenate(terms), np.concatenate(counts)


def write_postings(spark: SparkSession, docs: DataFrame, block: Block, key: str, text: str) -> str:
    """A table of k, n, terms, counts: one row for each text with terms, query terms by number."""
    shared = spark.sparkContext.broadcast(block.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, off, terms, counts = _postings(batch.column(1), shared.value)
            lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], ["k", "n", "terms", "counts"]).filter(pa.array(n > 0))

    path = _store.scratch(spark, "postings")
    rows = spread(docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")))
    with _store.small_batches(spark):
        rows.mapInArrow(_store.lean(run), "k long, n long, terms array<int>, counts array<int>").write.parquet(path)
    shared.destroy()
    return path


def corpus_weights(postings: DataFrame, size: int) -> Weights:
    """Size of the corpus and the weight of each of `size` query terms; one row a term comes to the driver."""

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])

    whole = postings.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    n = whole["n"]
    df = np.zeros(size, np.int64)
    for r in postings.select("terms").mapInArrow(holders, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    return Weights(n, whole["l"] or 0, np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], np.int64))


class Heaps:
    """The best `most` documents of each term set among the windows walked so far."""

    def __init__(self, block: Block, weights: Weights, window: int, most: int) -> None:
        self.block, self.weights, self.most = block, weights, most
        self.score = np.zeros(window, np.int64)
        self.touched = np.zeros(-(-window // 64), np.uint64)
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in block.names]

    def _length_norm(self, n: np.ndarray) -> np.ndarray:
        if 50 * int(n.max(initial=0)) * self.weights.documents < 1 << 63:
            return 50 + 50 * n * self.weights.documents // self.weights.length
        return np.array([50 + 50 * x * self.weights.documents // self.weights.length for x in n.tolist()], np.int64)

    def walk(self, keys: np.ndarray, n: np.ndarray, off: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> None:
        """Score one window: at most `window` documents, in order of key (LAST for none)."""
        slot = np.repeat(np.arange(len(keys)), np.diff(off))
        order = np.argsort(terms, kind="stable")
        term, slot, tf = terms[order], slot[order], counts[order].astype(np.int64)
        part = self.weights.weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * self._length_norm(n)[slot]))
        begin = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.block.vocabulary)))])
        # a term's slots as words of a bitset: one word for each 64 slots it touches
        word = slot >> 6
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (word[1:] != word[:-1])])) if len(term) else np.zeros(0, np.int64)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (slot & 63).astype(np.uint64), new) if len(new) else np.zeros(0, np.uint64)
        word, word_at = word[new], np.searchsorted(new, begin)
        for at, wanted in enumerate(self.block.terms):
            for t in wanted[begin[wanted + 1] > begin[wanted]].tolist():
                a, b = begin[t], begin[t + 1]
                self.score[slot[a:b]] += part[a:b]
                c, d = word_at[t], word_at[t + 1]
                self.touched[word[c:d]] |= bits[c:d]
            self._harvest(at, keys)

    def _harvest(self, at: int, keys: np.ndarray) -> None:
        full = np.flatnonzero(self.touched)
        if not len(full):
            return
        row, bit = np.nonzero((self.touched[full][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1))
        slots = full[row] * 64 + bit
        score = self.score[slots]
        self.score[slots] = 0
        self.touched[full] = 0
        heap = self.heaps[at]
        good = score >= (heap[0][0] if len(heap) == self.most else 1)
        score, key = score[good], keys[slots[good]]
        best = np.lexsort((key, -score))[: self.most]
        for entry in zip(score[best].tolist(), (-key[best]).tolist(), strict=True):
            if len(heap) < self.most:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            else:
                break


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows in order of key, cut where a window of keys ends or is full: keys, n, offsets, terms, counts."""

    def flush(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
        held = pa.Table.from_batches(parts).combine_chunks()
        lists = held.column("terms").combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        keys = held.column("k").fill_null(LAST).to_numpy()
        return keys, held.column("n").to_numpy(), np.concatenate([[0], np.cumsum(size)]).astype(np.int64), lists.flatten().to_numpy(), held.column("counts").combine_chunks().flatten().to_numpy()

    parts: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        which = batch.column(0).fill_null(LAST).to_numpy() // window
        at = 0
        while at < len(which):
            if parts and (which[at] != last or rows == window):
                yield flush(parts)
                parts, rows = [], 0
            last = which[at]
            end = min(int(np.searchsorted(which, last, "right")), at + window - rows)
            parts.append(batch.slice(at, end - at))
            rows, at = rows + end - at, end
    if parts:
        yield flush(parts)


def _best(rows: DataFrame, most: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("k"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def score_block(spark: SparkSession, postings: DataFrame, block: Block, weights: Weights, window: int, most: int) -> DataFrame:
    """h, g, k, score: each task's best `most` of each term set, with the group it is merged in."""
    shared = spark.sparkContext.broadcast((block, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(*shared.value, window, most)
        for held in _windows(batches, window):
            heaps.walk(*held)
        group = TaskContext.get().partitionId() % MERGE
        for (h, g), heap in zip(heaps.block.names, heaps.heaps, strict=True):
            if heap:
                score, key = zip(*heap, strict=True)
                keys = [None if -k == LAST else -k for k in key]
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(heap), pa.int64()), pa.array([g] * len(heap), pa.int64()), pa.array(keys, pa.int64()), pa.array(score, pa.int64()), pa.array([group] * len(heap), pa.int32())], ["h", "g", "k", "score", "merge"])

    # rows of one key may be many: a hash of what they hold lets a range end among them
    ordered = postings.withColumn("salt", F.xxhash64("n", "terms", "counts")).repartitionByRange("k", "salt").sortWithinPartitions(F.asc_nulls_last("k")).drop("salt")
    return ordered.mapInArrow(_store.lean(run), "h long, g long, k long, score long, merge int")


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, most: int = 50, window: int = 8192, block_bytes: int = 16 << 20, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """item, rank, key, score: the `most` documents of highest score above 0 for each item."""
    _store.ship(spark)
    asked = _store.cut(spark, term_sets(items, item, item_text))
    sets = asked.groupBy("h", "g").agg(F.first("terms").alias("terms"))
    total = sets.agg(F.sum(F.octet_length(F.concat_ws(" ", "terms")) + 24).alias("n")).first()["n"] or 0
    n = 1 if total <= block_bytes else -(-2 * total // block_bytes)  # half full on average, as sets are dealt by hash
    found = []
    for b in range(n):
        rows = (sets if n == 1 else sets.filter(F.pmod(F.col("h"), F.lit(n)) == b)).collect()
        if not rows:
            continue
        block = build_block(rows)
        postings = spark.read.parquet(write_postings(spark, docs, block, key, text))
        weights = corpus_weights(postings, len(block.vocabulary))
        if weights.documents:
            ranked = _best(score_block(spark, postings, block, weights, window, most), most, "h", "g", "merge")
            found.append(_store.cut(spark, _best(ranked.drop("rank"), most, "h", "g").select("h", "g", "rank", "k", "score")))
    kind = items.schema[item].dataType.simpleString()
    if not found:
        return spark.createDataFrame([], f"{item} {kind}, rank int, {key} long, score long")
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    # many items may have one set: both sides are dealt over salts
    salted = asked.select("i", "h", "g", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD_ITEMS)).cast("int").alias("salt"))
    best = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD_ITEMS - 1))))
    return salted.join(best, ["h", "g", "salt"]).select(F.col("i").alias(item), F.col("rank").cast("int").alias("rank"), F.col("k").alias(key), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = """
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents
), held AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), lengths AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM held GROUP BY doc_id
), corpus AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM lengths
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, corpus GROUP BY term, docs
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, h.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // l)))) AS BIGINT) AS score
  FROM asked JOIN held h USING (term) JOIN weights USING (term) JOIN lengths g ON g.doc_id = h.doc_id, corpus GROUP BY item_id, h.doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op13_lexical_search": query}
ORACLES: dict[str, str] = {"op13_lexical_search": SQL}
