"""A stored lexical index: posting lists with positions in buckets of terms, kept by generation.

A segment holds the postings (term, chunk_id, n, positions) of the chunks that one update added, in folders by bucket and
in order of term within a file, and the ids of all chunks that it added or took away. A version is a list of segments;
a chunk's postings are those of the last segment that names it. A search reads only the buckets of the asked terms, and of
these only the row groups whose terms fit; positions are read by none but those who ask for them.

Updates write a new segment and then the next version's file, which only one of two writers can create. A chunk's words are
grouped where the chunk is read, and the postings of some chunks are shuffled once, a word's as one row: by bucket and, in
larger segments, by a class of the first chunk, so that a hot term's postings lie in many files.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators.retrieval import best_by_terms, by_terms

BUCKETS = 64
#: Asked terms up to this number are pushed to the scan by value; more are joined.
PUSHED = 500
#: Chunks whose words are grouped at once.
GROUPED = 1024
#: Bytes of a segment's rows, as the plan knows them, that make a task of their own; and what a plan says that does not know.
PART_BYTES, UNKNOWN = 4 << 20, 1 << 50
_PACKS = pa.schema([("term", pa.string()), ("ids", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())), ("places", pa.list_(pa.int32()))])


def _grouped(ids: pa.Array, words: pa.Array) -> pa.RecordBatch:
    """A pack for each word of some chunks: the chunks that hold it, where each one's places end, and the places."""
    sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    coded = words.flatten().dictionary_encode()
    chunk = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(chunk)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    key = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * max(len(sizes), 1) + chunk
    order = np.argsort(key, kind="stable")
    key = key[order]
    ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) + 1 if len(key) else np.zeros(0, np.int64)  # of postings, in places
    held, code = chunk[order[ends - 1]], key[ends - 1] // max(len(sizes), 1)
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)  # postings that begin a pack
    packs = np.append(first, len(ends)).astype(np.int32)
    before = np.append(0, ends)[packs].astype(np.int32)
    within = (ends - np.repeat(before[:-1], np.diff(packs))).astype(np.int32)
    columns = [pa.ListArray.from_arrays(pa.array(at), v) for at, v in ((packs, ids.take(pa.array(held))), (packs, pa.array(within)), (before, pa.array(place[order].astype(np.int32))))]
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[first])), *columns], schema=_PACKS)


def packs_of(chunks: DataFrame) -> DataFrame:
    """term, ids, ends, places of chunks (chunk_id, body): a word's postings in some chunks as one row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, GROUPED):
                batch = whole.slice(at, GROUPED)
                yield _grouped(batch.column(0), batch.column(1))

    words = chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), text.tokens(F.col("body")).alias("words"))
    return words.mapInArrow(run, "term string, ids array<long>, ends array<int>, places array<int>")


def unpacked(packs: DataFrame) -> DataFrame:
    """term, chunk_id, n, positions of packs."""
    rows = packs.select("term", "ends", "places", F.posexplode("ids").alias("i", "chunk_id"))
    start = F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(0)
    n = F.get("ends", F.col("i")) - start
    return rows.select("term", "chunk_id", n.alias("n"), F.slice("places", start + 1, n).alias("positions"))


def postings_of(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, n, positions of chunks (chunk_id, body), each by itself: nothing is shuffled."""
    return unpacked(packs_of(chunks))


class LexicalIndex:
    """Postings under a folder of any file system that Hadoop reaches."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def version(self) -> int:
        """The last complete version, 0 if there is none."""
        return self._manifest()[0]

    def _manifest(self) -> tuple[int, list[str]]:
        if not self.fs.exists(self._path("")):
            return 0, []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(""))]
        for n in sorted((int(m[1]) for m in (re.fullmatch(r"version-(\d+)", x) for x in names) if m), reverse=True):
            source = self.fs.open(self._path(f"version-{n}"))
            try:
                said = self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
            finally:
                source.close()
            if said:  # empty while its writer is still at it
                return n, json.loads(said)
        return 0, []

    def _activate(self, expected: int, segments: list[str]) -> int:
        try:
            out = self.fs.create(self._path(f"version-{expected + 1}"), False)
        except Exception as e:  # py4j wraps what the file system says
            raise RuntimeError("another version was published") from e
        try:
            out.write(bytearray(json.dumps(segments).encode()))
        finally:
            out.close()
        return expected + 1

    def bucket(self, term):
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _write(self, packs: DataFrame, changed: DataFrame) -> str:
        """A segment of packs and of the ids it decides on. Packs are shuffled, postings written."""
        name = f"segment-{uuid.uuid4().hex}"
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if (size := int(str(unpacked(packs)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))) < UNKNOWN:
            parts = max(parts, size // PART_BYTES)
        share = F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.lit(max(1, 4 * parts // self.buckets)))
        rows = unpacked(packs.repartition(parts, self.bucket("term"), share))
        ordered = rows.withColumn("bucket", self.bucket("term")).sortWithinPartitions("bucket", "term", "chunk_id")
        ordered.write.partitionBy("bucket").parquet(f"{self.root}/{name}/postings")
        changed.select("chunk_id").distinct().write.parquet(f"{self.root}/{name}/changed")
        return name

    def update(self, added: DataFrame, expected: int, removed: DataFrame | None = None) -> int:
        """The next version: chunks (chunk_id, body) new or with a new body, and ids (chunk_id) that go. Returns its number.

        Two writers that start from one version can't both win. A null body has no postings; ids are unique in `added`.
        """
        version, segments = self._manifest()
        if version != expected:
            raise RuntimeError("another version was published")
        ids = added.select("chunk_id")
        return self._activate(expected, [*segments, self._write(packs_of(added), ids if removed is None else ids.unionByName(removed.select("chunk_id")))])

    def compact(self, expected: int) -> int:
        """The next version, with one segment for all that is live."""
        version, segments = self._manifest()
        if version != expected:
            raise RuntimeError("another version was published")
        live = self.postings(None, segments)
        packs = live.select("term", F.array("chunk_id").alias("ids"), F.array("n").alias("ends"), F.col("positions").alias("places"))
        return self._activate(expected, [self._write(packs, live)])

    def postings(self, terms: DataFrame | None = None, segments: list[str] | None = None) -> DataFrame:
        """term, chunk_id, n, positions of live chunks, for the terms asked for (term) or all."""
        segments = self._manifest()[1] if segments is None else segments
        asked, buckets = None, None
        if terms is not None:
            some = terms.select("term", self.bucket("term").alias("b")).distinct().limit(PUSHED + 1).collect()
            if len(some) <= PUSHED:
                asked, buckets = [r["term"] for r in some], sorted({r["b"] for r in some})
            else:
                buckets = [r["b"] for r in terms.select(self.bucket("term").alias("b")).distinct().collect()]  # at most self.buckets
        found, later = None, None
        for name in reversed(segments):
            rows = self.spark.read.schema("term string, chunk_id long, n int, positions array<int>, bucket int").parquet(f"{self.root}/{name}/postings")
            if buckets is not None:
                rows = rows.filter(F.col("bucket").isin(buckets))
                rows = rows.filter(F.col("term").isin(asked)) if asked is not None else rows.join(terms.select("term").distinct(), "term", "left_semi")
            rows = rows.select("term", "chunk_id", "n", "positions")
            if later is not None:
                rows = rows.join(later, "chunk_id", "left_anti")
            changed = self.spark.read.schema("chunk_id long").parquet(f"{self.root}/{name}/changed")
            later = changed if later is None else later.unionByName(changed)
            found = rows if found is None else found.unionByName(rows)
        return found if found is not None else self.spark.createDataFrame([], "term string, chunk_id long, n int, positions array<int>")

    def search(self, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
        """query_id, chunk_id, score, rank for queries (query_id, terms): any of the distinct terms matches, among allowed chunks (chunk_id)."""
        mine, terms = by_terms(queries)
        rows = self.postings(terms).select("term", "chunk_id", F.col("n").alias("positions"))
        if allowed is not None:
            rows = rows.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
        return best_by_terms(rows, mine, terms, k)

    def phrase(self, words: list[str]) -> DataFrame:
        """chunk_id, starts of the chunks that hold the words one after the other, from positions alone."""
        terms = self.spark.createDataFrame([(w,) for w in words], "term string")
        held = self.postings(terms).select("term", "chunk_id", "positions")
        # a word's positions, moved back by its place in the phrase: where all words agree, the phrase starts
        places = F.explode(F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in enumerate(words)]), lambda x: x["w"] == F.col("term"))).alias("x")
        moved = held.select("chunk_id", "positions", places).select("chunk_id", F.explode(F.transform("positions", lambda p: p - F.col("x.i"))).alias("start"), F.col("x.i").alias("i"))
        whole = moved.groupBy("chunk_id", "start").agg(F.countDistinct("i").alias("n")).filter(F.col("n") == len(words))
        return whole.groupBy("chunk_id").agg(F.sort_array(F.collect_list("start")).alias("starts"))
