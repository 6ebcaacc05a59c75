"""A stored vector index for cosine distance: centroids, and vectors in folders by the cell of their nearest centroid.

Centroids are fitted on at most `SAMPLE` vectors, chosen by a hash of their id; every vector is indexed. A search asks the
cells whose centroids are nearest to a query. On unit vectors, cosine distance is half the square of Euclidean distance d,
so by the triangle inequality a cell with centroid c and radius r holds nothing nearer to q than d(q, c) - r: the exact way
then also asks every cell whose bound is below the k-th best found, and so equals a full scan.

Who may see what is decided before anything is ranked. Vectors that are null, zero or not finite take no part.
Centroids are at most `CELLS`, so they and a block of queries are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import vectors
from quarry.operators import ranking
from quarry.operators.retrieval import QUERY_BLOCK, nearest
from quarry.session import cut, spread

SAMPLE, CELLS, ROUNDS = 65_536, 1024, 12
#: Share of the cells that a search probes if it isn't told how many: what vectors without clusters in 64 dimensions need
#: for a recall above 0.9 (measured: 0.92 to 0.96). Clustered vectors need few.
PROBED = 0.7
#: Slack of a bound in double precision over vectors kept in single precision.
SLACK = 1e-5


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of a list column as rows, and which rows are usable; others are zero."""
    rows = column.to_pylist()
    width = max((len(r) for r in rows if r is not None), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        if r is not None and len(r) == width and None not in r:
            out[i] = r
    length = np.linalg.norm(out, axis=1)
    good = np.isfinite(length) & (length > 0)
    out[~good] = 0
    out[good] /= length[good][:, None]
    return out, good


def fit(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 5) -> np.ndarray:
    """Centroids of unit vectors by Lloyd's rounds; an empty cell takes the vector that lies worst."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        near = sample @ centroids.T
        nearest = near.argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        sizes = np.bincount(nearest, minlength=len(centroids))
        worst = np.argsort(near.max(1), kind="stable")
        for n, c in enumerate(np.flatnonzero(sizes == 0)):
            sums[c] = sample[worst[n]]
        length = np.linalg.norm(sums, axis=1)
        keep = length > 0
        centroids[keep] = sums[keep] / length[keep][:, None]
    return centroids


class VectorIndex:
    """Vectors (chunk_id, embedding) under a folder, by cell."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, chunks: DataFrame, cells: int | None = None) -> int:
        """Fits, assigns and writes; returns the number of cells."""
        n = chunks.count()
        part = SAMPLE / max(1, n)
        unit = 1 << 30
        some = chunks if n <= SAMPLE else chunks.filter(F.pmod(F.xxhash64(F.lit(23), "chunk_id"), F.lit(unit)) < int(unit * part)).orderBy(F.xxhash64(F.lit(29), "chunk_id"), "chunk_id").limit(SAMPLE)
        sample, good = _matrix(pa.array([r["embedding"] for r in some.select("embedding").collect()], pa.list_(pa.float64())))
        sample = sample[good]
        cells = cells or min(CELLS, max(1, int(n**0.5)))
        centroids = fit(sample, cells) if len(sample) else np.zeros((1, 1))
        shared = self.spark.sparkContext.broadcast(centroids)
        kind = chunks.schema["embedding"].dataType.simpleString()

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit, good = _matrix(batch.column(1))
                if unit.shape[1] != shared.value.shape[1]:
                    continue
                near = unit @ shared.value.T
                cell = near.argmax(1)
                away = np.sqrt(np.maximum(0, 2 - 2 * near[np.arange(len(cell)), cell]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(away), pa.array(cell.astype(np.int32))], ["chunk_id", "embedding", "away", "cell"]).filter(pa.array(good))

        # a cell of any size is written by as many tasks as its range holds: ranges end within a cell
        placed = spread(chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), "embedding")).mapInArrow(assign, f"chunk_id long, embedding {kind}, away double, cell int")
        placed.repartitionByRange("cell", "chunk_id").write.mode("errorifexists").partitionBy("cell").parquet(f"{self.root}/vectors")
        radius = {r["cell"]: r["radius"] for r in self._vectors().groupBy("cell").agg(F.max("away").alias("radius")).collect()}  # one row a cell
        rows = [(c, [float(x) for x in centroids[c]], float(radius[c])) for c in sorted(radius)]
        self.spark.createDataFrame(rows, "cell int, centroid array<double>, radius double").coalesce(1).write.parquet(f"{self.root}/centroids")
        return len(rows)

    def _vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/vectors")

    def _nearest(self, queries: DataFrame) -> DataFrame:
        """query_id, q, cell, away, bound: every query with every cell; at most QUERY_BLOCK * CELLS small rows."""
        cells = self.spark.read.parquet(f"{self.root}/centroids")
        pairs = queries.join(F.broadcast(cells))
        away = F.sqrt(F.greatest(F.lit(0.0), 2 * vectors.cosine_distance(F.col("q"), F.col("centroid"))))
        return pairs.select("query_id", "q", "cell", away.alias("away"), F.greatest(F.lit(0.0), away - F.col("radius")).alias("bound"))

    def _asked(self, queries: DataFrame, probes: DataFrame, k: int, allowed: DataFrame | None) -> DataFrame:
        """query_id, chunk_id, distance of the k nearest that the probed cells (query_id, cell) of a block of queries (query_id, q) hold; only their folders are read."""
        some = queries.select("query_id", "q").toArrow()  # at most QUERY_BLOCK
        pairs = probes.select("query_id", "cell").toArrow()  # at most QUERY_BLOCK * CELLS pairs of numbers
        cells = np.unique(pairs.column("cell").to_numpy())
        probed = np.zeros((some.num_rows, int(cells.max(initial=-1)) + 1), bool)
        probed[pc.index_in(pairs.column("query_id"), some.column("query_id")).to_numpy(), pairs.column("cell").to_numpy()] = True
        rows = self._vectors().filter(F.col("cell").isin(cells.tolist())).select("cell", "chunk_id", "embedding")
        if allowed is not None:
            rows = rows.join(allowed.select("chunk_id"), "chunk_id", "left_semi")
        return nearest(rows, some, k, probed)

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, allowed: DataFrame | None = None) -> DataFrame:
        """query_id, chunk_id, distance, rank of each query's (query_id, q) k nearest among allowed chunks (chunk_id); block by block of queries."""
        probes = probes or math.ceil(self.spark.read.parquet(f"{self.root}/centroids").count() * PROBED)
        n = queries.count()
        blocks, found = max(1, -(-n // QUERY_BLOCK)), None
        for b in range(blocks):
            some = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
            part = self._block(some, k, probes, exact, allowed)
            found = part if found is None else found.unionByName(part)
        return found

    def _block(self, queries: DataFrame, k: int, probes: int, exact: bool, allowed: DataFrame | None) -> DataFrame:
        order = [F.col("distance").asc_nulls_last(), F.col("chunk_id")]
        cells = self._nearest(queries)
        first = ranking.top_k(cells, ["query_id"], [F.col("away"), F.col("cell")], probes).select("query_id", "cell")
        found = ranking.top_k(self._asked(queries, first, k, allowed), ["query_id"], order, k)
        if not exact:
            return found
        # the k-th best so far, or no limit where fewer were found: half the square of a Euclidean distance
        found = cut(self.spark, found)
        limit = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("worst"))
        more = cells.join(F.broadcast(limit), "query_id", "left").join(F.broadcast(first.select("query_id", "cell")), ["query_id", "cell"], "left_anti")
        more = more.filter(F.col("worst").isNull() | (F.col("bound") * F.col("bound") / 2 <= F.col("worst") + SLACK)).select("query_id", "cell")
        both = found.select("query_id", "chunk_id", "distance").unionByName(self._asked(queries, more, k, allowed))
        return ranking.top_k(both, ["query_id"], order, k)
