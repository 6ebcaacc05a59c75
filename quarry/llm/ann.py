"""Operator 4: approximate nearest neighbours with one navigable small-world graph per shard.

Vectors are dealt to shards of about `SHARD` rows by a hash of their id. A shard's task builds a
hierarchical graph over its distinct vectors (copies share a node, so a frequent vector neither
tangles the graph nor crowds out others). Nodes enter in a random order, as they would one by one: each
level links a node to `M` of the `EF_BUILD` nearest that entered before it, in different directions,
and back, keeping 2M of them in the end (M on upper levels). The nearest are found exactly, a block
of nodes at a time, which costs less than walks at a shard's size. The graph is stored as flat arrays:
the vectors, each node's level, the neighbours of the ground level (nodes x 2M) and of the upper
levels, one after another.

Queries are taken in blocks of `QUERIES_IN_BLOCK`, a broadcast of known size each; a job for each block
reads every shard's graph once. The queries of a block walk a graph side by side, from the entry point
down the levels, and shard results are merged by exact distance. All rows are indexed; a shard's and
a block's size are fixed, so tasks don't grow with the table.

Nearness is Euclidean distance in double precision on the original vectors; ties go to the smaller
id. Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors
of different lengths never meet. Rows that share an id count once (the smallest vector); a query
never finds its own id; with fewer candidates than k all are returned; empty tables give no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import _store

SHARD = 8192
QUERIES_IN_BLOCK = 16384
#: Queries that walk a graph side by side, and nodes that look for their neighbours at once.
ABREAST = 512
M = 12
EF_BUILD = 48
EF_SEARCH = 128
#: Nodes that a walk opens at once.
OPENED = 4
GRAPH = "dim int, shard int, ids binary, first binary, vectors binary, levels binary, ground binary, upper binary, entry int"


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def _diverse(vectors: np.ndarray, dist: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
    """For each row of candidates (-1: none; nearest first) `most` in different directions, -1 where there are fewer.

    A candidate closer to a chosen one than to the centre waits; those that wait fill what is left.
    """
    rows, width = nodes.shape
    if width <= most:
        return np.pad(nodes, ((0, 0), (0, most - width)), constant_values=-1)
    v = vectors[np.maximum(nodes, 0)]
    square = np.einsum("rcd,rcd->rc", v, v)
    shadow = np.full((rows, width), np.inf, np.float32)
    chosen = np.zeros((rows, width), bool)
    count = np.zeros(rows, np.int64)
    for i in range(width):
        take = (nodes[:, i] >= 0) & (dist[:, i] <= shadow[:, i]) & (count < most)
        if not take.any():
            continue
        chosen[take, i] = True
        count += take
        some = np.flatnonzero(take)
        between = square[some] + square[some, i][:, None] - 2 * np.einsum("rcd,rd->rc", v[some], v[some, i])
        shadow[some] = np.minimum(shadow[some], between)
    order = np.argsort(np.where(chosen, 0, np.where(nodes >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(nodes, order, 1)


def _level(vectors: np.ndarray, most: int) -> np.ndarray:
    """Neighbours (n x most, -1: none) of one level; rows of vectors in order of entry."""
    n = len(vectors)
    out = np.full((n, most), -1, np.int32)
    if n < 2:
        return out
    width = min(EF_BUILD, n - 1)
    forward = np.full((n, min(M, most)), -1, np.int32)
    for a in range(0, n, ABREAST):
        b = min(a + ABREAST, n)
        d = _square(vectors[a:b], vectors[:b])
        d[np.arange(b)[None, :] >= np.arange(a, b)[:, None]] = np.inf  # only those that entered before
        w = min(width, b)
        near = np.argpartition(d, w - 1, axis=1)[:, :w] if w < b else np.tile(np.arange(b), (b - a, 1))
        dist = np.take_along_axis(d, near, 1)
        order = np.argsort(dist, axis=1, kind="stable")
        near, dist = np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1)
        forward[a:b] = _diverse(vectors, dist, np.where(np.isinf(dist), -1, near), forward.shape[1])
    # links back: a node's candidates are those it chose and those that chose it
    here, there = np.repeat(np.arange(n), forward.shape[1]), forward.ravel()
    ok = there >= 0
    one, two = np.concatenate([here[ok], there[ok]]), np.concatenate([there[ok], here[ok]])
    gap = vectors[one] - vectors[two]
    dist = np.einsum("ij,ij->i", gap, gap)
    order = np.lexsort((two, dist, one))
    one, two, dist = one[order], two[order], dist[order]
    first = np.searchsorted(one, np.arange(n + 1))
    degree = np.diff(first)
    # a hub has many candidates: they are looked at in slices of nodes of about equal degree
    by_degree = np.argsort(degree, kind="stable")
    a = 0
    while a < n:
        b = a + 1
        while b < n and (b - a + 1) * int(degree[by_degree[b]]) <= 1 << 15:
            b += 1
        some, wide = by_degree[a:b], max(int(degree[by_degree[b - 1]]), 1)
        column = np.arange(wide)[None, :]
        at = np.minimum(first[some][:, None] + column, len(two) - 1)
        full = column < degree[some][:, None]
        out[some] = _diverse(vectors, np.where(full, dist[at], np.inf).astype(np.float32), np.where(full, two[at], -1), most)
        a = b
    return out


class Graph:
    """A hierarchical navigable small world over the rows of `vectors` (float32 for walking)."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        rng = np.random.default_rng(11)
        self.levels = np.minimum((-np.log(1 - rng.random(n)) / np.log(M)).astype(np.int8), 12)
        self.first = np.concatenate([[0], np.cumsum(self.levels.astype(np.int64))])
        self.entry = int(np.argmax(self.levels)) if n else -1

    def build(self) -> Graph:
        self.ground = _level(self.vectors, 2 * M)
        self.upper = np.full((int(self.first[-1]), M), -1, np.int32)
        for level in range(1, int(self.levels.max(initial=0)) + 1):
            nodes = np.flatnonzero(self.levels >= level)
            found = _level(self.vectors[nodes], M)
            self.upper[self.first[nodes] + level - 1] = np.where(found >= 0, nodes[found], -1)
        return self

    def links(self, level: int, nodes: np.ndarray) -> np.ndarray:
        return self.ground[nodes] if level == 0 else self.upper[self.first[nodes] + level - 1]

    def search(self, queries: np.ndarray, ef: int) -> np.ndarray:
        """For each query up to ef nodes near it (-1: none), nearest first; all queries walk side by side."""
        start = np.full((len(queries), 1), self.entry)
        for level in range(int(self.levels[self.entry]), 0, -1):
            start = self._walk(queries, start, level, 16)
        return self._walk(queries, start, 0, ef)

    def _walk(self, queries: np.ndarray, start: np.ndarray, level: int, ef: int) -> np.ndarray:
        q, n = len(queries), len(self.vectors)
        rows = np.arange(q)[:, None]
        seen = np.zeros((q, n + 1), bool)
        seen[:, n] = True  # stands for no node
        start = np.where(start < 0, n, start)
        seen[rows, start] = True
        nodes = np.full((q, ef), n)
        dist = np.full((q, ef), np.inf, np.float32)
        w = min(start.shape[1], ef)
        nodes[:, :w] = start[:, :w]
        gap = self.vectors[np.minimum(nodes[:, :w], n - 1)] - queries[:, None, :]
        dist[:, :w] = np.where(nodes[:, :w] < n, np.einsum("qcd,qcd->qc", gap, gap), np.inf)
        opened = np.zeros((q, ef), bool)
        live = np.arange(q)
        while len(live):
            # the nearest nodes that are not opened yet; a query is done when all it has are
            wait = np.where(opened[live], np.inf, dist[live])
            pick = np.argpartition(wait, OPENED - 1, axis=1)[:, :OPENED] if ef > OPENED else np.tile(np.arange(ef), (len(live), 1))
            ok = np.isfinite(np.take_along_axis(wait, pick, 1))
            more = ok.any(1)
            live, pick, ok = live[more], pick[more], ok[more]
            if not len(live):
                break
            at = live[:, None]
            opened[at, pick] |= ok
            centre = np.where(ok, nodes[at, pick], 0)
            near = np.where(ok[:, :, None], self.links(level, centre), -1).reshape(len(live), -1)
            near = np.where(near < 0, n, near)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n  # two opened nodes may share a neighbour
            near[seen[at, near]] = n
            seen[at, near] = True
            r, c = np.nonzero(near < n)
            far = np.full(near.shape, np.inf, np.float32)
            gap = self.vectors[near[r, c]] - queries[live[r]]
            far[r, c] = np.einsum("ij,ij->i", gap, gap)
            every = np.concatenate([dist[live], far], 1)
            keep = np.argpartition(every, ef - 1, axis=1)[:, :ef]
            dist[live] = np.take_along_axis(every, keep, 1)
            nodes[live] = np.take_along_axis(np.concatenate([nodes[live], near], 1), keep, 1)
            opened[live] = np.take_along_axis(np.concatenate([opened[live], np.zeros(near.shape, bool)], 1), keep, 1)
        order = np.argsort(dist, axis=1, kind="stable")
        nodes = np.take_along_axis(nodes, order, 1)
        return np.where(nodes < n, nodes, -1)


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, all components finite numbers."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(table: pa.Table, column: str, dim: int) -> np.ndarray:
    values = table.column(column).combine_chunks()
    values = pa.concat_arrays(values.chunks) if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _build(group: pa.Table) -> pa.Table:
    dim, shard = group.column("dim")[0].as_py(), group.column("shard")[0].as_py()
    ids, v = group.column("id").to_numpy(), _matrix(group, "v", dim).astype(np.float64)
    order = np.lexsort((*v.T[::-1], ids))
    order = order[np.concatenate([[True], np.diff(ids[order]) != 0])]  # an id counts once
    ids, v = ids[order], v[order]
    distinct, back = np.unique(v, axis=0, return_inverse=True)
    order = np.lexsort((ids, back.ravel()))
    first = np.searchsorted(back.ravel()[order], np.arange(len(distinct) + 1))
    mixed = np.random.default_rng(5).permutation(len(distinct))  # sorted vectors would make a lopsided graph
    members = [ids[order][first[x] : first[x + 1]] for x in mixed]
    graph = Graph(distinct[mixed]).build()
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "shard": pa.array([shard], pa.int32()), "ids": [np.concatenate(members).astype("<i8").tobytes()],
        "first": [np.cumsum([0, *map(len, members)]).astype("<i8").tobytes()], "vectors": [distinct[mixed].astype("<f8").tobytes()], "levels": [graph.levels.tobytes()],
        "ground": [graph.ground.astype("<i4").tobytes()], "upper": [graph.upper.astype("<i4").tobytes()], "entry": pa.array([graph.entry], pa.int32()),
    })


def _load(row: dict) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    v = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
    g = Graph.__new__(Graph)
    g.vectors, g.levels, g.entry = v.astype(np.float32), np.frombuffer(row["levels"], np.int8), row["entry"]
    g.first = np.concatenate([[0], np.cumsum(g.levels.astype(np.int64))])
    g.ground, g.upper = np.frombuffer(row["ground"], "<i4").reshape(-1, 2 * M), np.frombuffer(row["upper"], "<i4").reshape(-1, M)
    return g, v, np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["first"], "<i8")


def _search(blocks, k: int, ef: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """blocks: broadcast, the queries of each dimension as (ids, vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                if r["dim"] not in blocks.value:
                    continue
                graph, v, ids, first = _load(r)
                own, queries = blocks.value[r["dim"]]
                out: tuple[list, list, list] = ([], [], [])
                for a in range(0, len(own), ABREAST):
                    q = queries[a : a + ABREAST]
                    found = graph.search(q.astype(np.float32), max(ef, k + 1))
                    d = np.sqrt(((v[np.maximum(found, 0)] - q[:, None, :]) ** 2).sum(2))
                    d[found < 0] = np.inf
                    order = np.argsort(d, axis=1, kind="stable")
                    for me, nodes, dist in zip(own[a : a + ABREAST].tolist(), np.take_along_axis(found, order, 1).tolist(), np.take_along_axis(d, order, 1).tolist(), strict=True):
                        hits: list[tuple[float, int]] = []
                        for x, e in zip(nodes, dist, strict=True):
                            if x < 0 or (len(hits) >= k and e > hits[k - 1][0]):
                                break
                            hits += [(e, y) for y in ids[first[x] : min(first[x] + k + 1, first[x + 1])].tolist() if y != me]
                            hits.sort()
                        for e, y in hits[:k]:
                            out[0].append(me)
                            out[1].append(y)
                            out[2].append(e)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def _rows(table: DataFrame, key: str, vector: str) -> DataFrame:
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))


def build_index(spark: SparkSession, table: DataFrame, key: str = "vec_id", vector: str = "embedding", shard: int | None = None) -> DataFrame:
    """One row per shard with its graph in flat arrays."""
    _store.ship(spark)
    rows = _rows(table, key, vector)
    shards = max(1, -(-rows.count() // (shard or SHARD)))
    # hashed twice, so that a shard's number of rows does not follow patterns in the ids
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64(F.xxhash64("id")), F.lit(shards)).cast("int"))
    # a shard is minutes of work in few bytes: a fixed number of partitions keeps them from being merged
    tasks = max(_store.partitions(spark), 4 * shards)
    return dealt.repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInArrow(_build, GRAPH)


def search(spark: SparkSession, index: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", ef: int = EF_SEARCH) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of each query; index is read once a block of queries, so keep it."""
    _store.ship(spark)
    rows = _store.cut(spark, _rows(queries, key, vector))
    blocks = max(1, -(-rows.count() // (QUERIES_IN_BLOCK * 7 // 8)))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = None
    for b in range(blocks):
        some = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64(F.xxhash64("id")), F.lit(blocks)) == b)
        by_dim: dict[int, dict[int, list[float]]] = {}
        for r in some.orderBy("id", "v").collect():
            by_dim.setdefault(r["dim"], {}).setdefault(r["id"], r["v"])
        shared = spark.sparkContext.broadcast({dim: (np.array(list(q), np.int64), np.array(list(q.values()), np.float64)) for dim, q in by_dim.items()})
        near = index.mapInArrow(_store.lean(_search(shared, k, ef)), "query_id long, vec_id long, score double")
        best = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if blocks > 1:
            best = _store.cut(spark, best)
            shared.destroy()
        found = best if found is None else found.unionByName(best)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = _store.cut(spark, build_index(spark, table))
    return search(spark, index, table.filter("vec_id % 100 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_nearest": query}
ORACLES: dict[str, str] = {}
