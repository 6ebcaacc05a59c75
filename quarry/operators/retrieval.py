"""Dense, lexical and hybrid retrieval over many queries at once, reranking and citation checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import hashing, text, vectors
from quarry.operators import ranking
from quarry.session import cut

#: Vectors of queries are broadcast up to this number of rows; more are searched block by block.
QUERY_BLOCK = 2048
#: As many where a block meets vectors as matrices.
NEAR_BLOCK = 16_384
#: Rows and queries of one product, pairs whose distances are taken at once, and what the rounding of a distance may hide.
ROWS, COLUMNS, PAIRS, SLACK = 8192, 256, 1 << 13, 1e-9
#: Rows of a batch that is returned.
OUT = 1 << 16
#: What orders pairs without a number after all others, and pairs without a value after these; and what is not asked.
NAN, NULL, NEVER = 1e300, 2e300, np.inf
#: Asked terms up to this number are broadcast.
FEW = 100_000


class _Nearest:
    """The k nearest rows met so far of each query (keys, ids), by distance and then id.

    Products are taken in single precision: they only tell which rows may be in reach. `reach` is twice what rounding of unit
    rows and of a product in any order can make of a cosine, so no row is lost; distances themselves are in double precision.
    """

    def __init__(self, vectors_of: pa.Array, k: int, probed: np.ndarray | None) -> None:
        sizes = vectors_of.value_lengths().drop_null().to_numpy(zero_copy_only=False)
        self.width = int(np.bincount(sizes).argmax()) if len(sizes) else 0
        self.q, whole = vectors.matrix(vectors_of, self.width)
        self.unit, self.norm, self.odd = self._plain(self.q, whole)
        self.k, self.probed, self.reach = k, probed, (self.width + 8) * 2.0**-23 + SLACK
        self.key, self.id = np.full((len(self.q), k), NEVER), np.full((len(self.q), k), np.iinfo(np.int64).max)

    @staticmethod
    def _plain(rows: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit rows in single precision, their norms, and 0 or the key of rows without a distance; these are zero."""
        with np.errstate(all="ignore"):
            norm = vectors.lengths(rows)
            plain = np.isfinite(norm) & (norm > 0)
            unit = np.where(plain[:, None], rows / norm[:, None], 0.0).astype(np.float32)
        return unit, norm, np.where(plain, 0.0, np.where(whole, NAN, NULL))

    def take(self, ids: np.ndarray, column: pa.Array, cells: np.ndarray | None) -> None:
        rows, whole = vectors.matrix(column, self.width)
        unit, norm, odd = self._plain(rows, whole)
        plain, without = np.flatnonzero(odd == 0), np.flatnonzero(odd)
        unit = unit if len(plain) == len(unit) else unit[plain]
        for low in range(0, len(self.q), COLUMNS):
            of = np.arange(low, min(low + COLUMNS, len(self.q)))
            asks, odd_asks = of[self.odd[of] == 0], of[self.odd[of] > 0]
            self._measured(asks, plain, unit, rows, norm, ids, cells)
            self._unmeasured(asks, without, odd, ids, cells)
            self._unmeasured(odd_asks, np.arange(len(ids)), odd, ids, cells)

    def _measured(self, asks: np.ndarray, plain: np.ndarray, unit: np.ndarray, rows: np.ndarray, norm: np.ndarray, ids: np.ndarray, cells: np.ndarray | None) -> None:
        """Queries and rows that have a distance."""
        if not len(asks) or not len(plain):
            return
        cosine = self.unit[asks] @ unit.T
        if self.probed is not None:
            cosine[~self.probed[asks][:, cells[plain]]] = -np.inf
        worst = self.key[asks, -1]
        least = 1 - worst - self.reach  # -inf where fewer than k rows are known
        few = np.flatnonzero(worst >= NAN)
        if len(few):
            least[few] = -np.inf
            if len(plain) > self.k:
                least[few] = np.partition(cosine[few], len(plain) - self.k, axis=1)[:, len(plain) - self.k] - 2 * self.reach
        # finite, so that rows which are not probed stay below
        least = np.maximum(least, -2.0).astype(np.float32)
        hit = np.flatnonzero(cosine >= np.nextafter(least, np.float32(-np.inf))[:, None])
        at, row = asks[hit // len(plain)], plain[hit % len(plain)]
        key = np.empty(len(hit))
        for i in range(0, len(hit), PAIRS):
            r, q = row[i : i + PAIRS], at[i : i + PAIRS]
            key[i : i + PAIRS] = vectors.distances(rows[r], self.q[q], norm[r], self.norm[q])
        key[np.isnan(key)] = NAN
        self._keep(at, key, ids[row])

    def _unmeasured(self, asks: np.ndarray, some: np.ndarray, odd: np.ndarray, ids: np.ndarray, cells: np.ndarray | None) -> None:
        """Queries and rows of which one has no distance; they only count where fewer than k rows have one."""
        asks = asks[self.key[asks, -1] >= NAN]
        if not len(asks) or not len(some):
            return
        key = np.maximum(self.odd[asks][:, None], odd[some])
        asked = np.ones(key.shape, bool) if self.probed is None else self.probed[asks][:, cells[some]]
        at, row = np.nonzero(asked)
        self._keep(asks[at], key[at, row], ids[some[row]])

    def _keep(self, at: np.ndarray, key: np.ndarray, ids: np.ndarray) -> None:
        """Rows met, ordered by query."""
        worst, last = self.key[at, -1], self.id[at, -1]
        better = np.flatnonzero((key < worst) | ((key == worst) & (ids < last)))
        at, key, ids = at[better], key[better], ids[better]
        if not len(at):
            return
        first = np.flatnonzero(np.diff(at, prepend=-1))
        touched = at[first]
        width = self.k + int(np.diff(first, append=len(at)).max())
        all_keys, all_ids = np.full((len(touched), width), NEVER), np.full((len(touched), width), np.iinfo(np.int64).max)
        all_keys[:, : self.k], all_ids[:, : self.k] = self.key[touched], self.id[touched]
        line = np.repeat(np.arange(len(touched)), np.diff(first, append=len(at)))
        place = self.k + np.arange(len(at)) - first[line]
        all_keys[line, place], all_ids[line, place] = key, ids
        order = np.lexsort((all_ids, all_keys), axis=1)[:, : self.k]
        self.key[touched], self.id[touched] = np.take_along_axis(all_keys, order, 1), np.take_along_axis(all_ids, order, 1)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries (rows), keys and ids."""
        at, place = np.nonzero(self.key < NEVER)
        return at, self.key[at, place], self.id[at, place]


def nearest(rows: DataFrame, queries: pa.Table, k: int, probed: np.ndarray | None = None) -> DataFrame:
    """query_id, chunk_id, distance: of each task, the k nearest rows (chunk_id, embedding) of each query (query_id, q).

    Rows meet a block of queries as matrices; those that a product leaves in reach get their distance in the order of
    components of `cosine_distance`, so nothing depends on the product. Pairs without a number come after all others, those
    without a value last. probed: with a column cell of rows, which cells (columns) each query (rows) asks. chunk_id is a whole number.
    """
    names = queries.column("query_id").combine_chunks()
    shared = rows.sparkSession.sparkContext.broadcast((names, queries.column("q").combine_chunks(), probed))
    kind = rows.schema["chunk_id"].dataType.simpleString()
    schema = pa.schema([("query_id", names.type), ("chunk_id", {"int": pa.int32()}.get(kind, pa.int64())), ("distance", pa.float64())])
    of_query = {pa.int32(): "int", pa.int64(): "long"}.get(names.type, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q, probed = shared.value
        best = _Nearest(q, k, probed)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                cells = batch.column(2).to_numpy() if probed is not None else None
                best.take(batch.column(0).to_numpy().astype(np.int64), batch.column(1), cells)
        at, keys, ids = best.found()
        for low in range(0, len(at), OUT):
            some = slice(low, low + OUT)
            value = pa.array(np.where(keys[some] >= NAN, np.nan, keys[some]), mask=keys[some] >= NULL)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at[some])), pa.array(ids[some]).cast(schema.field(1).type), value], schema=schema)

    return rows.select("chunk_id", "embedding", *(["cell"] if probed is not None else [])).mapInArrow(run, f"query_id {of_query}, chunk_id {kind}, distance double")


def dense_topk(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, distance, rank. chunks: chunk_id, embedding; queries: query_id, q.

    A stated set of queries against all chunks: exact, one scan a block of queries; every task keeps k rows a query.
    """
    n = queries.count()
    blocks = max(1, -(-n // NEAR_BLOCK))
    order = [F.col("distance").asc_nulls_last(), F.col("chunk_id")]
    found = None
    for b in range(blocks):
        some = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        part = ranking.top_k(nearest(chunks, some.select("query_id", "q").toArrow(), k), ["query_id"], order, k)
        found = part if found is None else found.unionByName(part)
    return found


def by_terms(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """query_id, asked of every query (query_id, terms), and asked, term of those that stand for all queries of the same terms."""
    sets = queries.select("query_id", F.array_sort(F.array_distinct("terms")).alias("terms"))
    firsts = cut(queries.sparkSession, sets.groupBy("terms").agg(F.min("query_id").alias("asked")))
    return sets.join(firsts, "terms").select("query_id", "asked"), firsts.select("asked", F.explode("terms").alias("term"))


def best_by_terms(rows: DataFrame, queries: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank from postings (term, chunk_id, positions) and both results of `by_terms`: one search for queries that ask the same."""
    hits = rows.join(F.broadcast(terms) if terms.limit(FEW + 1).count() <= FEW else terms, "term").groupBy("asked", "chunk_id").agg(F.sum("positions").alias("positions"))
    best = ranking.top_k(hits.withColumn("score", lexical_score(F.col("positions"))), ["asked"], [F.desc("score"), F.col("chunk_id")], k)
    return queries.join(best, "asked").select("query_id", "chunk_id", "positions", "score", "rank")


def postings(chunks: DataFrame, key: str, body: str) -> DataFrame:
    """key, term, positions: how often each term stands in each chunk."""
    words = chunks.select(F.col(key).alias("chunk_id"), F.explode(text.tokens(F.col(body))).alias("term"))
    return words.groupBy("chunk_id", "term").agg(F.count("*").alias("positions"))


def lexical_score(positions: Column) -> Column:
    """Every matching position counts 0.1, the sum s is scaled to s / (s + 1)."""
    raw = 0.1 * positions
    return raw / (raw + 1)


def lexical_topk(chunks: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", body: str = "body") -> DataFrame:
    """query_id, chunk_id, score, rank for queries (query_id, terms): any of the distinct terms matches."""
    mine, terms = by_terms(queries)
    words = chunks.select(F.col(key).alias("chunk_id"), F.explode(text.tokens(F.col(body))).alias("term"))
    # only words that some query asks for are counted and shuffled
    asked = terms.select("term").distinct()
    counts = words.join(F.broadcast(asked) if asked.count() <= FEW else asked, "term", "left_semi").groupBy("chunk_id", "term").agg(F.count("*").alias("positions"))
    return best_by_terms(counts, mine, terms, k)


def hybrid(dense: DataFrame, lexical: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    """query_id, chunk_id, rrf, rank_0 (dense), rank_1 (lexical), rank; cut after the merge."""
    fused = ranking.fuse([dense, lexical], ["query_id", "chunk_id"], rrf_k)
    return ranking.top_k(fused, ["query_id"], [F.desc("rrf"), F.col("chunk_id")], k)


def rerank(pool: DataFrame, k: int) -> DataFrame:
    """Reorders a pool (query_id, chunk_id, rank) by a fixed score of the pair; never adds a candidate."""
    pair = F.concat(F.col("query_id").cast("string"), F.lit("|"), F.col("chunk_id").cast("string"))
    scored = pool.select("query_id", "chunk_id", F.col("rank").alias("hybrid_rank"), text.stable_sigmoid(hashing.scaled_hash(pair, -8.0, 8.0)).alias("score"))
    return ranking.top_k(scored, ["query_id"], [F.desc("score"), F.col("hybrid_rank"), F.col("chunk_id")], k)


def one_generation(rows: DataFrame, document: str, generation: str) -> DataFrame:
    """Documents that stand in a result with more than one generation."""
    return rows.groupBy("query_id", document).agg(F.countDistinct(generation).alias("generations")).filter("generations > 1")


def citation_status(answer: Column, evidence: Column) -> Column:
    """valid or why not: labels must be strict, in range of the evidence count, and present if there is any."""
    labels = text.citation_labels(answer)
    top = F.array_max(F.transform(labels, lambda x: F.regexp_extract(x, r"(\d+)", 1).cast("int")))
    return (
        F.when(labels.isNull(), "malformed").when((evidence == 0) & (F.size(labels) > 0), "label_without_context").when((evidence > 0) & (F.size(labels) == 0), "label_required")
        .when(F.coalesce(top, F.lit(0)) > evidence, "label_out_of_range").otherwise("valid")
    )
