"""Section M with F02-F04 and C10: authorised retrieval end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import hashing, vectors
from quarry.operators import context, ranking, retrieval
from quarry.operators import joins as J
from quarry.operators import relational as R
from quarry.plans import indexes
from quarry.plans.documents import marked
from quarry.plans.joins import FILE, LIVE
from quarry.plans.relational import live_versions
from quarry.plans.views import view, with_views
from quarry.registry import query
from quarry.session import cut, table

TERMS = ["stupid", "licensed", "erea", "des", "que"]
DISTANCE = "1 - list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"
ALLOWED = f"""allowed AS (SELECT d.document_id FROM docs d JOIN versions v ON {LIVE} JOIN files f ON {FILE} WHERE d.owner_id = 7 OR EXISTS (SELECT 1 FROM acl a WHERE a.document_id = d.document_id AND
  ((a.subject_type = 'user' AND a.subject_id = '7') OR (a.subject_type = 'role' AND a.subject_id IN ('analyst', 'support')) OR (a.subject_type = 'market' AND a.subject_id IN ('de', 'en')))))"""
ROUTES = f"""{ALLOWED},
dense AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY dist, chunk_id) AS rank, dist FROM (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, {DISTANCE} AS dist FROM embeddings e JOIN allowed ON e.vec_id = allowed.document_id, embeddings q WHERE q.vec_id % 100 = 0) QUALIFY rank <= 30),
counts AS (SELECT doc_id AS chunk_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM documents JOIN allowed ON doc_id = document_id) GROUP BY ALL),
asked AS (SELECT vec_id AS query_id, unnest(['{TERMS[0]}', '{TERMS[1]}', list_extract(['{TERMS[2]}', '{TERMS[3]}', '{TERMS[4]}'], CAST(1 + vec_id // 100 % 3 AS INT))]) AS w FROM embeddings WHERE vec_id % 100 = 0),
lexical AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, 0.1::DOUBLE * sum(n) / (0.1::DOUBLE * sum(n) + 1) AS score FROM counts JOIN asked USING (w) GROUP BY ALL) QUALIFY rank <= 30),
fused AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, coalesce(1.0::DOUBLE / (60 + a.rank), 0.0::DOUBLE) + coalesce(1.0::DOUBLE / (60 + b.rank), 0.0::DOUBLE) AS rrf FROM dense a FULL OUTER JOIN lexical b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS rank FROM fused)"""


def allowed(spark, d):
    """Live documents that user 7, an analyst and support agent for two markets, may read: filtered before anything is ranked."""
    return R.accessible(live_versions(spark, d), view(spark, d, "acl"), "7", ["analyst", "support"], ["de", "en"])


def queries_of(spark, d):
    e = table(spark, d, "embeddings").filter("vec_id % 100 = 0")
    third = F.element_at(F.array(*map(F.lit, TERMS[2:])), (1 + F.floor(F.col("vec_id") / 100) % 3).cast("int"))
    return e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.array(F.lit(TERMS[0]), F.lit(TERMS[1]), third).alias("terms"))


def permitted(spark, d):
    """The ids of `allowed`, computed once for all that a query does with them."""
    return cut(spark, allowed(spark, d).select(F.col("document_id").alias("chunk_id")))


def dense_route(spark, d, k=30, ok=None):
    ok = allowed(spark, d).select(F.col("document_id").alias("chunk_id")) if ok is None else ok
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding").join(ok, "chunk_id", "left_semi")
    return retrieval.dense_topk(chunks, queries_of(spark, d).select("query_id", "q"), k)


def lexical_route(spark, d, k=30, ok=None):
    """By the stored index: the postings of the asked terms alone are read."""
    ok = allowed(spark, d).select(F.col("document_id").alias("chunk_id")) if ok is None else ok
    return indexes.lexical(spark, d).search(queries_of(spark, d).select("query_id", "terms"), k, ok)


def hybrid_route(spark, d, k=8, ok=None):
    ok = permitted(spark, d) if ok is None else ok
    return retrieval.hybrid(dense_route(spark, d, ok=ok), lexical_route(spark, d, ok=ok), k)


@query("m01_dense_route", with_views(f"WITH {ROUTES} SELECT query_id, chunk_id, rank, round(1 - greatest(0.0, least(2.0, dist)), 6) AS similarity FROM dense"))
def _(spark, d):
    return dense_route(spark, d).select("query_id", "chunk_id", "rank", F.round(vectors.similarity(F.col("distance")), 6).alias("similarity"))


@query("m02_lexical_route", with_views(f"WITH {ROUTES} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM lexical"))
def _(spark, d):
    return lexical_route(spark, d).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("m03_reciprocal_rank_fusion", with_views(f"WITH {ROUTES} SELECT query_id, chunk_id, round(rrf, 6) AS rrf, rank FROM best WHERE rank <= 30"))
def _(spark, d):
    return hybrid_route(spark, d, 30).select("query_id", "chunk_id", F.round("rrf", 6).alias("rrf"), "rank")


@query("m16_hybrid_search", with_views(f"WITH {ROUTES} SELECT query_id, chunk_id, round(rrf, 6) AS rrf, rank FROM best WHERE rank <= 8"))
def _(spark, d):
    """The flagship: authorised documents only, dense and lexical top 30, fused, top 8."""
    return hybrid_route(spark, d).select("query_id", "chunk_id", F.round("rrf", 6).alias("rrf"), "rank")


@query("m04_one_generation", with_views("SELECT query_id, candidate_id % 50 AS document_id, count(DISTINCT candidate_id % 3) AS generations FROM ranked WHERE rank <= 40 GROUP BY ALL HAVING count(DISTINCT candidate_id % 3) > 1"))
def _(spark, d):
    rows = view(spark, d, "ranked").filter("rank <= 40").select("query_id", (F.col("candidate_id") % 50).alias("document_id"), (F.col("candidate_id") % 3).alias("generation"))
    return retrieval.one_generation(rows, "document_id", "generation")


HASHED = "CAST(('0x' || substr(sha256(query_id || '|' || candidate_id), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551615.0::DOUBLE"
RERANKED = f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, candidate_id) AS final_rank FROM (SELECT *, 1 / (1 + exp(-(-8.0 + 16.0 * ({HASHED})))) AS score FROM ranked WHERE rank <= 20))"


def reranked(spark, d, k=20):
    pool = view(spark, d, "ranked").filter("rank <= 20").withColumnRenamed("candidate_id", "chunk_id")
    return retrieval.rerank(pool, k)


@query("m05_rerank", with_views(f"SELECT query_id, candidate_id AS chunk_id, final_rank AS rank, round(score, 6) AS score FROM {RERANKED} WHERE final_rank <= 5"))
def _(spark, d):
    return reranked(spark, d, 5).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query("m06_evidence_gate", with_views(f"""
WITH s AS (SELECT query_id, max(CASE WHEN final_rank = 1 THEN score END) AS top, max(CASE WHEN final_rank = 2 THEN score END) AS second FROM {RERANKED} GROUP BY query_id),
k AS (SELECT s.query_id, any_value(top) AS top, any_value(second) AS second, CASE WHEN any_value(top) < 0.3 THEN 0 ELSE least(5, count(*) FILTER (r.score >= greatest(0.3, s.top * 0.9))) END AS kept FROM s JOIN {RERANKED} r ON s.query_id = r.query_id GROUP BY s.query_id)
SELECT query_id, CAST(kept AS INT) AS retained, CASE WHEN kept = 0 THEN 'unsupported' WHEN kept >= 2 AND top < 0.9995 AND top - second <= 0.05 THEN 'uncertain' ELSE 'supported' END AS outcome FROM k
"""))
def _(spark, d):
    return ranking.evidence_gate(reranked(spark, d).select("query_id", "rank", "score"), 0.3, 0.9, 5, 0.9995, 0.05)


ANCHORS = f"{ROUTES}, a AS (SELECT query_id, chunk_id, rank FROM best WHERE rank <= 4)"
CANDIDATES = f"""{ANCHORS}, c AS (SELECT query_id, chunk_id, 'anchor' AS role, rank, 0 AS tier, 0 AS side FROM a UNION ALL SELECT query_id, chunk_id - 1, 'previous', rank, 1, 0 FROM a WHERE chunk_id % 20 > 0 AND chunk_id - 1 IN (SELECT document_id FROM allowed)
  UNION ALL SELECT query_id, chunk_id + 1, 'next', rank, 1, 1 FROM a WHERE chunk_id % 20 < 19 AND chunk_id + 1 IN (SELECT document_id FROM allowed)),
wanted AS (SELECT query_id, chunk_id, role, rank, side, row_number() OVER (PARTITION BY query_id ORDER BY tier, rank, side) AS priority FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY tier, rank, side) AS r FROM c) WHERE r = 1)"""
# admitted one by one in order of priority: a text that repeats or breaks the budget of 4,000 tokens is left out
CONTEXT = f"""{CANDIDATES}, bodies AS (SELECT w.*, trim(d.text, ' ' || chr(9) || chr(10) || chr(13)) AS body, CAST(list_sum(list_transform(regexp_extract_all(d.text, '[\\p{{L}}\\p{{N}}_]+|[^\\s\\p{{Z}}\\p{{L}}\\p{{N}}_]'), lambda x: ceil(length(x) / 4.0))) AS INT) AS tokens FROM wanted w JOIN documents d ON d.doc_id = w.chunk_id),
walk AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS priority, CAST(0 AS BIGINT) AS used, CAST([] AS VARCHAR[]) AS texts, CAST([] AS BIGINT[]) AS ids FROM bodies
  UNION ALL SELECT s.query_id, s.priority + 1, CASE WHEN b.fits THEN s.used + b.tokens ELSE s.used END, CASE WHEN b.fits THEN list_append(s.texts, b.body) ELSE s.texts END, CASE WHEN b.fits THEN list_append(s.ids, b.chunk_id) ELSE s.ids END
  FROM walk s JOIN LATERAL (SELECT b.*, b.body <> '' AND NOT list_contains(s.texts, b.body) AND s.used + b.tokens <= 4000 AS fits FROM bodies b WHERE b.query_id = s.query_id AND b.priority = s.priority + 1) b ON true),
final AS (SELECT query_id, unnest(arg_max(ids, priority)) AS chunk_id FROM walk GROUP BY query_id),
chosen AS (SELECT b.query_id, b.chunk_id, b.role, b.rank, b.tokens, b.body, row_number() OVER (PARTITION BY b.query_id ORDER BY b.rank, CASE b.role WHEN 'previous' THEN 0 WHEN 'anchor' THEN 1 ELSE 2 END) AS position FROM final f JOIN bodies b ON b.query_id = f.query_id AND b.chunk_id = f.chunk_id)"""


def readable(spark, d, ok, wanted=None):
    """Chunks the caller may read: every document as a chunk of a longer one, twenty neighbours make a document.

    Anchors and neighbours are taken from these rows alone, so a chunk that is not allowed is neither shown nor stepped over.
    """
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.floor(F.col("doc_id") / 20).alias("document_id"), (F.col("doc_id") % 20 + 1).cast("int").alias("chunk_index"), F.col("text").alias("body"))
    chunks = chunks if wanted is None else only(chunks, wanted)
    return chunks.join(ok, "chunk_id", "left_semi")


def only(rows, wanted):
    """The rows of the chunks wanted, which are a few of each query: up to `FEW` ids, no other text is shuffled."""
    ids = wanted.select("chunk_id").distinct()
    return rows.join(F.broadcast(ids) if ids.count() <= retrieval.FEW else ids, "chunk_id", "left_semi")


def searched(spark, d):
    """What one search gives all that follows: the chunks that may be read, and its four best of each query with both ranks."""
    ok = permitted(spark, d)
    return ok, cut(spark, hybrid_route(spark, d, 4, ok).select("query_id", "chunk_id", "rank", "rrf", "rank_0", "rank_1"))


def windows(spark, d, ok, found):
    """chunk_id, previous, next of the chunks found: only documents that hold one of them are looked at."""
    chunks = readable(spark, d, ok).drop("body")
    near = J.neighbours(chunks.join(found.select(F.floor(F.col("chunk_id") / 20).alias("document_id")).distinct(), "document_id", "left_semi"), ["document_id"], "chunk_index", "chunk_id")
    return near.select("chunk_id", "previous", "next")


@query("m07_rehydrated_windows", with_views(f"WITH {ANCHORS} SELECT a.query_id, a.chunk_id, p.document_id AS previous, n.document_id AS next FROM a LEFT JOIN allowed p ON p.document_id = a.chunk_id - 1 AND p.document_id // 20 = a.chunk_id // 20 LEFT JOIN allowed n ON n.document_id = a.chunk_id + 1 AND n.document_id // 20 = a.chunk_id // 20"))
def _(spark, d):
    ok, found = searched(spark, d)
    return found.join(windows(spark, d, ok, found), "chunk_id").select("query_id", "chunk_id", "previous", "next")


@query("m08_candidate_priority", with_views(f"WITH {CANDIDATES} SELECT query_id, chunk_id, role, priority FROM wanted"))
def _(spark, d):
    ok, found = searched(spark, d)
    return context.candidates(found, windows(spark, d, ok, found)).select("query_id", "chunk_id", "role", "priority")


def wanted_of(spark, d, ok, found):
    return cut(spark, context.candidates(found, windows(spark, d, ok, found)))


def context_of(spark, d, ok, wanted):
    return context.select_context(wanted.join(readable(spark, d, ok, wanted), "chunk_id").withColumn("overlap_tokens", F.lit(0)))


def built_context(spark, d):
    ok, found = searched(spark, d)
    return context_of(spark, d, ok, wanted_of(spark, d, ok, found))


@query("m10_budgeted_context", with_views(f"WITH RECURSIVE {CONTEXT} SELECT query_id, position, chunk_id, role, tokens FROM chosen"))
def _(spark, d):
    return built_context(spark, d).select("query_id", "position", "chunk_id", "role", "tokens")


@query("j04_search_evidence", with_views(f"""WITH RECURSIVE {CONTEXT} SELECT c.query_id, CAST(c.position AS INT) AS ordinal, '[E' || c.position || ']' AS label, sha256(c.query_id || '|' || c.chunk_id || '|' || sha256(c.body)) AS evidence_id, c.chunk_id, d.source || ' ' || c.chunk_id // 20 AS title, d.lang AS language,
  CAST(c.chunk_id % 20 + 1 AS INT) AS chunk_index, CAST(length(d.text) - length(ltrim(d.text, ' ' || chr(9) || chr(10) || chr(13))) AS INT) AS char_start, CAST(length(rtrim(d.text, ' ' || chr(9) || chr(10) || chr(13))) AS INT) AS char_end, c.role, CAST(c.rank AS INT) AS anchor_rank,
  CAST(x.rank AS INT) AS dense_rank, CAST(y.rank AS INT) AS lexical_rank, round(b.rrf, 6) AS rrf, substr(c.body, 1, 240) AS excerpt
  FROM chosen c JOIN documents d ON d.doc_id = c.chunk_id LEFT JOIN best b ON c.role = 'anchor' AND b.query_id = c.query_id AND b.chunk_id = c.chunk_id LEFT JOIN dense x ON c.role = 'anchor' AND x.query_id = c.query_id AND x.chunk_id = c.chunk_id LEFT JOIN lexical y ON c.role = 'anchor' AND y.query_id = c.query_id AND y.chunk_id = c.chunk_id"""))
def _(spark, d):
    """What a search returns to its caller: evidence in reading order with label, identity, title, locator, ranks of both routes and excerpt."""
    ok, found = searched(spark, d)
    wanted = wanted_of(spark, d, ok, found)
    rows = context_of(spark, d, ok, wanted).withColumn("body_hash", hashing.text_sha256("text"))
    hits = found.select("query_id", "chunk_id", F.lit("anchor").alias("role"), "rrf", "rank_0", "rank_1")
    about = only(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "source", "lang", F.col("text").alias("whole")), wanted)
    full = rows.join(hits, ["query_id", "chunk_id", "role"], "left").join(about, "chunk_id")
    blank = r"[ \t\n\r]+"
    start = F.length("whole") - F.length(F.regexp_replace("whole", f"^{blank}", ""))
    identity = F.sha2(F.concat_ws("|", F.col("query_id").cast("string"), F.col("chunk_id").cast("string"), "body_hash"), 256)
    return full.select(
        "query_id", F.col("position").alias("ordinal"), F.format_string("[E%d]", "position").alias("label"), identity.alias("evidence_id"), "chunk_id", F.concat_ws(" ", "source", F.floor(F.col("chunk_id") / 20).cast("string")).alias("title"), F.col("lang").alias("language"),
        (F.col("chunk_id") % 20 + 1).cast("int").alias("chunk_index"), start.alias("char_start"), F.length(F.regexp_replace("whole", f"{blank}$", "")).alias("char_end"), "role", "anchor_rank",
        F.col("rank_0").cast("int").alias("dense_rank"), F.col("rank_1").cast("int").alias("lexical_rank"), F.round("rrf", 6).alias("rrf"), F.substring("text", 1, 240).alias("excerpt"),
    )


@query("m12_context_identity", with_views(f"WITH RECURSIVE {CONTEXT} SELECT query_id, count(*) AS segments, CAST(sum(tokens) AS BIGINT) AS tokens, sha256(string_agg(chunk_id || ':' || sha256(body), ',' ORDER BY position)) AS context_hash FROM chosen GROUP BY query_id"))
def _(spark, d):
    segment = F.struct("position", F.concat_ws(":", F.col("chunk_id").cast("string"), hashing.text_sha256("text")).alias("s"))
    rows = built_context(spark, d).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(segment)), lambda x: x["s"]), ",").alias("s"), F.count("*").alias("segments"), F.sum("tokens").alias("tokens"))
    return rows.select("query_id", "segments", "tokens", F.sha2("s", 256).alias("context_hash"))


@query("m13_citation_validation", "SELECT event_id, CASE WHEN event_id % 6 IN (2, 3, 4) THEN 'malformed' WHEN event_id % 4 = 0 AND event_id % 6 IN (0) THEN 'label_without_context' WHEN event_id % 6 = 1 THEN 'malformed' WHEN event_id % 4 > 0 AND event_id % 6 = 5 THEN 'label_required' WHEN event_id % 6 = 0 AND event_id % 4 = 1 THEN 'label_out_of_range' ELSE 'valid' END AS status FROM events")
def _(spark, d):
    return marked(spark, d).select("event_id", retrieval.citation_status(F.col("answer"), (F.col("event_id") % 4).cast("int")).alias("status"))


@query("m14_evidence_summaries", with_views(f"WITH {ALLOWED} SELECT g.query_id, count(*) AS evidence, count(DISTINCT g.evidence_id) AS documents FROM golden g JOIN allowed a ON a.document_id = g.evidence_id GROUP BY g.query_id"))
def _(spark, d):
    ev = view(spark, d, "golden").withColumn("document_id", F.col("evidence_id"))
    return ev.join(allowed(spark, d).select("document_id"), "document_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("evidence"), F.countDistinct("document_id").alias("documents"))


@query("m15_reauthorized_sources", with_views(f"WITH {ALLOWED} SELECT g.query_id, count(*) = count(a.document_id) AS unchanged FROM golden g LEFT JOIN allowed a ON a.document_id = g.evidence_id GROUP BY g.query_id"))
def _(spark, d):
    ok = allowed(spark, d).select("document_id").withColumn("ok", F.lit(True))
    ev = view(spark, d, "golden").withColumn("document_id", F.col("evidence_id")).join(ok, "document_id", "left")
    return ev.groupBy("query_id").agg(F.every(F.coalesce("ok", F.lit(False))).alias("unchanged"))


@query("f03_hybrid_truncation", with_views(f"WITH {ROUTES} SELECT query_id, count(*) AS merged, count(*) FILTER (rank <= 8) AS kept FROM best GROUP BY query_id"))
def _(spark, d):
    ok = permitted(spark, d)
    fused = ranking.numbered(ranking.fuse([dense_route(spark, d, ok=ok), lexical_route(spark, d, ok=ok)], ["query_id", "chunk_id"]), ["query_id"], [F.desc("rrf"), F.col("chunk_id")])
    return fused.groupBy("query_id").agg(F.count("*").alias("merged"), F.count_if(F.col("rank") <= 8).alias("kept"))
