"""N05, L13, P10, P24 and P30 with their whole content: audits of chunks, chunk sets, restored runs, offline runners."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import hashing
from quarry.operators import audit, chunking, quality_gate, ranking, retrieval
from quarry.operators import relational as R
from quarry.operators import writes as W
from quarry.plans.documents import marked
from quarry.plans.retrieval import RERANKED, reranked
from quarry.plans.views import view, with_views
from quarry.registry import query
from quarry.session import cut, table


@query("n05_full_audit")
def _(spark, d):
    """Every document's chunks against its blocks: boundaries, heading and image contexts, edges, order and locators."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return audit.audit_structure(docs, cut(spark, chunking.chunk_sources(docs, "doc_id", "text")), "doc_id", "text")


def chunk_sets(spark, d):
    """One row a document: the identity of its chunk set (settings, order, places and bodies) and its statistics."""
    s = chunking.Settings()
    chunks = chunking.chunk_sources(table(spark, d, "documents"), "doc_id", "text", s)
    item = F.concat_ws(":", *[F.col(c).cast("string") for c in ("chunk_index", "char_start", "char_end", "token_count", "overlap_tokens")], hashing.text_sha256("body"))
    rows = chunks.withColumn("item", item).groupBy("doc_id").agg(
        F.count("*").alias("chunks"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"), F.sum("token_count").alias("tokens"), F.sum("overlap_tokens").alias("shared_tokens"), R.joined_in_order(F.col("item"), "chunk_index", "\n").alias("items")
    )
    settings = f"{s.target}/{s.most}/{s.overlap}/{s.heading}\n"
    return rows.withColumn("identity", F.sha2(F.concat(F.lit(settings), "items"), 256)).withColumn("mean_tokens", F.round(F.col("tokens") / F.col("chunks"), 6)).drop("items")


@query("l13_chunk_sets")
def _(spark, d):
    return chunk_sets(spark, d)


@query("p10_chunk_set_states", r"SELECT doc_id, CASE WHEN regexp_matches(text, '[\p{L}\p{N}\p{P}\p{S}]') THEN 'ready' ELSE 'failed' END AS status, CAST(1 AS INT) AS attempt_count, CAST(doc_id % 3 = 0 AS BOOLEAN) AND regexp_matches(text, '[\p{L}\p{N}\p{P}\p{S}]') AS found FROM documents")
def _(spark, d):
    """Chunk sets claimed, completed with the chunks that were made, or failed where there are none; a second request finds the ready ones by identity."""
    docs = table(spark, d, "documents")
    sets = W.claim(docs.select("doc_id", F.lit("pending").alias("status"), F.lit(0).alias("attempt_count")), F.lit(True)).drop("changed")
    made = cut(spark, chunk_sets(spark, d).select("doc_id", "identity", "chunks"))
    results = made.select("doc_id", F.lit(1).alias("expected_attempt"), F.col("chunks").alias("expected_count"), F.col("chunks").alias("actual_count"))
    done = W.complete(sets, results, ["doc_id"]).drop("changed").join(made.select("doc_id", "identity"), "doc_id", "left")
    ended = W.fail(done, F.col("identity").isNull(), F.lit(False)).drop("changed")
    # every third document is asked for again, by the identity its set would have
    again = made.filter("doc_id % 3 = 0").select("doc_id", F.col("identity").alias("asked"))
    same = (F.col("asked") == F.col("identity")) & (F.col("status") == "ready")
    return ended.join(again, "doc_id", "left").select("doc_id", "status", "attempt_count", F.coalesce(same, F.lit(False)).alias("found"))


@query("p24_restored_state", with_views("""
WITH last AS (SELECT root_id, max(run_id) AS version, count(*) FILTER (status IN ('running', 'waiting')) AS open_runs, max(CASE WHEN is_root THEN status END) AS root_status FROM runs GROUP BY root_id),
open_deps AS (SELECT e.task_id FROM task_edges e LEFT JOIN tasks x ON x.task_id = e.depends_on WHERE x.status IS NULL OR x.status <> 'completed'),
board AS (SELECT r.root_id, count(*) FILTER (t.status = 'pending') AS pending, count(*) FILTER (t.status = 'pending' AND t.task_id NOT IN (SELECT task_id FROM open_deps)) AS ready FROM runs r JOIN tasks t ON t.task_id = r.run_id GROUP BY r.root_id)
SELECT l.root_id, l.version, sha256(e.props) AS state_sha256, l.open_runs, coalesce(b.pending, 0) AS pending, coalesce(b.ready, 0) AS ready, coalesce(l.root_status IN ('running', 'waiting'), false) AS resumable
FROM last l JOIN events e ON e.event_id = l.version LEFT JOIN board b ON b.root_id = l.root_id
"""))
def _(spark, d):
    """What a restart finds of each root run: its latest checkpoint with hash, open runs, the task board with what could start, and whether it goes on."""
    runs = view(spark, d, "runs")
    state = table(spark, d, "events").select(F.col("event_id").alias("run_id"), "props")
    last = runs.join(state, "run_id").groupBy("root_id").agg(
        F.max("run_id").alias("version"), F.sha2(F.max_by("props", "run_id"), 256).alias("state_sha256"), F.count_if(F.col("status").isin("running", "waiting")).alias("open_runs"), F.max(F.when(F.col("is_root"), F.col("status"))).alias("root_status")
    )
    tasks = view(spark, d, "tasks")
    waits = view(spark, d, "task_edges").join(tasks.select(F.col("task_id").alias("depends_on"), F.col("status").alias("s")), "depends_on", "left").filter(~F.col("s").eqNullSafe(F.lit("completed"))).select("task_id").distinct()
    pending = tasks.filter("status = 'pending'").join(waits.withColumn("waits", F.lit(True)), "task_id", "left")
    board = pending.join(runs.select(F.col("run_id").alias("task_id"), "root_id"), "task_id").groupBy("root_id").agg(F.count("*").alias("pending"), F.count_if(F.col("waits").isNull()).alias("ready"))
    full = last.join(board, "root_id", "left").na.fill(0, ["pending", "ready"])
    return full.select("root_id", "version", "state_sha256", "open_runs", "pending", "ready", F.coalesce(F.col("root_status").isin("running", "waiting"), F.lit(False)).alias("resumable"))


@query("p30_offline_runners", with_views(rf"""
WITH hits AS (SELECT x.query_id, min(r.rank) AS first, min(CASE WHEN q.final_rank <= 5 THEN q.final_rank END) AS after FROM (SELECT DISTINCT query_id FROM golden) x
  LEFT JOIN (SELECT r.* FROM ranked r JOIN golden g ON r.query_id = g.query_id AND r.candidate_id = g.evidence_id) r ON r.query_id = x.query_id
  LEFT JOIN (SELECT r.* FROM {RERANKED} r JOIN golden g ON r.query_id = g.query_id AND r.candidate_id = g.evidence_id) q ON q.query_id = x.query_id GROUP BY x.query_id),
health AS (SELECT length(regexp_replace(text, '\s', '', 'g')) AS total, length(regexp_replace(regexp_replace(text, '\s', '', 'g'), '[^\p{{L}}\p{{N}}\p{{P}}]', '', 'g')) AS valid FROM documents),
cited AS (SELECT CASE WHEN event_id % 6 IN (2, 3, 4) THEN 'malformed' WHEN event_id % 4 = 0 AND event_id % 6 IN (0) THEN 'label_without_context' WHEN event_id % 6 = 1 THEN 'malformed' WHEN event_id % 4 > 0 AND event_id % 6 = 5 THEN 'label_required' WHEN event_id % 6 = 0 AND event_id % 4 = 1 THEN 'label_out_of_range' ELSE 'valid' END AS status FROM events)
SELECT 'retrieval' AS runner, count(*) AS cases, count(*) FILTER (first <= 5) AS passed, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS rate FROM hits
UNION ALL SELECT 'rerank', count(*), count(*) FILTER (after IS NOT NULL), round(avg(CASE WHEN after IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) FROM hits
UNION ALL SELECT 'parser', count(*), count(*) FILTER (total >= 20 AND valid > 0 AND round(valid / total, 6) >= 0.9), round(avg(CASE WHEN total >= 20 AND valid > 0 AND round(valid / total, 6) >= 0.9 THEN 1.0 ELSE 0.0 END), 6) FROM health
UNION ALL SELECT 'chunk', count(*), count(*), 1.0 FROM documents WHERE regexp_matches(text, '[\p{{L}}\p{{N}}\p{{P}}\p{{S}}]')
UNION ALL SELECT 'citation', count(*), count(*) FILTER (status = 'valid'), round(avg(CASE WHEN status = 'valid' THEN 1.0 ELSE 0.0 END), 6) FROM cited
UNION ALL SELECT 'answer', count(*), count(*) FILTER (value > 50), round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) FROM runs WHERE is_root
"""))
def _(spark, d):
    """Six runners as one report: what share of its cases each passes.

    retrieval and rerank: evidence among the first five; parser: healthy texts; chunk: chunks in order and within the limit; citation: valid labels;
    answer: root runs whose value passes the rule.
    """
    golden = view(spark, d, "golden").withColumnRenamed("evidence_id", "candidate_id")
    cases = golden.select("query_id").distinct()

    def hit(ranked, rank):
        return cases.join(ranked.join(golden, ["query_id", "candidate_id"]).groupBy("query_id").agg(F.min(rank).alias("first")), "query_id", "left").select(F.coalesce(F.col("first") <= 5, F.lit(False)).alias("passed"))

    docs = table(spark, d, "documents")
    chunks = chunking.chunk_sources(docs, "doc_id", "text").groupBy("doc_id").agg(((F.max("chunk_index") == F.count("*")) & F.every(F.col("token_count") <= chunking.Settings().most)).alias("passed"))
    parts = {
        "retrieval": hit(view(spark, d, "ranked"), "rank"),
        "rerank": hit(reranked(spark, d, 5).withColumn("candidate_id", F.col("chunk_id")).drop("chunk_id"), "rank"),
        "parser": quality_gate.text_health(docs, "text").select((F.col("status") == "healthy").alias("passed")),
        "chunk": chunks.select("passed"),
        "citation": marked(spark, d).select((retrieval.citation_status(F.col("answer"), (F.col("event_id") % 4).cast("int")) == "valid").alias("passed")),
        "answer": view(spark, d, "runs").filter("is_root").select((F.col("value") > 50).alias("passed")),
    }
    report = None
    for name, rows in parts.items():
        part = rows.agg(F.count("*").alias("cases"), F.count_if("passed").alias("passed")).select(F.lit(name).alias("runner"), "cases", "passed", F.round(ranking.ratio(F.col("passed"), F.col("cases")), 6).alias("rate"))
        report = part if report is None else report.unionByName(part)
    return report
