"""Operators of several sections that the other modules do not register by their own name."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text, vectors
from quarry.operators import chunking, context, quality_gate, ranking, retrieval, tools
from quarry.operators import joins as J
from quarry.operators import relational as R
from quarry.operators import writes as W
from quarry.plans.documents import LINES, lines
from quarry.plans.relational import read_range, sheet
from quarry.plans.retrieval import CONTEXT, RERANKED, ROUTES, built_context, lexical_route, reranked
from quarry.plans.views import view, with_views
from quarry.registry import query
from quarry.session import table
from quarry.sources import files


@query("a06_csv_source", "SELECT 'r' || n_regionkey || '.csv' AS path, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INT) AS row_number, n_nationkey || '|' || n_name || '|x;y' AS cells FROM nation")
def _(spark, d):
    line = F.concat_ws(";", F.col("n_nationkey").cast("string"), "n_name", F.lit('"x;y"'))
    made = table(spark, d, "nation").groupBy("n_regionkey").agg(R.joined_in_order(line, "n_nationkey", "\n").alias("body"))
    source = made.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".csv")).alias("path"), F.col("body").cast("binary").alias("content"))
    return files.blocks(source).select("path", "row_number", F.array_join("cells", "|").alias("cells"))


@query("a13_object_keys", r"SELECT doc_id, regexp_matches(k, '^[a-z0-9][a-z0-9._-]*(/[a-z0-9][a-z0-9._-]*)*$') AND NOT regexp_matches(k, '(^|/)\.{1,2}(/|$)') AS valid FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'tenant/' || lang || '/' || doc_id WHEN 1 THEN '../' || doc_id WHEN 2 THEN 'a//' || doc_id ELSE upper(lang) END AS k FROM documents)")
def _(spark, d):
    i, key = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    k = F.when(key == 0, F.concat(F.lit("tenant/"), "lang", F.lit("/"), i)).when(key == 1, F.concat(F.lit("../"), i)).when(key == 2, F.concat(F.lit("a//"), i)).otherwise(F.upper("lang"))
    return table(spark, d, "documents").select("doc_id", (k.rlike(r"^[a-z0-9][a-z0-9._-]*(/[a-z0-9][a-z0-9._-]*)*$") & ~k.rlike(r"(^|/)\.{1,2}(/|$)")).alias("valid"))


@query("a19_golden_cases", "SELECT event_id AS case_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 7 <> 0 AS should_answer FROM events")
def _(spark, d):
    line = F.concat(F.lit('{"case_id":'), F.col("event_id").cast("string"), F.lit(',"should_answer":'), (F.col("event_id") % 7 != 0).cast("string"), F.lit(',"extra":'), "props", F.lit("}"))
    rows = table(spark, d, "events").select(F.from_json(line, "case_id long, should_answer boolean, extra struct<k:long>").alias("c"))
    return rows.select("c.case_id", F.col("c.extra.k").alias("k"), "c.should_answer")


@query("e04_adjacent_rows", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN lag(l_linenumber) OVER w = l_linenumber - 1 THEN lag(l_partkey) OVER w END AS previous, CASE WHEN lead(l_linenumber) OVER w = l_linenumber + 1 THEN lead(l_partkey) OVER w END AS next
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)
""")
def _(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    return J.neighbours(rows, ["l_orderkey"], "l_linenumber", "l_partkey")


@query("e09_carried_heading", f"SELECT doc_id, i, last_value(CASE WHEN length(line) <= 25 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS heading FROM {LINES}")
def _(spark, d):
    w = Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return lines(spark, d).select("doc_id", "i", F.last(F.when(F.length("line") <= 25, F.col("line")), ignorenulls=True).over(w).alias("heading"))


@query("e10_window_statistics")
def _(spark, d):
    """Chunks, tokens and shared tokens per document under the default settings."""
    rows = chunking.chunk_texts(table(spark, d, "documents"), "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"), F.sum("overlap_tokens").alias("shared"))


@query("f02_lexical_topk", with_views(f"WITH {ROUTES} SELECT query_id, chunk_id, rank FROM lexical WHERE rank <= 5"))
def _(spark, d):
    return lexical_route(spark, d, 5).select("query_id", "chunk_id", "rank")


@query("f04_rerank_topk", with_views(f"SELECT query_id, candidate_id AS chunk_id, final_rank AS rank FROM {RERANKED} WHERE final_rank <= 3"))
def _(spark, d):
    return reranked(spark, d, 3).select("query_id", "chunk_id", "rank")


@query("h11_older_summary", "SELECT conv_id, substr(string_agg(role || ': ' || substr(text, 1, 240), ' | ' ORDER BY turn), 1, 2000) AS summary FROM conversations GROUP BY conv_id")
def _(spark, d):
    part = F.concat("role", F.lit(": "), F.substring("text", 1, 240))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.substring(R.joined_in_order(part, "turn", " | "), 1, 2000).alias("summary"))


@query("h20_cosine", "SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(b, "vec_id").select("vec_id", F.round(vectors.similarity(vectors.cosine_distance(F.col("embedding"), F.col("b"))), 6).alias("similarity"))


@query("h22_lexical_score", r"SELECT doc_id, round(0.1 * n / (0.1 * n + 1), 6) AS score FROM (SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: x IN ('the', 'des', 'que'))) AS n FROM documents) WHERE n > 0")
def _(spark, d):
    n = F.size(F.filter(text.tokens(F.col("text")), lambda x: x.isin("the", "des", "que")))
    return table(spark, d, "documents").withColumn("n", n).filter("n > 0").select("doc_id", F.round(retrieval.lexical_score(F.col("n")), 6).alias("score"))


@query("j04_search_knowledge", with_views(f"WITH RECURSIVE {CONTEXT} SELECT query_id, position, chunk_id, role, tokens FROM chosen"))
def _(spark, d):
    """Hybrid search, its best chunks as context with neighbours, all of them authorised, budgeted and in reading order."""
    return built_context(spark, d).select("query_id", "position", "chunk_id", "role", "tokens")


@query("j05_read_uploaded_file", "SELECT o_orderkey AS row_number, o_orderstatus || '|' || o_orderpriority AS cells, length(o_orderstatus || o_orderpriority) AS characters FROM orders WHERE o_orderkey BETWEEN 10 AND 20")
def _(spark, d):
    rows = read_range(sheet(spark, d), "B10:C20")
    return rows.select("row_number", F.array_join("cells", "|").alias("cells"), F.length(F.array_join("cells", "")).cast("long").alias("characters"))


@query("j08_capabilities", with_views("SELECT role_name, count(DISTINCT user_id) AS users, CASE WHEN role_name IN ('viewer') THEN 'search_knowledge' ELSE 'get_evidence_detail,get_product_spec,read_uploaded_file,search_inventory,search_knowledge' END AS tools FROM user_roles GROUP BY role_name"))
def _(spark, d):
    roles = view(spark, d, "user_roles").groupBy("role_name").agg(F.countDistinct("user_id").alias("users"))
    grants = [(r, t.name) for r in ("viewer", "other") for t in tools.TOOLS if r == "other" or t.name == "search_knowledge"]
    policy = spark.createDataFrame(grants, "kind string, tool string")  # a fixed table of a few rows
    full = roles.withColumn("kind", F.when(F.col("role_name") == "viewer", "viewer").otherwise("other")).join(F.broadcast(policy), "kind")
    return full.groupBy("role_name", "users").agg(F.array_join(F.sort_array(F.collect_set("tool")), ",").alias("tools"))


BLANK = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+"


@query("m09_overlap_trim", rf"SELECT doc_id, sha256(t) AS digest FROM (SELECT doc_id, regexp_replace(nfc_normalize(text), '{BLANK}', '', 'g') AS t FROM documents) WHERE t <> ''")
def _(spark, d):
    """Chunks of a document without what they share with the chunk before, joined: the document but for white space."""
    own = context.trim_chunks(chunking.chunk_texts(table(spark, d, "documents"), "doc_id", "text"), "doc_id")
    whole = F.regexp_replace(R.joined_in_order(F.coalesce("text", F.lit("lost")), "chunk_index", ""), BLANK, "")
    return own.groupBy("doc_id").agg(F.sha2(whole, 256).alias("digest"))


@query("m11_natural_order", with_views(f"WITH RECURSIVE {CONTEXT} SELECT query_id, position, rank AS anchor_rank, true AS in_order FROM chosen"))
def _(spark, d):
    w = Window.partitionBy("query_id").orderBy("position")
    return built_context(spark, d).select("query_id", "position", "anchor_rank", (F.coalesce(F.lag("anchor_rank").over(w), F.lit(0)) <= F.col("anchor_rank")).alias("in_order"))


@query("p04_created_documents", with_views("SELECT d.document_id, min(v.version_no) AS first_version, count(*) AS versions FROM docs d JOIN versions v ON v.document_id = d.document_id GROUP BY d.document_id"))
def _(spark, d):
    return view(spark, d, "docs").select("document_id").join(view(spark, d, "versions"), "document_id").groupBy("document_id").agg(F.min("version_no").alias("first_version"), F.count("*").alias("versions"))


@query("p09_parse_transitions", with_views("SELECT version_id, CASE WHEN parse_status = 'failed' THEN 'parsing' ELSE parse_status END AS status FROM versions"))
def _(spark, d):
    rows = view(spark, d, "versions").select("version_id", F.col("parse_status").alias("status"), F.lit(0).alias("attempt_count"))
    return W.claim(rows, F.lit(True), free=("failed",), working="parsing").select("version_id", "status")


@query("p10_chunk_sets", "SELECT source, lang, count(*) AS chunks, CASE WHEN count(*) > 5 THEN 'ready' ELSE 'pending' END AS status FROM documents GROUP BY source, lang")
def _(spark, d):
    rows = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("chunks"))
    return rows.withColumn("status", F.when(F.col("chunks") > 5, "ready").otherwise("pending"))


@query("p11_active_versions", with_views("SELECT d.document_id, v.version_id IS NOT NULL AND v.parse_status = 'ready' AS active_ready FROM docs d LEFT JOIN versions v ON v.version_id = d.active_version_id"))
def _(spark, d):
    v = view(spark, d, "versions").select(F.col("version_id").alias("active_version_id"), "parse_status")
    return view(spark, d, "docs").join(v, "active_version_id", "left").select("document_id", F.coalesce(F.col("parse_status") == "ready", F.lit(False)).alias("active_ready"))


@query("p16_latest_checkpoint", "SELECT user_id, max(event_id) AS version, arg_max(props, event_id) AS state FROM events GROUP BY user_id")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("version"), F.max_by("props", "event_id").alias("state"))


@query("p20_context_calls", with_views("SELECT run_id, count(*) AS calls, min(call_id) AS first_call FROM tool_calls WHERE tool = 'search_knowledge' AND status = 'succeeded' GROUP BY run_id"))
def _(spark, d):
    return view(spark, d, "tool_calls").filter("tool = 'search_knowledge' AND status = 'succeeded'").groupBy("run_id").agg(F.count("*").alias("calls"), F.min("call_id").alias("first_call"))


@query("p22_evidence_in_tenant", with_views("SELECT g.evidence_id, d.tenant_id FROM (SELECT DISTINCT evidence_id FROM golden) g JOIN docs d ON d.document_id = g.evidence_id WHERE d.tenant_id = 'T0'"))
def _(spark, d):
    docs = view(spark, d, "docs").filter("tenant_id = 'T0'").select(F.col("document_id").alias("evidence_id"), "tenant_id")
    return view(spark, d, "golden").select("evidence_id").distinct().join(docs, "evidence_id")


STALLED = "status = 'running'"


@query("p26_no_progress", with_views(f"""
SELECT r.user_id, count(*) AS results, min(s.stopped_at) AS stopped_at FROM runs r
LEFT JOIN (SELECT user_id, min(run_id) AS stopped_at FROM (SELECT user_id, run_id, {STALLED} AND lag({STALLED}) OVER (PARTITION BY user_id ORDER BY run_id) AS again FROM runs) WHERE again GROUP BY user_id) s ON s.user_id = r.user_id
WHERE s.stopped_at IS NULL OR r.run_id <= s.stopped_at GROUP BY r.user_id
"""))
def _(spark, d):
    """Results each user's worker gives until two in a row show no progress, and the one that ended it."""
    rows = tools.until_stalled(view(spark, d, "runs"), ["user_id"], "run_id", ~F.expr(STALLED))
    return rows.groupBy("user_id").agg(F.count("*").alias("results"), F.min(F.when(F.col("stopped"), F.col("run_id"))).alias("stopped_at"))


@query("p26_repeated_handoffs", with_views("SELECT r.root_id, c.tool, c.props, count(*) AS handoffs, count(*) - 1 AS refused FROM tool_calls c JOIN runs r ON r.run_id = c.run_id GROUP BY r.root_id, c.tool, c.props"))
def _(spark, d):
    calls = view(spark, d, "tool_calls").join(view(spark, d, "runs").select("run_id", "root_id"), "run_id")
    rows = tools.repeated_handoffs(calls, ["root_id"], "call_id", F.to_json(F.struct("tool", "props")))
    return rows.groupBy("root_id", "tool", "props").agg(F.count("*").alias("handoffs"), F.count_if("refused").alias("refused"))


@query("p28_review_values", """
SELECT event_id, '{"items": ["[REDACTED]", {"n": ' || event_id || '}], "note": "' || CASE event_id % 4 WHEN 0 THEN '[REDACTED]' WHEN 1 THEN 'plain ' || event_type WHEN 2 THEN '[REDACTED]' ELSE 'sql select' END || '", "props": {"k": ' || json_extract_string(props, '$.k') || '}}' AS shown FROM events
""")
def _(spark, d):
    """Review values: private fields gone at any depth, suspicious texts hidden."""
    n = F.col("event_id") % 4
    note = F.when(n == 0, "see Bearer abc").when(n == 1, F.concat(F.lit("plain "), "event_type")).when(n == 2, "Select a from b").otherwise("sql select")
    number = F.col("event_id").cast("string")
    value = F.concat(F.lit('{"note": "'), note, F.lit('", "user_id": '), F.col("user_id").cast("string"), F.lit(', "Stack": [1], "items": ["/home/a/b", {"n": '), number, F.lit(', "SQL": "x"}], "props": '), "props", F.lit("}"))
    return table(spark, d, "events").select("event_id", quality_gate.review_values(value).alias("shown"))


@query("p30_retrieval_runner", with_views("""
SELECT k, round(avg(CASE WHEN first <= k THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(avg(CASE WHEN first <= 10 THEN 1.0 / first ELSE 0.0 END), 6) AS mrr
FROM (SELECT g.query_id, min(r.rank) AS first FROM (SELECT DISTINCT query_id FROM golden) g LEFT JOIN (SELECT r.* FROM ranked r JOIN golden x ON r.query_id = x.query_id AND r.candidate_id = x.evidence_id) r ON r.query_id = g.query_id GROUP BY g.query_id), (SELECT unnest([5, 10, 20]) AS k) GROUP BY k
"""))
def _(spark, d):
    suite = ranking.ranking_suite(view(spark, d, "ranked"), view(spark, d, "golden"), (5, 10, 20))
    return suite.groupBy(F.col("cutoff").alias("k")).agg(F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))


@query("p24_runtime_restore", with_views("SELECT root_id, count(*) FILTER (status IN ('running', 'waiting')) AS open_runs, count(*) FILTER (status = 'completed') AS completed FROM runs GROUP BY root_id"))
def _(spark, d):
    s = F.col("status")
    return view(spark, d, "runs").groupBy("root_id").agg(F.count_if(s.isin("running", "waiting")).alias("open_runs"), F.count_if(s == "completed").alias("completed"))


@query("o01_replayed_requests", with_views("SELECT run_id, tool, min(call_id) AS answered_by, count(*) - 1 AS replays FROM tool_calls WHERE status = 'succeeded' GROUP BY run_id, tool"))
def _(spark, d):
    return view(spark, d, "tool_calls").filter("status = 'succeeded'").groupBy("run_id", "tool").agg(F.min("call_id").alias("answered_by"), (F.count("*") - 1).alias("replays"))


@query("o03_inventory_graph", with_views("SELECT v.sku, CASE WHEN count(s.snapshot_id) = 0 THEN 'not_found' WHEN count(DISTINCT s.warehouse_id) > 1 THEN 'ambiguous' ELSE 'found' END AS status FROM variants v LEFT JOIN snapshots s ON s.variant_id = v.variant_id AND s.tenant_id = 'T1' GROUP BY v.sku"))
def _(spark, d):
    stock = view(spark, d, "snapshots").filter("tenant_id = 'T1'").groupBy("variant_id").agg(F.count("*").alias("n"), F.countDistinct("warehouse_id").alias("w"))
    full = view(spark, d, "variants").select("variant_id", "sku").join(stock, "variant_id", "left")
    return full.select("sku", F.when(F.col("n").isNull(), "not_found").when(F.col("w") > 1, "ambiguous").otherwise("found").alias("status"))


