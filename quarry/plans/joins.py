"""Section C: joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.operators import joins as J
from quarry.operators import ranking
from quarry.operators import relational as R
from quarry.plans.relational import live_versions
from quarry.plans.views import view, with_views
from quarry.registry import query
from quarry.session import table

LIVE = "d.document_id = v.document_id AND d.active_version_id = v.version_id AND NOT d.is_deleted AND v.parse_status = 'ready' AND v.index_status = 'ready'"
FILE = "f.file_id = v.file_id AND f.tenant_id = d.tenant_id AND NOT f.is_deleted AND f.status <> 'soft_deleted'"


@query("c01_authorized_chunks", with_views(f"""
SELECT e.vec_id AS chunk_id, d.document_id, v.version_id, f.extension FROM embeddings e JOIN docs d ON e.vec_id = d.document_id JOIN versions v ON {LIVE} JOIN files f ON {FILE} WHERE d.tenant_id = 'T1'
"""))
def _(spark, d):
    chunks = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("document_id"))
    return chunks.join(live_versions(spark, d).filter("tenant_id = 'T1'"), "document_id").select("chunk_id", "document_id", "version_id", "extension")


def latest_stock(spark, d):
    """The newest snapshots of each variant and warehouse, joined to their names, ties kept."""
    top = R.latest(view(spark, d, "snapshots"), ["tenant_id", "variant_id", "warehouse_id"], "snapshot_at")
    w = view(spark, d, "warehouses").filter("status = 'active'").select("tenant_id", "warehouse_id", "code", "market_code")
    v = view(spark, d, "variants").filter("status = 'active'").select("variant_id", "sku", "spu")
    return R.available(top).join(w, ["tenant_id", "warehouse_id"]).join(v, "variant_id")


LATEST = """(SELECT s.* FROM snapshots s JOIN (SELECT tenant_id, variant_id, warehouse_id, max(snapshot_at) AS t FROM snapshots GROUP BY ALL) m
  ON s.tenant_id = m.tenant_id AND s.variant_id = m.variant_id AND s.warehouse_id = m.warehouse_id AND s.snapshot_at = m.t)"""


@query("c02_latest_stock", with_views(f"""
SELECT s.snapshot_id, v.sku, w.code, w.market_code, s.on_hand - s.reserved - s.unsellable AS available FROM {LATEST} s JOIN warehouses w ON s.warehouse_id = w.warehouse_id AND s.tenant_id = w.tenant_id AND w.status = 'active'
JOIN variants v ON s.variant_id = v.variant_id AND v.status = 'active'
"""))
def _(spark, d):
    return latest_stock(spark, d).select("snapshot_id", "sku", "code", "market_code", "available")


@query("c03_product_resolve", with_views("""
WITH x AS (SELECT sku AS q FROM variants UNION SELECT spu FROM variants UNION SELECT upper(name_en) FROM variants)
SELECT q, variant_id, p FROM (SELECT *, rank() OVER (PARTITION BY q ORDER BY p) AS r FROM (
  SELECT q, variant_id, min(p) AS p FROM (SELECT x.q, v.variant_id, 1 AS p FROM x JOIN variants v ON v.sku = x.q UNION ALL SELECT x.q, v.variant_id, 2 FROM x JOIN variants v ON lower(v.name_en) = lower(x.q)
  UNION ALL SELECT x.q, v.variant_id, 3 FROM x JOIN variants v ON v.spu = x.q) GROUP BY ALL)) WHERE r = 1
"""))
def _(spark, d):
    v = view(spark, d, "variants")
    asked = v.select(F.col("sku").alias("q")).union(v.select("spu")).union(v.select(F.upper("name_en"))).distinct()
    # one equality join per kind of match, never a join on an OR
    hits = asked.join(v, F.col("q") == F.col("sku")).select("q", "variant_id", F.lit(1).alias("p"))
    hits = hits.unionByName(asked.join(v, F.lower("q") == F.lower("name_en")).select("q", "variant_id", F.lit(2).alias("p")))
    hits = hits.unionByName(asked.join(v, F.col("q") == F.col("spu")).select("q", "variant_id", F.lit(3).alias("p")))
    return R.by_priority(hits, ["q"], "p").select("q", "variant_id", "p").distinct()


@query("c04_identity", with_views("SELECT u.user_id, u.status, r.role_name FROM users u LEFT JOIN user_roles r ON u.user_id = r.user_id"))
def _(spark, d):
    return view(spark, d, "users").join(view(spark, d, "user_roles"), "user_id", "left").select("user_id", "status", "role_name")


@query("c05_live_documents", with_views("SELECT document_id FROM docs d WHERE NOT is_deleted AND EXISTS (SELECT 1 FROM versions v WHERE v.document_id = d.document_id AND v.parse_status = 'ready')"))
def _(spark, d):
    return view(spark, d, "docs").filter("NOT is_deleted").join(view(spark, d, "versions").filter("parse_status = 'ready'"), "document_id", "left_semi").select("document_id")


@query("c06_unlinked_files", with_views("SELECT f.file_id FROM files f WHERE f.status = 'uploaded' AND NOT f.is_deleted AND NOT EXISTS (SELECT 1 FROM versions v WHERE v.file_id = f.file_id AND v.version_no = 2)"))
def _(spark, d):
    linked = view(spark, d, "versions").filter("version_no = 2").select("file_id")
    return view(spark, d, "files").filter("status = 'uploaded' AND NOT is_deleted").join(linked, "file_id", "left_anti").select("file_id")


@query("c07_file_visibility", with_views("""
SELECT f.file_id FROM files f WHERE (NOT EXISTS (SELECT 1 FROM versions v WHERE v.file_id = f.file_id AND v.version_no = 2) AND f.owner_id = 7)
  OR EXISTS (SELECT 1 FROM versions v JOIN docs d ON d.document_id = v.document_id WHERE v.file_id = f.file_id AND v.version_no = 2 AND d.owner_id % 10 = 7)
"""))
def _(spark, d):
    links = view(spark, d, "versions").filter("version_no = 2").join(view(spark, d, "docs").select("document_id", F.col("owner_id").alias("o")), "document_id")
    flags = links.groupBy("file_id").agg(F.bool_or(F.col("o") % 10 == 7).alias("reachable"))
    return view(spark, d, "files").join(flags, "file_id", "left").filter((F.col("reachable").isNull() & (F.col("owner_id") == 7)) | F.coalesce("reachable", F.lit(False))).select("file_id")


@query("c08_file_versions", with_views("SELECT f.file_id, v.version_id, v.version_id = d.active_version_id AS is_active FROM files f JOIN versions v ON f.file_id = v.file_id JOIN docs d ON d.document_id = v.document_id AND d.tenant_id = f.tenant_id"))
def _(spark, d):
    full = view(spark, d, "files").select("file_id", "tenant_id").join(view(spark, d, "versions"), "file_id").join(view(spark, d, "docs").select("document_id", "tenant_id", "active_version_id"), ["document_id", "tenant_id"])
    return full.select("file_id", "version_id", (F.col("version_id") == F.col("active_version_id")).alias("is_active"))


@query("c09_neighbours", "SELECT c.conv_id, c.turn, p.turn AS previous, n.turn AS next FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 AND p.turn % 5 <> 3 LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1 AND n.turn % 5 <> 3 WHERE c.turn % 5 <> 3")
def _(spark, d):
    rows = table(spark, d, "conversations").filter("turn % 5 <> 3").withColumn("v", F.col("turn"))  # with gaps
    return J.neighbours(rows, ["conv_id"], "turn", "v").select("conv_id", "turn", "previous", "next")


@query("c10_merge_ranked", """
SELECT coalesce(a.k, b.k) AS k, a.rank AS rank_a, b.rank AS rank_b, coalesce(a.f <> b.f, false) AS conflict FROM (SELECT vec_id AS k, CAST(row_number() OVER (ORDER BY vec_id) AS INT) AS rank, label AS f FROM embeddings WHERE vec_id % 3 = 0) a
FULL OUTER JOIN (SELECT vec_id AS k, CAST(row_number() OVER (ORDER BY vec_id DESC) AS INT) AS rank, CASE WHEN vec_id % 7 = 0 THEN -1 ELSE label END AS f FROM embeddings WHERE vec_id % 4 = 0) b ON a.k = b.k
""")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("k"), F.col("label").alias("f"))
    a = ranking.positions(e.filter("k % 3 = 0"), [F.col("k")])
    b = ranking.positions(e.filter("k % 4 = 0"), [F.desc("k")]).withColumn("f", F.when(F.col("k") % 7 == 0, -1).otherwise(F.col("f")))
    return J.merge_ranked(a, b, ["k"], ["f"]).select("k", "rank_a", "rank_b", "conflict")


@query("c10_merged_lists", """
SELECT a.k, a.rank AS rank_a, b.rank AS rank_b, a.f <> b.f AS conflict FROM (SELECT doc_id AS k, CAST(row_number() OVER (ORDER BY n_chars, doc_id) AS INT) AS rank, lang AS f FROM documents) a
JOIN (SELECT doc_id AS k, CAST(row_number() OVER (ORDER BY source, doc_id DESC) AS INT) AS rank, CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE lang END AS f FROM documents) b ON a.k = b.k
""")
def _(spark, d):
    """Two orders of all documents as ranked lists, merged; facts differ for each seventh."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("k"), F.col("lang").alias("f"), "n_chars", "source")
    a = ranking.positions(rows.select("k", "f", "n_chars"), [F.col("n_chars"), F.col("k")]).drop("n_chars")
    b = ranking.positions(rows.select("k", "f", "source"), [F.col("source"), F.desc("k")]).drop("source")
    b = b.withColumn("f", F.when(F.col("k") % 7 == 0, "xx").otherwise(F.col("f")))
    return J.merge_ranked(a, b, ["k"], ["f"]).select("k", "rank_a", "rank_b", "conflict")


@query("c11_authorized_evidence", with_views(f"SELECT g.query_id, g.evidence_id FROM golden g JOIN docs d ON d.document_id = g.evidence_id JOIN versions v ON {LIVE} JOIN files f ON {FILE}"))
def _(spark, d):
    ev = view(spark, d, "golden").withColumn("document_id", F.col("evidence_id"))
    return ev.join(live_versions(spark, d), "document_id").select("query_id", "evidence_id")


@query("c12_evidence_detail", with_views(f"SELECT g.query_id, g.evidence_id, d.document_type AS title FROM golden g JOIN docs d ON d.document_id = g.evidence_id JOIN versions v ON {LIVE} JOIN files f ON {FILE} JOIN documents t ON t.doc_id = d.document_id AND t.source = d.document_type AND t.n_chars = f.size_bytes"))
def _(spark, d):
    ev = view(spark, d, "golden").withColumn("document_id", F.col("evidence_id"))
    facts = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "source", "n_chars")
    full = ev.join(live_versions(spark, d), "document_id").join(facts, "document_id").filter("source = document_type AND n_chars = size_bytes")
    return full.select("query_id", "evidence_id", F.col("document_type").alias("title"))


@query("c13_owned_messages", "SELECT m.conv_id, m.turn FROM conversations m JOIN (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 5 = 2) t ON m.conv_id = t.conv_id")
def _(spark, d):
    m = table(spark, d, "conversations").select("conv_id", "turn")
    return m.join(m.filter("conv_id % 5 = 2").select("conv_id").distinct(), "conv_id")


@query("c14_tools_of_runs", with_views("SELECT r.root_id, string_agg(tool, ',' ORDER BY first) AS tools FROM (SELECT r.root_id, c.tool, min(c.call_id) AS first FROM tool_calls c JOIN runs r ON c.run_id = r.run_id GROUP BY ALL) r GROUP BY r.root_id"))
def _(spark, d):
    calls = view(spark, d, "tool_calls").join(view(spark, d, "runs").select("run_id", "root_id"), "run_id")
    first = calls.groupBy("root_id", "tool").agg(F.min("call_id").alias("first"))
    return first.groupBy("root_id").agg(R.joined_in_order(F.col("tool"), "first", ",").alias("tools"))


@query("c15_chunk_vectors", "SELECT d.doc_id AS chunk_id, e.vec_id IS NOT NULL AND len(e.embedding) = 64 AS valid FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def _(spark, d):
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"))
    vec = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.size("embedding").alias("n"))
    return chunks.join(vec, "chunk_id", "left").select("chunk_id", (F.coalesce("n", F.lit(0)) == 64).alias("valid"))


SPANS = "(SELECT doc_id, doc_id * 3 % 700 AS s0, doc_id * 3 % 700 + 180 AS s1 FROM documents)"
CHUNKS = "(SELECT doc_id, i AS chunk, i * 400 AS c0, least((i + 1) * 400 + 60, n_chars) AS c1 FROM (SELECT doc_id, n_chars, unnest(range((n_chars - 1) // 400 + 1)) AS i FROM documents WHERE n_chars > 0))"


def spans_and_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    start = F.col("doc_id") * 3 % 700
    spans = docs.select("doc_id", start.alias("s0"), (start + 180).alias("s1"))
    i = F.col("chunk")
    chunks = docs.filter("n_chars > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_chars") - 1) / 400)))).select("doc_id", i, (i * 400).alias("c0"), F.least((i + 1) * 400 + 60, F.col("n_chars")).alias("c1"))
    return spans, chunks


@query("c16_span_containment", f"SELECT s.doc_id, c.chunk, least(s.s1, c.c1) - greatest(s.s0, c.c0) AS shared, c.c0 <= s.s0 AND s.s1 <= c.c1 AS contained FROM {SPANS} s JOIN {CHUNKS} c ON s.doc_id = c.doc_id AND s.s0 < c.c1 AND c.c0 < s.s1")
def _(spark, d):
    met = J.covered_spans(*spans_and_chunks(spark, d), "doc_id", 1000)
    return met.select("doc_id", "chunk", J.overlap(F.col("s0"), F.col("s1"), F.col("c0"), F.col("c1")).alias("shared"), ((F.col("c0") <= F.col("s0")) & (F.col("s1") <= F.col("c1"))).alias("contained"))


@query("c17_golden_map", f"SELECT doc_id, chunk, string_agg(DISTINCT CAST(part AS VARCHAR), ',' ORDER BY CAST(part AS VARCHAR)) AS covered FROM (SELECT s.doc_id, s.part, c.chunk FROM (SELECT doc_id, 0 AS part, s0, s0 + 90 AS s1 FROM {SPANS} UNION ALL SELECT doc_id, 1, s0 + 90, s1 FROM {SPANS}) s JOIN {CHUNKS} c ON s.doc_id = c.doc_id AND c.c0 <= s.s0 AND s.s1 <= c.c1) GROUP BY doc_id, chunk")
def _(spark, d):
    spans, chunks = spans_and_chunks(spark, d)
    parts = spans.select("doc_id", F.lit(0).alias("part"), "s0", (F.col("s0") + 90).alias("s1")).unionByName(spans.select("doc_id", F.lit(1).alias("part"), (F.col("s0") + 90).alias("s0"), "s1"))
    met = J.covered_spans(parts, chunks, "doc_id", 1000).filter("c0 <= s0 AND s1 <= c1")
    return met.groupBy("doc_id", "chunk").agg(F.array_join(F.sort_array(F.collect_set(F.col("part").cast("string"))), ",").alias("covered"))


@query("c18_citation_labels", with_views("SELECT c.call_id, g.evidence_id FROM (SELECT call_id, call_id - call_id % 100 AS query_id, 1 + call_id % 14 AS ordinal FROM tool_calls) c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY evidence_id) AS ordinal FROM golden) g ON c.query_id = g.query_id AND c.ordinal = g.ordinal"))
def _(spark, d):
    cited = view(spark, d, "tool_calls").select("call_id", (F.col("call_id") - F.col("call_id") % 100).alias("query_id"), (1 + F.col("call_id") % 14).alias("ordinal"))
    allowed = view(spark, d, "golden").withColumn("ordinal", F.row_number().over(Window.partitionBy("query_id").orderBy("evidence_id")))
    return cited.join(allowed, ["query_id", "ordinal"], "left").select("call_id", "evidence_id")


@query("c19_ready_tasks", with_views("""
SELECT plan_id, task_id FROM (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY task_id) AS s FROM (
  SELECT t.*, row_number() OVER (PARTITION BY plan_id, worker ORDER BY task_id) AS r FROM tasks t WHERE status = 'pending'
  AND NOT EXISTS (SELECT 1 FROM task_edges e LEFT JOIN tasks p ON p.task_id = e.depends_on WHERE e.task_id = t.task_id AND p.status IS DISTINCT FROM 'completed')) WHERE r = 1) WHERE s <= 2
"""))
def _(spark, d):
    return J.ready_tasks(view(spark, d, "tasks"), view(spark, d, "task_edges"), 2).select("plan_id", "task_id")


@query("c20_trusted_anchors", with_views("SELECT r.query_id, r.candidate_id FROM ranked r LEFT JOIN (SELECT document_id FROM docs WHERE NOT is_deleted) d ON d.document_id = r.candidate_id WHERE r.rank <= 5 AND d.document_id IS NULL"))
def _(spark, d):
    trusted = view(spark, d, "docs").filter("NOT is_deleted").select(F.col("document_id").alias("candidate_id"))
    return view(spark, d, "ranked").filter("rank <= 5").join(trusted, "candidate_id", "left_anti").select("query_id", "candidate_id")
