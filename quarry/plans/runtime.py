"""Sections I, J, O and P: tools, conversations, runs, budgets and the remaining repository reads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import relational as R
from quarry.operators import tools
from quarry.plans.joins import latest_stock
from quarry.plans.relational import live_versions, tail
from quarry.plans.views import view, with_views
from quarry.registry import query
from quarry.session import table


@query("i02_exactly_once", "SELECT user_id % 100 AS request_id, min(event_id) AS first_event, count(*) AS attempts FROM events GROUP BY user_id % 100")
def _(spark, d):
    return table(spark, d, "events").groupBy((F.col("user_id") % 100).alias("request_id")).agg(F.min("event_id").alias("first_event"), F.count("*").alias("attempts"))


@query("i03_versioned_state", with_views("SELECT root_id, max(run_id) AS version, arg_max(status, run_id) AS state FROM runs GROUP BY root_id"))
def _(spark, d):
    return view(spark, d, "runs").groupBy("root_id").agg(F.max("run_id").alias("version"), F.max_by("status", "run_id").alias("state"))


@query("j01_tool_registry", "SELECT * FROM (VALUES ('get_product_spec', 3, false), ('search_inventory', 3, true), ('search_knowledge', 8, false), ('read_uploaded_file', 3, false), ('get_evidence_detail', 3, false)) AS t(tool, timeout_s, market_scoped)")
def _(spark, d):
    return tools.registry_frame(spark)


@query("j02_get_product_spec", with_views("SELECT v.sku, CASE WHEN count(s.name) = 0 THEN 'not_found' ELSE 'found' END AS status, string_agg(s.name || '=' || s.value, ',' ORDER BY s.name) AS specs FROM variants v LEFT JOIN specs s ON s.variant_id = v.variant_id AND s.verification_status = 'verified' WHERE v.status = 'active' GROUP BY v.sku"))
def _(spark, d):
    v = view(spark, d, "variants").filter("status = 'active'").select("variant_id", "sku")
    s = view(spark, d, "specs").filter("verification_status = 'verified'")
    full = v.join(s, "variant_id", "left").groupBy("sku").agg(F.count("name").alias("n"), R.joined_in_order(F.concat("name", F.lit("="), "value"), "name", ",").alias("specs"))
    return full.select("sku", F.when(F.col("n") == 0, "not_found").otherwise("found").alias("status"), F.when(F.col("n") > 0, F.col("specs")).alias("specs"))


@query("j03_search_inventory", with_views("""
SELECT v.sku, w.market_code, count(*) AS warehouses, sum(s.on_hand - s.reserved - s.unsellable) AS available, bool_or(s.on_hand - s.reserved - s.unsellable < 0) AS violation
FROM (SELECT s.* FROM snapshots s JOIN (SELECT tenant_id, variant_id, warehouse_id, max(snapshot_at) AS t FROM snapshots GROUP BY ALL) m ON s.tenant_id = m.tenant_id AND s.variant_id = m.variant_id AND s.warehouse_id = m.warehouse_id AND s.snapshot_at = m.t) s
JOIN warehouses w ON s.warehouse_id = w.warehouse_id AND s.tenant_id = w.tenant_id AND w.status = 'active' JOIN variants v ON s.variant_id = v.variant_id AND v.status = 'active' WHERE s.tenant_id = 'T1' GROUP BY v.sku, w.market_code
"""))
def _(spark, d):
    rows = latest_stock(spark, d).filter("tenant_id = 'T1'")
    return rows.groupBy("sku", "market_code").agg(F.count("*").alias("warehouses"), F.sum("available").alias("available"), F.bool_or(F.col("available") < 0).alias("violation"))


@query("j06_evidence_detail", with_views("SELECT g.evidence_id, count(*) AS questions FROM golden g GROUP BY g.evidence_id"))
def _(spark, d):
    return view(spark, d, "golden").groupBy("evidence_id").agg(F.count("*").alias("questions"))


@query("j07_result_envelope", with_views("SELECT call_id, CASE WHEN status = 'succeeded' AND duration_ms IS NULL THEN 'invalid' WHEN status = 'failed' AND call_id % 10 = 0 THEN 'invalid' ELSE 'valid' END AS envelope FROM tool_calls"))
def _(spark, d):
    calls = view(spark, d, "tool_calls").withColumn("has_data", F.when(F.col("status") == "succeeded", F.col("duration_ms").isNotNull()).otherwise(F.col("call_id") % 10 == 0))
    return calls.select("call_id", tools.envelope(F.col("status"), F.col("has_data")).alias("envelope"))


@query("o05_repeated_calls", with_views("SELECT run_id, tool, props, count(*) AS n FROM tool_calls GROUP BY ALL HAVING count(*) > 1"))
def _(spark, d):
    return view(spark, d, "tool_calls").groupBy("run_id", "tool", "props").agg(F.count("*").alias("n")).filter("n > 1")


@query("o06_limits", with_views("SELECT run_id, count(*) AS calls, count(*) > CASE WHEN run_id % 8 = 0 THEN 8 ELSE 4 END AS exceeded FROM tool_calls GROUP BY run_id"))
def _(spark, d):
    limit = F.when(F.col("run_id") % 8 == 0, 8).otherwise(4)
    return view(spark, d, "tool_calls").groupBy("run_id").agg(F.count("*").alias("calls")).withColumn("exceeded", F.col("calls") > limit)


@query("o08_conversation_memory", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
SELECT conv_id, count(*) FILTER (back <= 4) AS recent, count(*) FILTER (back > 4) AS older, substr(coalesce(string_agg(role || ': ' || substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 240), ' | ' ORDER BY turn) FILTER (back > 4), ''), 1, 2000) AS summary FROM r GROUP BY conv_id
""")
def _(spark, d):
    turns = table(spark, d, "conversations").withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    part = F.when(F.col("back") > 4, F.concat("role", F.lit(": "), F.substring(text.squeeze(F.col("text")), 1, 240)))
    older = F.array_sort(F.collect_list(F.when(F.col("back") > 4, F.struct(F.col("turn").alias("o"), part.alias("v")))))
    return turns.groupBy("conv_id").agg(F.count_if(F.col("back") <= 4).alias("recent"), F.count_if(F.col("back") > 4).alias("older"), F.substring(F.array_join(F.transform(older, lambda x: x["v"]), " | "), 1, 2000).alias("summary"))


@query("p01_identity_by_email", with_views("SELECT u.user_id, u.email, string_agg(r.role_name, ',' ORDER BY r.role_name) AS roles FROM users u LEFT JOIN (SELECT DISTINCT user_id, role_name FROM user_roles) r ON u.user_id = r.user_id WHERE u.status = 'active' GROUP BY u.user_id, u.email"))
def _(spark, d):
    roles = view(spark, d, "user_roles").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("role_name")), ",").alias("roles"))
    return view(spark, d, "users").filter("status = 'active'").join(roles, "user_id", "left").select("user_id", "email", "roles")


@query("p03_threads", "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def _(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))


@query("p05_manageable_documents", with_views("SELECT document_id FROM docs WHERE owner_id = 7 AND NOT is_deleted"))
def _(spark, d):
    return view(spark, d, "docs").filter("owner_id = 7 AND NOT is_deleted").select("document_id")


@query("p06_accessible_list", with_views("""
SELECT document_id FROM docs d WHERE NOT is_deleted AND EXISTS (SELECT 1 FROM versions v WHERE v.document_id = d.document_id AND v.parse_status = 'ready') AND (owner_id = 7 OR EXISTS (SELECT 1 FROM acl a WHERE a.document_id = d.document_id AND
  ((subject_type = 'user' AND subject_id = '7') OR (subject_type = 'role' AND subject_id = 'support')))) ORDER BY created_seq DESC, document_id LIMIT 100
"""))
def _(spark, d):
    live = view(spark, d, "docs").filter("NOT is_deleted").join(view(spark, d, "versions").filter("parse_status = 'ready'"), "document_id", "left_semi")
    mine = R.accessible(live, view(spark, d, "acl"), "7", ["support"], [])
    return mine.orderBy(F.desc("created_seq"), "document_id").limit(100).select("document_id")


@query("p07_versions_and_acl", with_views("SELECT v.document_id, count(DISTINCT v.version_id) AS versions, count(DISTINCT a.subject_type || a.subject_id) AS grants FROM versions v LEFT JOIN acl a ON a.document_id = v.document_id GROUP BY v.document_id"))
def _(spark, d):
    grants = view(spark, d, "acl").groupBy("document_id").agg(F.countDistinct(F.concat("subject_type", "subject_id")).alias("grants"))
    return view(spark, d, "versions").groupBy("document_id").agg(F.countDistinct("version_id").alias("versions")).join(grants, "document_id", "left").na.fill(0, ["grants"])


@query("p08_acl_subjects", with_views("SELECT a.document_id, a.subject_type, a.subject_id, CASE a.subject_type WHEN 'user' THEN TRY_CAST(a.subject_id AS BIGINT) IN (SELECT user_id FROM users WHERE status = 'active') WHEN 'role' THEN a.subject_id IN (SELECT role_name FROM user_roles) ELSE upper(a.subject_id) IN ('DE', 'FR') END AS known FROM acl a"))
def _(spark, d):
    acl = view(spark, d, "acl")
    known = view(spark, d, "users").filter("status = 'active'").select(F.lit("user").alias("subject_type"), F.col("user_id").cast("string").alias("subject_id"))
    known = known.unionByName(view(spark, d, "user_roles").select(F.lit("role").alias("subject_type"), F.col("role_name").alias("subject_id")).distinct()).withColumn("hit", F.lit(True))
    full = acl.join(known, ["subject_type", "subject_id"], "left")
    return full.select("document_id", "subject_type", "subject_id", F.when(F.col("subject_type") == "market", F.upper("subject_id").isin("DE", "FR")).otherwise(F.coalesce("hit", F.lit(False))).alias("known"))


@query("p12_live_graph", with_views("SELECT d.tenant_id, count(*) AS versions, sum(f.size_bytes) AS bytes FROM docs d JOIN versions v ON d.document_id = v.document_id AND d.active_version_id = v.version_id AND NOT d.is_deleted AND v.parse_status = 'ready' AND v.index_status = 'ready' JOIN files f ON f.file_id = v.file_id AND f.tenant_id = d.tenant_id AND NOT f.is_deleted AND f.status <> 'soft_deleted' GROUP BY d.tenant_id"))
def _(spark, d):
    return live_versions(spark, d).groupBy("tenant_id").agg(F.count("*").alias("versions"), F.sum("size_bytes").alias("bytes"))


@query("p13_file_list", with_views("SELECT file_id, extension FROM files WHERE owner_id = 7 AND NOT is_deleted ORDER BY created_seq DESC, file_id LIMIT 50"))
def _(spark, d):
    return view(spark, d, "files").filter("owner_id = 7 AND NOT is_deleted").orderBy(F.desc("created_seq"), "file_id").limit(50).select("file_id", "extension")


@query("p14_owned_runs", with_views("SELECT r.run_id, r.root_id FROM runs r JOIN runs o ON o.run_id = r.root_id WHERE o.user_id % 50 = 7"))
def _(spark, d):
    r = view(spark, d, "runs")
    roots = r.filter("user_id % 50 = 7").select(F.col("run_id").alias("root_id"))
    return r.join(roots, "root_id", "left_semi").select("run_id", "root_id")


@query("p15_task_board", with_views("SELECT t.plan_id, count(DISTINCT t.task_id) AS tasks, count(e.depends_on) AS edges FROM tasks t LEFT JOIN task_edges e ON e.task_id = t.task_id GROUP BY t.plan_id"))
def _(spark, d):
    edges = view(spark, d, "task_edges").groupBy("task_id").agg(F.count("*").alias("n"))
    return view(spark, d, "tasks").join(edges, "task_id", "left").groupBy("plan_id").agg(F.count("*").alias("tasks"), F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))


@query("p17_latest_waiting_root", with_views("SELECT user_id, max(run_id) AS run_id FROM runs WHERE is_root AND status = 'waiting' GROUP BY user_id"))
def _(spark, d):
    return view(spark, d, "runs").filter("is_root AND status = 'waiting'").groupBy("user_id").agg(F.max("run_id").alias("run_id"))


@query("p18_calls_under_root", with_views("SELECT r.root_id, c.call_id, row_number() OVER (PARTITION BY r.root_id ORDER BY c.ts, c.call_id) AS pos FROM tool_calls c JOIN runs r ON r.run_id = c.run_id"))
def _(spark, d):
    calls = view(spark, d, "tool_calls").join(view(spark, d, "runs").select("run_id", "root_id"), "run_id")
    return calls.select("root_id", "call_id", F.row_number().over(Window.partitionBy("root_id").orderBy("ts", "call_id")).alias("pos"))


@query("p19_existing_evidence", with_views("SELECT DISTINCT r.candidate_id AS evidence_id FROM ranked r WHERE r.candidate_id IN (SELECT evidence_id FROM golden)"))
def _(spark, d):
    r = view(spark, d, "ranked").select(F.col("candidate_id").alias("evidence_id")).distinct()
    return r.join(view(spark, d, "golden"), "evidence_id", "left_semi")


@query("p21_citation_allow_list", with_views("SELECT query_id, count(*) AS n, max(ordinal) = count(*) AND min(ordinal) = 1 AND bool_and(evidence_id % 31 <> 0) AS visible FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY evidence_id) AS ordinal FROM golden) GROUP BY query_id"))
def _(spark, d):
    g = view(spark, d, "golden").withColumn("ordinal", F.row_number().over(Window.partitionBy("query_id").orderBy("evidence_id")))
    return g.groupBy("query_id").agg(F.count("*").alias("n"), ((F.max("ordinal") == F.count("*")) & (F.min("ordinal") == 1) & F.every(F.col("evidence_id") % 31 != 0)).alias("visible"))


@query("p23_run_trace", with_views("SELECT root_id, count(*) AS runs, count_if(status = 'failed') AS failed, min(ts) AS started, max(ts) AS ended FROM runs GROUP BY root_id"))
def _(spark, d):
    return view(spark, d, "runs").groupBy("root_id").agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


@query("p25_evidence_dedup", with_views("SELECT s.call_id FROM tool_calls s WHERE s.tool = 'search_knowledge' AND NOT EXISTS (SELECT 1 FROM tool_calls x WHERE x.tool = 'get_evidence_detail' AND x.props = s.props)"))
def _(spark, d):
    calls = view(spark, d, "tool_calls")
    return calls.filter("tool = 'search_knowledge'").join(calls.filter("tool = 'get_evidence_detail'").select("props"), "props", "left_anti").select("call_id")


@query("p29_file_read", "SELECT conv_id, turn, pos FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2)")
def _(spark, d):
    return tail(table(spark, d, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn", "pos")
