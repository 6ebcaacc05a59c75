"""Section K: inserts and state transitions, as the rows they leave behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import relational as R
from quarry.operators import writes as W
from quarry.plans.views import view, with_views
from quarry.registry import query
from quarry.session import table


def jobs(spark, d):
    m = F.col("version_id") % 5
    status = F.when(m == 0, "pending").when(m == 1, "failed").when(m == 2, "processing").otherwise("ready")
    return view(spark, d, "versions").select("version_id", "document_id", "version_no", status.alias("status"), (F.col("version_id") % 3).cast("int").alias("attempt_count"))


JOBS = "(SELECT version_id, document_id, version_no, CASE version_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'failed' WHEN 2 THEN 'processing' ELSE 'ready' END AS status, CAST(version_id % 3 AS INT) AS attempt_count FROM versions)"


@query("k01_insert_absent", "SELECT doc_id, min(quality) AS quality FROM (SELECT doc_id, quality FROM labels WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 9 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 2 = 0)) GROUP BY doc_id")
def _(spark, d):
    stored = table(spark, d, "labels").filter("doc_id % 2 = 0").select("doc_id", "quality")
    new = table(spark, d, "documents").select("doc_id", F.lit(9).alias("quality"))
    return R.insert_absent(stored, new.unionByName(new), ["doc_id"])


@query("k02_claim", with_views(f"SELECT version_id, CASE WHEN version_id % 2 = 1 AND status IN ('pending', 'failed') THEN 'processing' ELSE status END AS status, attempt_count + CASE WHEN version_id % 2 = 1 AND status IN ('pending', 'failed') THEN 1 ELSE 0 END AS attempt_count, version_id % 2 = 1 AND status IN ('pending', 'failed') AS changed FROM {JOBS}"))
def _(spark, d):
    return W.claim(jobs(spark, d), F.col("version_id") % 2 == 1).select("version_id", "status", "attempt_count", "changed")


@query("k03_complete", with_views(f"SELECT version_id, CASE WHEN status = 'processing' AND attempt_count = 1 AND version_id % 4 <> 3 THEN 'ready' ELSE status END AS status, status = 'processing' AND attempt_count = 1 AND version_id % 4 <> 3 AS changed FROM {JOBS}"))
def _(spark, d):
    rows = jobs(spark, d)
    results = rows.select("version_id", F.lit(1).alias("expected_attempt"), F.lit(10).alias("expected_count"), F.when(F.col("version_id") % 4 == 3, 9).otherwise(10).alias("actual_count"))
    return W.complete(rows, results, ["version_id"]).select("version_id", "status", "changed")


@query("k03_switch_pointer", with_views("SELECT d.document_id, coalesce(max(v.version_id) FILTER (v.parse_status = 'ready'), any_value(d.active_version_id)) AS active_version_id FROM docs d LEFT JOIN versions v ON v.document_id = d.document_id GROUP BY d.document_id"))
def _(spark, d):
    ready = view(spark, d, "versions").filter("parse_status = 'ready'").select("document_id", "version_id", "version_no")
    return W.switch_pointer(view(spark, d, "docs"), ready).select("document_id", "active_version_id")


@query("k04_fail", with_views(f"SELECT version_id, CASE WHEN status = 'processing' AND version_id % 3 = 0 THEN CASE WHEN version_no = 2 THEN 'ready' ELSE 'failed' END ELSE status END AS status FROM {JOBS}"))
def _(spark, d):
    return W.fail(jobs(spark, d), F.col("version_id") % 3 == 0, F.col("version_no") == 2).select("version_id", "status")


@query("k04_drop_generation", "SELECT c.conv_id, count(*) AS chunks FROM conversations c WHERE c.conv_id % 4 <> 1 GROUP BY c.conv_id")
def _(spark, d):
    c = table(spark, d, "conversations")
    return W.drop_generation(c, c.filter("conv_id % 4 = 1"), ["conv_id"]).groupBy("conv_id").agg(F.count("*").alias("chunks"))


@query("k05_soft_delete", with_views("SELECT document_id, CASE WHEN is_deleted THEN 1 WHEN document_id % 7 = 0 THEN 2 END AS deleted_at, NOT is_deleted AND document_id % 7 = 0 AS changed FROM docs"))
def _(spark, d):
    rows = view(spark, d, "docs").withColumn("deleted_at", F.when(F.col("is_deleted"), 1))
    return W.soft_delete(rows, F.col("document_id") % 7 == 0, F.lit(2)).select("document_id", "deleted_at", "changed")


@query("k06_delete_board", with_views("SELECT task_id FROM tasks WHERE plan_id % 30 <> 0"))
def _(spark, d):
    t = view(spark, d, "tasks")
    return W.delete_subtree(t, t.filter("plan_id % 30 = 0").select("plan_id"), "plan_id").select("task_id")


STEPS = "(SELECT doc_id, ['uploaded', 'parsing', 'ready', 'failed', 'soft_deleted'][CAST(doc_id % 5 + 1 AS INT)] AS old_status, ['uploaded', 'parsing', 'ready', 'failed', 'soft_deleted'][CAST(doc_id // 5 % 5 + 1 AS INT)] AS new_status FROM documents)"


@query("k07_state_machine", f"SELECT doc_id, old_status = new_status OR (old_status || '>' || new_status) IN ({', '.join(repr(a + '>' + b) for a, b in W.FILE_STATES)}) AS legal FROM {STEPS}")
def _(spark, d):
    names = F.array(*map(F.lit, ["uploaded", "parsing", "ready", "failed", "soft_deleted"]))
    rows = table(spark, d, "documents").select("doc_id", F.element_at(names, (F.col("doc_id") % 5 + 1).cast("int")).alias("old_status"), F.element_at(names, (F.floor(F.col("doc_id") / 5) % 5 + 1).cast("int")).alias("new_status"))
    return W.transitions(rows).select("doc_id", "legal")


@query("k10_persisted_evidence", with_views("SELECT query_id, evidence_id, row_number() OVER (PARTITION BY query_id ORDER BY evidence_id) AS citation_ordinal, CAST(round(0.5 + (evidence_id % 100) / 250.0, 3) AS DOUBLE) AS confidence FROM golden"))
def _(spark, d):
    from pyspark.sql import Window

    score = F.round(0.5 + (F.col("evidence_id") % 100) / 250.0, 3).cast("decimal(4,3)")
    rows = view(spark, d, "golden").withColumn("citation_ordinal", F.row_number().over(Window.partitionBy("query_id").orderBy("evidence_id")))
    return rows.select("query_id", "evidence_id", "citation_ordinal", score.cast("double").alias("confidence"))


@query("k11_ingest_plan", with_views("SELECT v.version_id, CASE WHEN v.parse_status = 'failed' THEN 'parse' WHEN v.index_status IN ('pending') THEN 'index' WHEN v.index_status = 'superseded' THEN 'skip' WHEN d.active_version_id <> v.version_id THEN 'activate' ELSE 'done' END AS next_step FROM versions v JOIN docs d ON d.document_id = v.document_id"))
def _(spark, d):
    full = view(spark, d, "versions").join(view(spark, d, "docs").select("document_id", "active_version_id"), "document_id")
    step = F.when(F.col("parse_status") == "failed", "parse").when(F.col("index_status") == "pending", "index").when(F.col("index_status") == "superseded", "skip").when(F.col("active_version_id") != F.col("version_id"), "activate").otherwise("done")
    return full.select("version_id", step.alias("next_step"))
