"""Section D: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import percentiles, ranking
from quarry.operators import relational as R
from quarry.plans.views import view, with_views
from quarry.registry import query
from quarry.session import table


@query("d01_latest_time", with_views("SELECT tenant_id, variant_id, warehouse_id, max(snapshot_at) AS latest FROM snapshots GROUP BY ALL"))
def _(spark, d):
    return view(spark, d, "snapshots").groupBy("tenant_id", "variant_id", "warehouse_id").agg(F.max("snapshot_at").alias("latest"))


@query("d02_filtered_count", with_views("SELECT count(run_id) AS n FROM runs WHERE status = 'failed' AND is_root"))
def _(spark, d):
    return view(spark, d, "runs").filter("status = 'failed' AND is_root").agg(F.count("run_id").alias("n"))


@query("d03_count_filter", "SELECT lang, count(*) FILTER (n_chars > 2000) AS long, count(*) FILTER (source = 'src0') AS src0, count(*) AS n FROM documents GROUP BY lang")
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(F.col("n_chars") > 2000).alias("long"), F.count_if(F.col("source") == "src0").alias("src0"), F.count("*").alias("n"))


@query("d04_coalesced_sum", "SELECT p_partkey, coalesce(sum(l_linenumber), 0) AS total FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_quantity > 49 GROUP BY p_partkey")
def _(spark, d):
    per = table(spark, d, "lineitem").filter("l_quantity > 49").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_linenumber").alias("total"))
    return table(spark, d, "part").select("p_partkey").join(per, "p_partkey", "left").na.fill(0, ["total"])


@query("d05_next_version", with_views("SELECT d.document_id, coalesce(max(v.version_no), 0) + 1 AS next_version FROM docs d LEFT JOIN versions v ON v.document_id = d.document_id AND v.document_id % 3 <> 0 GROUP BY d.document_id"))
def _(spark, d):
    top = view(spark, d, "versions").filter("document_id % 3 <> 0").groupBy("document_id").agg(F.max("version_no").alias("m"))
    return view(spark, d, "docs").join(top, "document_id", "left").select("document_id", (F.coalesce("m", F.lit(0)) + 1).alias("next_version"))


@query("d06_distinct_identity", "SELECT DISTINCT lang, source FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct()


@query("d07_collected_roles", with_views("SELECT user_id, string_agg(DISTINCT role_name, ',' ORDER BY role_name) AS roles, string_agg(DISTINCT market, ',' ORDER BY market) AS markets FROM user_roles GROUP BY user_id"))
def _(spark, d):
    return view(spark, d, "user_roles").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("role_name")), ",").alias("roles"), F.array_join(F.sort_array(F.collect_set("market")), ",").alias("markets"))


@query("d08_nearest_rank_percentiles", with_views("SELECT tool, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95 FROM tool_calls GROUP BY tool"))
def _(spark, d):
    return percentiles.nearest_ranks(view(spark, d, "tool_calls"), ["tool"], "duration_ms", {"p50": 0.5, "p95": 0.95}).select("tool", "p50", "p95")


@query("d09_latency_summary", with_views("SELECT count(*) AS n, min(duration_ms) AS min, quantile_disc(duration_ms, 0.5) AS p50, quantile_disc(duration_ms, 0.95) AS p95, max(duration_ms) AS max FROM tool_calls"))
def _(spark, d):
    calls = view(spark, d, "tool_calls")
    whole = calls.agg(F.count("*").alias("n"), F.min("duration_ms").alias("min"), F.max("duration_ms").alias("max"))
    ranks = percentiles.nearest_ranks(calls, [], "duration_ms", {"p50": 0.5, "p95": 0.95}).drop("n")
    return whole.join(F.broadcast(ranks), F.lit(True), "left").select("n", "min", "p50", "p95", "max")  # one row each


@query("d10_cohort_means", with_views("SELECT coalesce(tool, 'all') AS cohort, status, count(*) AS n, round(avg(duration_ms), 6) AS mean FROM tool_calls GROUP BY GROUPING SETS ((tool, status), (status))"))
def _(spark, d):
    rows = view(spark, d, "tool_calls").groupingSets([["tool", "status"], ["status"]], "tool", "status").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 6).alias("mean"))
    return rows.select(F.coalesce("tool", F.lit("all")).alias("cohort"), "status", "n", "mean")


@query("d11_micro_ratios", "SELECT lang, round(sum(CASE WHEN n_chars > 2000 THEN n_chars END) / nullif(sum(CASE WHEN source = 'src1' THEN n_chars END), 0), 6) AS nullable, round(coalesce(sum(CASE WHEN n_chars > 2000 THEN n_chars END) / nullif(sum(CASE WHEN source = 'none' THEN n_chars ELSE 0 END), 0), 0.0), 6) AS zeroed FROM documents GROUP BY lang")
def _(spark, d):
    part = lambda c: F.sum(F.when(c, F.col("n_chars")).otherwise(0))
    big, one, none = part(F.col("n_chars") > 2000), part(F.col("source") == "src1"), part(F.col("source") == "none")
    return table(spark, d, "documents").groupBy("lang").agg(F.round(ranking.ratio(big, one), 6).alias("nullable"), F.round(ranking.ratio(big, none, 0.0), 6).alias("zeroed"))


@query("d12_fail_closed", with_views("SELECT root_id % 64 AS g, CASE WHEN bool_and(status <> 'failed') THEN 'completed' ELSE 'calculation_failed' END AS state, CASE WHEN bool_and(status <> 'failed') THEN round(avg(value), 6) END AS rate FROM runs GROUP BY root_id % 64"))
def _(spark, d):
    fine = F.every(F.col("status") != "failed")
    return view(spark, d, "runs").groupBy((F.col("root_id") % 64).alias("g")).agg(F.when(fine, "completed").otherwise("calculation_failed").alias("state"), F.when(fine, F.round(F.avg("value"), 6)).alias("rate"))


@query("d13_answer_aggregate", "SELECT event_type, count(*) AS cases, count_if(value > 50) AS passed, round(sum(value), 4) AS total, round(count_if(value > 50) / count(*), 6) AS rate FROM events GROUP BY event_type")
def _(spark, d):
    passed = F.count_if(F.col("value") > 50)
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("cases"), passed.alias("passed"), F.round(F.sum("value"), 4).alias("total"), F.round(passed / F.count("*"), 6).alias("rate"))


@query("d14_safety_aggregate", "SELECT event_type, count_if(event_id % 11 = 0) AS leaks, bool_or(event_id % 997 = 0) AS any_critical FROM events GROUP BY event_type")
def _(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("event_id") % 11 == 0).alias("leaks"), F.bool_or(F.col("event_id") % 997 == 0).alias("any_critical"))


MOVES = "SELECT r.query_id, CASE WHEN b.rank IS NULL THEN 'missing' WHEN b.rank < r.rank THEN 'promoted' WHEN b.rank > r.rank THEN 'demoted' ELSE 'unchanged' END AS movement FROM ranked r LEFT JOIN (SELECT query_id, candidate_id, row_number() OVER (PARTITION BY query_id ORDER BY (candidate_id * 31) % 101, candidate_id) AS rank FROM ranked WHERE candidate_id % 3 <> 0) b ON r.query_id = b.query_id AND r.candidate_id = b.candidate_id"


def moves(spark, d):
    """How each candidate moves between two rankings of one pool."""
    r = view(spark, d, "ranked")
    after = ranking.numbered(r.filter("candidate_id % 3 <> 0").select("query_id", "candidate_id"), ["query_id"], [(F.col("candidate_id") * 31) % 101, F.col("candidate_id")], "after")
    full = r.join(after, ["query_id", "candidate_id"], "left")
    return full.withColumn("movement", F.when(F.col("after").isNull(), "missing").when(F.col("after") < F.col("rank"), "promoted").when(F.col("after") > F.col("rank"), "demoted").otherwise("unchanged"))


@query("d15_rank_movement", with_views(f"SELECT query_id, count_if(movement = 'missing') AS missing, count_if(movement = 'promoted') AS promoted, count_if(movement = 'demoted') AS demoted, count_if(movement = 'unchanged') AS unchanged FROM ({MOVES}) GROUP BY query_id"))
def _(spark, d):
    kinds = [F.count_if(F.col("movement") == k).alias(k) for k in ("missing", "promoted", "demoted", "unchanged")]
    return moves(spark, d).groupBy("query_id").agg(*kinds)


@query("d16_context_aggregate", "SELECT role, sum(length(text)) AS used, round(sum(length(text)) / sum(4000), 6) AS utilization, round(count(DISTINCT text) / count(*), 6) AS novel FROM conversations GROUP BY role")
def _(spark, d):
    used = F.sum(F.length("text"))
    return table(spark, d, "conversations").groupBy("role").agg(used.alias("used"), F.round(used / F.sum(F.lit(4000)), 6).alias("utilization"), F.round(F.countDistinct("text") / F.count("*"), 6).alias("novel"))


@query("d17_category_frequency", "SELECT event_type, count(*) FILTER (value < 25) AS low, count(*) FILTER (value >= 25) AS high FROM events GROUP BY event_type")
def _(spark, d):
    band = F.when(F.col("value") < 25, "low").when(F.col("value") >= 25, "high")
    return table(spark, d, "events").withColumn("band", band).groupBy("event_type").pivot("band", ["low", "high"]).count().na.fill(0)


@query("d18_weighted_mode", "SELECT lang, arg_max(size, (w, -size)) AS body_size FROM (SELECT lang, CAST(round(n_chars / 500.0) AS BIGINT) AS size, sum(n_chars) AS w FROM documents GROUP BY ALL) GROUP BY lang")
def _(spark, d):
    rows = table(spark, d, "documents").groupBy("lang", F.round(F.col("n_chars") / 500.0).cast("long").alias("size")).agg(F.sum("n_chars").alias("w"))
    return rows.groupBy("lang").agg(F.max_by("size", F.struct("w", -F.col("size"))).alias("body_size"))


@query("d19_token_recall", """
WITH t AS (SELECT doc_id % 100 AS g, doc_id < 500 AS a, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents),
c AS (SELECT g, w, count(*) FILTER (a) AS x, count(*) FILTER (NOT a) AS y FROM t GROUP BY g, w)
SELECT g, round(sum(least(x, y)) / nullif(sum(x), 0), 6) AS recall FROM c GROUP BY g
""")
def _(spark, d):
    words = table(spark, d, "documents").select((F.col("doc_id") % 100).alias("g"), (F.col("doc_id") < 500).alias("a"), F.explode(text.tokens(F.col("text"))).alias("w"))
    c = words.groupBy("g", "w").agg(F.count_if("a").alias("x"), F.count_if(~F.col("a")).alias("y"))
    return c.groupBy("g").agg(F.round(ranking.ratio(F.sum(F.least("x", "y")), F.sum("x")), 6).alias("recall"))


@query("d20_argmax_ties", "SELECT p_brand, p_partkey FROM (SELECT *, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r FROM part) WHERE r = 1")
def _(spark, d):
    return R.latest(table(spark, d, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size").select("p_brand", "p_partkey")


@query("d21_best_config", "SELECT source, lang, n FROM (SELECT source, lang, count(*) AS n, sum(n_chars) AS c FROM documents GROUP BY ALL) ORDER BY n DESC, c, source, lang LIMIT 1")
def _(spark, d):
    rows = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    return rows.orderBy(F.desc("n"), "c", "source", "lang").limit(1).select("source", "lang", "n")


@query("d22_topk_choice", with_views("SELECT k, hits FROM (SELECT c.k, count(*) AS hits FROM ranked r JOIN golden g ON r.query_id = g.query_id AND r.candidate_id = g.evidence_id JOIN (SELECT unnest([3, 5, 8, 10]) AS k) c ON r.rank <= c.k GROUP BY c.k) ORDER BY hits DESC, k LIMIT 1"))
def _(spark, d):
    hits = view(spark, d, "ranked").join(view(spark, d, "golden").withColumnRenamed("evidence_id", "candidate_id"), ["query_id", "candidate_id"])
    counts = hits.agg(*[F.count_if(F.col("rank") <= k).alias(str(k)) for k in (3, 5, 8, 10)])
    return counts.unpivot([], ["3", "5", "8", "10"], "k", "hits").select(F.col("k").cast("int").alias("k"), "hits").orderBy(F.desc("hits"), "k").limit(1)


@query("d23_artifact_statistics", "SELECT doc_id, len(string_split(text, chr(10))) AS blocks, length(regexp_replace(text, '\\s', '', 'g')) AS characters FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("blocks"), text.solid_length(F.col("text")).alias("characters"))


@query("d24_parser_aggregate", "SELECT source, count_if(n_chars < 500) AS native, count_if(n_chars >= 500) AS enhanced, quantile_disc(n_chars, 0.5) AS p50, max(n_chars) AS peak FROM documents GROUP BY source")
def _(spark, d):
    docs = table(spark, d, "documents")
    counts = docs.groupBy("source").agg(F.count_if(F.col("n_chars") < 500).alias("native"), F.count_if(F.col("n_chars") >= 500).alias("enhanced"), F.max("n_chars").alias("peak"))
    middle = percentiles.nearest_ranks(docs, ["source"], "n_chars", {"p50": 0.5}).select(F.col("source").alias("_s"), "p50")
    return counts.join(middle, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "native", "enhanced", "p50", "peak")


@query("d25_chunk_cohorts", "SELECT lang, source, count(*) AS chunks, round(avg(n_chars), 6) AS mean FROM documents GROUP BY lang, source")
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("chunks"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("d26_budget_capacity", with_views("SELECT root_id, 24 - max(CASE WHEN is_root THEN run_id % 5 ELSE 0 END) - coalesce(sum(CASE WHEN NOT is_root AND status IN ('running', 'waiting') THEN 4 - run_id % 3 END), 0) AS model_calls_left FROM runs GROUP BY root_id"))
def _(spark, d):
    opened = ~F.col("is_root") & F.col("status").isin("running", "waiting")
    reserved = F.coalesce(F.sum(F.when(opened, 4 - F.col("run_id") % 3)), F.lit(0))
    used = F.max(F.when(F.col("is_root"), F.col("run_id") % 5).otherwise(0))
    return view(spark, d, "runs").groupBy("root_id").agg((24 - used - reserved).alias("model_calls_left"))


@query("d27_page_totals", "SELECT conv_id, turn // 2 AS page, sum(length(regexp_replace(text, '\\s', '', 'g'))) AS characters FROM conversations GROUP BY conv_id, turn // 2")
def _(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).alias("page")).agg(F.sum(text.solid_length(F.col("text"))).alias("characters"))

