"""Sections E and N: ordered-row metrics and the evaluation suite."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import joins as J
from quarry.operators import near_text, ranking
from quarry.operators import relational as R
from quarry.plans.aggregates import MOVES, moves
from quarry.plans.joins import CHUNKS, LATEST, SPANS, spans_and_chunks
from quarry.plans.views import view, with_views
from quarry.registry import query
from quarry.session import table


@query("e01_dense_rank_numbering", "SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1], vec_id) AS rank FROM embeddings")
def _(spark, d):
    rows = table(spark, d, "embeddings").select("label", "vec_id", F.element_at("embedding", 1).alias("x"))
    return ranking.numbered(rows, ["label"], [F.col("x"), F.col("vec_id")]).select("label", "vec_id", "rank")


HITS = "(SELECT r.query_id, r.candidate_id, r.rank, g.evidence_id IS NOT NULL AS rel FROM ranked r LEFT JOIN golden g ON r.query_id = g.query_id AND r.candidate_id = g.evidence_id)"


def judged(spark, d):
    gold = view(spark, d, "golden").select("query_id", F.col("evidence_id").alias("candidate_id"), F.lit(True).alias("rel"))
    return view(spark, d, "ranked").join(gold, ["query_id", "candidate_id"], "left").na.fill(False, ["rel"])


@query("e02_reciprocal_rank", with_views(f"SELECT query_id, min(CASE WHEN rel THEN rank END) AS first_rank, round(coalesce(CASE WHEN min(CASE WHEN rel THEN rank END) <= 10 THEN 1.0 / min(CASE WHEN rel THEN rank END) END, 0.0), 6) AS rr FROM {HITS} GROUP BY query_id"))
def _(spark, d):
    first = F.min(F.when(F.col("rel"), F.col("rank")))
    return judged(spark, d).groupBy("query_id").agg(first.alias("first_rank")).withColumn("rr", F.round(F.when(F.col("first_rank") <= 10, 1 / F.col("first_rank")).otherwise(0.0), 6))


@query("e03_novelty_ndcg", with_views("""
WITH f AS (SELECT r.query_id, g.evidence_id, min(r.rank) AS rank FROM ranked r JOIN golden g ON r.query_id = g.query_id AND (r.candidate_id = g.evidence_id OR r.candidate_id = g.evidence_id + 4) WHERE r.rank <= 10 GROUP BY ALL),
i AS (SELECT query_id, count(DISTINCT evidence_id) AS n FROM golden GROUP BY query_id)
SELECT i.query_id, round(coalesce((SELECT sum(1 / log2(f.rank + 1)) FROM f WHERE f.query_id = i.query_id) / (SELECT sum(1 / log2(r + 1)) FROM (SELECT unnest(range(1, 11)) AS r) WHERE r <= i.n), 0.0), 6) AS ndcg FROM i
"""))
def _(spark, d):
    gold = view(spark, d, "golden")
    # a candidate covers its own evidence and that of the one four before it
    covers = gold.select("query_id", "evidence_id", F.explode(F.array("evidence_id", F.col("evidence_id") + 4)).alias("candidate_id"))
    found = view(spark, d, "ranked").join(covers, ["query_id", "candidate_id"])
    return ranking.novelty_ndcg(found, gold, 10).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@query("e05_latest_with_ties", with_views(f"SELECT tenant_id, variant_id, warehouse_id, count(*) AS n FROM {LATEST} GROUP BY ALL"))
def _(spark, d):
    rows = view(spark, d, "snapshots")
    w = Window.partitionBy("tenant_id", "variant_id", "warehouse_id").orderBy(F.desc("snapshot_at"))
    return rows.withColumn("r", F.rank().over(w)).filter("r = 1").groupBy("tenant_id", "variant_id", "warehouse_id").agg(F.count("*").alias("n"))


@query("e06_cutoff_suite", with_views(f"""
SELECT i.query_id, c.cutoff, round(coalesce(h.n, 0) / c.cutoff, 6) AS precision, round(coalesce(h.n, 0) / i.n, 6) AS recall, CASE WHEN h.n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit
FROM (SELECT query_id, count(DISTINCT evidence_id) AS n FROM golden GROUP BY query_id) i CROSS JOIN (SELECT unnest([1, 3, 5, 8, 10, 20]) AS cutoff) c
LEFT JOIN (SELECT query_id, cutoff, count(*) AS n FROM {HITS} JOIN (SELECT unnest([1, 3, 5, 8, 10, 20]) AS cutoff) ON rank <= cutoff WHERE rel GROUP BY ALL) h ON h.query_id = i.query_id AND h.cutoff = c.cutoff
"""))
def _(spark, d):
    rows = ranking.ranking_suite(view(spark, d, "ranked"), view(spark, d, "golden"))
    return rows.select("query_id", "cutoff", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "hit")


@query("e07_near_duplicate_rows", r"""
WITH r AS (SELECT doc_id, lang, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS m, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS t FROM documents)
SELECT a.doc_id FROM r a WHERE EXISTS (SELECT 1 FROM r b WHERE b.doc_id < a.doc_id AND (a.m = b.m OR (len(a.t) >= 20 AND len(b.t) >= 20 AND len(a.t) * 0.9 <= len(b.t) AND len(b.t) * 0.9 <= len(a.t)
  AND len(list_intersect(a.t, b.t)) >= 0.9 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))))))
""")
def _(spark, d):
    return near_text.repeats(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text").select("doc_id")


@query("e08_repeated_edges", r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE len(string_split(text, chr(10))) >= 2),
e AS (SELECT doc_id, 'header' AS edge, trim(a[1]) AS line FROM l UNION ALL SELECT doc_id, 'footer', trim(a[len(a)]) FROM l WHERE trim(a[len(a)]) <> trim(a[1])),
k AS (SELECT * FROM e WHERE length(line) BETWEEN 1 AND 200 AND regexp_matches(line, '[\p{L}\p{N}]'))
SELECT edge, line, count(DISTINCT doc_id) AS pages FROM k GROUP BY edge, line HAVING count(DISTINCT doc_id) >= 3
""")
def _(spark, d):
    pages = table(spark, d, "documents").select("doc_id", F.transform(F.split("text", "\n"), F.trim).alias("a")).filter(F.size("a") >= 2)
    first, last = F.element_at("a", 1), F.element_at("a", -1)
    edges = F.array(F.struct(F.lit("header").alias("edge"), first.alias("line")), F.struct(F.lit("footer").alias("edge"), F.when(last != first, last).alias("line")))
    rows = pages.select("doc_id", F.explode(edges).alias("e")).select("doc_id", "e.edge", "e.line").filter(F.length("line").between(1, 200) & F.col("line").rlike(r"[\p{L}\p{N}]"))
    return rows.groupBy("edge", "line").agg(F.countDistinct("doc_id").alias("pages")).filter("pages >= 3")


@query("e12_rank_delta", with_views(f"SELECT query_id, movement, count(*) AS n FROM ({MOVES}) GROUP BY ALL"))
def _(spark, d):
    return moves(spark, d).groupBy("query_id", "movement").agg(F.count("*").alias("n"))


@query("e13_first_forbidden", with_views("SELECT query_id, min(CASE WHEN candidate_id % 16 = 0 THEN rank END) AS first_forbidden FROM ranked WHERE rank <= 10 GROUP BY query_id"))
def _(spark, d):
    return view(spark, d, "ranked").filter("rank <= 10").groupBy("query_id").agg(F.min(F.when(F.col("candidate_id") % 16 == 0, F.col("rank"))).alias("first_forbidden"))


@query("e14_confusion", with_views(f"SELECT query_id, coalesce(min(CASE WHEN NOT rel AND candidate_id % 3 = query_id % 3 THEN rank END) < min(CASE WHEN rel THEN rank END), false) AS confused FROM {HITS} GROUP BY query_id"))
def _(spark, d):
    wrong = F.min(F.when(~F.col("rel") & (F.col("candidate_id") % 3 == F.col("query_id") % 3), F.col("rank")))
    return judged(spark, d).groupBy("query_id").agg(F.coalesce(wrong < F.min(F.when(F.col("rel"), F.col("rank"))), F.lit(False)).alias("confused"))


@query("e15_placeholders", with_views("SELECT query_id, rank, CASE WHEN candidate_id % 5 = 0 THEN NULL ELSE candidate_id END AS candidate_id FROM ranked WHERE rank <= 10"))
def _(spark, d):
    rows = view(spark, d, "ranked").filter("rank <= 10")
    kept = rows.filter("candidate_id % 5 <> 0")
    holes = rows.filter("candidate_id % 5 = 0").select("query_id", F.lit(None).cast("long").alias("candidate_id"), "rank")
    return kept.unionByName(holes).select("query_id", "rank", "candidate_id")


@query("e16_descending", "SELECT label, bool_and(ok) AS descending FROM (SELECT label, coalesce(lag(embedding[1]) OVER (PARTITION BY label ORDER BY vec_id) >= embedding[1], true) AS ok FROM embeddings) GROUP BY label")
def _(spark, d):
    rows = table(spark, d, "embeddings").select("label", "vec_id", F.element_at("embedding", 1).alias("score"))
    ok = F.coalesce(F.lag("score").over(Window.partitionBy("label").orderBy("vec_id")) >= F.col("score"), F.lit(True))
    return rows.withColumn("ok", ok).groupBy("label").agg(F.every("ok").alias("descending"))


@query("e17_redundant_segments", with_views("SELECT query_id, count(*) AS segments, count(*) FILTER (rank <> best) AS redundant FROM (SELECT query_id, rank, min(rank) OVER (PARTITION BY query_id, candidate_id % 12) AS best FROM ranked WHERE rank <= 12) GROUP BY query_id"))
def _(spark, d):
    rows = view(spark, d, "ranked").filter("rank <= 12")
    best = F.min("rank").over(Window.partitionBy("query_id", F.col("candidate_id") % 12))  # evidence = candidate mod 12
    return rows.withColumn("best", best).groupBy("query_id").agg(F.count("*").alias("segments"), F.count_if(F.col("rank") != F.col("best")).alias("redundant"))


@query("n01_suite_means", with_views(f"""
SELECT c.cutoff, round(avg(coalesce(h.n, 0) / i.n), 6) AS recall, round(avg(CASE WHEN h.n > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM (SELECT query_id, count(DISTINCT evidence_id) AS n FROM golden GROUP BY query_id) i CROSS JOIN (SELECT unnest([1, 3, 5, 8, 10, 20]) AS cutoff) c
LEFT JOIN (SELECT query_id, cutoff, count(*) AS n FROM {HITS} JOIN (SELECT unnest([1, 3, 5, 8, 10, 20]) AS cutoff) ON rank <= cutoff WHERE rel GROUP BY ALL) h ON h.query_id = i.query_id AND h.cutoff = c.cutoff GROUP BY c.cutoff
"""))
def _(spark, d):
    rows = ranking.ranking_suite(view(spark, d, "ranked"), view(spark, d, "golden"))
    return rows.groupBy("cutoff").agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("hit"), 6).alias("hit_rate"))


REASON = "CASE query_id // 100 % 4 WHEN 0 THEN 'acl_denied' WHEN 1 THEN 'version_unavailable' WHEN 2 THEN 'unknown' ELSE 'source_rejected' END"


@query("n02_no_answer_leakage", with_views(f"SELECT query_id, {REASON} AS reason, least(count(*), 10) AS returned, CASE WHEN {REASON} = 'unknown' THEN NULL ELSE coalesce(bool_or(rank <= 10 AND candidate_id % 16 = 0), false) END AS false_recall FROM ranked GROUP BY query_id"))
def _(spark, d):
    return no_answer(view(spark, d, "ranked"), 10)


def no_answer(ranked, cutoff):
    """Leakage of protected candidates; not judged where the reason protects nothing."""
    m = F.floor(F.col("query_id") / 100) % 4
    reason = F.when(m == 0, "acl_denied").when(m == 1, "version_unavailable").when(m == 2, "unknown").otherwise("source_rejected")
    leak = F.bool_or((F.col("rank") <= cutoff) & (F.col("candidate_id") % 16 == 0))
    per = ranked.groupBy("query_id").agg(F.least(F.count("*"), F.lit(cutoff)).alias("returned"), leak.alias("leak")).withColumn("reason", reason)
    return per.select("query_id", "reason", "returned", F.when(F.col("reason") != "unknown", F.col("leak")).alias("false_recall"))


@query("n03_bounded_plan", "SELECT * FROM (VALUES (10, 60), (20, 60), (30, 60), (20, 20), (20, 100)) AS t(depth, k)")
def _(spark, d):
    return spark.createDataFrame([(10, 60), (20, 60), (30, 60), (20, 20), (20, 100)], "depth int, k int")


@query("n04_failure_layer", f"""
SELECT s.doc_id, CASE WHEN d.n_chars < s.s1 THEN 'parser' WHEN bool_or(c.c0 <= s.s0 AND s.s1 <= c.c1) THEN 'none' WHEN count(c.chunk) > 0 THEN 'chunk' ELSE 'locator' END AS layer FROM {SPANS} s JOIN documents d ON d.doc_id = s.doc_id
LEFT JOIN {CHUNKS} c ON s.doc_id = c.doc_id AND s.s0 < c.c1 AND c.c0 < s.s1 GROUP BY s.doc_id, d.n_chars, s.s1
""")
def _(spark, d):
    spans, chunks = spans_and_chunks(spark, d)
    met = J.covered_spans(spans, chunks, "doc_id", 1000).groupBy("doc_id").agg(F.bool_or((F.col("c0") <= F.col("s0")) & (F.col("s1") <= F.col("c1"))).alias("whole"))
    full = spans.join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").join(met, "doc_id", "left")
    layer = F.when(F.col("n_chars") < F.col("s1"), "parser").when(F.col("whole"), "none").when(F.col("whole").isNotNull(), "chunk").otherwise("locator")
    return full.select("doc_id", layer.alias("layer"))


@query("n06_config_selection", "SELECT source, chunks, mean FROM (SELECT source, count(*) AS chunks, round(avg(n_chars), 6) AS mean, rank() OVER (ORDER BY count(*) DESC, max(n_chars) DESC) AS r FROM documents GROUP BY source) WHERE r = 1")
def _(spark, d):
    rows = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("chunks"), F.round(F.avg("n_chars"), 6).alias("mean"), F.struct(F.count("*"), F.max("n_chars")).alias("key"))
    return R.latest(rows.withColumn("one", F.lit(1)), ["one"], "key").select("source", "chunks", "mean")


@query("n07_rerank_comparison", with_views(f"SELECT query_id, count_if(movement = 'promoted') - count_if(movement = 'demoted') AS net, round(count_if(movement <> 'missing') / count(*), 6) AS kept FROM ({MOVES}) GROUP BY query_id"))
def _(spark, d):
    m = F.col("movement")
    return moves(spark, d).groupBy("query_id").agg((F.count_if(m == "promoted") - F.count_if(m == "demoted")).alias("net"), F.round(F.count_if(m != "missing") / F.count("*"), 6).alias("kept"))


@query("n08_safety_cases", with_views("SELECT query_id, CASE WHEN min(CASE WHEN candidate_id % 16 = 0 THEN rank END) <= 5 THEN 'leaked' ELSE 'safe' END AS verdict FROM ranked GROUP BY query_id"))
def _(spark, d):
    first = F.min(F.when(F.col("candidate_id") % 16 == 0, F.col("rank")))
    return view(spark, d, "ranked").groupBy("query_id").agg(F.when(first <= 5, "leaked").otherwise("safe").alias("verdict"))


@query("n09_answer_case", r"""
WITH a AS (SELECT conv_id, turn, role, text || CASE turn % 4 WHEN 0 THEN ' [E1] [E2] [E1]' WHEN 1 THEN ' [E13]' WHEN 2 THEN ' [e2]' ELSE '' END AS answer FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS refs, CASE turn % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'citation_out_of_range' WHEN 2 THEN 'citation_malformed' ELSE 'citation_missing' END AS verdict FROM a
""")
def _(spark, d):
    rows = table(spark, d, "conversations").filter("role = 'assistant'")
    mark = F.element_at(F.array(F.lit(" [E1] [E2] [E1]"), F.lit(" [E13]"), F.lit(" [e2]"), F.lit("")), (F.col("turn") % 4 + 1).cast("int"))
    rows = rows.withColumn("f", text.citation_facts(F.concat("text", mark)))
    verdict = F.when(F.col("f.malformed") > 0, "citation_malformed").when(F.col("f.out_of_range") > 0, "citation_out_of_range").when(F.col("f.references") == 0, "citation_missing").otherwise("passed")
    return rows.select("conv_id", "turn", F.col("f.references").alias("refs"), verdict.alias("verdict"))


@query("n10_parser_miss", r"""
SELECT d.doc_id, CASE WHEN contains(d.text, b.text) THEN 'found' WHEN contains(regexp_replace(lower(d.text), '\s', '', 'g'), regexp_replace(lower(b.text), '\s', '', 'g')) THEN 'whitespace_only' ELSE 'missing' END AS category
FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40
""")
def _(spark, d):
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("i"), F.col("text").alias("needle"))
    rows = table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 40).alias("i")).join(items, "i")
    category = F.when(F.contains("text", "needle"), "found").when(F.contains(text.tight_text(F.col("text")), text.tight_text(F.col("needle"))), "whitespace_only").otherwise("missing")
    return rows.select("doc_id", category.alias("category"))


@query("n11_artifact_recovery", r"SELECT lang, count(*) AS facts, count_if(regexp_matches(regexp_replace(lower(text), '\s', '', 'g'), 'licen[sc]e')) AS recovered FROM documents GROUP BY lang")
def _(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("facts"), F.count_if(text.tight_text(F.col("text")).rlike("licen[sc]e")).alias("recovered"))


@query("n12_filter_audit", with_views(f"""
SELECT reason, count(*) AS probes, count_if(false_recall) AS leaks, (SELECT count(*) FROM ranked r JOIN docs a ON a.document_id = r.query_id JOIN docs b ON b.document_id = r.candidate_id WHERE a.tenant_id <> b.tenant_id AND r.rank <= 3) AS tenant_leaks
FROM (SELECT query_id, {REASON} AS reason, CASE WHEN {REASON} = 'unknown' THEN NULL ELSE coalesce(bool_or(rank <= 10 AND candidate_id % 16 = 0), false) END AS false_recall FROM ranked GROUP BY query_id) WHERE reason <> 'unknown' GROUP BY reason
"""))
def _(spark, d):
    r = view(spark, d, "ranked")
    docs = view(spark, d, "docs").select("document_id", "tenant_id")
    pairs = r.filter("rank <= 3").join(docs.select(F.col("document_id").alias("query_id"), F.col("tenant_id").alias("a")), "query_id").join(docs.select(F.col("document_id").alias("candidate_id"), F.col("tenant_id").alias("b")), "candidate_id")
    leaks = pairs.filter("a <> b").agg(F.count("*").alias("tenant_leaks"))
    audit = no_answer(r, 10).filter("reason <> 'unknown'").groupBy("reason").agg(F.count("*").alias("probes"), F.count_if("false_recall").alias("leaks"))
    return audit.crossJoin(F.broadcast(leaks))  # one row on the right
