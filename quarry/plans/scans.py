"""Section A: scans, previews, ad-hoc SQL, uploads, artifacts and their JSON and Markdown forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quarry.functions import hashing, text
from quarry.operators import relational as R
from quarry.plans.views import sql, view, with_views
from quarry.registry import query
from quarry.session import TABLES, table


@query("a01_table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def _(spark, d):
    parts = [table(spark, d, t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n")) for t in TABLES]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("a02_health", "SELECT 1 AS ok")
def _(spark, d):
    return spark.sql("SELECT 1 AS ok")


@query("a03_list_tables", " UNION ALL ".join(f"SELECT '{t}' AS table_name" for t in TABLES))
def _(spark, d):
    return spark.createDataFrame([(t,) for t in TABLES], "table_name string")


@query("a04_preview", "SELECT n_nationkey AS pos, concat_ws(',', coalesce(CAST(n_nationkey AS VARCHAR), 'None'), coalesce(n_name, 'None'), coalesce(CAST(n_regionkey AS VARCHAR), 'None')) AS line FROM nation ORDER BY n_nationkey LIMIT 100")
def _(spark, d):
    rows = table(spark, d, "nation").orderBy("n_nationkey").limit(100)
    return rows.select(F.col("n_nationkey").alias("pos"), R.as_csv_line(rows).alias("line"))


AD_HOC = "SELECT o_orderpriority, count(*) AS n, sum(l_quantity) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderpriority"


@query("a05_ad_hoc_sql", f"SELECT concat_ws(',', o_orderpriority, CAST(n AS VARCHAR), CAST(CAST(qty AS BIGINT) AS VARCHAR)) AS line FROM ({AD_HOC})")
def _(spark, d):
    rows = sql(spark, d, AD_HOC).withColumn("qty", F.col("qty").cast("long"))
    return rows.select(R.as_csv_line(rows).alias("line"))


@query("a12_canonical_blocks", """
SELECT document_id, position, kind, body, rows FROM (
  SELECT doc_id AS document_id, CAST(i + 1 AS INT) AS position, 'text' AS kind, line AS body, NULL::INT AS rows FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE trim(line) <> ''
  UNION ALL SELECT -page_id - 1, 1, 'table', NULL, CAST(len(string_split(html, chr(10))) AS INT) FROM pages)
""")
def _(spark, d):
    return R.adapt_blocks(table(spark, d, "documents"), table(spark, d, "pages"))


@query("a14_upload_validation", """
SELECT page_id, CASE WHEN ext NOT IN ('html', 'pdf') THEN 'extension_not_allowed' WHEN strlen(html) = 0 THEN 'empty' WHEN strlen(html) > 4000 THEN 'too_large'
  WHEN ext = 'pdf' AND NOT starts_with(html, '%PDF-') THEN 'content_mismatch' ELSE 'ok' END AS status
FROM (SELECT page_id, coalesce(html, '') AS html, CASE page_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'pdf' ELSE 'exe' END AS ext FROM pages)
""")
def _(spark, d):
    files = table(spark, d, "pages").select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("content"), F.when(F.col("page_id") % 3 == 0, "html").when(F.col("page_id") % 3 == 1, "pdf").otherwise("exe").alias("extension"))
    return files.select("page_id", R.upload_status("extension", "content", {"html": "", "pdf": "%PDF-"}, 4000).alias("status"))


@query("a15_describe", """
SELECT * FROM (SELECT 'p_size' AS name, count(p_size) AS n, round(avg(p_size), 6) AS mean, round(stddev_samp(p_size), 6) AS std, CAST(min(p_size) AS DOUBLE) AS min, quantile_cont(p_size, 0.25) AS q25, quantile_cont(p_size, 0.5) AS q50, quantile_cont(p_size, 0.75) AS q75, CAST(max(p_size) AS DOUBLE) AS max FROM part)
UNION ALL SELECT 'p_retailprice', count(p_retailprice), round(avg(p_retailprice), 6), round(stddev_samp(p_retailprice), 6), min(p_retailprice), quantile_cont(p_retailprice, 0.25), quantile_cont(p_retailprice, 0.5), quantile_cont(p_retailprice, 0.75), max(p_retailprice) FROM part
""")
def _(spark, d):
    return R.describe(table(spark, d, "part"), ["p_size", "p_retailprice"])


@query("a16_artifact_identity", """
SELECT doc_id, sha256('{"blocks":' || CAST(len(string_split(text, chr(10))) AS VARCHAR) || ',"document_id":' || CAST(doc_id AS VARCHAR) || ',"language":"' || lang || '","source":"' || source || '"}') AS artifact_id FROM documents
""")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.struct(F.col("source"), F.col("lang").alias("language"), F.size(F.split("text", "\n")).alias("blocks"), F.col("doc_id").alias("document_id")).alias("a"))
    return rows.select("doc_id", hashing.canonical_sha256(F.col("a"), rows.schema["a"].dataType).alias("artifact_id"))


@query("a17_markdown", """
SELECT conv_id, sha256(string_agg('## ' || role || chr(10) || chr(10) || replace(replace(replace(text, '\\', '\\\\'), '|', '\\|'), chr(10), '<br>'), chr(10) || chr(10) ORDER BY turn)) AS markdown_sha FROM conversations GROUP BY conv_id
""")
def _(spark, d):
    turns = table(spark, d, "conversations")
    block = F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), text.escape_cell(F.col("text")))
    return turns.groupBy("conv_id").agg(F.sha2(R.joined_in_order(block, "turn", "\n\n"), 256).alias("markdown_sha"))


@query("a18_idempotent_seed", with_views("""
SELECT s.variant_id, CASE WHEN s.variant_id % 10 >= 5 THEN 'inserted' WHEN s.variant_id % 10 = 0 THEN 'conflict' ELSE 'unchanged' END AS outcome FROM variants s
"""))
def _(spark, d):
    seed = view(spark, d, "variants").select("variant_id", "sku", "name_en")
    stored = seed.filter("variant_id % 10 < 5").withColumn("name_en", F.when(F.col("variant_id") % 10 == 0, F.concat("name_en", F.lit("?"))).otherwise(F.col("name_en")))
    return R.seed_outcome(seed, stored, ["variant_id"]).select("variant_id", "outcome")


@query("a22_report_identity", "SELECT lang, sha256('{\"cases\":' || count(*) || ',\"lang\":\"' || lang || '\",\"passed\":' || count(*) FILTER (doc_id % 3 = 0) || '}') AS report_sha FROM documents GROUP BY lang")
def _(spark, d):
    rows = table(spark, d, "documents").groupBy("lang").agg(F.count_if(F.col("doc_id") % 3 == 0).alias("passed"), F.count("*").alias("cases"))
    rows = rows.select("lang", F.struct("lang", "cases", "passed").alias("r"))
    return rows.select("lang", hashing.canonical_sha256(F.col("r"), rows.schema["r"].dataType).alias("report_sha"))
