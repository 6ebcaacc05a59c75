"""Sections B, F and G: filters and predicates, ordering and top-k, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import relational as R
from quarry.operators import retrieval
from quarry.plans.views import view, with_views
from quarry.registry import query
from quarry.session import table


@query("b01_projection", "SELECT doc_id, lang FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang")


@query("b02_tenant_scope", with_views("SELECT w.code, count(*) AS n FROM snapshots s JOIN warehouses w ON s.warehouse_id = w.warehouse_id AND s.tenant_id = w.tenant_id WHERE s.tenant_id = 'T1' GROUP BY w.code"))
def _(spark, d):
    s, w = view(spark, d, "snapshots"), view(spark, d, "warehouses")
    return s.filter("tenant_id = 'T1'").join(w, ["tenant_id", "warehouse_id"]).groupBy("code").agg(F.count("*").alias("n"))


@query("b03_live_rows", with_views("""
SELECT d.document_id, v.version_id FROM docs d JOIN versions v ON v.document_id = d.document_id AND v.version_id = d.active_version_id JOIN files f ON f.file_id = v.file_id AND f.tenant_id = d.tenant_id
WHERE NOT d.is_deleted AND NOT f.is_deleted AND f.status <> 'soft_deleted' AND v.parse_status = 'ready' AND v.index_status = 'ready'
"""))
def _(spark, d):
    return live_versions(spark, d).select("document_id", "version_id")


def live_versions(spark, d):
    """Documents with their active, parsed and indexed version on a live file of the same tenant."""
    docs = view(spark, d, "docs").filter("NOT is_deleted").withColumnRenamed("active_version_id", "version_id")
    versions = view(spark, d, "versions").filter("parse_status = 'ready' AND index_status = 'ready'")
    files = view(spark, d, "files").filter("NOT is_deleted AND status <> 'soft_deleted'").select("file_id", "tenant_id", "extension", "size_bytes")
    return docs.join(versions, ["document_id", "version_id"]).join(files, ["file_id", "tenant_id"])


@query("b04_in_list", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus IN ('F', 'O')")
def _(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_orderstatus").isin("F", "O")).select("o_orderkey")


@query("b05_neighbour_range", "SELECT q.conv_id, q.turn AS anchor, c.turn FROM conversations q JOIN conversations c ON q.conv_id = c.conv_id AND c.turn BETWEEN greatest(1, q.turn - 1) AND q.turn + 1")
def _(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    q = c.withColumnRenamed("turn", "anchor")
    return q.join(c, "conv_id").filter(F.col("turn").between(F.greatest(F.lit(1), F.col("anchor") - 1), F.col("anchor") + 1))


@query("b06_identity_tuples", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT o_orderkey, 1 FROM orders WHERE o_orderkey % 97 = 0)")
def _(spark, d):
    keys = table(spark, d, "orders").filter("o_orderkey % 97 = 0").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").join(keys, ["l_orderkey", "l_linenumber"], "left_semi")


@query("b07_array_membership", "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), split_part((SELECT min(p_name) FROM part), ' ', 1))")
def _(spark, d):
    part = table(spark, d, "part")
    alias = part.agg(F.element_at(F.split(F.min("p_name"), " "), 1).alias("alias"))
    return part.crossJoin(F.broadcast(alias)).filter(F.array_contains(F.split("p_name", " "), F.col("alias"))).select("p_partkey")  # one row on the right


@query("b08_casefold_equality", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def _(spark, d):
    return table(spark, d, "customer").filter(F.lower("c_mktsegment") == F.lit("BuILDING".casefold())).select("c_custkey")


@query("b09_json_field", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'")
def _(spark, d):
    return table(spark, d, "events").filter(F.get_json_object("props", "$.k") == "7").select("event_id")


@query("b10_json_equality", "SELECT a.event_id, count(*) AS same FROM events a JOIN events b ON CAST(json_extract(a.props, '$.k') AS BIGINT) = CAST(json_extract(b.props, '$.k') AS BIGINT) GROUP BY a.event_id")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", F.from_json("props", "k long").alias("props"))
    per = rows.groupBy("props").agg(F.count("*").alias("same"))  # counted before it is joined: no pairs are made
    return rows.filter("props.k IS NOT NULL").join(per, "props").select("event_id", "same")


@query("b11_lexical_match", "SELECT doc_id FROM documents WHERE list_has_any(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ['stupid', 'licensed', 'erea'])")
def _(spark, d):
    rows = table(spark, d, "documents")
    return rows.filter(F.arrays_overlap(text.tokens(F.col("text")), F.array(*map(F.lit, ["stupid", "licensed", "erea"])))).select("doc_id")


ACL_SQL = """FROM docs d WHERE CAST(d.owner_id AS VARCHAR) = '7' OR EXISTS (SELECT 1 FROM acl a WHERE a.document_id = d.document_id AND
  ((a.subject_type = 'user' AND a.subject_id = '7') OR (a.subject_type = 'role' AND a.subject_id IN ('analyst')) OR (a.subject_type = 'market' AND a.subject_id IN ('de'))))"""


@query("b12_acl", with_views(f"SELECT d.document_id {ACL_SQL}"))
def _(spark, d):
    return R.accessible(view(spark, d, "docs"), view(spark, d, "acl"), "7", ["analyst"], ["de"]).select("document_id")


@query("b12_acl_company_owner", with_views("SELECT document_id FROM docs"))
def _(spark, d):
    return R.accessible(view(spark, d, "docs"), view(spark, d, "acl"), "7", [], [], company_owner=True).select("document_id")


@query("b13_cardinality", with_views("SELECT spu, count(*) AS matches, string_agg(sku, ',' ORDER BY sku) AS names, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'found' END AS status FROM variants WHERE category LIKE '%A%' AND size_value = 10 GROUP BY spu"))
def _(spark, d):
    rows = view(spark, d, "variants").filter("category LIKE '%A%' AND size_value = 10")
    return R.cardinality(rows, ["spu"], "sku")


@query("b14_synthetic_flag", with_views("SELECT s.snapshot_id, s.is_demo AND w.is_demo AND v.is_demo AS synthetic FROM snapshots s JOIN warehouses w ON s.warehouse_id = w.warehouse_id JOIN variants v ON s.variant_id = v.variant_id"))
def _(spark, d):
    s, w, v = (view(spark, d, n) for n in ("snapshots", "warehouses", "variants"))
    full = s.join(w.select("warehouse_id", F.col("is_demo").alias("w")), "warehouse_id").join(v.select("variant_id", F.col("is_demo").alias("v")), "variant_id")
    return full.select("snapshot_id", (F.col("is_demo") & F.col("w") & F.col("v")).alias("synthetic"))


@query("b15_available", with_views("SELECT snapshot_id, on_hand - reserved - unsellable AS available, CASE WHEN on_hand - reserved - unsellable < 0 THEN 'contract_violation' ELSE 'ok' END AS status FROM snapshots"))
def _(spark, d):
    return R.available(view(spark, d, "snapshots")).select("snapshot_id", "available", "status")


def sheet(spark, d):
    """Orders as a sheet: a row per order, cells in order of column."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("row_number"), F.array(F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("cells"))


@query("b16_range_read", "SELECT o_orderkey AS row_number, concat_ws('|', o_orderstatus, o_orderpriority) AS cells FROM orders WHERE o_orderkey BETWEEN 2 AND 90")
def _(spark, d):
    return read_range(sheet(spark, d), "B2:C90").select("row_number", F.array_join("cells", "|").alias("cells"))


def read_range(rows, reference):
    """Rows and columns of a reference such as A1:C9."""
    ref = F.lit(reference)
    part = lambda i: F.regexp_extract(ref, r"^([A-Z]+)(\d+):([A-Z]+)(\d+)$", i)
    first, last = text.column_number(part(1)), text.column_number(part(3))
    return rows.filter(F.col("row_number").between(part(2).cast("long"), part(4).cast("long"))).withColumn("cells", F.slice("cells", first, last - first + 1))


@query("b17_row_range", "SELECT o_orderkey AS row_number FROM orders WHERE o_orderkey BETWEEN 100 AND 199")
def _(spark, d):
    return sheet(spark, d).filter(F.col("row_number").between(100, 199)).select("row_number")


@query("b18_block_read", "SELECT doc_id AS document_id, string_split(text, chr(10))[2] AS body FROM documents WHERE trim(coalesce(string_split(text, chr(10))[2], '')) <> ''")
def _(spark, d):
    blocks = R.adapt_blocks(table(spark, d, "documents"), table(spark, d, "pages"))
    return blocks.filter("kind = 'text' AND position = 2").select("document_id", "body")


@query("b19_preview_blocks", """
SELECT document_id, position FROM (SELECT doc_id AS document_id, CAST(i + 1 AS INT) AS position, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE trim(line) <> '') WHERE r <= 3
""")
def _(spark, d):
    blocks = R.adapt_blocks(table(spark, d, "documents"), table(spark, d, "pages")).filter("kind = 'text'")
    first = F.row_number().over(Window.partitionBy("document_id").orderBy("position"))
    return blocks.withColumn("r", first).filter("r <= 3").select("document_id", "position")


@query("b20_character_budget", """
WITH x AS (SELECT conv_id, turn, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
SELECT conv_id, turn, CAST(least(n, 600 - (upto - n)) AS INT) AS taken, upto > 600 AS truncated FROM x WHERE upto - n < 600 AND r <= 12
""")
def _(spark, d):
    return character_budget(table(spark, d, "conversations").withColumn("n", F.length("text")), "conv_id", "turn", 600, 12).select("conv_id", "turn", "taken", "truncated")


def character_budget(rows, key, order, most, sections):
    """Sections in order until the budget of characters is used; the one that crosses it is cut and marked."""
    w = Window.partitionBy(key).orderBy(order)
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("upto", upto).withColumn("r", F.row_number().over(w)).filter((F.col("upto") - F.col("n") < most) & (F.col("r") <= sections))
    return rows.withColumn("taken", F.least(F.col("n"), F.lit(most) - (F.col("upto") - F.col("n"))).cast("int")).withColumn("truncated", F.col("upto") > most)


@query("b21_cell_cap", "SELECT lang, least(n, greatest(1, 1000 // n)) AS columns, n > greatest(1, 1000 // n) AS clipped FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def _(spark, d):
    rows = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    width = F.greatest(F.lit(1), F.floor(F.lit(1000) / F.col("n")))
    return rows.select("lang", F.least("n", width).alias("columns"), (F.col("n") > width).alias("clipped"))


@query("b22_permission", with_views("""
SELECT call_id, CASE WHEN tool = 'read_uploaded_file' THEN 'tool_not_registered' WHEN tool = 'get_evidence_detail' AND call_id % 2 = 0 THEN 'not_read_only' WHEN call_id % 3 <> 1 THEN 'tenant_mismatch'
  WHEN call_id % 7 = 0 THEN 'role_denied' WHEN tool = 'search_inventory' AND call_id % 4 = 0 THEN 'market_required' WHEN tool = 'search_inventory' AND call_id % 4 <> 1 THEN 'market_denied' ELSE 'allowed' END AS decision FROM tool_calls
"""))
def _(spark, d):
    calls = view(spark, d, "tool_calls").select("call_id", "tool", F.concat(F.lit("T"), (F.col("call_id") % 3).cast("string")).alias("tenant"), F.when(F.col("call_id") % 7 == 0, F.array(F.lit("guest"))).otherwise(F.array(F.lit("analyst"))).alias("roles"), F.element_at(F.array(F.lit(None).cast("string"), F.lit("DE"), F.lit("FR"), F.lit("US")), (F.col("call_id") % 4 + 1).cast("int")).alias("market"))
    policy = spark.createDataFrame([("get_product_spec", True, False), ("search_inventory", True, True), ("search_knowledge", True, False), ("get_evidence_detail", None, False)], "tool string, read_only boolean, scoped boolean")
    full = calls.join(F.broadcast(policy.withColumn("known", F.lit(True))), "tool", "left").withColumn("read_only", F.coalesce("read_only", F.col("call_id") % 2 == 1))
    rules = [
        (F.coalesce("known", F.lit(False)), "tool_not_registered"), (F.col("read_only"), "not_read_only"), (F.col("tenant") == "T1", "tenant_mismatch"), (F.arrays_overlap("roles", F.array(F.lit("analyst"), F.lit("support"))), "role_denied"),
        (~F.col("scoped") | F.col("market").isNotNull(), "market_required"), (~F.col("scoped") | F.col("market").isin("DE"), "market_denied"),
    ]
    return full.select("call_id", R.first_failure(rules).alias("decision"))


@query("b23_identity_gate", "SELECT label, count(*) FILTER (vec_id % 3 = 0) AS matching, CASE WHEN count(*) FILTER (vec_id % 3 = 0) = 0 THEN 'identity_mismatch' ELSE 'ok' END AS status FROM embeddings GROUP BY label")
def _(spark, d):
    rows = table(spark, d, "embeddings").select("label", F.struct(F.when(F.col("vec_id") % 3 == 0, "m1").otherwise("m2").alias("model"), F.lit("r1").alias("revision")).alias("identity"))
    want = F.struct(F.lit("m1").alias("model"), F.lit("r1").alias("revision"))
    out = rows.groupBy("label").agg(F.count_if(F.col("identity") == want).alias("matching"))
    return out.withColumn("status", F.when(F.col("matching") == 0, "identity_mismatch").otherwise("ok"))


COSINE = "1 - list_dot_product(e.embedding::DOUBLE[], x.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(x.embedding::DOUBLE[], x.embedding::DOUBLE[])))"


@query("f01_dense_topk", f"SELECT query_id, vec_id, round(dist, 6) + 0.0 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS r FROM (SELECT x.vec_id AS query_id, e.vec_id, {COSINE} AS dist FROM embeddings e, embeddings x WHERE x.vec_id % 100 = 0)) WHERE r <= 30")
def _(spark, d):
    rows = table(spark, d, "embeddings")
    q = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    near = retrieval.dense_topk(rows.select(F.col("vec_id").alias("chunk_id"), "embedding"), q, 30)
    return near.select("query_id", F.col("chunk_id").alias("vec_id"), (F.round("distance", 6) + 0.0).alias("distance"))


@query("f05_recent_list", with_views("SELECT document_id FROM docs WHERE NOT is_deleted ORDER BY created_seq DESC, document_id LIMIT 50"))
def _(spark, d):
    return view(spark, d, "docs").filter("NOT is_deleted").orderBy(F.desc_nulls_last("created_seq"), "document_id").limit(50).select("document_id")


@query("f06_chronological_tail", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3")
def _(spark, d):
    return tail(table(spark, d, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "pos")


def tail(rows, key, order, n):
    """The last n rows of each group, numbered in order."""
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("r") <= n)
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(order))).drop("r")


@query("f07_latest_version", with_views("SELECT document_id, version_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY version_no DESC) AS r FROM versions) WHERE r = 1"))
def _(spark, d):
    return view(spark, d, "versions").groupBy("document_id").agg(F.max_by("version_id", "version_no").alias("version_id"))


@query("f08_natural_order", with_views("SELECT warehouse_id, row_number() OVER (ORDER BY code, warehouse_id) AS pos FROM warehouses"))
def _(spark, d):
    return view(spark, d, "warehouses").select("warehouse_id", F.row_number().over(Window.orderBy(F.asc_nulls_last("code"), "warehouse_id")).alias("pos"))


@query("f09_fetch_one", with_views("SELECT 'SKU-7' AS sku, CASE count(*) WHEN 0 THEN 'not_found' WHEN 1 THEN 'found' ELSE 'ambiguous' END AS status, min(variant_id) AS variant_id FROM variants WHERE sku = 'SKU-7'"))
def _(spark, d):
    two = view(spark, d, "variants").filter("sku = 'SKU-7'").limit(2)
    return two.agg(F.count("*").alias("n"), F.min("variant_id").alias("variant_id")).select(F.lit("SKU-7").alias("sku"), F.when(F.col("n") == 0, "not_found").when(F.col("n") == 1, "found").otherwise("ambiguous").alias("status"), "variant_id")


@query("g01_union_dedup", "SELECT doc_id, bool_or(a) AS in_first, bool_or(b) AS in_second FROM (SELECT doc_id, true AS a, false AS b FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, false, true FROM documents WHERE doc_id % 4 = 0) GROUP BY doc_id")
def _(spark, d):
    ids = table(spark, d, "documents").select("doc_id")
    one = ids.filter("doc_id % 3 = 0").select("doc_id", F.lit(True).alias("a"), F.lit(False).alias("b"))
    two = ids.filter("doc_id % 4 = 0").select("doc_id", F.lit(False).alias("a"), F.lit(True).alias("b"))
    return one.unionByName(two).groupBy("doc_id").agg(F.bool_or("a").alias("in_first"), F.bool_or("b").alias("in_second"))


@query("g02_intersection", "SELECT l_partkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY l_partkey HAVING count(DISTINCT l_returnflag) = 3")
def _(spark, d):
    rows = table(spark, d, "lineitem").filter(F.col("l_returnflag").isin("A", "N", "R")).groupBy("l_partkey").agg(F.countDistinct("l_returnflag").alias("n"))
    return rows.filter("n = 3").select("l_partkey")


@query("g03_difference", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("g04_same_cohort", """
SELECT lang, CASE WHEN a = 0 AND b = 0 THEN 'equal' WHEN a = 0 THEN 'subset' WHEN b = 0 THEN 'superset' ELSE 'overlapping' END AS relation
FROM (SELECT lang, count_if(quality = 1 AND toxic <> 0) AS a, count_if(quality <> 1 AND toxic = 0) AS b FROM labels JOIN documents USING (doc_id) GROUP BY lang)
""")
def _(spark, d):
    """How the cohort of good documents stands to that of harmless ones, language by language."""
    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return R.cohort_relation(rows, ["lang"], F.col("quality") == 1, F.col("toxic") == 0)


@query("g05_ordered_distinct", "SELECT conv_id, turn, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i), ' ') AS words FROM (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations)")
def _(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))
