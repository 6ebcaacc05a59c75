"""The engine's business tables, derived from the supplied ones by fixed rules.

Each view is a SELECT over the supplied tables in SQL that Spark and DuckDB read alike, so a query
and its oracle start from the same rows. `view` gives the Spark side, `with_views` the other one.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import TABLES, table

VIEWS = {
    # A snapshot per order line: variant = part, warehouse = supplier, market = nation.
    "snapshots": """SELECT l_orderkey * 10 + l_linenumber AS snapshot_id, concat('T', CAST(l_suppkey % 3 AS STRING)) AS tenant_id,
        l_partkey AS variant_id, l_suppkey AS warehouse_id, l_shipdate AS snapshot_at, CAST(l_quantity AS INT) AS on_hand,
        l_linenumber AS reserved, CAST(l_orderkey % 5 AS INT) AS unsellable, CAST(l_orderkey % 11 AS INT) AS inbound,
        CAST(l_partkey % 7 AS INT) AS safety_stock, l_returnflag = 'N' AS is_demo FROM lineitem""",
    "warehouses": """SELECT s_suppkey AS warehouse_id, concat('T', CAST(s_suppkey % 3 AS STRING)) AS tenant_id, s_name AS code, n_name AS market_code,
        CASE WHEN s_suppkey % 10 = 0 THEN 'inactive' ELSE 'active' END AS status, s_suppkey % 2 = 0 AS is_demo
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "variants": """SELECT p_partkey AS variant_id, concat('SKU-', CAST(p_partkey AS STRING)) AS sku, p_brand AS spu, p_name AS name_en, p_type AS category,
        CASE WHEN p_partkey % 13 = 0 THEN 'inactive' ELSE 'active' END AS status, p_size AS size_value, p_partkey % 3 = 0 AS is_demo FROM part""",
    "specs": """SELECT p_partkey AS variant_id, 'size' AS name, CAST(p_size AS STRING) AS value, 'cm' AS unit,
        CASE WHEN p_partkey % 4 = 0 THEN 'pending' ELSE 'verified' END AS verification_status FROM part WHERE p_partkey % 6 <> 0
        UNION ALL SELECT p_partkey, 'brand', p_brand, NULL, 'verified' FROM part WHERE p_partkey % 6 <> 0""",
    # Governed files, documents and versions of the text table.
    "files": """SELECT doc_id AS file_id, concat('T', CAST(doc_id % 3 AS STRING)) AS tenant_id, doc_id % 50 AS owner_id, CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'xlsx' ELSE 'csv' END AS extension,
        n_chars AS size_bytes, CASE WHEN doc_id % 23 = 0 THEN 'soft_deleted' WHEN doc_id % 19 = 0 THEN 'uploaded' ELSE 'ready' END AS status, doc_id % 23 = 0 AS is_deleted, doc_id AS created_seq FROM documents""",
    "docs": """SELECT doc_id AS document_id, concat('T', CAST(doc_id % 3 AS STRING)) AS tenant_id, doc_id % 50 AS owner_id, source AS document_type, lang AS market,
        CASE WHEN doc_id % 5 = 0 THEN 'restricted' ELSE 'company' END AS access_level, doc_id * 10 + 1 + CAST(doc_id % 2 AS INT) AS active_version_id, doc_id % 31 = 0 AS is_deleted, doc_id AS created_seq FROM documents""",
    "versions": """SELECT doc_id * 10 + 1 AS version_id, doc_id AS document_id, doc_id AS file_id, 1 AS version_no, 'ready' AS parse_status, CASE WHEN doc_id % 2 = 0 THEN 'ready' ELSE 'superseded' END AS index_status FROM documents
        UNION ALL SELECT doc_id * 10 + 2, doc_id, doc_id, 2, CASE WHEN doc_id % 29 = 0 THEN 'failed' ELSE 'ready' END, CASE WHEN doc_id % 29 = 0 THEN 'pending' ELSE 'ready' END FROM documents WHERE doc_id % 2 = 1""",
    "acl": """SELECT doc_id AS document_id, 'user' AS subject_type, CAST((doc_id * 7) % 50 AS STRING) AS subject_id FROM documents WHERE doc_id % 3 = 0
        UNION ALL SELECT doc_id, 'role', CASE WHEN doc_id % 2 = 0 THEN 'analyst' ELSE 'support' END FROM documents WHERE doc_id % 4 = 0
        UNION ALL SELECT doc_id, 'market', lang FROM documents WHERE doc_id % 5 = 1""",
    "users": """SELECT c_custkey AS user_id, concat('T', CAST(c_custkey % 3 AS STRING)) AS tenant_id, lower(c_name) AS email, CASE WHEN c_custkey % 17 = 0 THEN 'disabled' ELSE 'active' END AS status FROM customer""",
    "user_roles": """SELECT c_custkey AS user_id, lower(c_mktsegment) AS role_name, n_name AS market FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 <> 0
        UNION ALL SELECT c_custkey, 'viewer', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0""",
    # Runs, tool calls and tasks of the event table.
    "runs": """SELECT event_id AS run_id, event_id - event_id % 8 AS root_id, event_id % 8 = 0 AS is_root, user_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'waiting' WHEN 'signup' THEN 'running' ELSE 'completed' END AS status, ts, value FROM events""",
    "tool_calls": """SELECT event_id AS call_id, event_id - event_id % 3 AS run_id, CASE event_id % 5 WHEN 0 THEN 'get_product_spec' WHEN 1 THEN 'search_inventory' WHEN 2 THEN 'search_knowledge' WHEN 3 THEN 'read_uploaded_file' ELSE 'get_evidence_detail' END AS tool,
        CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status, CAST(floor(value * 10) AS BIGINT) AS duration_ms, ts, props FROM events""",
    "tasks": """SELECT event_id AS task_id, event_id - event_id % 10 AS plan_id, concat('w', CAST(event_id % 3 AS STRING)) AS worker, CASE WHEN event_id % 10 < 3 THEN 'completed' WHEN event_id % 10 = 9 THEN 'failed' ELSE 'pending' END AS status FROM events""",
    "task_edges": """SELECT event_id AS task_id, event_id - 2 AS depends_on FROM events WHERE event_id % 10 >= 2 UNION ALL SELECT event_id, event_id - 5 FROM events WHERE event_id % 10 >= 5""",
    # Ranked lists: queries are the rows whose id is divisible by 100, candidates all other rows of the label. Evidence are the
    # six nearest by their first component; the ranked list is the first forty by a fixed order.
    "golden": """SELECT query_id, evidence_id FROM (SELECT q.vec_id AS query_id, c.vec_id AS evidence_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY abs(CAST(element_at(c.embedding, 1) AS DOUBLE) - CAST(element_at(q.embedding, 1) AS DOUBLE)), c.vec_id) AS r
        FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id) x WHERE r <= 6""",
    "ranked": """SELECT query_id, candidate_id, CAST(rank AS INT) AS rank FROM (SELECT q.vec_id AS query_id, c.vec_id AS candidate_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY (c.vec_id * 7919 + q.vec_id * 104729) % 1009, c.vec_id) AS rank
        FROM embeddings q JOIN embeddings c ON q.label = c.label WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id) x WHERE rank <= 40""",
}


#: Bytes of queries that are sent to every task at once; more are taken block by block, a scan of the candidates each.
QUERY_BYTES = 16 << 20


def _of_label(spark: SparkSession, sf_dir: str, order: Callable[[], list[Column]], k: int) -> DataFrame:
    """query_id, candidate_id, rank: the first k other rows of each query's label.

    Candidates are never dealt out by label, of which there are few: queries are broadcast, in blocks whose size follows from the
    table's as the plan knows it, and every task keeps k rows a query.
    """
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.element_at("embedding", 1).cast("double").alias("x"))
    queries = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("x").alias("y"))
    # a row of the table takes more bytes than a query has, and one in a hundred is a query
    blocks = 1 + int(str(rows._jdf.queryExecution().analyzed().stats().sizeInBytes())) // 100 // QUERY_BYTES
    found = None
    for b in range(blocks):
        some = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        met = rows.join(F.broadcast(some), "label").filter("vec_id <> query_id")
        first = F.row_number().over(Window.partitionBy("query_id").orderBy(*order(), "vec_id"))
        part = met.withColumn("rank", first).filter(F.col("rank") <= k).select("query_id", F.col("vec_id").alias("candidate_id"), "rank")
        found = part if found is None else found.unionByName(part)
    return found


#: Derived tables that Spark makes in another way than the SQL above says; the rows are the same.
BUILT: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "golden": lambda spark, d: _of_label(spark, d, lambda: [F.abs(F.col("x") - F.col("y"))], 6).select("query_id", F.col("candidate_id").alias("evidence_id")),
    "ranked": lambda spark, d: _of_label(spark, d, lambda: [(F.col("vec_id") * 7919 + F.col("query_id") * 104729) % 1009], 40),
}


def _uses(sql: str, names) -> list[str]:
    words = set(re.findall(r"\w+", sql))
    return [n for n in names if n in words]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table as a DataFrame."""
    return BUILT[name](spark, sf_dir) if name in BUILT else sql(spark, sf_dir, VIEWS[name])


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Any SQL over the supplied and derived tables, without leaving temporary views behind."""
    frames = {n: table(spark, sf_dir, n) for n in _uses(text, TABLES)}
    frames |= {n: view(spark, sf_dir, n) for n in _uses(text, VIEWS) if VIEWS[n] != text}
    marked = text.replace("{", "{{").replace("}", "}}")
    for n in frames:
        marked = re.sub(rf"(?i)\b(from|join)(\s+){n}\b(?!\.)", rf"\1\2{{{n}}}", marked)
    used = {n: f for n, f in frames.items() if f"{{{n}}}" in marked}
    return spark.sql(marked, **used)


def with_views(text: str) -> str:
    """The oracle's form: the derived tables that the text names, as common table expressions."""
    names, todo = [], _uses(text, VIEWS)
    while todo:
        n = todo.pop()
        if n not in names:
            names.append(n)
            todo += [m for m in _uses(VIEWS[n], VIEWS) if m != n]
    ordered = [n for n in VIEWS if n in names]
    if not ordered:
        return text
    body = text.strip()
    more = re.match(r"(?i)with\s+(recursive\s+)?", body)
    # DuckDB knows STRING as a name of VARCHAR, and element_at of lists by another one
    heads = ", ".join(f"{n} AS ({VIEWS[n]})" for n in ordered).replace("element_at(", "list_extract(")
    return f"WITH {more[1] or ''}{heads}, {body[more.end():]}" if more else f"WITH {heads} {body}"
