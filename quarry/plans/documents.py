"""Sections H and L: scalar functions and document processing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import hashing, text, vectors
from quarry.operators import audit, chunking, context, quality_gate
from quarry.operators import relational as R
from quarry.plans.views import view, with_views
from quarry.registry import query
from quarry.session import table

TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query("h01_tokens", f"SELECT doc_id, len({TOKENS}) AS n, sha256(array_to_string({TOKENS}, ' ')) AS digest FROM documents")
def _(spark, d):
    t = text.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.sha2(F.array_join(t, " "), 256).alias("digest"))


@query("h02_token_count", r"SELECT doc_id, CAST(list_sum(list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\s\p{Z}\p{L}\p{N}_]'), lambda x: ceil(length(x) / 4.0))) AS INT) AS tokens FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.token_count(F.col("text")).alias("tokens"))


@query("h03_source_text", r"""
SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents
""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.source_text(F.col("text")), 256).alias("digest"))


@query("h04_match_text", r"SELECT item_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS m FROM benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.match_text(F.col("text")).alias("m"))


@query("h05_phrase_containment", r"SELECT doc_id, contains(regexp_replace(lower(text), '\s', '', 'g'), 'allrightsreserved') AS found FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.contains(text.tight_text(F.col("text")), F.lit("allrightsreserved")).alias("found"))


@query("h06_relaxed_text", r"SELECT item_id, regexp_replace(lower(text), '[\p{P}\p{Z}\s]', '', 'g') AS m FROM benchmark")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.relaxed_text(F.col("text")).alias("m"))


@query("h07_longest_common_run")
def _(spark, d):
    """Share of each benchmark item's tokens in its longest run within the text of the same number."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), text.tokens(F.col("text")).alias("a"))
    docs = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("b"))
    return items.join(docs, "doc_id").select("doc_id", text.longest_common_run(F.col("a"), F.col("b")).alias("share"))


MARKED = "(SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'see [E1] and [E2], [E1]' WHEN 1 THEN 'see [E13]' WHEN 2 THEN 'see [e3]' WHEN 3 THEN 'see ［E4］' WHEN 4 THEN 'see [E01] [E0]' ELSE 'none' END AS answer FROM events)"


def marked(spark, d):
    forms = ["see [E1] and [E2], [E1]", "see [E13]", "see [e3]", "see ［E4］", "see [E01] [E0]", "none"]
    return table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, forms)), (F.col("event_id") % 6 + 1).cast("int")).alias("answer"))


@query("h08_citation_labels", f"SELECT event_id, CASE event_id % 6 WHEN 0 THEN '[E1],[E2]' WHEN 5 THEN '' END AS labels FROM {MARKED}")
def _(spark, d):
    return marked(spark, d).select("event_id", F.array_join(text.citation_labels(F.col("answer")), ",").alias("labels"))


@query("h09_citation_facts", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 4 THEN 1 ELSE 0 END AS refs, CASE WHEN event_id % 6 IN (2, 3, 4) THEN 1 ELSE 0 END AS malformed, CASE event_id % 6 WHEN 0 THEN 1 ELSE 0 END AS duplicates, CASE WHEN event_id % 6 IN (1, 4) THEN 1 ELSE 0 END AS out_of_range FROM events")
def _(spark, d):
    rows = marked(spark, d).withColumn("f", text.citation_facts(F.col("answer")))
    return rows.select("event_id", F.col("f.references").alias("refs"), "f.malformed", "f.duplicates", "f.out_of_range")


@query("h10_safe_memory", r"""
SELECT conv_id, turn, CASE WHEN m = '' THEN '[redacted-content]' ELSE substr(m, 1, 1000) END AS safe FROM (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  text || ' password: x1 /home/a/b drop table', '\b(?:api[_-]?key|access[_-]?token|refresh[_-]?token|password|secret|storage[_-]?key)\s*[:=]\s*\S+', '[redacted-secret]', 'gi'),
  '(?:[A-Za-z]:[\\/][^\s]+|\\\\[^\s]+|/(?:home|users|var|etc|tmp|workspace|mnt)/[^\s]+)', '[redacted-path]', 'gi'), '\b(?:select|insert|update|delete|drop|alter)\s+', '[redacted-sql] ', 'gi'), '\btraceback\b', '[redacted-trace]', 'gi'), '\s+', ' ', 'g')) AS m FROM conversations)
""")
def _(spark, d):
    rows = table(spark, d, "conversations").withColumn("t", F.concat("text", F.lit(" password: x1 /home/a/b drop table")))
    return rows.select("conv_id", "turn", text.safe_memory(F.col("t")).alias("safe"))


@query("h12_argument_summary", """
SELECT event_id, '{"api_key": "[REDACTED]", "extra": {"k": ' || json_extract_string(props, '$.k') || '}, "filters": {"a": {"b": "[TRUNCATED]"}, "sql_text": "[REDACTED]"}, "ids": [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, "[TRUNCATED]"], "note": "' || repeat('x', 197) || '..."}' AS summary FROM events
""")
def _(spark, d):
    """Bounded arguments: names in order, sensitive ones hidden, long texts and lists and deep structures cut."""
    fixed = '"note": "' + "x" * 300 + '", "api_key": "s3cr3t", "filters": {"sql_text": "select 1", "a": {"b": 1}}, "ids": [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]'
    arguments = F.concat(F.lit("{" + fixed + ', "extra": '), "props", F.lit("}"))
    return table(spark, d, "events").select("event_id", quality_gate.summarize_arguments(arguments).alias("summary"))


@query("h13_canonical_json", "SELECT event_id, sha256('{\"event_type\":\"' || event_type || '\",\"ids\":{\"event\":' || event_id || ',\"user\":' || user_id || '}}') AS digest FROM events")
def _(spark, d):
    rows = table(spark, d, "events").select("event_id", F.struct(F.struct(F.col("user_id").alias("user"), F.col("event_id").alias("event")).alias("ids"), "event_type").alias("s"))
    return rows.select("event_id", hashing.canonical_sha256(F.col("s"), rows.schema["s"].dataType).alias("digest"))


@query("h14_text_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.text_sha256("text").alias("digest"))


@query("h15_uuid5", """
SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8', '9', 'a', 'b'][CAST('0x' || substr(h, 17, 1) AS INT) % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
FROM (SELECT event_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('chunk:' || event_id)) AS h FROM events)
""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", hashing.uuid5("6ba7b8109dad11d180b400c04fd430c8", F.concat(F.lit("chunk:"), F.col("event_id").cast("string"))).alias("id"))


@query("h16_cache_key", "SELECT doc_id, sha256('2:m1' || '1:' || (doc_id % 3) || length(text) || ':' || text) AS k FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", hashing.cache_key(F.lit("m1"), F.col("doc_id") % 3, F.col("text")).alias("k"))


@query("h17_fixed_embedding")
def _(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", vectors.fixed_embedding(F.col("text"), "document").alias("v"))
    return rows.select("item_id", F.round(vectors.norm(F.col("v")), 9).alias("norm"), F.round(F.element_at("v", 1), 9).alias("first"))


@query("h18_fixed_rerank_score", "SELECT doc_id, round(-8 + 16 * (CAST(('0x' || substr(sha256('q|' || doc_id), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551615.0::DOUBLE), 6) AS score FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(hashing.scaled_hash(F.concat(F.lit("q|"), F.col("doc_id").cast("string")), -8.0, 8.0), 6).alias("score"))


@query("h19_sigmoid", "SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS p FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.round(text.stable_sigmoid((F.col("value") - 50) / 10), 6).alias("p"))


@query("h21_vector_check", "SELECT vec_id, len(embedding) = 64 AND abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 0.001 AS usable FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", vectors.usable(F.col("embedding"), 64).alias("usable"))


LABEL = "CASE WHEN p_size > 26 THEN chr(CAST(64 + (p_size - 1) // 26 AS INT)) ELSE '' END || chr(CAST(65 + (p_size - 1) % 26 AS INT))"


@query("h23_column_label", f"SELECT p_partkey, {LABEL} AS label, p_size AS number FROM part")
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey", text.column_label(F.col("p_size")).alias("label"))
    return rows.select("p_partkey", "label", text.column_number(F.col("label")).alias("number"))


@query("h24_cell_escape", r"SELECT page_id, sha256(replace(replace(replace(html, '\', '\\'), '|', '\|'), chr(10), '<br>')) AS digest FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(text.escape_cell(F.col("html")), 256).alias("digest"))


@query("h25_row_render", "SELECT n_nationkey, rtrim('[data' || CASE WHEN n_nationkey % 2 = 0 THEN ' context' ELSE '' END || ' row ' || n_nationkey || '] ' || n_name || CASE WHEN n_nationkey % 3 = 0 THEN ' (=A1)' ELSE '' END || ' | ') AS line FROM nation")
def _(spark, d):
    n = table(spark, d, "nation")
    cells = F.array(text.cell_text(F.col("n_name"), F.when(F.col("n_nationkey") % 3 == 0, "=A1")), F.lit(""))
    return n.select("n_nationkey", text.row_text(F.lit("data"), F.col("n_nationkey") % 2 == 0, F.col("n_nationkey"), cells).alias("line"))


@query("h26_scalar_text", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN upper(CAST(event_id % 8 = 0 AS VARCHAR)) WHEN 1 THEN CAST(event_id AS VARCHAR) WHEN 2 THEN event_type ELSE '' END AS shown FROM events")
def _(spark, d):
    m = F.col("event_id") % 4
    kind = F.when(m == 0, "boolean").when(m == 1, "number").when(m == 2, "text").otherwise("empty")
    return table(spark, d, "events").select("event_id", text.scalar_text(kind, F.when(m == 2, F.col("event_type")), F.col("event_id"), F.col("event_id") % 8 == 0).alias("shown"))


@query("h27_solid_length", r"SELECT doc_id, length(regexp_replace(text, '\s', '', 'g')) AS n FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.solid_length(F.col("text")).alias("n"))


@query("h28_rounded_ratio", "SELECT l_orderkey, l_linenumber, round(l_linenumber / l_quantity, 6) AS share FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_linenumber") / F.col("l_quantity"), 6).alias("share"))


@query("h29_delimiter", r"""
SELECT doc_id, CASE WHEN c = m THEN ',' WHEN s = m THEN ';' WHEN t = m THEN chr(9) ELSE '|' END AS delimiter FROM (SELECT *, greatest(c, s, t, b) AS m FROM (SELECT doc_id, length(text) - length(replace(text, ',', '')) AS c,
  length(text) - length(replace(text, ';', '')) AS s, length(text) - length(replace(text, chr(9), '')) AS t, length(text) - length(replace(text, '|', '')) AS b FROM documents))
""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.best_delimiter(F.col("text")).alias("delimiter"))


@query("h30_locators", with_views("SELECT file_id, CASE extension WHEN 'pdf' THEN 'page ' || (1 + file_id % 9) WHEN 'docx' THEN 'paragraph ' || (1 + file_id % 40) WHEN 'xlsx' THEN 'sheet S1!A' || (1 + file_id % 99) ELSE 'row ' || (1 + file_id % 99) END AS locator FROM files"))
def _(spark, d):
    e, n = F.col("extension"), F.col("file_id")
    at = lambda head, m: F.concat(F.lit(head), (1 + n % m).cast("string"))
    return view(spark, d, "files").select("file_id", F.when(e == "pdf", at("page ", 9)).when(e == "docx", at("paragraph ", 40)).when(e == "xlsx", at("sheet S1!A", 99)).otherwise(at("row ", 99)).alias("locator"))


LINES = "(SELECT doc_id, i, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents))"


def lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))


KINDS = " ".join(f"WHEN regexp_matches(t, '{form}') THEN '{kind}'" for kind, form in quality_gate.LINE_KINDS.items())


@query("h31_line_kinds", rf"SELECT doc_id, i, CASE {KINDS} ELSE 'text' END AS kind FROM (SELECT doc_id, i, trim(regexp_replace(line, '\s+', ' ', 'g')) AS t FROM {LINES})")
def _(spark, d):
    x = F.col("line")
    return lines(spark, d).select("doc_id", "i", quality_gate.line_kind(x).alias("kind"))


@query("h32_text_role", rf"SELECT doc_id, i, regexp_matches(line, '^(?:[-*–—]\s+|[•▪◦]\s*|(?:\d{{1,4}}|[A-Za-z])[.)、]\s*)') AS is_list FROM {LINES}")
def _(spark, d):
    return lines(spark, d).select("doc_id", "i", text.is_list_item(F.col("line")).alias("is_list"))


@query("h33_elapsed", "SELECT event_id, greatest(0, epoch_us(ts) // 1000 - epoch_us(TIMESTAMP '2024-01-15 00:00:00') // 1000) AS elapsed_ms, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events")
def _(spark, d):
    rows = table(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    ms = F.unix_millis("t") - F.unix_millis(F.lit("2024-01-15 00:00:00").cast("timestamp"))
    return rows.select("event_id", F.greatest(F.lit(0), ms).alias("elapsed_ms"), F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


@query("h34_array_helpers", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) AS positive, list_has_any([label], [1, 2]) AS chosen FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positive"), F.exists(F.array("label"), lambda x: x.isin(1, 2)).alias("chosen"))


@query("h35_coalesced_ranges", """
WITH r AS (SELECT l_partkey AS k, l_linenumber * 10 + l_suppkey % 7 AS a, l_linenumber * 10 + l_suppkey % 7 + l_orderkey % 25 AS b FROM lineitem),
n AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (PARTITION BY k ORDER BY a, b) = 1 THEN 1 ELSE 0 END AS fresh FROM r),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM n)
SELECT k, min(a) AS a, max(b) AS b FROM g GROUP BY k, g
""")
def _(spark, d):
    a = F.col("l_linenumber") * 10 + F.col("l_suppkey") % 7
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), a.alias("a"), (a + F.col("l_orderkey") % 25).alias("b"))
    return chunking.coalesce_ranges(rows, "k", "a", "b")


HEALTH = r"""(SELECT doc_id, n_chars, length(regexp_replace(text, '\s', '', 'g')) AS total, length(regexp_replace(regexp_replace(text, '\s', '', 'g'), '[^\p{L}\p{N}\p{P}]', '', 'g')) AS valid FROM documents)"""


@query("l01_text_health", f"""
SELECT doc_id, CASE WHEN total = 0 OR valid = 0 THEN 'unusable' WHEN total < 20 OR round(valid / total, 6) < 0.9 THEN 'suspect' ELSE 'healthy' END AS status,
  CASE WHEN total = 0 THEN 'native_text_empty' WHEN valid = 0 THEN 'native_text_no_valid_characters' WHEN total < 20 AND round(valid / total, 6) < 0.9 THEN 'native_text_character_count_low,native_valid_character_ratio_low'
  WHEN total < 20 THEN 'native_text_character_count_low' WHEN round(valid / total, 6) < 0.9 THEN 'native_valid_character_ratio_low' ELSE 'native_text_readable' END AS reasons FROM {HEALTH}
""")
def _(spark, d):
    rows = quality_gate.text_health(table(spark, d, "documents"), "text")
    return rows.select("doc_id", "status", F.array_join("reasons", ",").alias("reasons"))


@query("l02_route", with_views("SELECT file_id, CASE extension WHEN 'csv' THEN 'native' WHEN 'docx' THEN 'native' WHEN 'pdf' THEN CASE WHEN file_id % 6 = 0 THEN 'enhanced' ELSE 'native' END ELSE CASE WHEN file_id % 5 = 0 THEN 'hybrid' ELSE 'native' END END AS route FROM files"))
def _(spark, d):
    rows = view(spark, d, "files").withColumn("health", F.when(F.col("file_id") % 6 == 0, "suspect").otherwise("healthy")).withColumn("complex", F.col("file_id") % 5 == 0)
    return rows.select("file_id", quality_gate.route(F.col("extension"), F.col("health"), F.col("complex")).alias("route"))


@query("l03_two_columns", "SELECT l_orderkey, count_if(l_discount < 0.042) >= 3 AND count_if(l_discount BETWEEN 0.055 AND 0.085) >= 3 AS two_columns FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    return quality_gate.two_columns(table(spark, d, "lineitem").select("l_orderkey", (F.col("l_discount") * 10).alias("centre")), "l_orderkey", "centre")


@query("l04_post_gate", r"SELECT doc_id, CASE WHEN n_chars > 0 AND round((n_chars - (doc_id % 7) * 100) / n_chars, 6) < 0.7 THEN 'rejected' ELSE 'accepted' END AS status FROM documents")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("native"), (F.col("n_chars") - (F.col("doc_id") % 7) * 100).alias("final"))
    return rows.select("doc_id", quality_gate.retention_status(F.col("native"), F.col("final")).alias("status"))


@query("l05_native_enhanced", "SELECT a.doc_id, CASE WHEN b.doc_id IS NULL THEN 'native' WHEN b.n >= a.n_chars THEN 'enhanced' ELSE 'native' END AS chosen FROM documents a LEFT JOIN (SELECT doc_id, n_chars + (doc_id % 3 - 1) * 5 AS n FROM documents WHERE doc_id % 2 = 0) b ON a.doc_id = b.doc_id")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    other = docs.filter("doc_id % 2 = 0").select("doc_id", (F.col("n_chars") + (F.col("doc_id") % 3 - 1) * 5).alias("n"))
    return docs.join(other, "doc_id", "left").select("doc_id", F.when(F.col("n") >= F.col("n_chars"), "enhanced").otherwise("native").alias("chosen"))


@query("l06_heading_levels", """
WITH b AS (SELECT p_brand, arg_max(p_size, (c, -p_size)) AS body FROM (SELECT p_brand, p_size, sum(length(p_name)) AS c FROM part GROUP BY ALL) GROUP BY p_brand),
h AS (SELECT p.p_brand, p.p_partkey, p.p_size FROM part p JOIN b USING (p_brand) WHERE p.p_size >= greatest(b.body + 1, b.body * 1.2))
SELECT p_brand, p_partkey, least(6, level) AS level FROM (SELECT *, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS level, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM h) WHERE r <= 100
""")
def _(spark, d):
    return quality_gate.heading_levels(table(spark, d, "part"), "p_brand", "p_partkey", "p_size", F.length("p_name")).select("p_brand", "p_partkey", "level")


@query("l08_heading_groups", f"SELECT doc_id, max(g) AS groups FROM (SELECT doc_id, i, sum(c) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, CASE WHEN lag(length(line) > 200) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM (length(line) > 200) THEN 1 ELSE 0 END AS c FROM {LINES})) GROUP BY doc_id")
def _(spark, d):
    rows = lines(spark, d).withColumn("long", F.length("line") > 200)
    return chunking.groups_by_change(rows, "doc_id", "i", "long").groupBy("doc_id").agg(F.max("group_no").alias("groups"))


@query("l09_text_chunks")
def _(spark, d):
    rows = chunking.chunk_texts(table(spark, d, "documents"), "doc_id", "text")
    return rows.select("doc_id", "chunk_index", "token_count", "overlap_tokens", F.sha2("body", 256).alias("body_sha256"))


@query("l10_heading_lanes")
def _(spark, d):
    level = F.when(F.length("line") <= 12, 1).when(F.length("line") <= 25, 2).when(F.length("line") <= 40, 3)
    rows = lines(spark, d).withColumn("level", level)
    return chunking.heading_lanes(rows, "doc_id", "i", "level", "line", 3).select("doc_id", "i", F.array_join("heading_path", " > ").alias("path"))


def order_tables(spark, d):
    """A table per order, a row per line, numbered from 1 in order of its values, the first as header."""
    values = F.struct("l_linenumber", "l_returnflag", "l_linestatus")
    orders = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(values)).alias("v"))
    cells = lambda v: F.array(*[F.struct(F.lit(i).alias("column"), F.lit(1).alias("span"), v[c].cast("string").alias("text")) for i, c in enumerate(("l_linenumber", "l_returnflag", "l_linestatus"), 1)])
    return orders.select("l_orderkey", F.transform("v", lambda v, i: F.struct((i + 1).alias("number"), (i == 0).alias("header"), cells(v).alias("cells"))).alias("rows"))


def order_chunks(tables):
    return chunking.chunk_tables(tables.filter(chunking.skip_reason(F.lit(False), F.col("rows")).isNull()), "l_orderkey", "rows", chunking.Settings(target=30, most=60))


@query("l11_table_chunks")
def _(spark, d):
    return order_chunks(order_tables(spark, d)).select("l_orderkey", "chunk_index", "first_row", "last_row", "token_count")


@query("m09_table_trim", """
SELECT l_orderkey, sha256(string_agg('[' || CASE WHEN r = 1 THEN 'header' ELSE 'data' END || ' row ' || r || '] ' || l_linenumber || ' | ' || l_returnflag || ' | ' || l_linestatus, chr(10) ORDER BY r)) AS digest
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag, l_linestatus) AS r FROM lineitem) GROUP BY l_orderkey
""")
def _(spark, d):
    """Table chunks without the rows they repeat, joined: the rows of the table, each once."""
    rows = order_chunks(order_tables(spark, d)).withColumn("own", context.trim_table(F.col("body")))
    return rows.groupBy("l_orderkey").agg(F.sha2(R.joined_in_order(F.col("own"), "chunk_index", "\n"), 256).alias("digest"))


@query("l12_merged_chunks", """
SELECT doc_id, kind, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY first_block, kind, chunk_index) AS position FROM (
  SELECT conv_id AS doc_id, 'text' AS kind, turn AS chunk_index, turn * 2 AS first_block FROM conversations UNION ALL SELECT conv_id, 'table', turn, turn * 3 + 1 FROM conversations WHERE turn % 2 = 0)
""")
def _(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"))
    texts = c.select("doc_id", F.lit("text").alias("kind"), "chunk_index", (F.col("chunk_index") * 2).alias("first_block"))
    tables = c.filter("chunk_index % 2 = 0").select("doc_id", F.lit("table").alias("kind"), "chunk_index", (F.col("chunk_index") * 3 + 1).alias("first_block"))
    return chunking.merge_chunks(texts, tables, "doc_id").select("doc_id", "kind", "chunk_index", "position")


@query("l13_chunk_set_identity", "SELECT source, count(*) AS documents, sha256(string_agg(CAST(doc_id AS VARCHAR) || ':' || n_chars, ',' ORDER BY doc_id)) AS identity FROM documents GROUP BY source")
def _(spark, d):
    item = F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("n_chars").cast("string"))
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.sha2(R.joined_in_order(item, "doc_id", ","), 256).alias("identity"))


@query("n05_structure_audit")
def _(spark, d):
    """Per document: lines that a chunk holds whole, chunks in order without gaps and within the limit."""
    docs = table(spark, d, "documents")
    return audit.audit_texts(docs, chunking.chunk_texts(docs, "doc_id", "text"), "doc_id", "text")


@query("n05_table_audit", "SELECT l_orderkey, count(*) AS table_rows, count(*) AS rows_preserved FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    tables = order_tables(spark, d)
    return audit.audit_rows(tables, order_chunks(tables), "l_orderkey", "rows")
