"""I03, J11, O04 and H01 over the given tables: versioned updates in a stream, files as a source, deadlines, segmentation."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import segment, text
from quarry.operators import deadlines, tools
from quarry.plans.views import view
from quarry.registry import query
from quarry.session import shared_dir, table
from quarry.sources import reader
from quarry.streaming import versions


def _scratch(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/quarry-{name}-{uuid.uuid4().hex}"


@query("i03_versioned_stream", """
WITH u AS (SELECT event_id, user_id, event_id % 7 = 0 AS stale, count(*) FILTER (event_id % 7 <> 0) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, props, event_type FROM events)
SELECT event_id, user_id, CASE WHEN stale THEN 'conflict' ELSE 'accepted' END AS status, CAST(CASE WHEN stale THEN before ELSE before + 1 END AS BIGINT) AS version FROM u
""")
def _(spark, d):
    """Every event as an update of its user's state, in two deliveries with a restart between: each seventh expects a version that nobody has."""
    events = table(spark, d, "events")
    before = F.count(F.when(F.col("event_id") % 7 != 0, 1)).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    expected = F.when(F.col("event_id") % 7 == 0, before + 1000).otherwise(before)
    # the event's number stands for its time: times of the given table don't rise with it
    rows = events.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), expected.alias("expected"), F.concat_ws(" ", F.col("event_id").cast("string"), "event_type", "props").alias("state"), F.timestamp_seconds("event_id").alias("ts"))
    half = rows.agg(F.percentile_approx("seq", 0.5)).first()[0] or 0
    folder, out, checkpoint = (_scratch(spark, f"versions-{n}") for n in ("in", "out", "state"))
    for part in (rows.filter(F.col("seq") <= half), rows.filter(F.col("seq") > half)):
        part.write.mode("append").parquet(folder)
        versions.run(spark, folder, out, checkpoint)
    return spark.read.schema(versions.ANSWERS).parquet(out).select(F.col("seq").alias("event_id"), F.col("key").alias("user_id"), "status", "version")


@query("j11_files_as_source", r"SELECT n_name AS name, CAST(count(*) + 1 AS BIGINT) AS rows, CAST(sum(s_suppkey) AS BIGINT) AS keys FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def _(spark, d):
    """Suppliers written as a CSV file for each nation, read back by the file format: a row a line, header included."""
    folder = _scratch(spark, "files")
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows.select("n_name", "s_suppkey", "s_name").repartition("n_name").write.partitionBy("n_name").option("header", "true").csv(folder)
    reader.register(spark)
    found = spark.read.format("quarry").option("columns", "extension,path,position,cells").load(folder).filter("extension = 'csv'")
    named = found.withColumn("name", F.url_decode(F.regexp_extract("path", r"n_name=([^/]*)/", 1)))
    first = F.col("position") == 1
    return named.groupBy("name").agg(F.count("*").alias("rows"), F.sum(F.when(~first, F.element_at("cells", 1).cast("long"))).alias("keys"))


@query("o04_tools_in_time", "SELECT tool, 'ok' AS status, count(*) AS rows FROM (SELECT CASE event_id % 5 WHEN 0 THEN 'get_product_spec' WHEN 1 THEN 'search_inventory' WHEN 2 THEN 'search_knowledge' WHEN 3 THEN 'read_uploaded_file' ELSE 'get_evidence_detail' END AS tool FROM events) GROUP BY tool")
def _(spark, d):
    """Each tool's calls counted by the tool itself, all at once and each under a deadline."""
    calls = view(spark, d, "tool_calls")
    work = lambda name: lambda: calls.filter(F.col("tool") == name).groupBy("tool").agg(F.count("*").alias("rows"))
    # a machine that is busy with other work may need longer than a service's seconds
    done = {t.name: deadlines.run_within(spark, 60 * t.timeout_s, work(t.name)) for t in tools.TOOLS}
    found = None
    for outcome in done.values():
        if outcome.result is not None:
            part = outcome.result.withColumn("status", F.lit(outcome.status))
            found = part if found is None else found.unionByName(part)
    return found.select("tool", "status", "rows")


@query("h01_segmented_words")
def _(spark, d):
    """Benchmark texts without their spaces, cut again by the frequencies of all documents' words, the most frequent ones."""
    words = table(spark, d, "documents").select(F.explode(text.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    known = words.orderBy(F.desc("n"), "word").limit(50_000)
    items = table(spark, d, "benchmark").select("item_id", text.tokens(F.col("text")).alias("words"))
    cut = segment.segmented(F.array_join("words", ""), known, letters="a-z0-9àâäçèéêëîïñôöùûüßœáíóú")
    rows = items.select("item_id", F.size("words").alias("words"), F.array_join("words", "").alias("run"), cut.alias("cut"))
    return rows.select("item_id", "words", F.size("cut").alias("tokens"), F.sha2(F.array_join("cut", " "), 256).alias("digest"))
