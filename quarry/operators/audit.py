"""Structure audits: whether chunks keep the lines of a text and the rows of a table whole and in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import source
from quarry.functions.text import match_text, nfc, token_count
from quarry.operators.joins import covered_spans
from quarry.operators.relational import joined_in_order

#: Width of the cells in which blocks and chunks meet, in characters.
CELL = 2048


def audit_texts(docs: DataFrame, chunks: DataFrame, key: str, text: str, most: int = 700) -> DataFrame:
    """key, units, preserved, boundary_breaks, break_rate, chunks, ordered, bounded of every document with a key.

    A unit is a line with more than white space that fits the limit; it is preserved if one chunk holds it whole,
    both sides in lower case with single spaces. ordered: numbers from 1 without gaps. A document without units
    has a null rate; without chunks it is ordered and bounded. chunks: key, chunk_index, body, token_count.
    Keys are unique; a document's chunks come together as one text no longer than it and its overlaps.
    """
    lines = F.transform(F.split(nfc(F.coalesce(F.col(text), F.lit(""))), r"\n"), lambda x: F.struct(match_text(x).alias("m"), token_count(x).alias("n")))
    units = docs.filter(F.col(key).isNotNull()).select(key, F.filter(lines, lambda x: (x["m"] != "") & (x["n"] <= most)).alias("_units"))
    whole = chunks.groupBy(key).agg(
        joined_in_order(match_text(F.col("body")), "chunk_index", "\n").alias("_whole"),
        F.count("*").alias("chunks"),
        ((F.min("chunk_index") == 1) & (F.max("chunk_index") == F.count("*")) & (F.countDistinct("chunk_index") == F.count("*"))).alias("ordered"),
        F.every(F.col("token_count") <= most).alias("bounded"),
    )
    rows = units.join(whole, key, "left").withColumn("units", F.size("_units").cast("long"))
    held = F.size(F.filter("_units", lambda x: F.contains(F.coalesce("_whole", F.lit("")), x["m"]))).cast("long")
    rows = rows.withColumn("preserved", held).withColumn("boundary_breaks", F.col("units") - F.col("preserved"))
    rate = F.round(F.col("boundary_breaks") / F.nullif(F.col("units"), F.lit(0)), 6)
    return rows.select(key, "units", "preserved", "boundary_breaks", rate.alias("break_rate"), F.coalesce("chunks", F.lit(0)).alias("chunks"), *[F.coalesce(c, F.lit(True)).alias(c) for c in ("ordered", "bounded")])


def audit_rows(tables: DataFrame, chunks: DataFrame, key: str, rows: str) -> DataFrame:
    """key, table_rows, rows_preserved: data rows, and those that exactly one chunk holds as its own whole row.

    tables: key, array<struct<number, header, cells>>; chunks: key, body. A table of headers only counts those.
    """
    own = chunks.select(key, F.explode(F.split("body", "\n")).alias("line"))
    own = own.select(key, F.regexp_extract("line", r"^\[(?:header|data) row (\d+)\] ", 1).alias("number"), F.regexp_replace("line", r"^\[[a-z]+ row \d+\] ?", "").alias("line")).filter("number <> ''")
    own = own.groupBy(key, F.col("number").cast("long").alias("number")).agg(F.count("*").alias("times"), F.min("line").alias("line"))
    want = tables.select(key, F.explode(rows).alias("r"))
    escaped = F.transform("r.cells", lambda c: F.replace(F.replace(F.replace(c["text"], F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")))
    want = want.select(key, F.col("r.number").cast("long").alias("number"), F.rtrim(F.array_join(escaped, " | ")).alias("wanted"))
    full = want.join(own, [key, "number"], "left")
    fits = (F.col("times") == 1) & (F.col("line") == F.col("wanted"))
    return full.groupBy(key).agg(F.count("*").alias("table_rows"), F.count_if(fits).alias("rows_preserved"))


def text_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, block, kind, start, end, body: the lines of each text's regular form that are not empty, with what they are.

    Of three lines or more the first is a header and the last a footer. A line with an address stands for an image, a short one
    without a stop at its end is a heading, others are paragraphs. start and end count characters of the regular form.
    """
    rows = docs.filter(F.col(key).isNotNull()).select(key, source.regular(F.col(text)).alias("_t"))
    lines = rows.select(key, F.posexplode(F.split("_t", "\n")).alias("block", "body"))
    before = F.coalesce(F.sum(F.length("body") + 1).over(Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = lines.withColumn("start", before).withColumn("end", F.col("start") + F.length("body")).filter("body <> ''")
    every = Window.partitionBy(key)
    edge = F.count("*").over(every) >= 3
    kind = (
        F.when(edge & (F.col("block") == F.min("block").over(every)), "header")
        .when(edge & (F.col("block") == F.max("block").over(every)), "footer")
        .when(F.col("body").rlike("https?://"), "image")
        .when((F.length("body") <= 40) & ~F.col("body").rlike(r"[.!?]\s*$"), "heading")
        .otherwise("paragraph")
    )
    return lines.select(key, "block", kind.alias("kind"), "start", "end", "body")


def audit_structure(docs: DataFrame, chunks: DataFrame, key: str, text: str, most: int = 700) -> DataFrame:
    """One row a document with a key: units of each kind and how many chunks keep whole, heading and image contexts, order, locators.

    chunks: those of `chunk_sources`. A block is kept if a chunk's character range contains it. A paragraph's heading is the
    nearest one above; its context is kept if a chunk that keeps the paragraph also contains the heading, or has it as its own
    nearest heading. An image's context are the paragraphs next to it; a link is kept if one chunk has both, or two that follow
    each other. ordered: numbers from 1 without gaps, starts that rise. located: each chunk's source range lies in the text
    and its regular form holds the body. Blocks over `most` tokens are not judged. Rates are null without units.
    """
    blocks = text_blocks(docs, key, text)
    sofar = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heading = F.when(F.col("kind") == "heading", F.col("block"))
    plain = F.when(F.col("kind") == "paragraph", F.col("block"))
    following = Window.partitionBy(key).orderBy("block").rowsBetween(1, Window.unboundedFollowing)
    blocks = blocks.withColumns({"heading": F.last(heading, ignorenulls=True).over(sofar), "above": F.last(plain, ignorenulls=True).over(sofar), "below": F.first(plain, ignorenulls=True).over(following)})
    blocks = blocks.withColumn("fits", token_count(F.col("body")) <= most)
    # a chunk's own heading is the last one that starts at or before it
    points = blocks.filter("kind = 'heading'").select(key, F.col("start").alias("at"), F.lit(0).alias("order"), F.col("block").alias("heading"), F.lit(None).cast("int").alias("chunk_index"))
    points = points.unionByName(chunks.select(key, F.col("char_start").alias("at"), F.lit(1).alias("order"), F.lit(None).cast("int").alias("heading"), "chunk_index"))
    upto = Window.partitionBy(key).orderBy("at", "order").rowsBetween(Window.unboundedPreceding, 0)
    own = points.withColumn("own", F.last("heading", ignorenulls=True).over(upto)).filter("chunk_index IS NOT NULL").select(key, "chunk_index", "own")
    spans = blocks.select(key, "block", F.col("start").alias("s0"), F.col("end").alias("s1"))
    met = covered_spans(spans, chunks.select(key, "chunk_index", F.col("char_start").alias("c0"), F.col("char_end").alias("c1")), key, CELL)
    inside = met.filter((F.col("c0") <= F.col("s0")) & (F.col("s1") <= F.col("c1"))).join(own, [key, "chunk_index"], "left").select(key, "block", "chunk_index", "own")
    inside = inside.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "own"))).alias("held"))  # a block's overlapping chunks
    numbers = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<chunk_index:int,own:int>>")), lambda x: x["chunk_index"])
    held = inside.select(key, F.col("block").alias("other"), F.col("held").alias("with"))
    rows = blocks.join(inside, [key, "block"], "left").withColumn("kept", F.col("held").isNotNull())
    judged = rows.filter("fits")
    units = judged.groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(f"{k}s") for k in ("paragraph", "header", "footer", "image")], *[F.count_if((F.col("kind") == k) & F.col("kept")).alias(f"{k}s_kept") for k in ("paragraph", "header", "footer", "image")])
    context = judged.filter("kind = 'paragraph' AND heading IS NOT NULL").join(held.withColumnRenamed("other", "heading"), [key, "heading"], "left")
    carried = F.exists(F.coalesce("held", F.array().cast("array<struct<chunk_index:int,own:int>>")), lambda x: x["own"].eqNullSafe(F.col("heading"))) | (F.size(F.array_intersect(numbers(F.col("held")), numbers(F.col("with")))) > 0)
    headings = context.groupBy(key).agg(F.count("*").alias("contexts"), F.count_if(carried).alias("contexts_kept"))
    links = judged.filter("kind = 'image'").select(key, "held", F.explode(F.array_compact(F.array("above", "below"))).alias("other")).join(held, [key, "other"], "left")
    near = F.exists(numbers(F.col("held")), lambda x: F.exists(numbers(F.col("with")), lambda y: F.abs(x - y) <= 1))
    images = links.groupBy(key).agg(F.count("*").alias("links"), F.count_if(near).alias("links_kept"))
    rising = F.col("char_start") > F.coalesce(F.lag("char_start").over(Window.partitionBy(key).orderBy("chunk_index")), F.lit(-1))
    texts = docs.filter(F.col(key).isNotNull()).select(key, F.col(text).alias("_whole"))
    placed = chunks.withColumn("rising", rising).join(texts, key)
    cut = source.regular(F.substring(F.col("_whole"), F.col("source_start") + 1, F.col("source_end") - F.col("source_start")))
    within = (F.col("source_start") >= 0) & (F.col("source_start") < F.col("source_end")) & (F.col("source_end") <= F.length("_whole")) & F.contains(cut, source.regular(F.col("body")))
    per = placed.groupBy(key).agg(F.count("*").alias("chunks"), (F.every("rising") & (F.min("chunk_index") == 1) & (F.max("chunk_index") == F.count("*"))).alias("ordered"), F.every(within).alias("located"))
    out = docs.filter(F.col(key).isNotNull()).select(key)
    for part in (units, headings, images, per):
        out = out.join(part, key, "left")
    counts = [c for part in (units, headings, images) for c in part.columns if c != key]
    out = out.na.fill(0, [*counts, "chunks"]).na.fill(True, ["ordered", "located"])
    total = F.col("paragraphs") + F.col("headers") + F.col("footers")
    kept = F.col("paragraphs_kept") + F.col("headers_kept") + F.col("footers_kept")
    return out.withColumn("boundary_breaks", total - kept).withColumn("break_rate", F.round(F.col("boundary_breaks") / F.nullif(total, F.lit(0)), 6))
