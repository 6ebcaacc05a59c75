"""A08 and L03 on files, set as PDF pages and read back with positions; H03 and L09 with the way back to the source."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import source
from quarry.operators import chunking, layout
from quarry.registry import query
from quarry.session import cut, spread, table
from quarry.sources import pdf

# How a text is set: words a line, lines a block, lines a column, columns a page (odd ids one, even ids two), points.
WORDS, BLOCK, COLUMN = 8, 5, 30
LEFT, RIGHT, BROAD, TOP = 40.0, 340.0, 220.0, 60.0
#: Bytes of files that leave a task at once.
FILES = 1 << 22


def set_pages(words: list[bytes], columns: int) -> bytes:
    """A text as a file: as many words a line, lines a block and blocks a column as above, in a size at which its longest line fits."""
    lines = [b" ".join(words[i : i + WORDS]).decode("utf-8", "replace") for i in range(0, len(words), WORDS)]
    longest = max((len(t) if t.isascii() else len(t.encode("utf-16-be")) // 2 for t in lines), default=1)
    size = min(9.0, BROAD / (longest * pdf.WIDTH / 1000))
    pages: list[list[tuple[float, float, float, str]]] = []
    for i, said in enumerate(lines):
        place = i % (COLUMN * columns)
        if place == 0:
            pages.append([])
        at = place % COLUMN
        pages[-1].append((LEFT if place < COLUMN else RIGHT, TOP + at * size * 1.2 + at // BLOCK * size * 1.5, size, said))
    return pdf.write_pages(pages or [[]])


def document_files(spark, d):
    """path (the document's id), content: every document as a PDF file."""

    def batch_of(paths: list[str], contents: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], ["path", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, contents, size = [], [], 0
        for batch in batches:
            for path, text, columns in zip(*(batch.column(i) for i in range(3)), strict=True):
                paths.append(path.as_py())
                contents.append(set_pages((text.as_py() or b"").split(), columns.as_py()))
                size += len(contents[-1])
                if size > FILES:
                    yield batch_of(paths, contents)
                    paths, contents, size = [], [], 0
        if paths:
            yield batch_of(paths, contents)

    # as bytes, which part at the six blanks of ASCII and nowhere else
    text = F.col("text").cast("string").cast("binary")
    docs = table(spark, d, "documents").select("doc_id", "text")
    # a scan may have all rows in few of its partitions, and a file costs far more than dealing its text: many even tasks
    parts = max(spark.sparkContext.defaultParallelism, 4 * docs.rdd.getNumPartitions())
    rows = docs.repartition(parts, "doc_id", "text").select(F.col("doc_id").cast("string").alias("path"), text.alias("text"), F.when(F.col("doc_id") % 2 == 0, 2).otherwise(1).alias("columns"))
    return rows.mapInArrow(run, "path string, content binary")


SET = rf"""WITH words AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, CASE WHEN doc_id % 2 = 0 THEN {2 * COLUMN} ELSE {COLUMN} END AS per FROM documents),
placed AS (SELECT doc_id, i // {WORDS} AS line, per, i, w[i + 1] AS word FROM (SELECT *, unnest(range(len(w))) AS i FROM words)),
set_lines AS (SELECT doc_id, line, line // per AS page, line % per // {COLUMN} AS col, line % {COLUMN} // {BLOCK} AS block, string_agg(word, ' ' ORDER BY i) AS said FROM placed GROUP BY doc_id, line, per)"""


@query("a08_pdf_layout", f"{SET} SELECT doc_id, count(*) AS lines, count(DISTINCT page) AS pages, count(DISTINCT (page, col, block)) AS blocks, sha256(string_agg(said, chr(10) ORDER BY line)) AS digest FROM set_lines GROUP BY doc_id")
def _(spark, d):
    """Lines, pages, blocks and text in reading order of every document's file, however many pages it has. A row a file: ids are expected to be unique."""
    rows = layout.outlines(document_files(spark, d), most_pages=sys.maxsize).filter("lines > 0")
    return rows.select(F.col("path").cast("long").alias("doc_id"), *[F.col(c).cast("long").alias(c) for c in ("lines", "pages", "blocks")], F.sha2("text", 256).alias("digest"))


@query("a08_pdf_pages", rf"""{SET} SELECT doc_id, CAST(page + 1 AS INT) AS page, length(t) AS characters, CASE WHEN length(t) < 20 THEN 'low_text_page' ELSE '' END AS warnings
FROM (SELECT doc_id, page, regexp_replace(string_agg(said, ' '), '\s', '', 'g') AS t FROM set_lines GROUP BY doc_id, page)""")
def _(spark, d):
    """Characters and warnings of every page that has text."""
    rows = layout.pages_of(layout.lines(layout.runs(document_files(spark, d)), empty=True)).filter("characters > 0")
    return rows.select(F.col("path").cast("long").alias("doc_id"), "page", F.col("characters").cast("long").alias("characters"), F.array_join("warnings", ",").alias("warnings"))


@query("l03_pdf_columns", f"""{SET}, sides AS (SELECT doc_id, page, count(DISTINCT block) FILTER (col = 0) AS l, count(DISTINCT block) FILTER (col = 1) AS r FROM set_lines GROUP BY doc_id, page)
SELECT d.doc_id, coalesce(max(s.l >= 3 AND s.r >= 3), false) AS two_columns FROM documents d LEFT JOIN sides s ON s.doc_id = d.doc_id GROUP BY d.doc_id""")
def _(spark, d):
    """The two-column tag from the blocks that the files' pages really show."""
    # what tags need of each block, or of a page without one: a few numbers, cut so that files are set and read once
    rows = layout.lines(layout.runs(document_files(spark, d)), empty=True)
    found = cut(spark, rows.groupBy("path", "page", "page_width", "block").agg(F.count("text").alias("lines"), *[F.min(c).alias(c) for c in ("left", "top")], *[F.max(c).alias(c) for c in ("right", "bottom", "drawings", "error")]))
    tagged = layout.tags(found, found.filter("lines > 0"))
    return tagged.select(F.col("path").cast("long").alias("doc_id"), F.array_contains("tags", "detected_two_column").alias("two_columns"))


# Blanks of every kind, for what trimming drops.
EDGE = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+"
REGULAR = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(nfc_normalize(text), chr(160), ' '), '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^{EDGE}|{EDGE}$', '', 'g')"


@query("h03_source_offsets", f"""
SELECT doc_id, sha256({REGULAR}) AS digest, length({REGULAR}) AS characters, length(text) - length(regexp_replace(text, '^{EDGE}', '')) AS first_source, length(regexp_replace(text, '{EDGE}$', '')) AS last_source,
  true AS in_order FROM documents WHERE length({REGULAR}) > 0
""")
def _(spark, d):
    """The regular form with NFC, how long it is, and where its first and last characters stand in the source."""
    rows = spread(table(spark, d, "documents")).select("doc_id", source.outline(F.col("text")).alias("s")).filter("s.text <> ''")
    return rows.select("doc_id", F.sha2("s.text", 256).alias("digest"), F.length("s.text").cast("long").alias("characters"), F.col("s.first").cast("long").alias("first_source"), F.col("s.last").cast("long").alias("last_source"), "s.in_order")


@query("l09_chunk_sources", f"""
SELECT doc_id, length(text) - length(regexp_replace(text, '^{EDGE}', '')) AS first_source, length(regexp_replace(text, '{EDGE}$', '')) AS last_source, true AS exact, true AS covered FROM documents WHERE length({REGULAR}) > 0
""")
def _(spark, d):
    """Chunks cut from the source itself: each chunk's source range, made regular, is its body; between chunks only blanks are left out."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    chunks = chunking.chunk_sources(docs, "doc_id", "text").join(docs, "doc_id")
    cut = F.substring(F.col("text"), F.col("source_start") + 1, F.col("source_end") - F.col("source_start"))
    chunks = chunks.withColumn("exact", source.regular(cut) == source.regular(F.col("body")))
    upto = F.lag("source_end").over(Window.partitionBy("doc_id").orderBy("chunk_index"))
    between = F.substring(F.col("text"), upto + 1, F.greatest(F.col("source_start") - upto, F.lit(0)))
    chunks = chunks.withColumn("covered", F.coalesce(F.regexp_replace(between, r"[\s\p{Z}\x0b\x1c-\x1f\x85]", "") == "", F.lit(True)))
    return chunks.groupBy("doc_id").agg(F.min("source_start").cast("long").alias("first_source"), F.max("source_end").cast("long").alias("last_source"), F.every("exact").alias("exact"), F.every("covered").alias("covered"))
