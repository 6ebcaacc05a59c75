"""A07, A09, L07 and I01 over the given tables: workbooks, word files and pushes made from them and read back."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from quarry.registry import query
from quarry.session import shared_dir, spread, table
from quarry.sources import files
from quarry.streaming import events

#: Rows of one workbook.
SHEET_ROWS = 500
#: Word files that leave a task together.
FILES = 128
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def workbook(rows: pd.DataFrame) -> bytes:
    """Key, name, size and a formula with its cached value, a row each after a header; names are shared strings; a second sheet is hidden."""
    names = sorted(set(rows["p_brand"]))
    cells = ['<row r="1"><c r="A1" t="inlineStr"><is><t>key</t></is></c><c r="B1" t="inlineStr"><is><t>brand</t></is></c><c r="C1" t="inlineStr"><is><t>size</t></is></c><c r="D1" t="inlineStr"><is><t>twice</t></is></c></row>']
    for n, r in enumerate(rows.sort_values("p_partkey").itertuples(), 2):
        cells.append(f'<row r="{n}"><c r="A{n}"><v>{r.p_partkey}</v></c><c r="B{n}" t="s"><v>{names.index(r.p_brand)}</v></c><c r="C{n}"><v>{r.p_size}</v></c><c r="D{n}"><f>C{n}*2</f><v>{2 * r.p_size}</v></c></row>')
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="Parts" r:id="a"/><sheet name="Notes" state="hidden" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{escape(x)}</t></si>" for x in names) + "</sst>")
        z.writestr("xl/worksheets/s1.xml", f"<worksheet><sheetData>{''.join(cells)}</sheetData></worksheet>")
        z.writestr("xl/worksheets/s2.xml", '<worksheet><sheetData><row r="1"><c r="A1"><v>1</v></c></row></sheetData></worksheet>')
    return out.getvalue()


@query("a07_xlsx_values", f"""
SELECT CAST(p_partkey // {SHEET_ROWS} AS BIGINT) AS file, count(*) AS rows, CAST(sum(p_partkey) AS BIGINT) AS keys, CAST(sum(2 * p_size) AS BIGINT) AS cached, count(*) AS formulas, sha256(string_agg(p_brand || '=C' || r || '*2', ',' ORDER BY p_partkey)) AS digest, 1 AS hidden_rows
FROM (SELECT *, 1 + row_number() OVER (PARTITION BY p_partkey // {SHEET_ROWS} ORDER BY p_partkey) AS r FROM part) GROUP BY p_partkey // {SHEET_ROWS}
""")
def _(spark, d):
    """Parts as workbooks of a few hundred rows: cached values and formulas of every cell, shared strings, hidden sheets."""
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", F.floor(F.col("p_partkey") / SHEET_ROWS).alias("file"))

    def make(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"path": [f"{key[0]}.xlsx"], "content": [workbook(rows)]})

    found = files.blocks(parts.groupBy("file").applyInPandas(make, "path string, content binary"))
    body = (F.col("row_number") > 1) & ~F.col("hidden")
    said = F.concat(F.element_at("cells", 2), F.element_at("formulas", 4))
    digest = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(body, F.struct("row_number", said.alias("s"))))), lambda x: x["s"]), ",")
    out = found.groupBy(F.regexp_extract("path", r"(\d+)\.xlsx$", 1).cast("long").alias("file")).agg(
        F.count_if(body).alias("rows"), F.sum(F.when(body, F.element_at("cells", 1).cast("long"))).alias("keys"), F.sum(F.when(body, F.element_at("cells", 4).cast("long"))).alias("cached"),
        F.count_if(body & (F.element_at("formulas", 4) != "")).alias("formulas"), F.sha2(digest, 256).alias("digest"), F.count_if("hidden").cast("int").alias("hidden_rows"),
    )
    return out


def word_file(lines: list[str], level: int, depth: int) -> bytes:
    """Lines as paragraphs, the first as a heading whose style inherits its level over `depth` others, a table of the line count, a header."""
    styles = [f'<w:style w:styleId="S0"><w:pPr><w:outlineLvl w:val="{level - 1}"/></w:pPr></w:style>', '<w:style w:styleId="Plain"/>']
    styles += [f'<w:style w:styleId="S{i}"><w:basedOn w:val="S{i - 1}"/></w:style>' for i in range(1, depth + 1)]
    paragraph = lambda said, style: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{escape(said)}</w:t></w:r></w:p>'
    body = [paragraph(said, f"S{depth}" if i == 0 else "Plain") for i, said in enumerate(lines)]
    body.append(f"<w:tbl><w:tr><w:tc>{paragraph('lines', 'Plain')}</w:tc><w:tc>{paragraph(str(len(lines)), 'Plain')}</w:tc></w:tr></w:tbl>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/styles.xml", f"<w:styles {W}>{''.join(styles)}</w:styles>")
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{''.join(body)}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {W}>{paragraph('Head', 'Plain')}</w:hdr>")
    return out.getvalue()


# What an XML file can hold of a text, cut into lines that are not blank.
XML_TEXT = r"regexp_replace(text, '[\x00-\x08\x0B\x0C\x0D\x0E-\x1F\x{FFFE}\x{FFFF}]', '', 'g')"
WORD_LINES = rf"(SELECT doc_id, i, line FROM (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS line FROM (SELECT doc_id, string_split({XML_TEXT}, chr(10)) AS a FROM documents)) WHERE regexp_matches(line, '[^\s\p{{Z}}\x{{85}}]'))"


def word_blocks(spark, d):
    """doc_id and the blocks of every document's word file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, FILES) for whole in batches for at in range(0, whole.num_rows, FILES)):
            made = [word_file(lines, k % 3 + 1, k % 4) for k, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f"{k}.docx" for k in batch.column(0).to_pylist()], pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    said = F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0D\x0E-\x1F￾￿]", "")
    rows = spread(table(spark, d, "documents")).select("doc_id", F.filter(F.split(said, "\n"), lambda x: x.rlike(r"[^\s\p{Z}\x{85}]")).alias("lines")).filter("size(lines) > 0")
    found = files.blocks(rows.mapInArrow(run, "path string, content binary"))
    return found.withColumn("doc_id", F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("long"))


@query("a09_docx_blocks", f"SELECT doc_id, count(*) AS lines, CAST(count(*) AS VARCHAR) AS cell, 'Head' AS header, sha256(string_agg(line, chr(10) ORDER BY i)) AS digest FROM {WORD_LINES} GROUP BY doc_id")
def _(spark, d):
    """Documents as word files: headings and paragraphs in order, the table after them, the header."""
    text = F.col("kind").isin("heading", "paragraph")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(text, F.struct("position", "text")))), lambda x: x["text"]), "\n")
    return word_blocks(spark, d).groupBy("doc_id").agg(F.count_if(text).alias("lines"), F.max(F.when(F.col("kind") == "row", F.element_at("cells", 2))).alias("cell"), F.max(F.when(F.col("kind") == "header", F.col("text"))).alias("header"), F.sha2(said, 256).alias("digest"))


@query("l07_inherited_levels", f"SELECT doc_id, CAST(doc_id % 3 + 1 AS INT) AS level, arg_min(line, i) AS heading FROM {WORD_LINES} GROUP BY doc_id")
def _(spark, d):
    """The level of each word file's heading, which its style has from another one up to three steps away."""
    return word_blocks(spark, d).filter("kind = 'heading'").select("doc_id", "level", F.col("text").alias("heading"))


@query("i01_pushed_events", "SELECT user_id AS thread, count(*) AS pushed, min(event_id) AS first_event, max(event_id) AS last_event, CAST(1 AS BIGINT) AS times FROM events GROUP BY user_id")
def _(spark, d):
    """Every event pushed to its thread, delivered in two parts with a restart between: each once."""
    folder, out, checkpoint = (f"{shared_dir(spark).rstrip('/')}/quarry-push-{n}-{uuid.uuid4().hex}" for n in ("in", "out", "state"))
    rows = table(spark, d, "events")
    for part in (0, 1):
        rows.filter(F.pmod(F.xxhash64("event_id"), F.lit(2)) == part).write.mode("append").parquet(folder)

        def send(batch, number: int) -> None:
            # a batch that is sent again takes the place of its first try
            batch.select("event_id", "user_id").write.mode("overwrite").parquet(f"{out}/batch={number}")

        events.push(events.events(spark, folder, 1000), send, checkpoint).awaitTermination()
    sent = spark.read.schema("event_id long, user_id long").parquet(f"{out}/batch=*")
    per = sent.groupBy("user_id", "event_id").agg(F.count("*").alias("n"))
    return per.groupBy(F.col("user_id").alias("thread")).agg(F.count("*").alias("pushed"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"), F.max("n").alias("times"))
