"""Page layout from positioned runs: lines, columns in reading order, blocks, headings, page warnings, tags.

A file gives its runs on an executor (`runs`); everything after is windows within a page, whose runs are bounded by the
file's limits, or aggregates over pages of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import quality_gate
from quarry.sources import pdf

RUNS = "path string, page int, page_width double, page_height double, images int, drawings int, run int, text string, size double, left double, top double, right double, bottom double, baseline double, error string"
OUTLINES = "path string, pages int, lines int, blocks int, text string, error string"
PAGE = ["path", "page"]
#: In sizes of the text: what still is one line, what parts two columns on one line, what parts two blocks.
SAME_LINE, GUTTER, BLOCK_GAP = 0.4, 1.5, 0.7
#: Characters of files' texts that leave a task at once.
BATCH = 1 << 22
#: From this share of the page's width on a line crosses columns.
CROSSING = 0.6


def runs(files: DataFrame) -> DataFrame:
    """RUNS of PDF files (path, content): a row per shown string, one without text for an empty page, one with an error for a file that can't be read."""
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in RUNS.split(", "))])
    none = (None,) * 8

    def read(path: str, content: bytes) -> Iterator[tuple]:
        try:
            for page in pdf.read_pages(content):
                about = (path, page.number, page.width, page.height, page.images, page.drawings)
                if not page.runs:
                    yield (*about, *none, None)
                for n, r in enumerate(page.runs, 1):
                    yield (*about, n, r.text, r.size, *r.box, r.baseline, None)
        except pdf.PdfError as e:
            yield (path, *(None,) * 5, *none, str(e))
        except (ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError):  # damaged inside
            yield (path, *(None,) * 5, *none, "malformed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                columns = zip(*read(path.as_py(), content.as_py() or b""), strict=True)
                arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=False)]
                if arrays:  # a file without pages has no rows
                    yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return files.select("path", "content").mapInArrow(run, RUNS)


def page_lines(page: pdf.Page) -> tuple[list[str], int]:
    """Texts of a page's lines in reading order, and how many blocks they are: for one page at hand what `lines` finds for many."""
    rows: list[list[tuple]] = []
    last = 0.0
    for baseline, left, n, r in sorted([(r.baseline, r.box[0], n, r) for n, r in enumerate(page.runs)]):
        if not rows or baseline - last > r.size * SAME_LINE:
            rows.append([])
        rows[-1].append((left, n, r))
        last = baseline
    pieces: list[tuple] = []  # top, left, row, piece, right, bottom, size, text
    for y, row in enumerate(rows):
        row.sort()
        reach = None
        for left, _, r in row:
            gap = None if reach is None else (left - reach) / max(r.size, 1e-9)
            _, top, right, bottom = r.box
            if gap is None or gap > GUTTER:
                pieces.append((top, left, y, len(pieces), right, bottom, r.size, r.text))
            else:
                a = pieces[-1]
                said = a[7] + (" " if gap > 0.15 else "") + r.text
                pieces[-1] = (min(a[0], top), a[1], y, a[3], max(a[4], right), max(a[5], bottom), max(a[6], r.size), said)
            reach = right if reach is None else max(reach, right)
    pieces = sorted([p for p in pieces if p[7].strip(" ")])
    bands: list[list[tuple]] = []
    inside = False  # whether the band is open to a line that does not cross
    for p in pieces:
        crossing = p[4] - p[1] >= page.width * CROSSING
        if crossing or not inside:
            bands.append([])
        bands[-1].append(p)
        inside = not crossing
    texts, blocks = [], 0
    for band in bands:
        columns: list[list[tuple]] = []
        edge = None
        for p in sorted(band, key=lambda p: (p[1], p)):
            if edge is None or p[1] >= edge:
                columns.append([])
            columns[-1].append(p)
            edge = p[4] if edge is None else max(edge, p[4])
        for column in columns:
            column.sort()
            above = None
            for p in column:
                blocks += above is None or p[0] - above[5] > p[6] * BLOCK_GAP or abs(p[6] - above[6]) > p[6] * 0.1
                texts.append(p[7].strip(" "))
                above = p
    return texts, blocks


def outlines(files: DataFrame, most_pages: int = 500) -> DataFrame:
    """OUTLINES of PDF files (path, content): a row a file, with its pages that have text, its lines and blocks by the rules of `lines`, all lines in reading order, and the error where it can't be read to its end.

    A file's layout needs its own runs alone and is worked out where it is read: no run leaves the task and nothing is shuffled.
    """
    schema = pa.schema([(name, {"string": pa.string(), "int": pa.int32()}[kind]) for name, kind in (f.split() for f in OUTLINES.split(", "))])

    def outline(path: str, content: bytes) -> tuple:
        texts, shown, blocks, error = [], 0, 0, None
        try:
            for page in pdf.read_pages(content, most_pages):
                said, parts = page_lines(page)
                texts += said
                shown += bool(said)
                blocks += parts
        except pdf.PdfError as e:
            error = str(e)
        except (ValueError, KeyError, IndexError, TypeError, AttributeError, RecursionError):  # damaged inside
            error = "malformed"
        return path, shown, len(texts), blocks, "\n".join(texts), error

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows.append(outline(path.as_py(), content.as_py() or b""))
                size += len(rows[-1][4])
                if size > BATCH:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return files.select("path", "content").mapInArrow(run, OUTLINES)


def lines(found: DataFrame, empty: bool = False) -> DataFrame:
    """path, page, page_width, band, column, line, block, text, font_size, box, char_start, char_end: lines in reading order from 1.

    With `empty`, also images, drawings and error, and a row of null text for each page without text and each file that can't be
    read: so pages, blocks and tags need no second reading of the files.

    Runs on one baseline are a line unless a gap of `GUTTER` sizes parts them. A line that crosses most of the page opens a
    band; within a band, lines whose extents overlap are a column; columns are read one after the other.
    """
    held = ["images", "drawings", "error"] if empty else []
    said = found if empty else found.filter(F.col("text").isNotNull())
    down = Window.partitionBy(*PAGE).orderBy("baseline", "left", "run")
    said = said.withColumn("row", F.sum(F.coalesce((F.col("baseline") - F.lag("baseline").over(down) > F.col("size") * SAME_LINE).cast("int"), F.lit(1))).over(down))
    along = Window.partitionBy(*PAGE, "row").orderBy("left", "run")
    reach = F.max("right").over(along.rowsBetween(Window.unboundedPreceding, -1))
    said = said.withColumn("gap", F.coalesce((F.col("left") - reach) / F.greatest("size", F.lit(1e-9)), F.lit(0.0)))
    said = said.withColumn("piece", F.sum((F.col("gap") > GUTTER).cast("int")).over(along))
    spaced = F.concat(F.when(F.col("gap") > 0.15, F.lit(" ")).otherwise(F.lit("")), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("left", "run", spaced.alias("t"))))
    whole = said.groupBy(*PAGE, "page_width", "row", "piece").agg(
        F.trim(F.array_join(F.transform(parts, lambda p: p["t"]), "")).alias("text"), F.max("size").alias("font_size"), F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), *[F.max(c).alias(c) for c in held], F.count("run").alias("shown")
    )
    whole = whole.filter((F.col("text") != "") | (F.col("shown") == 0)).withColumn("text", F.when(F.col("shown") > 0, F.col("text")))
    crossing = (F.col("right") - F.col("left")) >= F.col("page_width") * CROSSING
    upto = Window.partitionBy(*PAGE).orderBy("top", "left", "row", "piece")
    # each crossing line is a band of its own, and what follows it the next
    before = F.coalesce(F.sum(crossing.cast("int")).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = whole.withColumn("band", before * 2 + crossing.cast("int"))
    across = Window.partitionBy(*PAGE, "band").orderBy("left", "top", "row", "piece")
    edge = F.max("right").over(across.rowsBetween(Window.unboundedPreceding, -1))
    whole = whole.withColumn("column", F.sum(F.coalesce((F.col("left") >= edge).cast("int"), F.lit(1))).over(across))
    order = ["band", "column", "top", "left", "row", "piece"]
    reading = Window.partitionBy(*PAGE).orderBy(*order)
    above = Window.partitionBy(*PAGE, "band", "column").orderBy("top", "left", "row", "piece")
    far = (F.col("top") - F.lag("bottom").over(above)) > F.col("font_size") * BLOCK_GAP
    other = F.abs(F.col("font_size") - F.lag("font_size").over(above)) > F.col("font_size") * 0.1
    whole = whole.withColumn("opens", F.coalesce(far | other, F.lit(True)).cast("int"))
    ends = F.sum(F.length("text") + 1).over(reading)
    return whole.select(
        *PAGE, "page_width", F.col("band").cast("int").alias("band"), F.col("column").cast("int").alias("column"), F.row_number().over(reading).alias("line"), F.sum("opens").over(reading).cast("int").alias("block"), "text", "font_size", "left", "top", "right", "bottom",
        (ends - F.length("text") - 1).cast("int").alias("char_start"), (ends - 1).cast("int").alias("char_end"), *held,
    )


def blocks(of_lines: DataFrame) -> DataFrame:
    """path, page, page_width, block, text and box of each block, its lines joined by newlines."""
    parts = F.array_sort(F.collect_list(F.struct("line", "text")))
    box = [f(c).alias(c) for c, f in (("left", F.min), ("top", F.min), ("right", F.max), ("bottom", F.max))]
    return of_lines.groupBy(*PAGE, "page_width", "block").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"), *box)


def pages(found: DataFrame, of_lines: DataFrame, low: int = 20) -> DataFrame:
    """path, page, images, drawings, text (lines in reading order), characters, low_text, warnings of every page."""
    parts = F.array_sort(F.collect_list(F.struct("line", "text")))
    texts = of_lines.groupBy(*PAGE).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    about = found.filter(F.col("error").isNull()).groupBy(*PAGE).agg(F.max("images").alias("images"), F.max("drawings").alias("drawings"))
    return _described(about.join(texts, PAGE, "left"), low)


def pages_of(of_lines: DataFrame, low: int = 20) -> DataFrame:
    """The same from lines with `empty` alone."""
    parts = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("line", "text"))))
    rows = of_lines.filter(F.col("error").isNull()).groupBy(*PAGE).agg(F.max("images").alias("images"), F.max("drawings").alias("drawings"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
    return _described(rows, low)


def _described(rows: DataFrame, low: int) -> DataFrame:
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("characters", F.length(F.regexp_replace("text", r"\s", ""))).withColumn("low_text", F.col("characters") < low)
    few = F.when(F.col("characters") == 0, "empty_page").when(F.col("low_text"), "low_text_page")
    return rows.withColumn("warnings", F.array_compact(F.array(few, F.when(F.col("low_text") & (F.col("images") > 0), "scanned_page_suspected"))))


def headings(of_lines: DataFrame) -> DataFrame:
    """path, page, line, text, level, font_size of lines set well above the size of most text, at most 100 a page."""
    rows = of_lines.withColumn("size", F.round("font_size", 1)).withColumn("place", F.struct("page", "line"))
    fit = (F.length("text") > 1) & (F.length("text") <= 200) & F.col("text").rlike(r"[\p{L}\p{N}]") & (F.col("font_size") <= 1000)
    sizes = rows.groupBy("path", "size").agg(F.sum(F.greatest(F.length("text"), F.lit(1))).alias("w"))
    body = sizes.groupBy("path").agg(F.max_by("size", F.struct("w", -F.col("size"))).alias("body"))
    large = rows.filter(fit).join(body, "path").filter(F.col("font_size") >= F.greatest(F.col("body") + 1.0, F.col("body") * 1.2))
    large = large.withColumn("level", F.least(F.lit(6), F.dense_rank().over(Window.partitionBy("path").orderBy(F.desc("size")))))
    nth = F.row_number().over(Window.partitionBy(*PAGE).orderBy("line"))
    return large.withColumn("nth", nth).filter("nth <= 100").select("path", "page", "line", "text", "level", F.round("font_size", 2).alias("font_size"), "left", "top", "right", "bottom")


def tags(found: DataFrame, of_blocks: DataFrame) -> DataFrame:
    """path, tags of each file, sorted: two columns of text on a page, or four drawn paths, which make a table."""
    centred = of_blocks.withColumn("centre", (F.col("left") + F.col("right")) / 2 / F.col("page_width")).withColumn("at", F.struct(*PAGE))
    two = quality_gate.two_columns(centred, "at", "centre").filter("two_columns").select("at.path").distinct().withColumn("tag", F.lit("detected_two_column"))
    drawn = found.filter("drawings >= 4").select("path").distinct().withColumn("tag", F.lit("detected_document_table"))
    both = two.unionByName(drawn).groupBy("path").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    return found.filter(F.col("error").isNull()).select("path").distinct().join(both, "path", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
