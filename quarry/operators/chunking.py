"""Documents into chunks: token windows over text, row windows over tables, and their merge.

A window's end depends on where the window before it ended, so the rules run per document inside one
Arrow function; documents are independent and nothing is shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import source
from quarry.session import spread

CJK = "\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u3040-\u30ff\uac00-\ud7af"
# A CJK character opens no run, but a run may go on over one.
TOKEN = re.compile(rf"[{CJK}]|\w+|[^\w\s]")
CJK_CHARACTER = re.compile(f"[{CJK}]")
PIECE = 4
# Boundary kinds from strong to weak.
BOUNDARIES = (re.compile(r"\n\s*\n"), re.compile(r"[。！？.!?](?:[”’」』】）》])?"), re.compile(r"[；;，,、:]"), re.compile(r"\s+"))


@dataclass(frozen=True)
class Settings:
    target: int = 600
    most: int = 700
    overlap: int = 100
    heading: int = 120
    row_overlap: int = 1
    repeated_edges: int = 2


def token_spans(text: str) -> list[tuple[int, int]]:
    """Start and end of every token: single CJK characters, word runs cut into pieces, other symbols."""
    out = []
    for m in TOKEN.finditer(text):
        a, b = m.span()
        if b - a <= PIECE:
            out.append((a, b))
        else:
            out += [(i, min(i + PIECE, b)) for i in range(a, b, PIECE)]
    return out


def count_tokens(text: str) -> int:
    return len(token_spans(unicodedata.normalize("NFC", text)))


def _cut(text: str, low: int, target: int, high: int) -> int:
    """The last strongest boundary up to target, else the first one after it, else target itself."""
    for kind in BOUNDARIES:
        ends = [m.end() for m in kind.finditer(text, low, high)]
        if ends:
            fit = bisect_right(ends, target)
            return ends[fit - 1] if fit else ends[0]
    return target


def text_windows(text: str, settings: Settings = Settings(), heading: str = "") -> Iterator[tuple[int, int, int, int]]:
    """start, end, tokens (heading included) and tokens shared with the chunk before, of every chunk of a text in NFC."""
    spans = token_spans(text)
    starts, ends = [a for a, _ in spans], [b for _, b in spans]
    # without CJK a part's tokens are those of the whole that lie in it; a run cut before a CJK character counts anew
    plain = not CJK_CHARACTER.search(text)
    used = count_tokens(heading)
    target, most = settings.target - used, settings.most - used
    if target <= settings.overlap or most <= 0:
        raise ValueError("the heading takes too much of the chunk's budget")
    first, before = 0, -1
    while first < len(spans):
        if len(spans) - first <= most:
            stop = len(text)
        else:
            stop = _cut(text, ends[first + max(1, target // 2) - 1], ends[first + target - 1], ends[first + most - 1])
        a = starts[first]
        b = a + len(text[a:stop].rstrip())
        done = bisect_right(ends, b)
        if plain:
            yield a, b, used + done - first, max(0, bisect_right(ends, min(before, b)) - first)
        else:
            yield a, b, used + count_tokens(text[a:b]), count_tokens(text[a : min(before, b)]) if before > a else 0
        if b >= ends[-1]:
            return
        first, before = max(first + 1, done - settings.overlap), b


def chunk_texts(df: DataFrame, key: str, text: str, settings: Settings = Settings(), heading: str | None = None) -> DataFrame:
    """key, chunk_index (from 1), body, token_count, overlap_tokens; whole texts, one row a chunk."""

    def run(texts: pa.Array, headings: pa.Array) -> pa.Array:
        out = []
        for t, h in zip(texts.to_pylist(), headings.to_pylist(), strict=True):
            t, h = unicodedata.normalize("NFC", t or ""), h or ""
            path = token_spans(h)
            h = h[path[-settings.heading][0] :] if len(path) > settings.heading else h
            out.append([{"chunk_index": i, "body": t[a:b], "token_count": n, "overlap_tokens": s} for i, (a, b, n, s) in enumerate(text_windows(t, settings, h), 1)])
        kind = pa.struct([("chunk_index", pa.int32()), ("body", pa.string()), ("token_count", pa.int32()), ("overlap_tokens", pa.int32())])
        return pa.array(out, pa.list_(kind))

    cut = F.arrow_udf(run, "array<struct<chunk_index:int,body:string,token_count:int,overlap_tokens:int>>")
    rows = spread(df.select(key, text, *([heading] if heading else [])))
    rows = rows.select(F.col(key), F.explode(cut(F.col(text), F.col(heading) if heading else F.lit(""))).alias("c"))
    return rows.select(key, "c.*")


def chunk_sources(df: DataFrame, key: str, text: str, settings: Settings = Settings()) -> DataFrame:
    """key, chunk_index, body, token_count, overlap_tokens, char_start, char_end, source_start, source_end.

    Chunks of the regular form of a text (`functions.source`): the char range is the body's place in that form, the source range
    the place in the text as it was given, so a citation of a chunk shows the source itself. A base and its marks stay whole there.
    """

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            said, first, last = source.normalize(t or "")
            out.append([{"chunk_index": i, "body": said[a:b], "token_count": n, "overlap_tokens": s, "char_start": a, "char_end": b, "source_start": int(first[a]), "source_end": int(last[b - 1])} for i, (a, b, n, s) in enumerate(text_windows(said, settings), 1)])
        return pa.array(out, pa.list_(pa.struct([(c, pa.string() if c == "body" else pa.int32()) for c in columns])))

    columns = ("chunk_index", "body", "token_count", "overlap_tokens", "char_start", "char_end", "source_start", "source_end")
    kind = ",".join(f"{c}:{'string' if c == 'body' else 'int'}" for c in columns)
    rows = spread(df.select(key, text)).select(F.col(key), F.explode(F.arrow_udf(run, f"array<struct<{kind}>>")(F.col(text))).alias("c"))
    return rows.select(key, "c.*")


def _column_groups(cells: list[dict], width: int) -> list[tuple[int, int]]:
    """Column ranges that no merged cell crosses."""
    reach = list(range(width + 1))
    for c in cells:
        a = c["column"]
        if 1 <= a <= width:
            reach[a] = max(reach[a], min(width, a + (c.get("span") or 1) - 1))
    out, a = [], 1
    while a <= width:
        b, i = reach[a], a
        while i <= b:
            b = max(b, reach[i])
            i += 1
        out.append((a, b))
        a = b + 1
    return out


def table_windows(rows: list[dict], settings: Settings = Settings()) -> list[dict]:
    """Chunks of a table's rows ({number, header, cells: [{column, span, text}]}): headers repeat, rows overlap.

    A chunk holds the header rows, up to `row_overlap` rows of the chunk before, and new rows until the target;
    overlap is given up where it would break the limit. A row that is too long alone is cut between columns
    that no merged cell joins; a single cell over the limit is an error.
    """
    width = max((c["column"] + (c.get("span") or 1) - 1 for r in rows for c in r["cells"]), default=0)
    headers, body = [r for r in rows if r.get("header")], [r for r in rows if not r.get("header")]

    def line(r: dict, role: str, context: bool, band: tuple[int, int]) -> str:
        shown = " | ".join(c["text"].replace("\\", "\\\\").replace("|", "\\|").replace("\n", "<br>") for c in r["cells"] if band[0] <= c["column"] <= band[1])
        return f"[{role}{' context' if context else ''} row {r['number']}] {shown}".rstrip()

    def render(context: list[dict], new: list[dict], first: bool, band: tuple[int, int]) -> str:
        lines = [line(r, "header", not first, band) for r in headers]
        return "\n".join(lines + [line(r, "data", True, band) for r in context] + [line(r, "data", False, band) for r in new])

    # a line opens with a bracket, so a chunk's tokens are those of its lines
    sizes = {flag: [count_tokens(line(r, "data", flag, (1, width))) for r in body] for flag in (True, False)}
    heads = {first: sum(count_tokens(line(r, "header", not first, (1, width))) for r in headers) for first in (True, False)}
    upto = [0, *accumulate(sizes[False])]

    def cost(low: int, at: int, stop: int) -> int:
        """Tokens of a chunk with rows low..at as context and at..stop as its own."""
        return heads[not out] + sum(sizes[True][low:at]) + upto[stop] - upto[at]

    all_columns = (1, width)
    out: list[dict] = []
    at = 0
    if not body and headers:
        return [{"rows": [r["number"] for r in headers], "columns": all_columns, "body": (t := render([], [], True, all_columns)), "token_count": count_tokens(t)}]
    while at < len(body):
        low, stop = max(0, at - settings.row_overlap), at + 1
        while stop < len(body) and cost(low, at, stop) < settings.target and cost(low, at, stop + 1) <= settings.most:
            stop += 1
        while low < at and cost(low, at, stop) > settings.most:
            low += 1
        new, n = body[at:stop], cost(low, at, stop)
        if n <= settings.most:
            out.append({"rows": [r["number"] for r in new], "columns": all_columns, "body": render(body[low:at], new, not out, all_columns), "token_count": n})
        else:
            out += _bands(new, headers, render, width, not out, settings)
        at = stop
    return out


def _bands(new: list[dict], headers: list[dict], render, width: int, first: bool, settings: Settings) -> list[dict]:
    """One chunk per run of column groups that fits."""
    groups, out, g = _column_groups([c for r in [*headers, *new] for c in r["cells"]], width), [], 0
    while g < len(groups):
        fits = None
        for h in range(g, len(groups)):
            band = (groups[g][0], groups[h][1])
            text = render([], new, first, band)
            n = count_tokens(text)
            if n > settings.most:
                break
            fits = (h, band, text, n)
            if n >= settings.target:
                break
        if fits is None:
            raise ValueError("a table cell does not fit the limit")
        g = fits[0] + 1
        out.append({"rows": [r["number"] for r in new], "columns": fits[1], "body": fits[2], "token_count": fits[3]})
    return out


def chunk_tables(df: DataFrame, key: str, rows: str, settings: Settings = Settings()) -> DataFrame:
    """key, chunk_index, first_row, last_row, body, token_count of array<struct<number, header, cells>> columns.

    Hidden sheets and empty tables are filtered before; see `skip_reason`.
    """

    def run(tables: pa.Array) -> pa.Array:
        out = []
        for t in tables.to_pylist():
            found = table_windows(t or [], settings)
            out.append([{"chunk_index": i, "first_row": min(c["rows"]), "last_row": max(c["rows"]), "body": c["body"], "token_count": c["token_count"]} for i, c in enumerate(found, 1)])
        kind = pa.struct([("chunk_index", pa.int32()), ("first_row", pa.int32()), ("last_row", pa.int32()), ("body", pa.string()), ("token_count", pa.int32())])
        return pa.array(out, pa.list_(kind))

    cut = F.arrow_udf(run, "array<struct<chunk_index:int,first_row:int,last_row:int,body:string,token_count:int>>")
    return df.select(F.col(key), F.explode(cut(F.col(rows))).alias("c")).select(key, "c.*")


def skip_reason(hidden: Column, rows: Column) -> Column:
    return F.when(hidden, "hidden_sheet").when(F.size(rows) == 0, "empty_table")


def merge_chunks(texts: DataFrame, tables: DataFrame, key: str) -> DataFrame:
    """Text and table chunks in order of their first source block, numbered from 1, with the id of the chunk before."""
    rows = texts.unionByName(tables, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("first_block", "kind", "chunk_index")
    rows = rows.withColumn("position", F.row_number().over(w))
    return rows.withColumn("chunk_id", F.format_string("c%06d", "position")).withColumn("previous_id", F.when(F.col("position") > 1, F.format_string("c%06d", F.col("position") - 1)))


def heading_lanes(lines: DataFrame, key: str, order: str, level: str, title: str, most: int = 6) -> DataFrame:
    """The open headings above each line, outermost first: a heading closes those of its level and below.

    The latest heading of each level counts unless a higher one came after it; running maxima say so.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = lines
    for n in range(1, most + 1):
        out = out.withColumn(f"_a{n}", F.max(F.when(F.col(level) == n, F.col(order))).over(w)).withColumn(f"_t{n}", F.last(F.when(F.col(level) == n, F.col(title)), ignorenulls=True).over(w))
    parts = []
    for n in range(1, most + 1):
        above = [F.coalesce(F.col(f"_a{m}"), F.lit(-1)) for m in range(1, n)]
        alive = F.col(f"_a{n}").isNotNull() & (F.col(f"_a{n}") > (F.greatest(*above) if len(above) > 1 else above[0] if above else F.lit(-2)))
        parts.append(F.when(alive, F.col(f"_t{n}")))
    out = out.withColumn("heading_path", F.array_compact(F.array(*parts)))
    return out.drop(*[f"_{c}{n}" for n in range(1, most + 1) for c in "at"])


def groups_by_change(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Numbers runs of equal neighbouring values (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(order)
    changed = ~F.lag(value).over(w).eqNullSafe(F.col(value)) | (F.row_number().over(w) == 1)
    return df.withColumn("group_no", F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def coalesce_ranges(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Touching or overlapping [start, end) ranges of a key as one. Ranges without a start or an end come last and open no further one."""
    w = Window.partitionBy(key).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    upto = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_new", (F.coalesce(F.col(start) > upto, F.lit(False))).cast("int"))
    rows = rows.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_g")

