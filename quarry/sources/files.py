"""File sources: CSV, XLSX, DOCX, PDF and text files as tables of blocks, parsed on the executors.

`spark.read.format("binaryFile")` lists and reads files wherever Spark can; parsing runs in
`mapInArrow`, a bounded file at a time, with the standard library alone. A file that breaks a limit
or its format gives one row with `error` instead of failing the job.
"""

from __future__ import annotations

import csv as csvlib
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources import pdf

# Limits of one file.
MAX_BYTES = 25 * 1024 * 1024
MAX_ROWS = 200_000
MAX_COLUMNS = 500
MAX_CELLS = 500_000
MAX_CHARACTERS = 5_000_000
DELIMITERS = (",", ";", "\t", "|")
BLOCKS = "path string, position int, kind string, sheet string, page int, row_number int, level int, hidden boolean, text string, cells array<string>, formulas array<string>, error string"
_TYPES = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_BLOCKS = pa.schema([(name, _TYPES[kind]) for name, kind in (f.split() for f in BLOCKS.split(", "))])
#: Blocks, or bytes of files, after which what was parsed is sent on.
PACKED, PACKED_BYTES = 4096, 1 << 21


class FileError(ValueError):
    """A file that cannot be read as what it claims to be, or is over a limit."""


def decode(source: bytes) -> tuple[str, str]:
    """Text and its encoding: UTF-8 with or without a mark, else GB18030."""
    names = ("utf-8-sig",) if source.startswith(b"\xef\xbb\xbf") else ("utf-8", "gb18030")
    for name in names:
        try:
            return source.decode(name), name
        except UnicodeDecodeError:
            continue
    raise FileError("encoding")


def delimiter(text: str) -> str:
    """What the standard sniffer finds in the first 64 K characters, else the most frequent candidate."""
    sample = text[: 1 << 16]
    try:
        found = csvlib.Sniffer().sniff(sample, "".join(DELIMITERS)).delimiter
        if found in DELIMITERS:
            return found
    except csvlib.Error:
        pass
    return max(DELIMITERS, key=sample.count)


def read_csv(source: bytes) -> list[list[str]]:
    """All cells as strings; blank lines stay, short rows are filled, longer ones than the first are an error."""
    text, _ = decode(source)
    if "\0" in text:
        raise FileError("nul")
    if sum(not c.isspace() for c in text) > MAX_CHARACTERS:
        raise FileError("limit")
    if not text:
        return []
    try:
        rows = list(csvlib.reader(io.StringIO(text, newline=""), delimiter=delimiter(text), strict=True))
    except csvlib.Error as e:
        raise FileError("malformed") from e
    width = len(next((r for r in rows if r), []))
    if any(len(r) > width for r in rows):
        raise FileError("malformed")
    if len(rows) > MAX_ROWS or width > MAX_COLUMNS or len(rows) * width > MAX_CELLS:
        raise FileError("limit")
    return [r + [""] * (width - len(r)) for r in rows]


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    info = archive.getinfo(name)
    if info.file_size > 8 * MAX_BYTES:
        raise FileError("limit")
    raw = archive.read(info)
    if b"<!DOCTYPE" in raw[:2048] or b"<!ENTITY" in raw:
        raise FileError("entities")
    return ElementTree.fromstring(raw)


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _attribute(element: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), None)


def _column(reference: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n


def read_xlsx(source: bytes) -> Iterator[dict]:
    """A row per sheet row: cached values as text, formulas beside them, hidden sheets marked."""
    with zipfile.ZipFile(io.BytesIO(source)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in item.iter() if _local(t) == "t") for item in _xml(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        targets = {_attribute(r, "Id"): _attribute(r, "Target") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
        cells_seen = 0
        for sheet in (e for e in _xml(z, "xl/workbook.xml").iter() if _local(e) == "sheet"):
            part = "xl/" + targets[_attribute(sheet, "id")].removeprefix("/xl/")
            hidden = (sheet.get("state") or "visible") != "visible"
            for row in (e for e in _xml(z, part).iter() if _local(e) == "row"):
                cells: list[str] = []
                formulas: list[str] = []
                for c in (e for e in row if _local(e) == "c"):
                    at = _column(c.get("r", "")) or len(cells) + 1
                    if at > MAX_COLUMNS:
                        raise FileError("limit")
                    cells += [""] * (at - len(cells))
                    formulas += [""] * (at - len(formulas))
                    parts = {_local(e): e for e in c}
                    value = (parts["v"].text or "") if "v" in parts else ""
                    kind = c.get("t", "n")
                    if kind == "s" and value:
                        value = shared[int(value)]
                    elif kind == "b":
                        value = {"1": "TRUE", "0": "FALSE"}.get(value, value)
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter() if _local(t) == "t")
                    cells[at - 1] = value
                    formulas[at - 1] = f"={parts['f'].text}" if "f" in parts and parts["f"].text else ""
                cells_seen += len(cells)
                if cells_seen > MAX_CELLS:
                    raise FileError("limit")
                yield {"kind": "row", "sheet": sheet.get("name"), "hidden": hidden, "row_number": int(row.get("r", 0)), "cells": cells, "formulas": formulas}


def _styles(z: zipfile.ZipFile) -> dict[str, int]:
    """Heading level of each paragraph style, through the styles it is based on."""
    if "word/styles.xml" not in z.namelist():
        return {}
    own, base = {}, {}
    for s in (e for e in _xml(z, "word/styles.xml").iter() if _local(e) == "style"):
        key = _attribute(s, "styleId")
        for e in s.iter():
            if _local(e) == "outlineLvl":
                own[key] = int(_attribute(e, "val")) + 1
            elif _local(e) == "basedOn":
                base[key] = _attribute(e, "val")
            elif _local(e) == "name" and (m := re.fullmatch(r"heading (\d)", (_attribute(e, "val") or "").lower())):
                own.setdefault(key, int(m[1]))
    out = {}
    for key in {*own, *base}:
        k, seen = key, set()
        while k is not None and k not in own and k not in seen:
            seen.add(k)
            k = base.get(k)
        if k in own and own[k] <= 9:
            out[key] = own[k]
    return out


def read_docx(source: bytes) -> Iterator[dict]:
    """Paragraphs with heading levels and table rows, in the order of the body; headers and footers last."""
    with zipfile.ZipFile(io.BytesIO(source)) as z:
        styles = _styles(z)
        said = lambda e: "".join({"t": x.text or "", "tab": "\t", "br": "\n"}.get(_local(x), "") for x in e.iter())
        body = next(e for e in _xml(z, "word/document.xml") if _local(e) == "body")
        for block in body:
            if _local(block) == "p":
                style = next((_attribute(e, "val") for e in block.iter() if _local(e) == "pStyle"), None)
                if (text := said(block)).strip():
                    yield {"kind": "heading" if style in styles else "paragraph", "level": styles.get(style), "text": text}
            elif _local(block) == "tbl":
                for n, row in enumerate((e for e in block if _local(e) == "tr"), 1):
                    yield {"kind": "row", "row_number": n, "cells": ["\n".join(said(p) for p in c.iter() if _local(p) == "p") for c in row if _local(c) == "tc"]}
        for name in sorted(n for n in z.namelist() if re.fullmatch(r"word/(header|footer)\d*\.xml", n)):
            if (text := said(_xml(z, name))).strip():
                yield {"kind": "header" if "header" in name else "footer", "text": text}


def _pdf_streams(source: bytes) -> Iterator[bytes]:
    """The streams of a file, unpacked; those in other packings are passed over."""
    for m in re.finditer(rb"<<(?:[^<>]|<<[^<>]*>>|<[^<>]*>)*>>\s*stream\r?\n(.*?)\r?\nendstream", source, re.S):
        raw = m[1]
        if b"/FlateDecode" in m[0][: len(m[0]) - len(raw)]:
            try:
                raw = zlib.decompressobj().decompress(raw, 8 * MAX_BYTES)
            except zlib.error:
                continue
        yield raw


def read_pdf(source: bytes) -> Iterator[dict]:
    """A block per page with its text in order of drawing; `quarry.operators.layout` has lines, columns and boxes.

    Scanned pages come out empty, which the health rules then call unusable.
    """
    try:
        for page in pdf.read_pages(source):
            lines: list[str] = []
            last = None
            for run in page.runs:
                if last is not None and abs(run.baseline - last.baseline) <= 0.4 * run.size and run.box[0] >= last.box[0]:
                    lines[-1] += (" " if run.box[0] - last.box[2] > 0.15 * run.size else "") + run.text
                else:
                    lines.append(run.text)
                last = run
            yield {"kind": "page", "page": page.number, "text": "\n".join(lines)}
    except pdf.PdfError as e:
        raise FileError(str(e)) from e


def read_text(source: bytes) -> Iterator[dict]:
    for n, line in enumerate(decode(source)[0].splitlines(), 1):
        yield {"kind": "line", "row_number": n, "text": line}


def parse(extension: str, source: bytes) -> list[dict]:
    """Blocks of a file by its extension; FileError where it can't be read."""
    if len(source) > MAX_BYTES:
        raise FileError("limit")
    try:
        if extension == "csv":
            return [{"kind": "row", "row_number": n, "cells": r} for n, r in enumerate(read_csv(source), 1)]
        reader = {"xlsx": read_xlsx, "docx": read_docx, "pdf": read_pdf, "txt": read_text, "md": read_text}.get(extension)
        if reader is None:
            raise FileError("extension")
        return list(reader(source))
    except FileError:
        raise
    except (KeyError, ValueError, IndexError, TypeError, AttributeError, RecursionError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError) as e:
        raise FileError("malformed") from e


def layout_tags(extension: str, source: bytes) -> list[str]:
    """What makes a file hard to read, sorted: header or footer text and media of a DOCX, merged cells of an XLSX, four or more drawn paths of a PDF content stream.

    Two-column pages need block positions: `quality_gate.two_columns`. Other extensions have no tags; FileError where it can't be read.
    """
    if len(source) > MAX_BYTES:
        raise FileError("limit")
    tags = set()
    if extension == "pdf":
        if not source.startswith(b"%PDF-"):
            raise FileError("malformed")
        for raw in _pdf_streams(source):
            drawn = re.sub(rb"\((?:\\.|[^\\()])*\)|\bBT\b.*?\bET\b", b" ", raw, flags=re.S)
            if len(re.findall(rb"(?<!\S)(?:[fBb]\*?|[FSs])(?!\S)", drawn)) >= 4:
                tags.add("detected_document_table")
    elif extension in ("docx", "xlsx"):
        try:
            with zipfile.ZipFile(io.BytesIO(source)) as z:
                part = lambda heads, mark: any(n.startswith(heads) and n.endswith(".xml") and mark in z.read(n) for n in z.namelist())
                if extension == "xlsx" and part("xl/worksheets/", b"<mergeCells"):
                    tags.add("detected_merged_cells")
                if extension == "docx" and part(("word/header", "word/footer"), b"<w:t"):
                    tags.add("detected_header_footer")
                if extension == "docx" and any(n.startswith("word/media/") for n in z.namelist()):
                    tags.add("detected_embedded_media")
        except (zipfile.BadZipFile, KeyError, zlib.error) as e:
            raise FileError("malformed") from e
    return sorted(tags)


def blocks(files: DataFrame) -> DataFrame:
    """Blocks of files given as path, content; the blocks of several small files leave a task together."""

    def pack(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _BLOCKS], schema=_BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                source = content.as_py()
                try:
                    found = parse(path.rpartition(".")[2].lower(), source)
                except FileError as e:
                    found = [{"kind": "error", "error": str(e)}]
                rows += [{"path": path, "position": n} | b for n, b in enumerate(found, 1)]
                size += len(source)
                if len(rows) >= PACKED or size >= PACKED_BYTES:
                    yield pack(rows)
                    rows, size = [], 0
        yield pack(rows)

    return files.select("path", "content").mapInArrow(run, BLOCKS)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all files under a path; files over the limit are rows with an error and are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    large = files.filter(F.col("length") > MAX_BYTES).select("path", F.lit("limit").alias("error"))
    fine = blocks(files.filter(F.col("length") <= MAX_BYTES))
    return fine.unionByName(large.withColumns({"position": F.lit(1), "kind": F.lit("error")}), allowMissingColumns=True)
