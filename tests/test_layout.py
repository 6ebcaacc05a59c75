"""PDF files built by hand and by the writer: positions, sizes, columns, headings, warnings, tags."""

import random
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.operators import layout
from quarry.sources import files, pdf


def built(content, resources=b"<< /Font << /F1 4 0 R >> >>", packed=True, more=b"", kids=b"[3 0 R]"):
    data = zlib.compress(content) if packed else content
    return (
        b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids " + kids + b" /Count 1 /MediaBox [0 0 600 800] >> endobj\n3 0 obj << /Type /Page /Parent 2 0 R /Resources " + resources
        + b" /Contents 5 0 R >> endobj\n4 0 obj << /Type /Font /Subtype /Type1 /FirstChar 32 /Widths [250 " + b"500 " * 90 + b"] >> endobj\n5 0 obj << /Length %d" % len(data)
        + (b" /Filter /FlateDecode" if packed else b"") + b" >>\nstream\n" + data + b"\nendstream endobj\n" + more
    )


def test_positions_and_sizes():
    page = next(pdf.read_pages(built(b"BT /F1 20 Tf 54 730 Td (AB) Tj 0 -40 Td /F1 10 Tf [(C) -1000 (D)] TJ ET q 2 0 0 2 10 10 cm BT /F1 5 Tf 1 0 0 1 100 100 Tm (\\(x\\)\\101) Tj ET Q 0 0 m 5 5 l S")))
    assert [(r.text, round(r.size, 3)) for r in page.runs] == [("AB", 20), ("C D", 10), ("(x)A", 10)]
    assert page.runs[0].box == pytest.approx((54, 800 - 730 - 16, 74, 800 - 730 + 4))
    assert page.runs[1].box[0] == pytest.approx(54) and page.runs[1].box[2] == pytest.approx(54 + 5 + 10 + 5)
    assert page.runs[2].box[0] == pytest.approx(210) and page.runs[2].baseline == pytest.approx(800 - 210)
    assert (page.drawings, page.images) == (1, 0)


def test_text_operators():
    content = b"BT /F1 10 Tf 12 TL 1 0 0 1 50 700 Tm (one) Tj T* (two) Tj (three) ' 3 2 (f r) \" 100 Tz 5 Ts (up) Tj ET"
    page = next(pdf.read_pages(built(content, packed=False)))
    assert [r.text for r in page.runs] == ["one", "two", "three", "f r", "up"]
    assert [round(800 - r.baseline) for r in page.runs] == [700, 688, 676, 664, 664]
    assert page.runs[3].box[2] - page.runs[3].box[0] == pytest.approx(5 + 2.5 + 5 + 3 + 3 * 2)


def test_forms_images_and_object_streams():
    form = zlib.compress(b"BT /F1 8 Tf 10 10 Td (inside) Tj ET")
    inner = b"7 0 8 35 " + b"<< /Subtype /Image /Width 3 >>     " + b"<< /Subtype /Image >>"
    more = b"6 0 obj << /Subtype /Form /Matrix [1 0 0 1 100 200] /Length %d /Filter /FlateDecode >>\nstream\n" % len(form) + form + b"\nendstream endobj\n9 0 obj << /Type /ObjStm /N 2 /First 9 /Length %d >>\nstream\n" % len(inner) + inner + b"\nendstream endobj\n"
    page = next(pdf.read_pages(built(b"/X1 Do /X2 Do", b"<< /Font << /F1 4 0 R >> /XObject << /X1 6 0 R /X2 7 0 R /X3 8 0 R >> >>", more=more)))
    assert page.images == 2 and [r.text for r in page.runs] == ["inside"]
    assert page.runs[0].box[0] == pytest.approx(110) and page.runs[0].baseline == pytest.approx(800 - 210)


@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Zs", "Cc", "Zl", "Zp"]), min_size=1, max_size=12), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_written_pages_come_back(texts):
    page = next(pdf.read_pages(pdf.write_pages([[(40.0, 50.0 + 20 * i, 10.0, t) for i, t in enumerate(texts)]])))
    assert [r.text for r in page.runs] == texts
    assert [round(r.baseline, 3) for r in page.runs] == [50 + 20 * i for i in range(len(texts))]
    assert all(r.box[2] - r.box[0] == pytest.approx(5 * len(t.encode("utf-16-be")) // 2, abs=3) for r, t in zip(page.runs, texts, strict=True))


@given(st.binary(max_size=200))
@settings(max_examples=100, deadline=None)
def test_damaged_files_are_errors(junk):
    good = pdf.write_pages([[(40.0, 50.0, 10.0, "text")]])
    for source in (junk, b"%PDF-1.4\n" + junk, good[:80] + junk + good[80:], good[: len(good) // 2]):
        try:
            files.parse("pdf", source)
        except files.FileError:
            pass


def test_refused_files(spark):
    for source in (b"no", built(b"", more=b"trailer << /Encrypt 9 0 R >>")):
        with pytest.raises(pdf.PdfError):
            list(pdf.read_pages(source))
    rows = layout.runs(spark.createDataFrame([("a", bytearray(b"no")), ("b", bytearray(built(b"", more=b"trailer << /Encrypt << >> >>")))], "path string, content binary")).collect()
    assert sorted((r["path"], r["error"]) for r in rows) == [("a", "malformed"), ("b", "encrypted")]


@pytest.fixture(scope="module")
def pages(spark):
    brief = [[(54.0, 70.0, 20.0, "Two Column Brief"), (54.0, 120.0, 14.0, "Left Sales"), (320.0, 120.0, 14.0, "Right Actions"), (54.0, 155.0, 11.0, "Units sold: 139"), (320.0, 155.0, 11.0, "Daily budget: 18 EUR"), (54.0, 200.0, 11.0, "left end"), (320.0, 200.0, 11.0, "right end")]]
    banded = [[(40.0, 60.0, 10.0, "a left"), (340.0, 60.0, 10.0, "b right"), (40.0, 100.0, 10.0, "a title that runs across the whole page and so parts what is above from what is below it"), (40.0, 140.0, 10.0, "c left"), (340.0, 140.0, 10.0, "d right"), (80.0, 140.0, 10.0, "same line")]]
    wordy = [[(40.0, 60.0, 10.0, "Some body text that is longer"), (40.0, 90.0, 16.0, "Heading one"), (40.0, 120.0, 13.0, "Sub"), (40.0, 150.0, 16.0, "?!"), (40.0, 180.0, 10.0, "more body text here")], [(40.0, 60.0, 10.0, "OK")], []]
    rows = [("brief", pdf.write_pages(brief)), ("banded", pdf.write_pages(banded)), ("wordy", pdf.write_pages(wordy)), ("scan", built(b"/X2 Do 1 1 5 5 re f 1 1 5 5 re f 1 1 5 5 re f 1 1 5 5 re f", b"<< /XObject << /X2 7 0 R >> >>", more=b"7 0 obj << /Subtype /Image >> endobj"))]
    return layout.runs(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")).cache()


def by_path(rows, *columns):
    out = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["page"], r["line"])):
        out.setdefault(r["path"], []).append(tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]])
    return out


def test_reading_order(pages):
    rows = layout.lines(pages).collect()
    texts = by_path(rows, "text")
    assert texts["brief"] == ["Two Column Brief", "Left Sales", "Units sold: 139", "left end", "Right Actions", "Daily budget: 18 EUR", "right end"]
    assert texts["banded"] == ["a left", "b right", "a title that runs across the whole page and so parts what is above from what is below it", "c left same line", "d right"]
    for page_rows in by_path(rows, "path", "page", "text", "char_start", "char_end").values():
        whole = {}
        for _, page, said, _, _ in page_rows:
            whole.setdefault(page, []).append(said)
        assert all("\n".join(whole[page])[a:b] == said for _, page, said, a, b in page_rows)


def test_pages_headings_and_tags(pages):
    rows = layout.lines(pages)
    got = {(r["path"], r["page"]): (r["characters"], r["images"], r["warnings"]) for r in layout.pages(pages, rows).collect()}
    assert got[("wordy", 2)] == (2, 0, ["low_text_page"]) and got[("wordy", 3)] == (0, 0, ["empty_page"]) and got[("scan", 1)] == (0, 1, ["empty_page", "scanned_page_suspected"]) and got[("brief", 1)][2] == []
    heads = [(r["text"], r["level"]) for r in sorted(layout.headings(rows).collect(), key=lambda r: (r["path"], r["line"])) if r["path"] == "wordy"]
    assert heads == [("Heading one", 1), ("Sub", 2)]
    tagged = {r["path"]: r["tags"] for r in layout.tags(pages, layout.blocks(rows)).collect()}
    assert tagged == {"brief": ["detected_two_column"], "banded": [], "wordy": [], "scan": ["detected_document_table"]}


def test_pages_and_tags_from_lines_alone(pages):
    rows = layout.lines(pages, empty=True)
    pick = ["path", "page", "images", "drawings", "text", "characters", "low_text", "warnings"]
    want = layout.pages(pages, layout.lines(pages)).select(*pick).collect()
    assert sorted(map(str, layout.pages_of(rows).select(*pick).collect())) == sorted(map(str, want))
    said = rows.filter("text IS NOT NULL")
    assert sorted(map(str, said.drop("images", "drawings", "error").collect())) == sorted(map(str, layout.lines(pages).collect()))


@pytest.mark.parametrize("name", ["a08_pdf_pages", "l03_pdf_columns"])
def test_files_are_read_once(spark, sf, name):
    from quarry import registry

    # setting and reading are a step each
    assert registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") <= 2


def test_a_font_map_is_read_once_for_many_files(monkeypatch):
    seen = []
    monkeypatch.setattr(pdf, "UnicodeMap", lambda data, f=pdf.UnicodeMap: seen.append(data) or f(data))
    for i in range(5):
        assert [r.text for p in pdf.read_pages(pdf.write_pages([[(10.0, 20.0, 9.0, f"text {i} \u00e9\U0001f600")]])) for r in p.runs] == [f"text {i} \u00e9\U0001f600"]
    assert len(seen) <= 1


def scattered(seed, pages=3):
    """Pages of lines and pieces at places and in sizes that fall in and out of every rule's reach."""
    pick = random.Random(seed)
    words = ["one", "\u4e8c", "t\u00e9", "\U0001f600", "a longer line of words", "x" * 90, "\u00a0 "]
    return [[(pick.choice([40.0, 43.0, 120.5, 300.0, 340.0]), 40.0 + pick.randrange(60) * 3.7, pick.choice([8.0, 9.0, 9.5, 14.0]), pick.choice(words) + str(pick.randrange(9))) for _ in range(pick.randrange(40))] for _ in range(pages)]


def test_outlines_are_those_of_the_lines(spark):
    content = {str(i): pdf.write_pages(scattered(i)) for i in range(40)} | {"no": b"no", "none": pdf.write_pages([[]]), "hand": built(b"BT /F1 9 Tf 20 700 Td (one) Tj 0 -9 Td (two) Tj ET")}
    given = spark.createDataFrame([(p, bytearray(c)) for p, c in content.items()], "path string, content binary").cache()
    want = {p: [0, 0, set(), []] for p in content}
    for r in sorted(layout.lines(layout.runs(given)).collect(), key=lambda r: (r["path"], r["page"], r["line"])):
        a = want[r["path"]]
        a[2].add((r["page"], r["block"]))
        a[3].append(r["text"])
    pages = {p: {page for page, _ in a[2]} for p, a in want.items()}
    got = {r["path"]: (r["pages"], r["lines"], r["blocks"], r["text"]) for r in layout.outlines(given).collect()}
    assert got == {p: (len(pages[p]), len(a[3]), len(a[2]), "\n".join(a[3])) for p, a in want.items()}
    assert {r["path"]: r["error"] for r in layout.outlines(given).filter("error IS NOT NULL").collect()} == {"no": "malformed"}


def test_lines_taken_whole_are_as_those_taken_by_tokens(monkeypatch):
    even = pdf.write_pages(scattered(1))
    font = b"<< /Font << /F1 4 0 R >> >>"
    by_hand = [
        b"BT /F1 9 Tf 1 0 0 1 20 700 Tm <4142> Tj /F1 9.5 Tf 1 0 0 1 20.25 -6 Tm <414> Tj T* (next) Tj ET /F1 8 Tf BT 1 0 0 1 3 4 Tm <41> Tj ET",
        b"1 0 0 1 5 6 cm 2 Tc 3 Tw 80 Tz 4 Ts 12 TL BT /F1 9 Tf 1 0 0 1 20 700 Tm <41204220> Tj (on) ' 7 0 Td (more) Tj ET",
        b"2 1 0 2 5 6 cm BT /F1 9 Tf 1 0 0 1 20 700 Tm <4142> Tj /F2 9 Tf 1 0 0 1 20 690 Tm <4142> Tj/F1 9 Tf 1 0 0 1 20 680 Tm <43>Tj ET",
    ]
    # odd digits, half of a character at an edge, and text after lines in a font of two-byte codes
    wide = pdf.write_pages([[]]).replace(b"/Contents 7 0 R", b"/Contents 9 0 R") + b"9 0 obj << /Length 0 >>\nstream\n-50 Tz BT /F1 9 Tf 1 0 0 1 20 700 Tm <0041D83D> Tj /F1 9 Tf 1 0 0 1 20 690 Tm <DE000042> Tj /F1 9 Tf 1 0 0 1 20 680 Tm <00410> Tj <0043> Tj ET\nendstream endobj"
    sources = [even, wide, *[built(c, font) for c in by_hand]]
    whole = [list(pdf.read_pages(s)) for s in sources]
    assert all(p.runs for pages in whole[1:] for p in pages) and len(whole[1][0].runs) == 4
    monkeypatch.setattr(pdf, "_LINE", re.compile(rb"(?!)"))
    assert [list(pdf.read_pages(s)) for s in sources] == whole


def test_documents_of_many_pages_and_odd_blanks(spark, tmp_path):
    from quarry import registry

    texts = ["w " * 125_000, "a\u00a0b\x1cc \x0b\x0cd\te\x85f\n" * 70, "", None, " \n", "\U0001f600 \u4e8c" * 300]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts, 1)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = registry.queries()["a08_pdf_layout"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = duck.sql(f"SELECT doc_id, lines, pages, blocks, digest FROM ({registry.oracles()['a08_pdf_layout']})").fetchall()
    assert len(want) == 3 and sorted(map(tuple, rows.select("doc_id", "lines", "pages", "blocks", "digest").collect())) == sorted(want)
    # a file's lines stay in the task that reads it
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
