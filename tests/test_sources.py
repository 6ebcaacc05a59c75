"""File sources, object store, generations and artifacts."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.sources import files, objects


def sheet_file():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S1" r:id="a"/><sheet name="S2" state="hidden" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>name</t></si><si><r><t>a</t></r><r><t>b</t></r></si></sst>")
        z.writestr("xl/worksheets/s1.xml", '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="A2"><f>1+1</f><v>2</v></c><c r="B2" t="b"><v>1</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/s2.xml", "<worksheet><sheetData/></worksheet>")
    return out.getvalue()


def document_file():
    w = 'xmlns:w="w"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="My"><w:basedOn w:val="H1"/></w:style><w:style w:styleId="N"/></w:styles>')
        p = lambda t, s="N": f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Title', 'My')}{p('Some text')}<w:tbl><w:tr><w:tc>{p('x')}</w:tc><w:tc>{p('y')}</w:tc></w:tr></w:tbl>{p('After')}</w:body></w:document>")
        z.writestr("word/header1.xml", f"<w:hdr {w}>{p('Head')}</w:hdr>")
    return out.getvalue()


def page_file():
    stream = zlib.compress(b"BT /F1 12 Tf (Hello \\(world\\)) Tj 0 -14 Td [(Second) -20 ( line)] TJ ET")
    return b"%PDF-1.4\n1 0 obj << /Length 1 /Filter /FlateDecode >>\nstream\n" + stream + b"\nendstream endobj"


def test_csv_forms():
    assert files.read_csv("﻿a;b\n1;2\n".encode("utf-8")) == [["a", "b"], ["1", "2"]]
    assert files.read_csv("名\t值\n一\t二\n".encode("gb18030")) == [["名", "值"], ["一", "二"]]
    assert files.read_csv(b"") == []
    assert files.read_csv(b'a,b\n\n"x,1",\n') == [["a", "b"], ["", ""], ["x,1", ""]]
    assert files.read_csv(b"a,NA\nnull,1\n") == [["a", "NA"], ["null", "1"]]
    for bad in (b"a,b\n1,2,3\n", b"a\0b", b"\xff\xfe\xff", b'a,b\n"x'):
        with pytest.raises(files.FileError):
            files.read_csv(bad)


def test_files_become_blocks(spark, tmp_path):
    for name, content in {"a.csv": b"x,y\n1,2\n", "b.xlsx": sheet_file(), "c.docx": document_file(), "d.pdf": page_file(), "e.txt": b"one\ntwo", "f.exe": b"?", "g.xlsx": b"not a zip"}.items():
        (tmp_path / name).write_bytes(content)
    rows = {}
    for r in sorted(files.read_files(spark, f"file://{tmp_path}").collect(), key=lambda r: (r["path"], r["position"])):
        rows.setdefault(r["path"].rpartition("/")[2], []).append(r)
    assert [r["cells"] for r in rows["a.csv"]] == [["x", "y"], ["1", "2"]]
    assert [r["cells"] for r in rows["b.xlsx"]] == [["name", "", "ab"], ["2", "TRUE"]]
    assert rows["b.xlsx"][1]["formulas"] == ["=1+1", ""]
    assert [(r["kind"], r["level"], r["text"]) for r in rows["c.docx"] if r["kind"] != "row"] == [("heading", 1, "Title"), ("paragraph", None, "Some text"), ("paragraph", None, "After"), ("header", None, "Head")]
    assert rows["c.docx"][2]["cells"] == ["x", "y"]
    assert rows["d.pdf"][0]["text"] == "Hello (world)\nSecond line"
    assert [r["text"] for r in rows["e.txt"]] == ["one", "two"]
    assert rows["f.exe"][0]["error"] == "extension" and rows["g.xlsx"][0]["error"] == "malformed"


def test_object_store(spark, tmp_path):
    store = objects.ObjectStore(spark, f"file://{tmp_path}/objects")
    digest = store.put("t1/files/a.bin", b"abc")
    assert digest == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert store.exists("t1/files/a.bin") and store.open("t1/files/a.bin") == b"abc"
    with pytest.raises(FileExistsError):
        store.put("t1/files/a.bin", b"x")
    for key in ("../a", "/a", "a//b", "A", "a/./b", "", "a" * 600):
        with pytest.raises(ValueError):
            store.put(key, b"x")
    assert store.delete("t1/files/a.bin") and not store.exists("t1/files/a.bin")


def test_generations(spark, tmp_path):
    g = objects.Generations(spark, f"file://{tmp_path}/table")
    assert g.read() is None
    assert g.publish(spark.range(3), 0) == 1
    assert g.publish(g.read().union(spark.range(2)), 1) == 2
    with pytest.raises(RuntimeError):
        g.publish(spark.range(1), 1)
    assert g.read().count() == 5


def test_artifacts_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("b", '{"x":1}'), ("a", None)], "identity string, body string")
    objects.write_artifacts(rows, f"file://{tmp_path}/out")
    assert sorted(map(str, objects.read_artifacts(spark, f"file://{tmp_path}/out", "identity string, body string").collect())) == sorted(map(str, rows.collect()))


def test_exact_text_functions(spark):
    rows = spark.createDataFrame([("Straße  ﬁne Ⅷ",), (None,), ("  ",)], "t string")
    got = rows.select(text.match_text_exact(F.col("t")).alias("m"), text.tight_text_exact(F.col("t")).alias("s"), text.tokens_exact(F.col("t")).alias("w")).collect()
    assert tuple(got[0]) == ("strasse fine viii", "strassefineviii", "strasse fine viii")
    assert tuple(got[1]) == (None, None, None) and tuple(got[2]) == ("", "", "")


def test_layout_tags():
    def packed(parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, value in parts.items():
                z.writestr(name, value)
        return out.getvalue()

    assert files.layout_tags("docx", document_file()) == ["detected_header_footer"]
    assert files.layout_tags("docx", packed({"word/media/a.png": "x", "word/footer1.xml": "<w:p/>"})) == ["detected_embedded_media"]
    assert files.layout_tags("xlsx", sheet_file()) == [] == files.layout_tags("csv", b"a,b")
    assert files.layout_tags("xlsx", packed({"xl/worksheets/s1.xml": "<worksheet><mergeCells/></worksheet>"})) == ["detected_merged_cells"]
    paths = b"0 0 m 9 9 l S 0 0 5 5 re f* BT (S S S S) Tj ET 1 1 m 2 2 l s "
    page = lambda stream: b"%PDF-1.4\n1 0 obj << /Length 1 >>\nstream\n" + stream + b"\nendstream endobj"
    assert files.layout_tags("pdf", page(paths + b"0 0 m B")) == ["detected_document_table"]
    assert files.layout_tags("pdf", page(paths)) == files.layout_tags("pdf", page_file()) == []
    for name, bad in (("pdf", b"x"), ("docx", b"x")):
        with pytest.raises(files.FileError):
            files.layout_tags(name, bad)


def test_blocks_of_several_files_leave_together(spark, monkeypatch):
    made = [(f"{i}.txt", f"a{i}\nb".encode()) for i in range(7)] + [("x.csv", b"a,b\n1,2"), ("none.txt", b""), ("bad.docx", b"no"), ("odd.exe", b"?"), ("s.xlsx", sheet_file()), ("d.docx", document_file())]
    rows = spark.createDataFrame(made, "path string, content binary").repartition(1)
    assert "MapInArrow" in files.blocks(rows)._jdf.queryExecution().executedPlan().toString()
    want = [(p, n) for p, c in made for n, _ in enumerate(files.parse(p.rpartition(".")[2], c) if p[:3] not in ("bad", "odd") else [0], 1)]
    held = []
    for packed in (1, 5, 4096):
        monkeypatch.setattr(files, "PACKED", packed)
        found = files.blocks(rows).collect()
        assert sorted((r["path"], r["position"]) for r in found) == sorted(want)
        assert {r["path"]: r["error"] for r in found if r["kind"] == "error"} == {"bad.docx": "malformed", "odd.exe": "extension"}
        held.append(sorted(map(str, found)))
    assert held[0] == held[1] == held[2]
