"""The file format as a Spark source."""

import pytest

from quarry.sources import files, pdf, reader
from tests.test_sources import document_file, sheet_file


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "deep").mkdir()
    named = {"a.csv": b"x,y\n1,2\n", "b.xlsx": sheet_file(), "deep/c.docx": document_file(), "deep/d.pdf": pdf.write_pages([[(40.0, 50.0, 10.0, "A page")]]), "e.md": b"one\ntwo", "f.csv": b"a,b\n1\n", "g.exe": b"?", "_SUCCESS": b""}
    for name, content in named.items():
        (root / name).write_bytes(content)
    reader.register(spark)
    return str(root)


def test_blocks_equal_those_of_the_plain_reader(spark, folder):
    columns = ["position", "kind", "page", "row_number", "text", "cells", "error"]
    got = spark.read.format("quarry").load(f"file://{folder}")
    want = files.read_files(spark, f"file://{folder}").filter("path NOT LIKE '%_SUCCESS'")
    plain = lambda df: sorted(str((r["path"].removeprefix("file:"), *[r[c] for c in columns])) for r in df.collect())
    assert plain(got) == plain(want)
    assert got.rdd.getNumPartitions() == 1
    assert spark.read.format("quarry").option("groupBytes", "10").load(f"file://{folder}").rdd.getNumPartitions() == 6


def test_columns_and_filters(spark, folder):
    some = spark.read.format("quarry").option("columns", "path,text").load(f"file://{folder}")
    assert some.columns == ["path", "text"] and some.filter("text = 'A page'").count() == 1
    rows = spark.read.format("quarry").option("groupBytes", "1").load(f"file://{folder}").filter("extension IN ('md', 'csv') AND kind <> 'error'")
    assert sorted({r["path"].rpartition("/")[2] for r in rows.collect()}) == ["a.csv", "e.md", "f.csv"]
    assert rows.rdd.getNumPartitions() == 3  # the other files are not even opened
    one = f"{folder}/e.md"
    assert [r["text"] for r in spark.read.format("quarry").load(f"file://{folder}").filter(f"path = '{one}'").orderBy("position").collect()] == ["one", "two"]
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("quarry").option("columns", "nothing").load(f"file://{folder}").collect()


def test_groups():
    sizes = [("b", 5), ("a", 5), ("c", 30), ("d", 1), ("e", 9), ("f", 1)]
    assert [[p for p, _ in g.files] for g in reader.grouped(sizes, 10)] == [["a", "b"], ["c"], ["d", "e"], ["f"]]
    assert reader.grouped([], 10) == []
