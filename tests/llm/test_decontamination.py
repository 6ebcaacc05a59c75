"""Operator 8 against a plain greedy string tiling."""

import random
import re

import pytest

from quarry.llm import decontamination

WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def words(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]


def tiled(item, doc, least):
    """Coverage of item: mark the longest match of unmarked words, again and again."""
    mi, md = [False] * len(item), [False] * len(doc)
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not mi[i + n] and not md[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return sum(mi) / len(item)
        mi[i : i + n] = [True] * n
        md[j : j + n] = [True] * n


def brute(docs, bench, threshold=0.8):
    out = {}
    for d, t in docs:
        w = words(t)
        out[d] = sorted(i for i, u in bench if (x := words(u)) and w and tiled(x, w, min(5, len(x))) >= threshold)
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(4)
    w = [f"w{i}" for i in range(60)]
    bench = [(i, " ".join(rng.choice(w) for _ in range(rng.randint(6, 30)))) for i in range(12)]
    bench += [(20, "only three words"), (21, None), (22, "..."), (23, "rep rep rep rep rep rep rep rep"), (24, bench[0][1])]
    docs = [(0, None), (1, ""), (2, "clean text here"), (3, "rep " * 40), (4, "these are Only, three words!"), (5, "rep " * 7)]
    for k in range(60):
        item = bench[k % 12][1].split()
        if k % 4 == 1:  # reordered
            h = len(item) // 2
            item = item[h:] + item[:h]
        if k % 4 == 2:  # half of it
            item = item[: len(item) // 2]
        if k % 4 == 3:  # a word changed
            item[len(item) // 3] = "changed"
        pad = [rng.choice(w) for _ in range(30)]
        text = " ".join(pad[:15] + item + pad[15:])
        docs.append((10 + k, text.upper() if k % 5 == 0 else text.replace(" ", ", ") if k % 7 == 0 else text))
    return docs, bench


@pytest.mark.parametrize("block", [16 << 20, 200])
def test_against_plain_tiling(spark, case, block):
    docs, bench = case
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, items string")
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = brute(docs, bench)
    got = decontamination.find_leaks(spark, frame, items, block_bytes=block).collect()
    assert {r["doc_id"]: [x["item_id"] for x in r["items"]] for r in got} == want
    assert all(r["contaminated"] == bool(want[r["doc_id"]]) for r in got)
    kept = decontamination.drop_leaks(spark, frame, items, block_bytes=block)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, w in want.items() if not w)
    assert sum(map(bool, want.values())) > 30


def test_empty_tables(spark, no_docs, case):
    docs, bench = case
    items = spark.createDataFrame(bench, "item_id long, text string")
    assert decontamination.find_leaks(spark, no_docs, items).count() == 0
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert not any(r["contaminated"] for r in decontamination.find_leaks(spark, frame, items.limit(0)).collect())


@pytest.mark.parametrize("block", [16 << 20, 40])
def test_items_without_id(spark, block):
    bench = [(None, "one two three four five six"), (None, "seven eight nine ten eleven twelve"), (3, "red green blue black white grey")]
    docs = [(1, "x one two three four five six y red green blue black white grey"), (2, "seven eight nine ten eleven twelve"), (3, "none of them")]
    frame, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {r["doc_id"]: [x["item_id"] for x in r["items"]] for r in decontamination.find_leaks(spark, frame, items, block_bytes=block).collect()}
    assert got == {1: [None, 3], 2: [None], 3: []}
    assert [r["doc_id"] for r in decontamination.drop_leaks(spark, frame, items, block_bytes=block).collect()] == [3]


def test_copies_of_an_item_do_not_meet_in_one_block(spark):
    text = "one two three four five six seven"
    items = spark.createDataFrame([(1, text)] * 400 + [(2, "red green blue black white grey")], "item_id long, text string")
    blocks = decontamination._blocks(spark, items, 4000, "item_id", "text")
    sizes = [sum(len(r["t"]) for r in b.collect()) for b in blocks]
    assert sum(sizes) == 400 * len(text) + 31 and max(sizes) <= 4000
    frame = spark.createDataFrame([(1, "x " + text + " y"), (2, "clean")], "doc_id long, text string")
    got = {r["doc_id"]: len(r["items"]) for r in decontamination.find_leaks(spark, frame, items, block_bytes=8000).collect()}
    assert got == {1: 400, 2: 0}
