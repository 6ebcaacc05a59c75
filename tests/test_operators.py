"""Edge cases of operators: chunks, tables, context, fusion, gates, transitions, near duplicates."""

import random
import unicodedata

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry import registry
from quarry.functions import text, vectors
from quarry.operators import audit, chunking, context, joins, near_text, quality_gate, ranking, retrieval, tools, writes
from quarry.operators import relational as R

TEXTS = st.text(alphabet=st.sampled_from("ab c.,\n;é中文字!?１_ ́"), max_size=400)


def plain_count(value):
    """One token per CJK character at a run's start, one per four characters of a run, one per symbol."""
    value, n, i = unicodedata.normalize("NFC", value), 0, 0
    word = lambda c: c.isalnum() or c == "_"
    while i < len(value):
        if value[i].isspace():
            i += 1
        elif "一" <= value[i] <= "鿿" or not word(value[i]):
            n, i = n + 1, i + 1
        else:
            j = i
            while j < len(value) and word(value[j]):
                j += 1
            n, i = n + -(-(j - i) // 4), j
    return n


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_token_count(value):
    assert chunking.count_tokens(value) == plain_count(value)


@given(TEXTS, st.integers(6, 20))
@settings(max_examples=200, deadline=None)
def test_chunks_cover_the_text(value, target):
    value = unicodedata.normalize("NFC", value)
    s = chunking.Settings(target=target, most=target + 5, overlap=3)
    seen, last = set(), -1
    for a, b, n, shared in chunking.text_windows(value, s):
        assert n <= s.most and a > last and 0 <= shared
        last = a
        seen.update(range(a, b))
    assert all(value[i].isspace() for i in range(len(value)) if i not in seen)


def test_boundary_preference():
    words = "one two three four five six seven eight nine ten eleven twelve"
    s = chunking.Settings(target=8, most=10, overlap=1)
    strong = words.replace("six", "six.", 1)
    first = next(iter(chunking.text_windows(strong, s)))
    assert strong[first[0] : first[1]].endswith("six.")


def test_a_long_heading_is_an_error():
    with pytest.raises(ValueError):
        list(chunking.text_windows("a b c", chunking.Settings(target=5, most=6, overlap=2), "one two three four five"))


def cell(column, value, span=1):
    return {"column": column, "span": span, "text": value}


def test_tables_repeat_headers_and_overlap_rows():
    rows = [{"number": 1, "header": True, "cells": [cell(1, "name"), cell(2, "n")]}] + [{"number": i, "header": False, "cells": [cell(1, f"item {i}"), cell(2, str(i))]} for i in range(2, 12)]
    out = chunking.table_windows(rows, chunking.Settings(target=50, most=70))
    assert [n for c in out for n in c["rows"]] == list(range(2, 12))
    assert all(c["token_count"] <= 70 for c in out) and len(out) > 1
    assert out[1]["body"].startswith("[header context row 1]") and "[data context row" in out[1]["body"]


def test_wide_rows_split_between_merged_cells():
    rows = [{"number": 1, "header": False, "cells": [cell(1, "aaaa " * 8, 2), cell(3, "bbbb " * 8), cell(4, "cccc " * 8)]}]
    out = chunking.table_windows(rows, chunking.Settings(target=12, most=22))
    assert [c["columns"] for c in out] == [(1, 2), (3, 3), (4, 4)]
    with pytest.raises(ValueError):
        chunking.table_windows([{"number": 1, "header": False, "cells": [cell(1, "x " * 90)]}], chunking.Settings(target=12, most=22))
    assert chunking.table_windows([]) == []


def test_heading_lanes(spark):
    rows = [(1, 1, 1, "A"), (1, 2, 2, "A1"), (1, 3, None, "t"), (1, 4, 1, "B"), (1, 5, None, "t"), (1, 6, 3, "B3"), (1, 7, 2, "B2"), (1, 8, None, "t")]
    out = chunking.heading_lanes(spark.createDataFrame(rows, "k int, o int, l int, t string"), "k", "o", "l", "t").collect()
    assert [r["heading_path"] for r in sorted(out, key=lambda r: r["o"])] == [["A"], ["A", "A1"], ["A", "A1"], ["B"], ["B"], ["B", "B3"], ["B", "B2"], ["B", "B2"]]


def test_ranges_and_groups(spark):
    r = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10), (1, 2, 3), (2, 1, 2)], "k int, a int, b int")
    assert sorted(map(tuple, chunking.coalesce_ranges(r, "k", "a", "b").collect())) == [(1, 0, 7), (1, 9, 10), (2, 1, 2)]


def test_ranges_without_a_start_or_an_end(spark, tmp_path):
    # parts whose rows differ in start or end; suppliers below 7 and orders below 25 stand for themselves
    lines = [(1, 4, 2, 1), (1, 9, 1, 5), (1, None, 3, 1), (1, 2, None, 2), (1, None, 5, 5), (2, None, 1, 1), (2, 3, 4, 1), (2, 3, 1, 3), (3, 8, None, 1), (4, 1, 1, None), (4, 2, 1, 1), (None, 1, 1, 1), (None, 2, 1, 1), (None, 2, 6, 4)]
    spark.createDataFrame(lines, "l_partkey long, l_orderkey long, l_suppkey long, l_linenumber int").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    got = registry.queries()["h35_coalesced_ranges"](spark, str(tmp_path)).select("k", "a", "b").collect()
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, duck.sql(registry.oracles()["h35_coalesced_ranges"]).fetchall()))


def test_equal_ranges_are_one(spark):
    # a repeated table, shuffled: what ties in the order can't change
    rows = [(k, a, a + (a * 7 + k) % 5) for k in range(20) for a in range(0, 200, 4)]
    once, often = (chunking.coalesce_ranges(spark.createDataFrame(r, "k int, a int, b int").repartition(7), "k", "a", "b").collect() for r in (rows, rows * 6))
    assert sorted(map(tuple, often)) == sorted(map(tuple, once))


def test_fusion_and_truncation(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, chunk_id int, rank int")
    b = spark.createDataFrame([(1, 12, 1), (1, 10, 4)], "query_id int, chunk_id int, rank int")
    rows = ranking.fuse([a, b], ["query_id", "chunk_id"]).collect()
    got = {r["chunk_id"]: (r["rrf"], r["rank_0"], r["rank_1"]) for r in rows}
    assert got[10] == (1 / 61 + 1 / 64, 1, 4) and got[11] == (1 / 62, 2, None) and got[12] == (1 / 61, None, 1)
    top = ranking.top_k(ranking.fuse([a, b], ["query_id", "chunk_id"]), ["query_id"], [F.desc("rrf"), F.col("chunk_id")], 2)
    assert [r["chunk_id"] for r in top.orderBy("rank").collect()] == [10, 12]
    merged = joins.merge_ranked(a.withColumn("f", F.lit(1)), b.withColumn("f", F.lit(2)), ["query_id", "chunk_id"], ["f"])
    assert {r["chunk_id"]: r["conflict"] for r in merged.collect()} == {10: True, 11: False, 12: False}


def test_duplicate_evidence_adds_nothing(spark):
    gold = spark.createDataFrame([(1, 5), (1, 6)], "query_id int, evidence_id int")
    found = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 6, 3)], "query_id int, evidence_id int, rank int")
    import math

    value = ranking.novelty_ndcg(found, gold, 10).first()["ndcg"]
    assert value == pytest.approx((1 + 1 / 2) / (1 + 1 / math.log2(3)))
    assert ranking.novelty_ndcg(found.limit(0), gold, 10).first()["ndcg"] == 0


def test_gate(spark):
    rows = [(q, i, s) for q, scores in {1: [0.9, 0.88, 0.2], 2: [0.2], 3: [0.99, 0.5], 4: [0.95, 0.5]}.items() for i, s in enumerate(scores, 1)]
    out = ranking.evidence_gate(spark.createDataFrame(rows, "query_id int, rank int, score double"), 0.3, 0.8, 3, 0.97, 0.05)
    assert {r["query_id"]: (r["outcome"], r["retained"]) for r in out.collect()} == {1: ("uncertain", 2), 2: ("unsupported", 0), 3: ("supported", 1), 4: ("supported", 1)}


def test_neighbours_need_the_exact_index(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 4, "d")], "g int, i int, v string")
    out = {r["i"]: (r["previous"], r["next"]) for r in joins.neighbours(rows, ["g"], "i", "v").collect()}
    assert out == {1: (None, "b"), 2: ("a", None), 4: (None, None)}


def test_context_budget_dedup_and_order(spark):
    rows = [(1, c, role, rank, p, 1, i, body, o) for c, role, rank, p, i, body, o in [
        (10, "anchor", 1, 1, 5, "alpha beta gamma", 0), (20, "anchor", 2, 2, 9, "delta", 0), (11, "next", 1, 4, 6, "gamma epsilon", 2),
        (9, "previous", 1, 3, 4, "delta", 0), (30, "next", 2, 5, 10, "much " * 50, 0), (12, "next", 2, 6, 12, "zeta", 0)]]
    frame = spark.createDataFrame(rows, "query_id long, chunk_id long, role string, anchor_rank int, priority int, document_id long, chunk_index int, body string, overlap_tokens int")
    out = sorted(context.select_context(frame, 12, 5).collect(), key=lambda r: r["position"])
    assert [(r["chunk_id"], r["text"]) for r in out] == [(10, "alpha beta gamma"), (11, "epsilon"), (20, "delta"), (12, "zeta")]
    assert context.trim("a b", 1, "x") is None and context.trim(" a b ", 0, None) == "a b"


def test_lexical_scores(spark):
    chunks = spark.createDataFrame([(1, "apple pie Apple"), (2, "pie"), (3, "none")], "chunk_id long, body string")
    queries = spark.createDataFrame([(1, ["apple", "apple", "pie"])], "query_id long, terms array<string>")
    out = retrieval.lexical_topk(chunks, queries, 5).orderBy("rank").collect()
    assert [(r["chunk_id"], round(r["score"], 9)) for r in out] == [(1, round(0.3 / 1.3, 9)), (2, round(0.1 / 1.1, 9))]


def test_similarity_and_identity(spark):
    row = spark.range(1).select(vectors.similarity(F.lit(2.0000001)).alias("a"), vectors.similarity(F.lit(2.1)).alias("b"), vectors.similarity(F.lit(-1e-9)).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (-1.0, None, 1.0)


def test_uuid5_is_standard(spark):
    import uuid

    from quarry.functions import hashing

    got = spark.createDataFrame([("a",), ("ß",)], "n string").select("n", hashing.uuid5(uuid.NAMESPACE_URL.hex, F.col("n")).alias("u")).collect()
    assert all(r["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["n"])) for r in got)


def test_available_and_latest_ties(spark):
    rows = spark.createDataFrame([("T", 1, 1, 5, 150, 20, 5), ("T", 1, 1, 5, 10, 5, 5), ("T", 1, 1, 4, 1, 9, 0), ("T", 2, 1, 1, 1, 2, 0)], "tenant string, v int, w int, t int, on_hand int, reserved int, unsellable int")
    out = R.available(R.latest(rows, ["tenant", "v", "w"], "t")).collect()
    assert sorted((r["v"], r["available"], r["status"]) for r in out) == [(1, 0, "ok"), (1, 125, "ok"), (2, -1, "contract_violation")]


def test_transitions(spark):
    rows = spark.createDataFrame([(1, "pending", 0), (2, "ready", 1), (3, "processing", 1)], "id int, status string, attempt_count int")
    out = writes.claim(rows, F.col("id") < 9).collect()
    assert [(r["status"], r["attempt_count"], r["changed"]) for r in sorted(out)] == [("processing", 1, True), ("ready", 1, False), ("processing", 1, False)]
    late = spark.createDataFrame([(3, 2, 5, 5)], "id int, expected_attempt int, expected_count int, actual_count int")
    assert not any(r["changed"] for r in writes.complete(rows, late, ["id"]).collect())


def test_seed_is_idempotent(spark):
    seed = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, v string")
    stored = spark.createDataFrame([(1, "a"), (2, None), (3, "other")], "id int, v string")
    assert {r["id"]: r["outcome"] for r in R.seed_outcome(seed, stored, ["id"]).collect()} == {1: "unchanged", 2: "unchanged", 3: "conflict"}


def test_near_rows_against_all_pairs(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(80):
        words = rng.sample(base, 40) if k % 3 else base[: 40 + rng.randint(0, 3)]
        rows.append((k, "  ".join(words).upper() if k % 7 == 0 else " ".join(words)))
    rows += [(100, "short text"), (101, "Short  TEXT"), (102, "")]
    want, norm = set(), lambda t: " ".join(t.lower().split())
    for k, t in rows:
        for j, u in rows:
            a, b = set(t.lower().split()), set(u.lower().split())
            if j < k and (norm(t) == norm(u) or (len(a) >= 20 and len(b) >= 20 and len(a & b) >= 0.9 * len(a | b))):
                want.add(k)
    got = near_text.repeats(spark.createDataFrame(rows, "k int, t string"), "k", "t")
    assert {r["k"] for r in got.collect()} == want


def test_citations(spark):
    rows = spark.createDataFrame([("a [E1] b [E2] [E1]",), ("［E1］",), ("[E0]",), ("none",), ("[E12] [e1]",)], "t string")
    got = [r[0] for r in rows.select(text.citation_labels(F.col("t"))).collect()]
    assert got == [["[E1]", "[E2]"], None, None, [], None]


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_context_holds_readable_chunks_only(spark, folder):
    from quarry import registry
    from quarry.plans.retrieval import allowed

    d = f"/root/testdata/{folder}"
    fine = {r["document_id"] for r in allowed(spark, d).select("document_id").collect()}
    for name in ("j04_search_knowledge", "m08_candidate_priority"):
        rows = registry.queries()[name](spark, d).collect()
        assert rows and {r["chunk_id"] for r in rows} <= fine
    for r in registry.queries()["m07_rehydrated_windows"](spark, d).collect():
        assert {r["chunk_id"], r["previous"], r["next"]} - {None} <= fine


def test_no_text_is_shuffled_but_of_wanted_chunks(spark, monkeypatch):
    from quarry.operators import retrieval
    from quarry.plans import retrieval as plans

    d = "/root/testdata/sf0.01"
    ok = plans.permitted(spark, d)
    wanted = spark.createDataFrame([(i,) for i in (*range(60), 0, 1)], "chunk_id long")
    texts = plans.readable(spark, d, ok, wanted)
    above, scan = texts._jdf.queryExecution().sparkPlan().toString().split("FileScan")[:2]
    assert "text" in scan.splitlines()[0] and "BroadcastHashJoin" in above and above.count("Join") == 2
    fine = {r["chunk_id"] for r in ok.collect()}
    got = {r["chunk_id"] for r in texts.collect()}
    assert got == fine & set(range(60)) and texts.count() == len(got)
    monkeypatch.setattr(retrieval, "FEW", 3)
    assert {r["chunk_id"] for r in plans.readable(spark, d, ok, wanted).collect()} == got


def test_longest_common_run():
    import random

    from quarry.functions.text import common_run

    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 25))] for _ in range(2))
        plain = max((n for i in range(len(a)) for n in range(1, len(a) - i + 1) if any(a[i : i + n] == b[j : j + n] for j in range(len(b)))), default=0)
        assert common_run(a, b) == plain


def test_arguments_are_bounded():
    from quarry.operators.quality_gate import shown_fields

    got = shown_fields({f"k{i:02}": i for i in range(23)} | {"a-Token": "x", "b": [{"c": {"d": 1}}] * 12, "c": "y" * 201}, 20, 0)
    assert got["a-Token"] == "[REDACTED]" and got["b"] == [{"c": "[TRUNCATED]"}] * 10 + ["[TRUNCATED]"] and got["c"] == "y" * 197 + "..."
    assert got["_truncated_fields"] == 6 and len(got) == 21


def test_line_kinds(spark):
    want = {"Invoice  NUMBER": "label", "Product category ": "label", "Section 4 scope of the whole agreement as signed": "section", "approximately EUR 1,200.50 million per year": "currency", "$ 5": "currency", "A12/34-5": "reference_code",
            "1.2)": "outline", "（三）": "outline", "3. Terms of use": "numbered", "Overview": "heading", "This one ends. It is a text.": "text", "EUR five": "heading", "": "text"}
    rows = spark.createDataFrame([(k,) for k in want] + [(None,)], "line string")
    got = {r["line"]: r["kind"] for r in rows.select("line", quality_gate.line_kind(F.col("line")).alias("kind")).collect()}
    assert got == want | {None: "text"}


def test_review_values():
    value = '{"a": [{"Password": "x", "t": "sk-1"}, "SELECT a FROM b", 3], "acl": [1], "b": {"path": 1, "c": {"stack": 1, "d": "C:\\\\x"}}, "e": "select", "f": "user_id = 4"}'
    assert quality_gate.review_value(value) == '{"a": [{"t": "[REDACTED]"}, "[REDACTED]", 3], "b": {"c": {"d": "[REDACTED]"}}, "e": "select", "f": "[REDACTED]"}'
    assert quality_gate.review_value(None) is None and quality_gate.review_value("Bearer x") == '"[REDACTED]"' and quality_gate.review_value("") == '""' and quality_gate.review_value("[]") == "[]"


def plain_stall(progress, most):
    streak = 0
    for n, p in enumerate(progress, 1):
        streak = 0 if p else streak + 1
        if streak > most:
            return n, True
    return len(progress), False


def test_workers_stop_without_progress(spark):
    rng = random.Random(5)
    runs = {k: [rng.choice([True, False, None]) for _ in range(rng.randrange(1, 12))] for k in range(30)}
    rows = spark.createDataFrame([(k, i, p) for k, ps in runs.items() for i, p in enumerate(ps)], "k int, i int, p boolean")
    for most in (1, 2):
        out = tools.until_stalled(rows, ["k"], "i", F.col("p"), most).groupBy("k").agg(F.count("*"), F.max("stopped"), F.count_if("stopped")).collect()
        assert {r[0]: (r[1], r[2]) for r in out} == {k: plain_stall(p, most) for k, p in runs.items()}
        assert all(r[3] <= 1 for r in out)


def test_repeated_handoffs_are_refused(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 4, "a"), (1, 5, "a")], "root int, i int, s string")
    assert {r["i"]: r["refused"] for r in tools.repeated_handoffs(rows, ["root"], "i", F.col("s"), 2).collect()} == {1: False, 2: False, 3: False, 4: False, 5: True}


def test_text_audit(spark):
    s = chunking.Settings(target=30, most=40, overlap=5)
    texts = {1: "First line here.\n\nSECOND  line e\u0301\n" + "long words follow one another " * 12 + "\nlast line", 2: "", 3: None, 4: " \n", 5: "word " * 200, 6: "a\nb\nc"}
    docs = spark.createDataFrame(list(texts.items()) + [(None, "x")], "k int, t string")
    got = {r["k"]: r for r in audit.audit_texts(docs, chunking.chunk_texts(docs.filter("k IS NOT NULL"), "k", "t", s), "k", "t", s.most).collect()}
    norm = lambda v: " ".join(unicodedata.normalize("NFC", v).lower().split())
    assert set(got) == set(texts)
    for k, t in texts.items():
        value = unicodedata.normalize("NFC", t or "")
        bodies = [norm(value[a:b]) for a, b, *_ in chunking.text_windows(value, s)]
        units = [norm(x) for x in value.split("\n") if norm(x) and chunking.count_tokens(x) <= s.most]
        held = sum(any(u in b for b in bodies) for u in units)
        r = got[k]
        assert (r["units"], r["preserved"], r["chunks"], r["ordered"], r["bounded"]) == (len(units), held, len(bodies), True, True)
        assert r["break_rate"] == (round(1 - held / len(units), 6) if units else None)
    cut = spark.createDataFrame([(6, 1, "a b", 700), (6, 3, "c", 2)], "k int, chunk_index int, body string, token_count int")
    r = audit.audit_texts(docs.filter("k = 6"), cut, "k", "t").first()
    assert (r["units"], r["preserved"], r["ordered"], r["bounded"]) == (3, 3, False, True)


def test_table_audit_and_trim(spark):
    rows = [{"number": 1, "header": True, "cells": [cell(1, "name"), cell(2, "n|m")]}] + [{"number": i, "header": False, "cells": [cell(1, f"item\n{i}"), cell(2, "")]} for i in range(2, 12)]
    table = spark.createDataFrame([(1, rows), (2, rows[:1]), (3, [])], "k int, rows array<struct<number:int,header:boolean,cells:array<struct<column:int,span:int,text:string>>>>")
    chunks = chunking.chunk_tables(table, "k", "rows", chunking.Settings(target=50, most=70))
    assert {tuple(r) for r in audit.audit_rows(table, chunks, "k", "rows").collect()} == {(1, 11, 11), (2, 1, 1)}
    assert {tuple(r) for r in audit.audit_rows(table, chunks.filter("chunk_index > 1"), "k", "rows").filter("k = 2").collect()} == {(2, 1, 0)}
    own = [r["own"] for r in chunks.filter("k = 1").orderBy("chunk_index").select(context.trim_table(F.col("body")).alias("own")).collect()]
    lines = "\n".join(own).split("\n")
    assert len(own) > 1 and len(lines) == 11 and lines[0].startswith("[header row 1]") and [int(x.split()[2][:-1]) for x in lines] == list(range(1, 12))


def test_chunks_are_trimmed_by_the_chunk_before(spark):
    value = " ".join(f"word{i}{'.' * (i % 7 == 0)}" for i in range(400))
    rows = spark.createDataFrame([(1, value), (2, None)], "k int, t string")
    chunks = chunking.chunk_texts(rows, "k", "t", chunking.Settings(target=60, most=70, overlap=9))
    out = context.trim_chunks(chunks, "k").orderBy("chunk_index").collect()
    assert len(out) > 5 and "".join(r["text"] for r in out).replace(" ", "") == value.replace(" ", "")
    odd = spark.createDataFrame([(1, 1, "a b", 0), (1, 2, "x c", 1)], "k int, chunk_index int, body string, overlap_tokens int")
    assert [r["text"] for r in context.trim_chunks(odd, "k").orderBy("chunk_index").collect()] == ["a b", None]


def test_fixed_embedding(spark):
    import hashlib
    import struct

    got = spark.createDataFrame([("a",), ("",), ("é中",)], "t string").select("t", vectors.fixed_embedding(F.col("t"), "query", 8).alias("v")).collect()
    for r in got:
        raw = struct.unpack(">8i", hashlib.shake_256(b"query\0" + r["t"].encode()).digest(32))
        size = sum(x * x for x in raw) ** 0.5
        assert r["v"] == pytest.approx([x / size for x in raw], rel=1e-12)
