"""Queries without SQL against plain versions, over their whole output; and the admission of contexts."""

import hashlib
import random
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry import registry
from quarry.functions import source
from quarry.operators import audit, chunking, context


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def rows_of(spark, sf, name, *columns):
    return sorted((tuple(r[c] for c in columns) for r in registry.queries()[name](spark, sf).collect()), key=str)


def words(text):
    return re.findall(r"[^\W]+", text.lower())


def test_longest_common_runs(spark, sf, texts):
    def longest(a, b):
        best, before = 0, [0] * (len(b) + 1)
        for x in a:
            row = [0] * (len(b) + 1)
            for j, y in enumerate(b):
                if x == y:
                    row[j + 1] = before[j] + 1
                    best = max(best, row[j + 1])
            before = row
        return best

    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {i: longest(words(t), words(texts[i])) / len(words(t)) for i, t in items.items() if i in texts}
    got = dict(rows_of(spark, sf, "h07_longest_common_run", "doc_id", "share"))
    assert got == pytest.approx(want)


def test_fixed_embeddings(spark):
    from quarry.functions import vectors

    rows = spark.createDataFrame([("a",), ("ß 中",), ("",)], "t string")
    for r in rows.select("t", vectors.fixed_embedding(F.col("t"), "query").alias("v")).collect():
        raw = np.frombuffer(hashlib.shake_256(f"query\0{r['t']}".encode()).digest(256), ">i4").astype(float)
        assert r["v"] == pytest.approx((raw / np.linalg.norm(raw)).tolist())


def pieces(text):
    """Tokens by a walk over characters."""
    out, i = [], 0
    cjk = lambda c: "㐀" <= c <= "䶿" or "一" <= c <= "鿿" or "豈" <= c <= "﫿" or "぀" <= c <= "ヿ" or "가" <= c <= "힯"
    while i < len(text):
        c = text[i]
        if c.isspace():
            i += 1
        elif cjk(c) or not re.match(r"\w", c):
            out.append((i, i + 1))
            i += 1
        else:
            j = i
            while j < len(text) and re.match(r"\w", text[j]):
                j += 1
            out += [(k, min(k + 4, j)) for k in range(i, j, 4)]
            i = j
    return out


def plain_chunks(text, target=600, most=700, overlap=100):
    """Windows by the rule's words: as long as the limit allows if it is the end, else up to the last strongest boundary at or before the target, else the next one up to the limit."""
    spans, out, first, before = pieces(text), [], 0, None
    while first < len(spans):
        rest = spans[first:]
        if len(rest) <= most:
            end = len(text)
        else:
            low, goal, high = rest[target // 2 - 1][1], rest[target - 1][1], rest[most - 1][1]
            end = goal
            for kind in (r"\n\s*\n", r"[。！？.!?](?:[”’」』】）》])?", r"[；;，,、:]", r"\s+"):
                ends = [low + m.end() for m in re.finditer(kind, text[low:high])]
                if ends:
                    end = max((e for e in ends if e <= goal), default=min(ends))
                    break
        start = rest[0][0]
        body = text[start:end].rstrip()
        end = start + len(body)
        shared = len(pieces(text[start : min(before, end)])) if before is not None and before > start else 0
        out.append((body, len(pieces(body)), shared))
        if end >= spans[-1][1]:
            break
        done = sum(b <= end for _, b in spans)
        first, before = max(first + 1, done - overlap), end
    return out


def test_text_chunks(spark, sf, texts):
    want = []
    for d, t in texts.items():
        want += [(d, i, n, s, hashlib.sha256(b.encode()).hexdigest()) for i, (b, n, s) in enumerate(plain_chunks(unicodedata.normalize("NFC", t or "")), 1)]
    got = rows_of(spark, sf, "l09_text_chunks", "doc_id", "chunk_index", "token_count", "overlap_tokens", "body_sha256")
    assert got == sorted(want, key=str)
    sums = {}
    for d, _, n, s, _ in want:
        c, t, o = sums.get(d, (0, 0, 0))
        sums[d] = (c + 1, t + n, o + s)
    name = next(n for n in registry.queries() if n.startswith("e10_"))
    assert rows_of(spark, sf, name, "doc_id", "chunks", "tokens", "shared") == sorted(((d, *v) for d, v in sums.items()), key=str)


def test_heading_lanes(spark, sf, texts):
    want = []
    for d, t in texts.items():
        lane = {}
        for i, line in enumerate((t or "").split("\n")):
            level = next((n for n, most in ((1, 12), (2, 25), (3, 40)) if len(line) <= most), None)
            if level:
                lane = {n: said for n, said in lane.items() if n < level} | {level: line}
            want.append((d, i, " > ".join(lane[n] for n in sorted(lane))))
    got = rows_of(spark, sf, "l10_heading_lanes", "doc_id", "i", "path")
    first = min(i for _, i, _ in got)
    assert got == sorted(((d, i + first, p) for d, i, p in want), key=str)


def test_table_chunks(spark, sf):
    import collections

    tables = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus").collect():
        tables[r["l_orderkey"]].append(tuple(map(str, tuple(r)[1:])))
    want = []
    for order, rows in tables.items():
        rows.sort(key=lambda v: (int(v[0]), *v[1:]))
        said = lambda role, n, rows=rows: f"[{role} row {n}] " + " | ".join(rows[n - 1])
        size = lambda lines: len(pieces("\n".join(lines)))
        if len(rows) == 1:
            want.append((order, 1, 1, 1, size([said("header", 1)])))
            continue
        at, number = 2, 1
        while at <= len(rows):
            head = [said("header" if number == 1 else "header context", 1)]
            context_rows = [said("data context", at - 1)] if at > 2 else []
            lines = [said("data", at)]
            stop = at + 1
            while stop <= len(rows) and size(head + context_rows + lines) < 30 and size(head + context_rows + lines + [said("data", stop)]) <= 60:
                lines.append(said("data", stop))
                stop += 1
            if size(head + context_rows + lines) > 60:
                context_rows = []
            want.append((order, number, at, stop - 1, size(head + context_rows + lines)))
            at, number = stop, number + 1
    assert rows_of(spark, sf, "l11_table_chunks", "l_orderkey", "chunk_index", "first_row", "last_row", "token_count") == sorted(want, key=str)


def test_chunk_sets(spark, sf, texts):
    want = []
    for d, t in texts.items():
        said = source.normalize(t or "")[0]
        spans = list(chunking.text_windows(said))
        if spans:
            items = "\n".join(f"{i}:{a}:{b}:{n}:{s}:{hashlib.sha256(said[a:b].encode()).hexdigest()}" for i, (a, b, n, s) in enumerate(spans, 1))
            want.append((d, len(spans), min(n for *_, n, _ in spans), max(n for *_, n, _ in spans), hashlib.sha256(f"600/700/100/120\n{items}".encode()).hexdigest()))
    assert rows_of(spark, sf, "l13_chunk_sets", "doc_id", "chunks", "min_tokens", "max_tokens", "identity") == sorted(want, key=str)


def plain_audit(text, most=700):
    """The audit by walking over blocks and chunks of one text."""
    said, first, last = source.normalize(text or "")
    chunks = [(a, b) for a, b, _, _ in chunking.text_windows(said)]
    blocks, at = [], 0
    for line in said.split("\n"):
        if line:
            blocks.append([at, at + len(line), line])
        at += len(line) + 1
    for i, b in enumerate(blocks):
        edge = len(blocks) >= 3
        b.append("header" if edge and i == 0 else "footer" if edge and i == len(blocks) - 1 else "image" if re.search("https?://", b[2]) else "heading" if len(b[2]) <= 40 and not re.search(r"[.!?]\s*$", b[2]) else "paragraph")
    holds = [{i for i, (a, b) in enumerate(chunks) if a <= x and y <= b} for x, y, *_ in blocks]
    own = [max((i for i, b in enumerate(blocks) if b[3] == "heading" and b[0] <= a), default=None) for a, _ in chunks]
    out = dict.fromkeys(["paragraphs", "headers", "footers", "images", "paragraphs_kept", "headers_kept", "footers_kept", "images_kept", "contexts", "contexts_kept", "links", "links_kept"], 0)
    for i, (_, _, line, kind) in enumerate(blocks):
        if kind == "heading" or len(pieces(line)) > most:
            continue
        out[f"{kind}s"] += 1
        out[f"{kind}s_kept"] += bool(holds[i])
        if kind == "paragraph":
            heading = max((j for j in range(i) if blocks[j][3] == "heading"), default=None)
            if heading is not None:
                out["contexts"] += 1
                out["contexts_kept"] += bool(holds[i] & holds[heading]) or any(own[c] == heading for c in holds[i])
        if kind == "image":
            near = [max((j for j in range(i) if blocks[j][3] == "paragraph"), default=None), min((j for j in range(i + 1, len(blocks)) if blocks[j][3] == "paragraph"), default=None)]
            for j in near:
                if j is not None:
                    out["links"] += 1
                    out["links_kept"] += any(abs(x - y) <= 1 for x in holds[i] for y in holds[j])
    units = out["paragraphs"] + out["headers"] + out["footers"]
    breaks = units - out["paragraphs_kept"] - out["headers_kept"] - out["footers_kept"]
    return out | {"chunks": len(chunks), "ordered": True, "located": True, "boundary_breaks": breaks, "break_rate": round(breaks / units, 6) if units else None}


def test_full_audit(spark, sf, texts):
    got = {r["doc_id"]: r.asDict() for r in registry.queries()["n05_full_audit"](spark, sf).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        want = plain_audit(t)
        assert {k: got[d][k] for k in want} == want, d


def test_audit_sees_what_is_wrong(spark):
    docs = spark.createDataFrame([(1, "Title line\nHead\nOne paragraph here.\nhttps://x.y\nAnother one here.\nlast line"), (2, None), (None, "x")], "k long, t string")
    chunks = chunking.chunk_sources(docs.filter("k = 1"), "k", "t")
    good = {r["k"]: r for r in audit.audit_structure(docs, chunks, "k", "t").collect()}
    assert set(good) == {1, 2} and good[2]["chunks"] == 0 and good[2]["break_rate"] is None and good[2]["ordered"]
    assert (good[1]["boundary_breaks"], good[1]["contexts_kept"], good[1]["links_kept"], good[1]["located"]) == (0, 2, 2, True)
    for broken, field, value in (
        (chunks.withColumn("char_end", F.col("char_end") - 4), "boundary_breaks", 1),
        (chunks.withColumn("source_end", F.col("source_end") - 4), "located", False),
        (chunks.withColumn("chunk_index", F.lit(2)), "ordered", False),
        (chunks.withColumn("char_start", F.lit(16)), "contexts_kept", 2),
        (chunks.withColumn("char_start", F.lit(30)), "contexts_kept", 1),
        (chunks.withColumn("char_start", F.lit(40)), "links_kept", 0),
    ):
        assert audit.audit_structure(docs, broken, "k", "t").filter("k = 1").first()[field] == value, field


def plain_choice(rows, most_tokens, most_segments):
    """Admission that renders everything anew for each candidate."""

    def rendered(chosen):
        at = {(r.document_id, r.chunk_index): r.body for r in chosen}
        out = []
        for r in chosen:
            text = context.trim(r.body, int(r.overlap_tokens), at.get((r.document_id, r.chunk_index - 1)))
            if not text or text in [t for _, t in out]:
                return None
            out.append((r.chunk_id, text))
        return out

    chosen = []
    for r in rows:
        trial = rendered([*chosen, r]) if r.body not in [c.body for c in chosen] else None
        if trial is not None and len(trial) <= most_segments and sum(chunking.count_tokens(t) for _, t in trial) <= most_tokens:
            chosen.append(r)
    return sorted(rendered(chosen) or [])


@pytest.mark.parametrize("seed", range(60))
def test_admission(seed):
    rng = random.Random(seed)
    rows = []
    for doc in range(3):
        said = [rng.choice("abcd") for _ in range(24)]
        for i in range(6):
            shared = rng.choice([0, 0, 1, 2]) if i else 0
            rows.append({"document_id": doc, "chunk_index": i, "chunk_id": doc * 10 + i, "body": " ".join(said[max(0, i * 3 - shared) : i * 3 + rng.randint(1, 3)]), "overlap_tokens": shared, "role": "anchor", "anchor_rank": 1})
    rng.shuffle(rows)
    frame = pd.DataFrame(rows)
    got = context._choose(1, frame, rng.choice([4, 9, 30]), rng.choice([2, 5, 12]))
    state = random.Random(seed)
    # the same draws as above give the same budgets
    for doc in range(3):
        [state.choice("abcd") for _ in range(24)]
        for i in range(6):
            if i:
                state.choice([0, 0, 1, 2])
            state.randint(1, 3)
    state.shuffle(list(range(len(rows))))
    want = plain_choice(list(frame.itertuples()), state.choice([4, 9, 30]), state.choice([2, 5, 12]))
    assert sorted(zip(got["chunk_id"], got["text"], strict=True)) == want
