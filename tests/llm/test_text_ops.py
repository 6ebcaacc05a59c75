"""Operators 1, 2, 3 and 7 against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import _bpe, mixing, substring_dedup, token_counts, token_output

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@given(st.lists(st.text(alphabet=st.sampled_from("'st mdrevl \n\t.aZé1²! \u0085中😀<|>"), max_size=30), max_size=8))
@settings(max_examples=150, deadline=None)
def test_coder_equals_the_library(texts):
    import pyarrow as pa

    coder = _bpe.Coder(PATH)
    want = [e.ids for e in coder.library.encode_batch(texts, add_special_tokens=False)]
    n, ids = coder.encode(pa.array(texts, pa.string()))
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


@given(st.lists(st.text(max_size=40), max_size=8))
@settings(max_examples=200, deadline=None)
def test_coder_equals_the_library_on_any_characters(texts):
    import pyarrow as pa

    coder = _bpe.Coder(PATH)
    want = [e.ids for e in coder.library.encode_batch(texts, add_special_tokens=False)]
    n, ids = coder.encode(pa.array(texts, pa.string()))
    assert n.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_no_script_goes_to_the_library_whole(library, monkeypatch):
    import pyarrow as pa

    texts = ["中文的句子，没有空格。", "Ελληνικά и кириллица", "हिन्दी ١٢٣ 한국어", "quotes \u201cso\u201d \u2014 and 😀👍🏽", "", "plain's"]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    monkeypatch.setattr(_bpe.Coder, "_whole", None)
    for known in (None, _bpe.whole_tokens(PATH)):
        assert _bpe.Coder(PATH, ids=False, known=known).encode(pa.array(texts))[0].tolist() == want


def test_characters_the_proof_cannot_place_go_to_the_library(library):
    import pyarrow as pa

    odd = chr(0x558)  # stands for one that the two sides class differently
    kinds = _bpe.Classes(PATH)
    kinds.table[ord(odd)] = _bpe.FOREIGN
    coder = _bpe.Coder(PATH)
    coder.classes = kinds
    texts = ["before it", f"a {odd} b{odd}", "中 after it", f"{odd}", None]
    assert coder.encode(pa.array(texts))[1].tolist() == [i for t in texts for i in library.encode(t or "", add_special_tokens=False).ids]


def test_kept_ids_are_bounded(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(_bpe, "MOST_IDS", 50)
    monkeypatch.setattr(_bpe, "PIECE", 64)
    coder, texts = _bpe.Coder(PATH), [f"数据{i}的处理 word{i}" for i in range(60)] * 2
    assert coder.encode(pa.array(texts))[1].tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]
    assert coder.used < 200


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_files_go_to_the_library(name, texts):
    import pyarrow as pa

    coder = _bpe.Coder(public_tokenizers.path(name))
    want = [e.ids for e in coder.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert coder.encode(pa.array(texts, pa.string()))[1].tolist() == [i for w in want for i in w]


def test_token_counts(docs, no_docs, library):
    got = sorted(tuple(r) for r in token_counts.token_counts(docs, PATH).collect())
    want = sorted((d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for d, t in rows_of(docs))
    assert got == want
    assert token_counts.token_counts(no_docs, PATH).count() == 0


def test_whole_tokens_are_proven(library):
    """A vocabulary string is in the table just when the library gives it back as one token."""
    import numpy as np

    from quarry.llm import _bytes as B

    known = _bpe.whole_tokens(PATH)
    assert len(known) > 50_000 and (known[1:] > known[:-1]).all()
    back = {c: b for b, c in _bpe.Coder(PATH).letters.items()}
    entries = [s for s in library.get_vocab(with_added_tokens=False) if all(c in back for c in s)]
    raw = [bytes(back[c] for c in s) for s in entries]
    off = np.cumsum([0, *map(len, raw)])
    found = np.isin(B.span_hash(np.frombuffer(b"".join(raw), np.uint8), off[:-1], off[1:]), known)
    assert found.tolist() == [len(library.model.tokenize(s)) == 1 for s in entries]


def test_token_output_round_trip(spark, docs, no_docs, library, tmp_path):
    out = f"file://{tmp_path}/tokens"
    got = {(r["start"], r["doc_id"]): r for r in token_output.token_digests(spark, docs, PATH, out).collect()}
    start, stream = 0, []
    for d, t in sorted(rows_of(docs), key=lambda r: (r[0], len((r[1] or "").encode()))):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        row = got[(start, d)]
        assert row["n_tokens"] == len(ids)
        assert row["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        start += len(ids)
        stream += ids
    assert len(got) == docs.count()
    span = token_output.read_span(spark, out, 500, 1200).orderBy("start").collect()
    assert [i for r in span for i in r["ids"]] == stream[500:1700]
    assert token_output.token_digests(spark, no_docs, PATH).count() == 0


def test_token_files_are_dictionary_encoded_with_page_indexes(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    token_output.write_tokens(spark, docs, f"file://{tmp_path}/t", PATH)
    files = sorted(tmp_path.glob("t/*.parquet"))
    last = None
    for f in files:
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            ids = next(v for k, v in columns.items() if k.startswith("ids"))
            assert any("DICTIONARY" in e or "DELTA" in e for e in ids.encodings)
            assert ids.has_offset_index and ids.has_column_index
            assert last is None or columns["doc_id"].statistics.min >= last
            last = columns["doc_id"].statistics.max


@pytest.mark.parametrize("hot", [None, 7])
def test_token_output_spreads_a_key_of_many_rows(spark, library, monkeypatch, hot, tmp_path):
    from quarry.llm import _store

    monkeypatch.setattr(_store, "HOT_LEAST", 10)
    rows = [(hot, f"row {i} " * (i % 13)) for i in range(400)] + [(i, f"other {i}") for i in range(60)] + [(hot, None), (hot, "")]
    docs, out = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), f"file://{tmp_path}/t"
    got = sorted(tuple(r) for r in token_output.token_digests(spark, docs, PATH, out).select("start", "doc_id", "n_tokens", "ids_crc32").collect())
    coded = lambda t: [*library.encode(t or "", add_special_tokens=False).ids, 0]
    digest = lambda ids: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
    assert sorted((str(d), n, c) for _, d, n, c in got) == sorted((str(d), len(x := coded(t)), digest(x)) for d, t in rows)
    keys = [-1 if d is None else d for _, d, _, _ in got]
    assert keys == sorted(keys)
    start = 0
    for at, _, n, _ in got:
        assert at == start
        start += n
    parts = spark.read.parquet(out).groupBy(F.col("doc_id").eqNullSafe(F.lit(hot)).alias("hot"), "part").count().filter("hot").collect()
    assert len(parts) > 3 and max(r["count"] for r in parts) < 200


def brute_repeats(rows, width):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0, r[1] is None, r[1] or ""))
    seen, out = set(), []
    for d, t in rows:
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            if w in seen:
                gone[i : i + width] = [True] * width
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("width", [3, 20])
def test_substring_dedup(spark, docs, no_docs, width):
    got = substring_dedup.remove_repeats(spark, docs, width)
    rows = got.collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows) == brute_repeats(rows_of(docs), width)
    for r in rows:
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]
        assert all(0 <= s["start"] < s["end"] <= r["n_words"] for s in r["removed"])
    assert substring_dedup.remove_repeats(spark, no_docs, width).count() == 0


def test_substring_dedup_sends_the_texts_once(spark, docs):
    rows = substring_dedup.remove_repeats(spark, docs)
    rows.collect()
    assert "ReusedExchange" in rows._jdf.queryExecution().executedPlan().toString() or "ReusedExchange" in rows._jdf.queryExecution().toString()


def test_packed_hashes_come_back():
    import numpy as np

    x = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    assert (substring_dedup.unpack(substring_dedup.pack(x)) == x).all()
    assert (substring_dedup.unpack(substring_dedup.pack(x[:1])) == x[:1]).all()


def test_mixing(spark, docs, no_docs):
    rows = mixing.mix_sources(docs).collect()
    assert sorted((r["doc_id"], r["size"]) for r in rows) == sorted((d, len(WORD.findall(t or ""))) for d, t in rows_of(docs))
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[(r["source_size"], r["target"])].append(r)
    total = sum(r["size"] for r in rows)
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    for (size, target), members in by.items():
        assert target <= 2 * size
        assert abs(sum(r["taken"] for r in members) - target) <= 2 * max(r["size"] for r in members)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    assert mixing.mix_sources(no_docs).count() == 0


def brute_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        rate = (budget - sum(target.values())) / sum(w[s] for s in free)
        over = {s for s in free if rate * w[s] > most * sizes[s]}
        if not over:
            return target | {s: rate * w[s] for s in free}
        target |= {s: most * sizes[s] for s in over}
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, None: 5}, {"a": 1}, {"x": 0, "y": 7}, {"a": 100, "b": 100, "c": 100, "d": 3}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(frame, (3, 1, 2), 1.5, 2.0).collect()}
    want = brute_targets(sizes, (3, 1, 2), 1.5, 2.0)
    assert got == pytest.approx(want)


def test_mixing_stays_native(docs):
    plan = mixing.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
