"""The pipeline against a plain version of each stage on the smallest tables."""

import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import mixing, quality
from tests.llm.test_decontamination import brute as brute_leaks
from tests.llm.test_near_dedup import brute as brute_near

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (_, f) in enumerate(pipeline.STAGES):
        before = docs
        path = f"file://{tmp_path_factory.mktemp('stage')}/{i}"
        f(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((before, docs))
    return out


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_quality(spark, sf, stages):
    before, after = stages[0]
    model = quality.train(spark, before, spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids(after) == sorted(r["doc_id"] for r in quality.score(before, model).collect() if r["score"] >= 0.3)


def test_near(stages):
    before, after = stages[1]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert ids(after) == [d for d, _, _, kept in brute_near(rows, 80) if kept]


def test_leaks(spark, sf, stages):
    before, after = stages[2]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    shared = {w for _, t in bench for w in t.lower().split()}
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    some = [(d, t) for d, t in rows if len(shared & set((t or "").lower().split())) > 8 and len(t) < 3000]
    want = brute_leaks(some[:25], bench)
    kept = set(ids(after))
    assert all((d in kept) == (not w) for d, w in want.items())
    assert len(kept) < len(rows)


def test_mix(stages):
    before, after = stages[3]
    want = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(before).collect()}
    got = defaultdict(int)
    for d in ids(after):
        got[d] += 1
    assert dict(got) == {d: c for d, c in want.items() if c}
    assert after.columns == before.columns


def test_mix_null_and_repeated_ids(spark, stages):
    rows = [(None if i % 3 == 0 else i % 4, " ".join(["w"] * (i % 5 + 1)), "en", "ab"[i % 2], i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want, got = defaultdict(int), defaultdict(int)
    for r in mixing.mix_sources(docs).collect():
        want[r["doc_id"]] += r["copies"]
    often = defaultdict(int)
    for r in pipeline.mix_sources(spark, docs, "").collect():
        got[r["doc_id"]] += 1
        often[r["n_chars"]] += 1
    assert got == {d: c for d, c in want.items() if c}
    assert got[None] > 0 and max(often.values()) <= 2


def test_tokens(stages):
    before, after = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in after.collect())
    start = 0
    for (s, d, n, crc), (e, t) in zip(got, sorted((r["doc_id"], r["text"]) for r in before.collect()), strict=True):
        x = [*library.encode(t, add_special_tokens=False).ids, 0]
        assert (s, d, n, crc) == (start, e, len(x), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x)))
        start += len(x)


def test_run_is_the_stages(spark, sf, stages):
    assert sorted(map(tuple, pipeline.run(spark, sf).collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_stages_on_odd_rows(spark, sf):
    """Null and repeated ids, null and empty texts, clashing extra columns, empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, k long, h string, t string, copies int"
    same = " ".join(f"word{i}" for i in range(40))
    rows = [(1, same), (2, same), (2, "quite another text that stands alone here today"), (3, same + " more"), (None, same), (4, None), (5, ""), (6, "six words are in this one"), (6, "six words are in this one")]
    docs = spark.createDataFrame([(d, x, "en", "a", len(x or ""), 7, "h", "t", 9) for d, x in rows], schema)
    kept = pipeline.drop_near_duplicates(spark, docs, sf)
    assert kept.columns == docs.columns
    want = [(1, same), (2, rows[2][1]), (None, same), (4, None), (5, ""), (6, rows[7][1]), (6, rows[7][1])]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in kept.collect()))) == sorted(map(str, want))
    clean = pipeline.drop_benchmark_leaks(spark, docs, sf)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    mixed = pipeline.mix_sources(spark, docs, sf)
    assert mixed.columns == docs.columns and {r["copies"] for r in mixed.collect()} == {9}
    assert pipeline.filter_quality(spark, docs, sf).columns == docs.columns
    assert pipeline.write_tokens(spark, docs, sf).count() == len(rows)
    none = docs.limit(0)
    for _, f in pipeline.STAGES:
        assert f(spark, none, sf).count() == 0
