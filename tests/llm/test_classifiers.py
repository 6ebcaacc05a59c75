"""Operators 5 and 6: held-out accuracy on made texts, and defined results for odd rows."""

import random
import zlib

import pytest

from quarry.llm import quality, toxicity

INSULTS = ["vile", "fool", "rotten", "beast"]


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for d in range(900):
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 80))]
        toxic, good = d % 6 == 0 and d % 8 != 0, d % 4 != 0
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        if not good:
            w = [x + rng.choice(["%%%", "&&&", "$$$"]) for x in w] if d % 8 else [w[0]] * len(w)
        rows.append((d, " ".join(w), "score", 1))
        if d % 7:
            labels.append((d, int(good), int(toxic)))
    odd = [(10_000, None, "x", 0), (10_001, "", "x", 0), (10_001, "", "x", 0), (None, "vile fool", "x", 0), (10_002, "word " * 20_000, "x", 0)]
    truth = {d: (int(d % 4 != 0), int(d % 6 == 0 and d % 8 != 0)) for d in range(900)}
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score string, k int").repartition(5)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


@pytest.mark.parametrize("module,which", [(toxicity, 1), (quality, 0)])
def test_held_out_accuracy(spark, world, module, which):
    docs, labels, truth = world
    rows = module.score(docs, module.train(spark, docs, labels)).collect()
    assert len(rows) == docs.count()
    cut = 0.5 if which else 0.3
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)
        assert r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"]))
    some = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    right = sum(r["predicted"] == truth[r["doc_id"]][which] for r in some)
    assert right / len(some) > 0.95


@pytest.mark.parametrize("module", [toxicity, quality])
def test_held_out_labels_are_not_used(spark, world, module):
    docs, labels, _ = world
    column = "toxic" if module is toxicity else "quality"
    spoiled = [(r["doc_id"], 1 - r[column] if held(r["doc_id"]) else r[column]) for r in labels.collect()]
    other = spark.createDataFrame(spoiled, f"doc_id long, {column} int")
    one = module.score(docs, module.train(spark, docs, labels)).collect()
    two = module.score(docs, module.train(spark, docs, other)).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))


@pytest.mark.parametrize("module", [toxicity, quality])
def test_empty_tables(spark, world, no_docs, module):
    docs, labels, _ = world
    assert module.score(no_docs, module.train(spark, no_docs, labels)).count() == 0
    rows = module.score(docs, module.train(spark, docs, labels.limit(0))).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_quality_stage_keeps_columns(spark, world):
    docs, labels, _ = world
    model = quality.train(spark, docs, labels)
    kept = quality.score(docs, model, keep=True)
    assert kept.schema == docs.schema
    want = {r["doc_id"] for r in quality.score(docs, model).collect() if r["predicted"]}
    assert {r["doc_id"] for r in kept.collect()} == want


def test_quality_scores_follow_the_sizes(spark, world):
    """Every score against plain compression with the two dictionaries."""
    import math

    import numpy as np
    import zstandard as z

    docs, labels, _ = world
    model = quality.train(spark, docs, labels)
    packers = [z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(x), write_content_size=False, write_dict_id=False) for x in (model.good, model.bad)]
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality.score(docs, model).collect():
        t = (texts[r["doc_id"]] or "").encode()
        n, g, b = len(t) + 1, *(len(p.compress(t)) + 1 for p in packers)
        d, e = (g - b) / n, (g - b) / (g + b)
        x = [d, e, *(max(d - k, 0) for k in model.knots[:, 0]), *(max(e - k, 0) for k in model.knots[:, 1])]
        x += [v * f for f in (math.log(n),) for v in (d, e, abs(d), abs(e))] + [v * min(g, b) / n for v in (d, e)]
        at = float(np.dot((np.array(x) - model.mean) / model.scale, model.weights[:-1]) + model.weights[-1])
        assert r["score"] == pytest.approx(0.0 if not t else 1 / (1 + math.exp(-max(-30, min(30, at)))), abs=1e-9)


def test_equal_differences_score_alike():
    import numpy as np

    sizes = np.array([[1000, 300, 250], [1000, 300, 250], [2000, 300, 250]])
    knots = quality.knots_of(np.array([[100, 50, 40], [100, 40, 50], [300, 80, 80]]))
    a, b, c = quality.describe(sizes, knots)
    assert (a == b).all() and not (a == c).all()
    same = quality.describe(np.array([[500, 90, 90], [9000, 700, 700]]), knots)
    assert np.allclose(same[0], same[1])  # no difference: length and compressibility say nothing


def test_fit_lowers_the_non_negative_risk():
    import numpy as np

    rng = np.random.default_rng(3)
    words = np.arange(1, 9, dtype=np.uint64)
    draw = lambda toxic: np.flatnonzero(rng.random(8) < ([0.8, 0.6, 0.3, 0.3, 0.3, 0.3, 0.3, 0.3] if toxic else [0.05, 0.05, 0.3, 0.3, 0.3, 0.3, 0.3, 0.3])).astype(np.uint64) + 1
    p, u = [draw(True) for _ in range(200)], [draw(i < 60) for i in range(300)]

    def risk(model):
        z = lambda rows: np.array([model.bias + sum(model.weights[int(w) - 1] for w in r) for r in rows])
        zp, zu = z(p), z(u)
        plus, minus = lambda x: np.log1p(np.exp(-x)).mean(), lambda x: np.log1p(np.exp(x)).mean()
        return 0.2 * plus(zp) + max(0.0, minus(zu) - 0.2 * minus(zp))

    start = toxicity.Model(words, np.zeros(8), float(np.log(0.2 / 0.8)))
    fitted = toxicity.fit(words, p, u, 0.2)
    assert risk(fitted) < 0.8 * risk(start)
    assert fitted.weights[:2].min() > fitted.weights[2:].max()


def test_samples_agree_between_runs(spark):
    """By hash of the key columns: the same rows from other partitions, of repeated keys some and not all."""
    from quarry.llm import _sample

    frame = spark.createDataFrame([(None if i % 3 else i, f"text {i}") for i in range(6000)], "k long, t string")
    runs = [sorted(r["t"] for r in _sample.pick(frame.repartition(n), ["k", "t"], 600, 5).collect()) for n in (2, 7)]
    assert runs[0] == runs[1] and 450 < len(runs[0]) < 750
    assert _sample.pick(frame, "k", 6000, 5).count() == 6000


def test_quality_fits_the_same_from_other_partitions(spark, world):
    docs, labels, _ = world
    one, two = (quality.train(spark, d, labels) for d in (docs, docs.repartition(3)))
    assert one.good == two.good and one.bad == two.bad and (one.weights == two.weights).all()


def test_quality_keeps_to_its_bound_of_bytes(spark, world, monkeypatch):
    docs, labels, _ = world
    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, curve, prior: seen.append((texts, curve)) or quality.Model(b"", b"", quality.np.zeros(0), quality.np.zeros((0, 2)), quality.np.zeros(0), quality.np.zeros(0), prior))
    quality.train(spark, docs, labels, dictionary_bytes=16_000)
    texts, curve = seen[0]
    for y in (0, 1):
        assert 12_000 < sum(map(len, texts[y])) <= 16_000
        assert 12_000 < sum(len(t) for t, label in curve if label == y) <= 16_000
