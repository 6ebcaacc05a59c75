"""Operator 5: toxicity by non-negative positive-unlabelled learning (numpy logistic model).

Confirmed toxic rows are the positives P, a sample of all training texts is the unlabelled set U.
With class prior p, the risk is p E_P[l(+)] + max(0, E_U[l(-)] - p E_P[l(-)]); where the bracket
turns negative its gradient is ascended instead, as the non-negative estimator prescribes. p is
the share of toxic rows among labelled training rows.

Features are the distinct words of the whole text (letters and digits, A-Z lower-cased), hashed to
64 bits; the model keeps the `most` words whose frequency in P differs most from that in U.
Fitting uses at most `positives` and `unlabelled` rows (documented bounds, chosen by a hash of the
key); scoring is one pass over all texts, without a shuffle. Null and empty texts get the score of
a text without known words; rows with equal keys are scored each; a document labelled both toxic and not
counts as toxic; without any confirmed toxic row all scores are the prior; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import _bytes as B
from quarry.llm import _sample, _store
from quarry.session import spread


@dataclass
class Model:
    words: np.ndarray
    weights: np.ndarray
    bias: float


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, word hash) pairs of a batch, in order."""
    data, off = B.flat(column)
    rows, words = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for i, j in B.pieces(off):
        part = B.lower(data[off[i] : off[j]])
        begin, end, first = B.words(part, off[i : j + 1] - off[i], B.PLAIN)
        rows.append(np.repeat(np.arange(i, j), np.diff(first)))
        words.append(B.span_hash(part, begin, end))
    return np.concatenate(rows), np.concatenate(words)


def _matrix(model_words: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    x = np.zeros((len(lists), len(model_words)), np.float32)
    for r, w in enumerate(lists):
        at = np.minimum(np.searchsorted(model_words, w), len(model_words) - 1)
        x[r, at[model_words[at] == w]] = 1
    return x


def choose(samples: DataFrame, sizes: tuple[int, int], most: int, least: int = 4, sure: float = 4.0) -> np.ndarray:
    """The words whose document frequencies differ most, in standard errors; counted in Spark, at most `most` come back.

    samples: positive (boolean), w (distinct words of a text); sizes: texts in P and in U.
    """
    p, u = sizes
    words = samples.select("positive", F.explode("w").alias("word")).groupBy("word").agg(F.count_if("positive").alias("a"), F.count_if(~F.col("positive")).alias("b")).filter(F.col("a") + F.col("b") >= least)
    both = (F.col("a") + F.col("b")) / (p + u)
    z = F.abs(F.col("a") / p - F.col("b") / u) / F.sqrt(both * (1 - both) * (1 / p + 1 / u) + 1e-12)
    top = words.withColumn("z", z).filter(F.col("z") >= sure).orderBy(F.desc("z"), "word").limit(most)
    return np.sort(np.array([r["word"] for r in top.collect()], np.int64).view(np.uint64))


def fit(words: np.ndarray, p: list[np.ndarray], u: list[np.ndarray], prior: float, steps: int = 600, rate: float = 0.05, ridge: float = 2e-5) -> Model:
    prior = min(max(prior, 1e-4), 0.9)
    base = float(np.log(prior / (1 - prior)))
    if not (len(words) and p and u):
        return Model(words, np.zeros(0), base)
    xp, xu = _matrix(words, p), _matrix(words, u)
    w, bias = np.zeros(len(words), np.float32), base
    moment, spread = np.zeros(len(words) + 1), np.zeros(len(words) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        sp, su = sigmoid(xp @ w + bias), sigmoid(xu @ w + bias)
        negative = np.mean(-np.log1p(-np.minimum(su, 1 - 1e-9))) - prior * np.mean(-np.log1p(-np.minimum(sp, 1 - 1e-9)))
        sp, su = sp.astype(np.float32), su.astype(np.float32)
        plus = prior * (sp - 1) / len(p)  # gradient of p E_P[l(+)]
        minus_u, minus_p = su / len(u), -prior * sp / len(p)  # of E_U[l(-)] - p E_P[l(-)]
        gp, gu = (plus + minus_p, minus_u) if negative >= 0 else (-minus_p, -minus_u)
        grad = np.append(xp.T @ gp + xu.T @ gu + ridge * w, gp.sum() + gu.sum())
        moment = 0.9 * moment + 0.1 * grad
        spread = 0.99 * spread + 0.01 * grad**2
        step = rate * (moment / (1 - 0.9**t)) / (np.sqrt(spread / (1 - 0.99**t)) + 1e-9)
        w -= step[:-1].astype(np.float32)
        bias -= step[-1]
    return Model(words, w, float(bias))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 8000, most: int = 256, seed: int = 5, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    _store.ship(spark)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).filter(F.col("k").isNotNull() & ~_sample.held_out(key if key == "k" else "k"))
    known = labels.select(F.col(key).cast("long").alias("k"), F.col(label).alias("y")).filter(F.col("k").isNotNull() & F.col("y").isNotNull() & ~_sample.held_out("k"))
    prior = known.agg(F.avg(F.col("y").cast("double")).alias("p")).first()["p"] or 0.0
    sure = _sample.pick(known.filter("y = 1").select("k").distinct(), "k", positives, seed)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, word = features(batch.column(1))
            cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
            lists = [np.unique(word[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.view(np.int64) for x in lists], pa.list_(pa.int64()))], ["k", "w"])

    # `sure` is bounded by the sample's size, so it may be broadcast.
    p = rows.join(F.broadcast(sure), "k", "left_semi").mapInArrow(describe, "k long, w array<long>")
    u = _sample.pick(rows, ["k", "t"], unlabelled, seed + 1).mapInArrow(describe, "k long, w array<long>")
    # copies of one text would count as many; by content, each stands once
    both = p.withColumn("positive", F.lit(True)).unionByName(u.withColumn("positive", F.lit(False)))
    samples = _store.cut(spark, both.withColumn("h", F.xxhash64("w")).dropDuplicates(["positive", "h"]).select("positive", "h", "w"))
    sizes = {r["positive"]: r["n"] for r in samples.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if not (sizes.get(True) and sizes.get(False)):
        return fit(np.zeros(0, np.uint64), [], [], prior)
    words = choose(samples, (sizes[True], sizes[False]), most)
    known = F.array(*[F.lit(int(w)) for w in words.view(np.int64)]).cast("array<long>")
    marked = samples.select("positive", "h", F.array_intersect("w", known).alias("w")).orderBy("positive", "h").collect()
    lists: dict[bool, list[np.ndarray]] = {True: [], False: []}
    for r in marked:
        lists[r["positive"]].append(np.array(r["w"], np.int64).view(np.uint64))
    return fit(words, lists[True], lists[False], prior)


def score(docs: DataFrame, model: Model, cut: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score, predicted of each row."""
    _store.ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, word = features(batch.column(1))
            z = np.full(batch.num_rows, model.bias)
            if len(model.words) and len(word):
                at = np.minimum(np.searchsorted(model.words, word), len(model.words) - 1)
                hit = np.flatnonzero(model.words[at] == word)
                pair = np.unique(row[hit] * len(model.words) + at[hit])
                np.add.at(z, pair // len(model.words), model.weights[pair % len(model.words)])
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= cut).astype(np.int32))], ["k", "score", "predicted"])

    rows = spread(docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))).mapInArrow(_store.lean(run), f"k {kind}, score double, predicted int")
    return rows.select(F.col("k").alias(key), _sample.held_out("k").alias("held_out"), "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_toxicity": query}
ORACLES: dict[str, str] = {}
