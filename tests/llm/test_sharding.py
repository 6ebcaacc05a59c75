"""Operator 11 against its laws and against plain differencing."""

import heapq
import random
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import sharding


def plain_difference(sizes, shards):
    """The spread that Karmarkar-Karp leaves, with tuples written out in full."""
    heap = [(-s, n, [s] + [0] * (shards - 1)) for n, s in enumerate(sizes)]
    if shards == 1:
        return 0
    heapq.heapify(heap)
    while len(heap) > 1:
        _, n, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        both = sorted((x + y for x, y in zip(sorted(a, reverse=True), sorted(b), strict=True)), reverse=True)
        heapq.heappush(heap, (both[-1] - both[0], n, both))
    return heap[0][2][0] - heap[0][2][-1]


@given(st.lists(st.integers(1, 60), min_size=1, max_size=40), st.integers(1, 7))
@settings(max_examples=200, deadline=None)
def test_difference(sizes, shards):
    bins = sharding.difference(sizes, shards)
    sums = Counter({b: 0 for b in range(shards)})
    for b, s in zip(bins, sizes, strict=True):
        sums[b] += s
    assert len(sums) == shards and len(bins) == len(sizes)
    spread = max(sums.values()) - min(sums.values())
    assert spread <= max(sizes)
    assert spread == plain_difference(sizes, shards)


def test_difference_known():
    bins = sharding.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sum(s for s, b in zip([8, 7, 6, 5, 4], bins, strict=True) if b == x) for x in (0, 1)) == [14, 16]
    assert sharding.difference([], 3) == []
    assert len(set(sharding.difference([5] * 12, 4))) == 4


def law_holds(rows, source, shards, overhead):
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is not None) == sorted((d, len((t or "").encode()) + overhead, zlib.crc32((t or "").encode())) for d, t in source if d is not None)
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append((r["slot"], r["doc_id"]))
    for held in slots.values():
        held.sort()
        assert [s for s, _ in held] == list(range(len(held)))
        ids = [(d is not None, d or 0) for _, d in held]
        assert ids == sorted(ids)
    assert set(slots) <= set(range(shards))
    where = defaultdict(set)
    for r in rows:
        where[(r["text_crc32"], r["size"])].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


@pytest.mark.parametrize(("top", "fine"), [(8192, 16384), (64, 8), (64, 0)])
def test_shard(spark, docs, texts, top, fine):
    got = sharding.shard(spark, docs, 5, 16, top, fine).collect()
    source = [(r["doc_id"], r["text"]) for r in docs.collect()]
    law_holds(got, source, 5, 16)
    again = sharding.shard(spark, docs.repartition(7), 5, 16, top, fine).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_many_groups_are_near_equal(spark):
    rng = random.Random(5)
    texts = ["w" * int(rng.paretovariate(1.2) * 20) + str(i) for i in range(20000)]
    texts = [t[-9000:] for t in texts]
    rows = [(i, rng.choice(texts) if i % 3 else texts[i % 50]) for i in range(30000)] + [(None, None)] * 500 + [(7, "same")] * 1500
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.shard(spark, docs, 8, 16, 512, 2000).collect()
    law_holds(got, rows, 8, 16)
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    assert len(sums) == 8 and max(sums.values()) - min(sums.values()) <= 0.001 * sum(sums.values()) / 8


def test_a_group_above_its_share_stays_whole(spark):
    rows = [(i, "copy of one text" if i % 2 else f"text {i}") for i in range(2000)]
    got = sharding.shard(spark, spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    law_holds(got, rows, 8, 16)
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    big = {r["shard"] for r in got if r["doc_id"] % 2}
    rest = [s for x, s in sums.items() if x not in big]
    assert len(big) == 1 and len(rest) == 7 and max(rest) - min(rest) <= 25  # the largest of the others


def test_write_shards(spark, docs, tmp_path):
    path = f"file://{tmp_path}/shards"
    clashing = docs.withColumnsRenamed({"batch": "shard", "k": "slot"})
    sharding.write_shards(spark, clashing, path, 3)
    back = spark.read.parquet(path)
    assert set(clashing.columns) <= set(back.columns)
    assert sorted(map(str, back.select(*clashing.columns).collect())) == sorted(map(str, clashing.collect()))
    for s in range(3):
        slots = sorted(r["_slot"] for r in spark.read.parquet(f"{path}/_shard={s}").collect())
        assert slots == list(range(len(slots)))


def test_empty(spark, no_docs):
    assert sharding.shard(spark, no_docs).count() == 0
