"""Versioned state over batches and restarts."""

import datetime as dt
import hashlib

from quarry.streaming import versions

DAY = dt.datetime(2024, 1, 1)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_decisions():
    assert versions.decide(None, 0, "a", DAY) == ("accepted", 1, sha("a"))
    held = (1, sha("a"), DAY)
    assert versions.decide(held, 0, "b", DAY) == ("conflict", 1, sha("a"))
    assert versions.decide(held, 0, "a", DAY) == ("repeated", 1, sha("a"))
    assert versions.decide(held, 1, "b", DAY - dt.timedelta(1)) == ("late", 1, sha("a"))
    assert versions.decide(held, 1, "a", DAY) == ("accepted", 2, sha("a"))
    for bad in ((None, "a", DAY), (1, None, DAY), (1, "a", None), (-1, "a", DAY)):
        assert versions.decide(held, *bad) == ("invalid", 1, sha("a"))


def test_a_stale_version_is_refused_after_a_restart(spark, tmp_path):
    folder, out, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))

    def send(rows):
        spark.createDataFrame([(k, s, e, t, DAY + dt.timedelta(d)) for k, s, e, t, d in rows], versions.UPDATES).coalesce(1).write.mode("append").parquet(folder)
        versions.run(spark, folder, out, checkpoint)

    send([(1, 2, 1, "b", 1), (1, 1, 0, "a", 0), (2, 3, 0, "x", 0), (None, 4, 0, "x", 0)])
    send([(1, 5, 1, "late writer", 2), (1, 6, 2, "c", 2), (2, 7, 0, "x", 3), (2, 8, 1, "y", -1), (3, 9, 4, "z", 0)])
    got = {r["seq"]: (r["key"], r["status"], r["version"]) for r in spark.read.parquet(out).collect()}
    assert got == {
        1: (1, "accepted", 1), 2: (1, "accepted", 2), 3: (2, "accepted", 1), 5: (1, "conflict", 2), 6: (1, "accepted", 3),
        7: (2, "repeated", 1), 8: (2, "late", 1), 9: (3, "conflict", 0),
    }
    assert sorted(tuple(r) for r in versions.latest(spark.read.parquet(out)).collect()) == [(1, 3, sha("c")), (2, 1, sha("x"))]
