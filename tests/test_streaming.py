"""Streams over the event table."""

from pyspark.sql import functions as F

from quarry.streaming import events


def folder(sf, tmp_path):
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{sf}/events.parquet")
    half = rows.num_rows // 2
    pq.write_table(rows.slice(0, half), tmp_path / "a.parquet")
    pq.write_table(rows.slice(half), tmp_path / "b.parquet")
    return str(tmp_path)


def drain(query):
    query.awaitTermination(120)
    query.stop()


def test_push_and_state(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    source, seen, states = folder(sf, tmp_path / "in"), [], []
    drain(events.push(events.events(spark, source), lambda b, n: seen.append((n, b.count())), f"file://{tmp_path}/c1"))
    total = spark.read.parquet(f"{sf}/events.parquet").count()
    assert len(seen) == 2 and sum(n for _, n in seen) == total
    drain(events.latest_state(events.events(spark, source), lambda b: states.extend(b.collect()), f"file://{tmp_path}/c2"))
    final = {}
    for r in states:
        final[r["user_id"]] = max(final.get(r["user_id"], (-1, "")), (r["version"], r["state"]))
    want = spark.read.parquet(f"{sf}/events.parquet").groupBy("user_id").agg(F.max("event_id").alias("v"), F.max_by("event_type", "event_id").alias("s"))
    assert final == {r["user_id"]: (r["v"], r["s"]) for r in want.collect()}


def test_once_and_windows(spark, sf, tmp_path):
    (tmp_path / "in").mkdir()
    source = folder(sf, tmp_path / "in")
    rows = spark.read.parquet(f"{sf}/events.parquet")
    q = events.once(events.events(spark, source, 2), "event_id", "90 days").writeStream.format("memory").queryName("once_t").trigger(availableNow=True).start()
    drain(q)
    assert spark.table("once_t").count() == rows.count()
    q = events.windowed(events.events(spark, source, 2), "1 day", "90 days").writeStream.outputMode("complete").format("memory").queryName("win_t").trigger(availableNow=True).start()
    drain(q)
    want = rows.groupBy(F.date_trunc("day", "ts").alias("d"), "event_type").count().count()
    assert spark.table("win_t").count() == want
