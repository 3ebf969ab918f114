"""Streams over several files: what comes out does not depend on the order of arrival."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from intentloom.streaming import streams

START = datetime(2024, 1, 1)


def sights(times, hours):
    out = []
    for t in sorted(times):
        if not out or t >= out[-1] + timedelta(hours=hours):
            out.append(t)
    return out


def test_first_sights_over_files_out_of_order(spark, tmp_path):
    rng = random.Random(4)
    events = [(rng.choice("abc"), START + timedelta(minutes=rng.randrange(6 * 24 * 60))) for _ in range(300)] + [("late", START), ("late", START + timedelta(hours=10)), ("late", START + timedelta(hours=9, minutes=59))]
    events += [("end", START + timedelta(days=9)), ("a", None)]
    part = lambda t: min(5, (t - START).days if t else 0)
    files = [[] for _ in range(6)]
    for k, t in events:  # a third of the events of a day's last hours come with the next file
        later = t and t.hour >= 16 and rng.random() < 0.3
        files[min(5, part(t) + bool(later))].append((k, t))
    for rows in files:
        rng.shuffle(rows)
        spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = streams.run_to_table(streams.stream_first_sights(raw, ["k"], horizon="10 hours", late="12 hours"), str(tmp_path / "out"), str(tmp_path / "cp"))
    closed = START + timedelta(days=9) - timedelta(hours=12)
    want = {(k, t) for k in {e[0] for e in events} for t in sights([t for x, t in events if x == k and t and t < closed], 10)}
    assert {(r.k, r.ts) for r in found.collect()} == want and found.count() == len(want)


def test_dedup_forgets_keys_after_the_horizon(spark, tmp_path):
    """Keys return once the watermark of an earlier batch has passed their horizon, and not before: that is when Spark drops their state."""
    days = [[("a", 0), ("b", 0)], [("a", 1), ("c", 30)], [("a", 31), ("b", 58)], [("b", 70), ("a", 90)], [("c", 200)], [("a", 201), ("c", 205)]]
    for rows in days:
        spark.createDataFrame([(k, START + timedelta(hours=h)) for k, h in rows], "k string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = streams.run_to_table(streams.stream_dedup(raw, ["k"], horizon="24 hours").select("k", F.date_diff("ts", F.lit(START)).alias("day"), (F.unix_seconds("ts")).alias("s")), str(tmp_path / "out"), str(tmp_path / "cp"))
    hours = sorted((r.k, (r.s - int((START - datetime(1970, 1, 1)).total_seconds())) // 3600) for r in found.collect())
    assert hours == [("a", 0), ("a", 201), ("b", 0), ("c", 30), ("c", 205)]


def test_first_sights_call_by_bucket_and_keep_keys(spark, tmp_path):
    """Some 3,000 keys take a group of state per bucket, not one each; keys of numbers beyond 2**53 and nulls come back as they were."""
    big = 1 << 60
    day = lambda d: F.timestamp_seconds(F.lit(1704067200 + d * 86400))
    for d in range(3):
        rows = spark.range(3_000).select(F.when(F.col("id") > 0, F.col("id") + big).alias("k"), F.when(F.col("id") % 2 == 0, F.lit('a "b"\n')).alias("s"), day(d * 2).alias("ts"))
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema("k long, s string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = streams.run_to_table(streams.stream_first_sights(raw, ["k", "s"], horizon="3 days", buckets=8), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {tuple(r) for r in found.select("k", "s").collect()}
    assert got == {(None if i == 0 else big + i, 'a "b"\n' if i % 2 == 0 else None) for i in range(3_000)} and found.count() == 3_000
    state = spark.read.format("statestore").load(str(tmp_path / "cp"))
    assert 0 < state.count() <= 8
