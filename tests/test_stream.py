"""Streams must equal their batch meaning, whatever the micro-batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rewardloom.streaming import flows as L
from rewardloom.streaming import state as Z

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def feed(spark):
    """Sixty events in six files, one file per micro-batch."""
    Z.with_rocksdb(spark)
    folder = f"{L.work_folder(spark)}/feed"
    rows = [(i, START + dt.timedelta(minutes=i), i % 2, i % 7 == 6, float(i % 5), i // 4) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, q long, take boolean, value double, uid long")
    for part in range(6):
        df.where((F.col("id") >= part * 10) & (F.col("id") < part * 10 + 10)).coalesce(1).write.mode("append").parquet(folder)
    return lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder), rows


def test_queue_drops_the_oldest_and_serves_in_order(feed):
    stream, rows = feed
    out = L.run_available(Z.bounded_queue(stream(), "q", "id", 5, take="take")).where("outcome != 'state'").toPandas()
    expected = []
    for q in (0, 1):
        held = []
        for i, _, key, take, _, _ in rows:
            if key != q:
                continue
            if take:
                if held:
                    expected.append((str(q), held.pop(0), "consumed"))
                continue
            if len(held) >= 5:
                expected.append((str(q), held.pop(0), "dropped"))
            held.append(i)
    assert sorted(zip(out["queue"], out["item"], out["outcome"])) == sorted(expected)


def test_take_required_waits_for_full_steps(feed):
    stream, rows = feed
    out = L.run_available(Z.take_required(stream(), "q", "id", 7)).toPandas()
    for q in (0, 1):
        ids = [r[0] for r in rows if r[2] == q]
        got = out[out.queue == str(q)].sort_values("item")
        assert got["item"].tolist() == ids[: len(ids) // 7 * 7]
        assert got["step"].tolist() == [i // 7 for i in range(len(ids) // 7 * 7)]


def test_groups_complete_or_are_flushed_late(feed):
    stream, _ = feed
    partial = stream().where("NOT (uid % 3 = 1 AND id % 4 = 2)")
    out = L.run_available(Z.complete_groups(partial, "uid", "id", "value", "ts", 4, "1 minute", 120)).toPandas()
    complete = out[out.complete]
    assert set(complete["uid"]) == {u for u in range(15) if u % 3 != 1} and (complete["n"] == 4).all()
    flushed = out[~out.complete]
    assert set(flushed["uid"]) <= {u for u in range(15) if u % 3 == 1} and (flushed["n"] == 3).all() and len(flushed) >= 3


def test_rate_audit_replays_the_bucket(feed):
    stream, rows = feed
    out = L.run_available(Z.rate_audit(stream().withColumn("t", F.lit(1)), "q", "id", "ts", "t", rpm=0.25, burst=240)).toPandas()
    for q in (0, 1):
        level, clock, expected = 1.0, None, {}
        for i, ts, key, *_ in rows:
            if key != q:
                continue
            at = ts.replace(tzinfo=dt.timezone.utc).timestamp()
            start = at if clock is None else max(at, clock)
            if clock is not None:
                level = min(1.0, level + (start - clock) * 0.25 / 60)
            wait = max(0.0, (1 - level) / (0.25 / 60))
            level = min(1.0, level + wait * 0.25 / 60) - 1
            clock = start + wait
            expected[i] = clock - at
        got = out[out.client == str(q)].set_index("request")["wait_s"]
        assert all(abs(got[i] - w) < 1e-6 for i, w in expected.items())


def test_field_readiness_announces_once(spark, feed):
    stream, _ = feed
    fields = stream().select("uid", F.concat(F.lit("f"), F.col("id") % 4).alias("field"))
    again = fields.unionByName(stream().select("uid", F.lit("f0").alias("field")))
    out = L.run_available(Z.field_readiness(again, "uid", "field", {"a": ["f0", "f1"], "b": ["f0", "f1", "f2", "f3"]})).toPandas()
    assert out.groupby(["row", "task"]).size().max() == 1 and len(out) == 30


def test_dynamic_sampling_stops_or_fails(feed):
    stream, _ = feed
    groups = Z.complete_groups(stream(), "uid", "id", "value", "ts", 4, "1 minute", 120)
    assert L.stream_dynamic_sampling(groups, 5).count() == 5
    groups = Z.complete_groups(stream(), "uid", "id", "value", "ts", 4, "1 minute", 120)
    with pytest.raises(Exception, match="prompts after 2 batches"):
        L.stream_dynamic_sampling(groups, 1000, max_batches=2)
