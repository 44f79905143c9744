"""Streams against their batch operators: files come in time order, one a micro-batch."""

import pytest
from pyspark.sql import functions as F

from tideline.operators import context as cx
from tideline.streaming import stateful, usage as st

SF = "/root/testdata/sf0.001"
DAY = {"basic": 2, "pro": 2, "enterprise": 2}


@pytest.fixture(scope="module")
def stream(spark, tmp_path_factory):
    stateful.with_rocksdb(spark)
    path = str(tmp_path_factory.mktemp("events"))
    tier = F.when(F.col("user_id") % 3 == 0, "basic").when(F.col("user_id") % 3 == 1, "pro").otherwise("enterprise")
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", tier.alias("tier"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("mode"), F.col("value").alias("latency"))
    n = events.count()
    rank = events.orderBy("ts", "event_id").limit(n).toPandas()
    for i in range(3):
        spark.createDataFrame(rank.iloc[i * n // 3 : (i + 1) * n // 3], events.schema).coalesce(1).write.mode("append").parquet(f"{path}/p{i}")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")
    return events, source


def drained(df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.sql(f"select * from {name}")


def test_rate_limit(stream, tmp_path):
    events, source = stream
    got = drained(stateful.rate_limited(source, 86400, DAY, "30 days"), "rate", tmp_path).drop("late")
    want = cx.admitted_window(events, 86400, DAY).select("user_id", "event_id", "admitted")
    assert sorted(got.collect()) == sorted(want.collect())


def test_daily_quota(stream, tmp_path):
    events, source = stream
    got = drained(stateful.daily_quota(source, {"basic": 1, "pro": 2}, "30 days"), "quota", tmp_path).drop("late")
    want = cx.admitted_daily(events, {"basic": 1, "pro": 2}).select("user_id", "event_id", "admitted")
    assert sorted(got.collect()) == sorted(want.collect())


def test_metrics(stream, tmp_path):
    events, source = stream
    got = drained(st.tumbling_metrics(source, "1 day", "1 minute"), "metrics", tmp_path).collect()
    want = events.groupBy(F.window("ts", "1 day").alias("w"), "mode").agg(F.count("*").alias("n"), F.round(F.avg("latency"), 1).alias("avg_latency")).select("w.start", "mode", "n", "avg_latency").collect()
    assert got and set(got) <= set(want)


def test_window_counts(stream, tmp_path):
    events, source = stream
    got = drained(stateful.window_counts(source, 86400, "30 days"), "counts", tmp_path).drop("late")
    want = cx.window_usage(events, 86400).select("user_id", "event_id", "n_window")
    assert sorted(got.collect()) == sorted(want.collect())


def test_late_rows_are_counted_and_state_goes(spark, tmp_path):
    """A file of each load: the second advances the clock by days, the third and the last bring a row from before.

    Spark itself drops what was late a micro-batch ago; operators with keyed state tell what is late now."""
    stateful.with_rocksdb(spark)
    schema = "event_id long, user_id long, tier string, ts timestamp"
    files = [[(1, 1, "basic", "2024-01-01 00:00:00"), (2, 1, "basic", "2024-01-01 00:00:10")], [(3, 2, "basic", "2024-01-05 00:00:00")], [(4, 1, "basic", "2024-01-01 00:00:20"), (5, 1, "basic", "2024-01-06 00:00:00")], [(6, 3, "basic", "2024-01-09 00:00:00")], [(7, 1, "basic", "2024-01-01 00:00:30")]]
    for rows in files:
        spark.createDataFrame([(*r[:3], r[3]) for r in rows], "event_id long, user_id long, tier string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for f, values in ((lambda s: stateful.window_counts(s, 3 * 86400, "1 hour"), [1, 2, 1, None, 1, 1]), (lambda s: stateful.rate_limited(s, 3 * 86400, {"basic": 1}, "1 hour"), [True, False, True, None, True, True]), (lambda s: stateful.daily_quota(s, {"basic": 1}, "1 hour"), [True, False, True, None, True, True])):
        path = str(tmp_path / str(len(list(tmp_path.iterdir()))))
        got, dropped = stateful.drained(f(source), path)
        assert dropped == 1  # the last row: two micro-batches behind
        assert [(r[1], r[2], r[3]) for r in got.orderBy("event_id").collect()] == [(i + 1, v is None, v) for i, v in enumerate(values)]
        again, _ = stateful.drained(f(source), path)
        assert again.count() == 6
    _, late = stateful.drained(st.tumbling_metrics(source.withColumns({"mode": F.lit("m"), "latency": F.lit(1.0)}), "1 hour", "1 hour"), str(tmp_path / "metrics"))
    assert late == 1


def test_sessions(stream, spark, tmp_path):
    events, source = stream
    got = drained(stateful.sessions(source, "12 hours", "1 minute"), "sessions", tmp_path).collect()
    whole = events.groupBy(F.session_window("ts", "12 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n").collect()
    assert got and {*map(tuple, got)} <= {*map(tuple, whole)}


def test_users_share_a_state(stream, spark, tmp_path):
    """A bucket holds many users, also one without an id, and is called once a micro-batch (a call a user took the time: F3, F30)."""
    events, source = stream
    for f, want in ((lambda n: stateful.daily_quota(source, {"basic": 1, "pro": 2}, "30 days", buckets=n), cx.admitted_daily(events, {"basic": 1, "pro": 2})), (lambda n: stateful.rate_limited(source, 86400, DAY, "30 days", buckets=n), cx.admitted_window(events, 86400, DAY))):
        got = drained(f(2), f"shared{len(list(tmp_path.iterdir()))}", tmp_path).drop("late")
        assert sorted(got.collect()) == sorted(want.select("user_id", "event_id", "admitted").collect())
    spark.createDataFrame([(None, None, "basic", "2024-01-01"), (2**60 + 1, "a", "basic", "2024-01-01")], "event_id long, user_id string, tier string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "odd"))
    odd = spark.readStream.schema("event_id long, user_id string, tier string, ts timestamp").parquet(str(tmp_path / "odd"))
    rows = stateful.drained(stateful.daily_quota(odd, {"basic": 1}, buckets=1), str(tmp_path / "out"))[0].collect()
    assert {tuple(r) for r in rows} == {(None, None, False, True), ("a", 2**60 + 1, False, True)}
