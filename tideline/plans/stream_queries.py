"""Usage over streams: the events come as files in time order, are drained into tables, and equal the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.plans import context_queries as cq
from tideline.plans.registry import ORACLE_SQL, query
from tideline.streaming import stateful as st

SLICES = 4
_DAY = {"basic": 2, "pro": 2, "enterprise": 2}


def _source(t, files: int = 2) -> DataFrame:
    """The events as a stream: slices of time are written one after the other, and a micro-batch takes the files of one.

    A last slice holds a single event far ahead, of no user, so that the watermark closes what is open.
    """

    def build(path):
        events = cq._events(t).select("event_id", "user_id", "tier", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("mode"), F.col("value").alias("latency"))
        at = F.unix_micros("ts")
        cuts = events.select(at.cast("double").alias("us")).approxQuantile("us", [i / SLICES for i in range(1, SLICES)], 0.001)
        edges = [float("-inf"), *cuts, float("inf")]
        for lo, hi in zip(edges, edges[1:], strict=False):
            events.filter((at > lo) & (at <= hi)).repartition(files).write.mode("append").parquet(path)
        ahead = events.agg(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast(events.schema["user_id"].dataType).alias("user_id"), F.lit(None).cast("string").alias("tier"), (F.max("ts") + F.expr("interval 400 days")).alias("ts"), F.lit(None).cast("string").alias("mode"), F.lit(None).cast("double").alias("latency"))
        ahead.write.mode("append").parquet(path)

    path = t.once("event-files", build)
    return t.spark.readStream.schema(t.spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def _drained(t, name: str, stream: DataFrame) -> tuple[DataFrame, int]:
    found = []
    st.with_rocksdb(t.spark)
    path = t.once(name, lambda path: found.append(st.drained(stream, path)))
    return found[0] if found else (t.spark.read.schema(stream.schema).parquet(f"{path}/table"), 0)


@query(ORACLE_SQL["f11_daily_quota"])
def f11_stream(t):
    return _drained(t, "f11", st.daily_quota(_source(t), late="30 days"))[0].filter("event_id is not null and not late").select("event_id", "admitted")


@query(ORACLE_SQL["f12_rate_limit"])
def f12_stream(t):
    return _drained(t, "f12", st.rate_limited(_source(t), 86400, _DAY, "30 days"))[0].filter("event_id is not null and not late").select("event_id", "admitted")


@query(ORACLE_SQL["f13_window_usage"])
def f13_stream(t):
    return _drained(t, "f13", st.window_counts(_source(t), 86400, "30 days"))[0].filter("event_id is not null and not late").select("event_id", "n_window")


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS \"end\", count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN ts < before + INTERVAL 12 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)) GROUP BY user_id, s")
def f13_sessions(t):
    """Sessions of a user: events less than twelve hours apart."""
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    found = _drained(t, "f13s", st.sessions(_source(t), "12 hours", "1 day"))[0].filter("user_id is not null")
    return found.select("user_id", ntz("start").alias("start"), ntz("end").alias("end"), "n")


@query("SELECT date_trunc('hour', ts) AS start, event_type AS mode, count(*) AS n, round(avg(value), 6) AS avg_latency FROM events GROUP BY ALL")
def f14_stream(t):
    found = _drained(t, "f14", st.mode_metrics(_source(t), "1 hour", "1 day"))[0].filter("mode is not null")
    return found.select(F.col("start").cast("timestamp_ntz").alias("start"), "mode", "n", F.round(F.col("spent") / F.col("n"), 6).alias("avg_latency"))
