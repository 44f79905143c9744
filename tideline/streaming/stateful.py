"""Usage over streams with keyed state, event-time timers and counted late rows.

Processors hold what the batch operators need of a user's past and no more: the admitted times or all times of the trailing
window, or a day's count. A timer drops a bucket's state once the watermark has passed all that it could matter for. Events are
(event_id, user_id, tier, ts); those of one micro-batch are taken by (ts, event_id), so a stream equals the batch operator when
micro-batches come in time order. Rows that come after the watermark has passed them change nothing, and are given out as late.
State lives in the state store: the session has to use RocksDB (with_rocksdb()).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.operators.context import DAILY, PER_WINDOW

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_US = 86_400_000_000
#: Buckets that users are dealt to; a bucket's state and rows of a micro-batch have to fit a task.
BUCKETS = 256


def with_rocksdb(spark: SparkSession) -> None:
    spark.conf.set(_PROVIDER, _ROCKSDB)


class _Held(StatefulProcessor):
    """Keys are buckets of users. State: what is held of each user, as arrays of longs side by side, and one timer for when all
    of it may go; what is past goes with the next rows of the bucket."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "users array<string>, sizes array<long>, held array<long>")

    def restored(self, now: int) -> dict[str, list[int]]:
        if not self.held.exists():
            return {}
        users, sizes, held = self.held.get()
        ends = np.cumsum([0, *sizes])
        held = {u: self.left([*held[lo:hi]], now * 1000) for u, lo, hi in zip(users, ends[:-1], ends[1:], strict=True)}
        return {u: h for u, h in held.items() if h}

    def keep(self, held: dict[str, list[int]], now: int) -> None:
        held = {u: h for u, h in held.items() if h}
        self.held.update(([*held], [len(h) for h in held.values()], [int(t) for h in held.values() for t in h]))
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        self.handle.registerTimer(max([now + 1, *(self.until(h) for h in held.values())]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Rows before the watermark are given out as late, without a result; the others by user and time."""
        now = timerValues.getCurrentWatermarkInMs()
        batch = pd.concat(list(rows)).sort_values(["who", "us", "event"], ignore_index=True)
        late = batch["us"].to_numpy() // 1000 < now
        result = np.full(len(batch), None, object)
        if not late.all():
            held, there = self.restored(now), np.flatnonzero(~late)
            who, us, tier = (batch[c].to_numpy()[there] for c in ("who", "us", "tier"))
            edges = [0, *(np.flatnonzero(who[1:] != who[:-1]) + 1), who.size]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                result[there[lo:hi]], held[who[lo]] = self.judged(us[lo:hi], tier[lo:hi], held.get(who[lo], []))
            self.keep(held, now)
        yield pd.DataFrame({"who": batch["who"], "event": batch["event"], "numbered": batch["numbered"], "late": late, self.column: result})


class _RateLimit(_Held):
    """Held: the admitted times of the window."""

    column, kind = "admitted", "boolean"

    def __init__(self, seconds: int, limits: dict) -> None:
        self.span, self.limits = seconds * 1_000_000, limits

    def left(self, held: list[int], now_us: int) -> list[int]:
        return [h for h in held if h > now_us - self.span]

    def until(self, held: list[int]) -> int:
        return (held[-1] + self.span) // 1000 + 1

    def judged(self, us: np.ndarray, tier: np.ndarray, held: list[int]) -> tuple:
        out = []
        for at, t in zip(us.tolist(), tier, strict=True):
            held = [h for h in held if h > at - self.span]
            out.append(len(held) < self.limits.get(t, 2**31))
            if out[-1] and t in self.limits:
                held.append(at)
        return out, held


class _Window(_Held):
    """Held: all times of the window."""

    column, kind = "n_window", "long"

    def __init__(self, seconds: int) -> None:
        self.span = seconds * 1_000_000

    left, until = _RateLimit.left, _RateLimit.until

    def judged(self, us: np.ndarray, tier: np.ndarray, held: list[int]) -> tuple:
        times = np.concatenate([np.array(held, np.int64), us])
        n = np.searchsorted(times, us, "right") - np.searchsorted(times, us - self.span, "right")
        return n.tolist(), times[times > us[-1] - self.span].tolist()


class _Daily(_Held):
    """Held: pairs of a day and how many of it came so far, for the days that aren't over."""

    column, kind = "admitted", "boolean"

    def __init__(self, limits: dict) -> None:
        self.limits = limits

    def left(self, held: list[int], now_us: int) -> list[int]:
        return [x for day, n in zip(held[::2], held[1::2], strict=True) if (day + 1) * DAY_US > now_us for x in (day, n)]

    def until(self, held: list[int]) -> int:
        return (max(held[::2]) + 1) * DAY_US // 1000

    def judged(self, us: np.ndarray, tier: np.ndarray, held: list[int]) -> tuple:
        count, out = dict(zip(held[::2], held[1::2], strict=True)), []
        for day, t in zip((us // DAY_US).tolist(), tier, strict=True):
            out.append(count.get(day, 0) < self.limits.get(t, 2**31))
            count[day] = count.get(day, 0) + 1
        return out, [x for pair in count.items() for x in pair]


def _run(events: DataFrame, processor: _Held, late: str, buckets: int) -> DataFrame:
    """Users are dealt to buckets, one call and one state a micro-batch each: a call for every user costs more than his events."""
    kind = events.schema["user_id"].dataType.simpleString()
    who = F.when(F.col("user_id").isNull(), "").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    rows = events.withWatermark("ts", late).select(
        "ts", who.alias("who"), "tier", F.unix_micros("ts").alias("us"), F.coalesce("event_id", F.lit(0).cast("long")).alias("event"), F.col("event_id").isNotNull().alias("numbered"),
        F.pmod(F.xxhash64(who), F.lit(buckets)).alias("bucket"),
    )
    out = rows.groupBy("bucket").transformWithStateInPandas(processor, f"who string, event long, numbered boolean, late boolean, {processor.column} {processor.kind}", "Append", "EventTime")
    return out.select(F.when(F.col("who") != "", F.substring("who", 2, 2**31 - 1).cast(kind)).alias("user_id"), F.when(F.col("numbered"), F.col("event")).alias("event_id"), "late", processor.column)


def rate_limited(events: DataFrame, seconds: int = 60, limits: dict = PER_WINDOW, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """user_id, event_id, late, admitted: fewer than the tier's limit were admitted in the last ``seconds``; the refused don't count."""
    return _run(events, _RateLimit(seconds, limits), late, buckets)


def window_counts(events: DataFrame, seconds: int = 60, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """user_id, event_id, late, n_window: how many of the user's events lie less than ``seconds`` back, itself included."""
    return _run(events, _Window(seconds), late, buckets)


def daily_quota(events: DataFrame, limits: dict = DAILY, late: str = "1 day", buckets: int = BUCKETS) -> DataFrame:
    """user_id, event_id, late, admitted: the first of a user's day, up to the tier's limit."""
    return _run(events, _Daily(limits), late, buckets)


def mode_metrics(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, mode, n, spent of closed tumbling windows of (ts, mode, latency)."""
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "mode").agg(F.count("*").alias("n"), F.sum("latency").alias("spent")).select(F.col("w.start").alias("start"), "mode", "n", "spent")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n of closed sessions: events of a user less than ``gap`` apart."""
    w = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def drained(stream: DataFrame, path: str) -> tuple[DataFrame, int]:
    """Run a stream over all that is there into a table under path; returns the table, and how many rows Spark dropped as late.

    Spark drops rows behind the watermark of the micro-batch before; operators with keyed state give out, as ``late``, those
    behind the present one, so both together are the rows that count nowhere.

    Started again on the same path it goes on where it stopped.
    """
    query = stream.writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    late = sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/table"), late
