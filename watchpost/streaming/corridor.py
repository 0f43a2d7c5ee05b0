"""Corridor hand-offs and dropouts on streams: an interval join and event-time timers."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import signature as S
from ..operators.corridor import default_std, scored_pairs
from ..session import timers
from ..values import DEFAULTS, Params

SECOND_US = 1_000_000
DROPOUT = "exit_id long, camera_id string, expected_at string, exit_us long, due_us long"


def _marked(df: DataFrame, delay: str) -> DataFrame:
    return df.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", delay)


def _windows(edges: DataFrame, params: Params) -> DataFrame:
    low, high = (f(F.col("mean_s"), F.col("std_s"), params.sigmas) for f in (S.window_low, S.window_high))
    return default_std(edges).select("src", "dst", "mean_s", "std_s", low.alias("_lo"), high.alias("_hi"))


def handoff_candidates(exits: DataFrame, arrivals: DataFrame, edges: DataFrame, params: Params = DEFAULTS, delay: str = "1 minute",
                       sig_kind: str = "histogram") -> DataFrame:
    """All plausible exit -> arrival links of two streams, as the batch operator of this name gives them.

    A stream-stream join over time intervals.  Each pair is held to the window of its own
    edge; the widest window of all edges (one number) bounds how long the state store keeps
    an exit, and both watermarks let it forget.  Rows later than ``delay`` are not seen: part
    them with ``jobs.split_late`` before.
    """
    windows = _windows(edges, params)
    widest = float(windows.agg(F.max("_hi")).first()[0] or 0.0)
    ex = _marked(exits, delay).join(windows, exits["camera_id"] == windows["src"]).select(
        F.col("event_id").alias("exit_id"), F.col("ts_us").alias("exit_us"), F.col("ts").alias("exit_ts"), F.col("signature").alias("_es"),
        "src", "dst", "object_class", "mean_s", "std_s", "_lo", "_hi")
    ar = _marked(arrivals, delay).select(
        F.col("event_id").alias("arrival_id"), F.col("ts_us").alias("arrival_us"), F.col("ts").alias("arrival_ts"), F.col("signature").alias("_as"),
        F.col("camera_id").alias("_at"), F.col("object_class").alias("_class"))
    elapsed = (F.col("arrival_us") - F.col("exit_us")) / 1e6
    kept = F.expr(f"arrival_ts >= exit_ts AND arrival_ts <= exit_ts + INTERVAL {int(widest) + 1} SECONDS")
    pairs = ex.join(ar, (F.col("dst") == F.col("_at")) & (F.col("object_class") == F.col("_class")) & kept & elapsed.between(F.col("_lo"), F.col("_hi")))
    pairs = pairs.withColumn("elapsed_s", elapsed).withColumn("timing", S.timing_score(F.col("elapsed_s"), F.col("mean_s"), F.col("std_s")))
    return scored_pairs(pairs, params, sig_kind).select(
        "exit_id", "arrival_id", "src", "dst", "object_class", "elapsed_s", "timing", "appearance", "score")


class _Overdue(StatefulProcessor):
    """One exit: it waits for its claim until its timer; a claim that comes first waits as long for its exit."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "camera_id string, expected_at string, exit_us long, due_us long")
        self.claimed = handle.getValueState("claimed", "at long")

    def _forget(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.waiting.clear()
        self.claimed.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        exits, claims = pdf[~pdf["claim"]], pdf[pdf["claim"]]
        if len(claims) and (len(exits) or self.waiting.exists()) or len(exits) and self.claimed.exists():
            self._forget()
        elif len(claims):
            self.claimed.update((int(claims["ts_us"].min()),))
            self.handle.registerTimer(int(claims["due_us"].max() // 1000) + 1)
        elif len(exits):
            row = exits.sort_values("ts_us").iloc[0]
            self.waiting.update((row["camera_id"], row["expected_at"], int(row["ts_us"]), int(row["due_us"])))
            self.handle.registerTimer(int(row["due_us"] // 1000) + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            camera, expected, left, due = self.waiting.get()
            yield pd.DataFrame({"exit_id": [key[0]], "camera_id": [camera], "expected_at": [expected], "exit_us": [left], "due_us": [due]})
        self._forget()

    def close(self) -> None:
        pass


def dropouts(exits: DataFrame, claims: DataFrame, edges: DataFrame, params: Params = DEFAULTS, delay: str = "1 minute") -> DataFrame:
    """Travellers that left and were claimed nowhere in time, told by a timer and not by a later row.

    ``exits``: event_id, ts_us, camera_id, handoffs; ``claims``: exit_id, ts_us (of the
    arrival).  An exit with at least one hand-off behind it is due after the widest window of
    its camera's edges; if event time passes that moment without a claim, it is a dropout.
    Columns exit_id, camera_id, expected_at, exit_us, due_us.
    """
    timers(exits.sparkSession)
    widest = _windows(edges, params).groupBy(F.col("src").alias("camera_id")).agg(
        F.max("_hi").alias("_hi"), F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("expected_at"))
    hold = float(widest.agg(F.max("_hi")).first()[0] or 0.0)
    due = lambda hi: (F.col("ts_us") + (hi * SECOND_US).cast("long")).alias("due_us")
    left = exits.where("handoffs >= 1").join(widest, "camera_id").select(
        F.col("event_id").alias("exit_id"), "ts_us", F.lit(False).alias("claim"), "camera_id", "expected_at", due(F.col("_hi")))
    came = claims.select("exit_id", "ts_us", F.lit(True).alias("claim"), F.lit(None).cast("string").alias("camera_id"),
                         F.lit(None).cast("string").alias("expected_at"), due(F.lit(hold)))
    rows = _marked(left.unionByName(came), delay)
    return rows.groupBy("exit_id").transformWithStateInPandas(_Overdue(), DROPOUT, "append", "eventTime")
