"""Alert rationing: a sliding hourly budget per node with an adaptive bar."""
from __future__ import annotations

import json
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..values import DEFAULTS, Params
from .fold import fold, last_states
from .ordered import running, trailing_counts, with_chunks

HOUR_US = 3_600_000_000
RANK_CRITICAL = 4


RATION = "node_id string, event_id long, ts_us long, alerted boolean, threshold double, alerts_last_hour long"


def _ration_step(params: Params):
    budget = max(1, params.budget_per_hour)
    floor, ceiling = params.floor, params.ceiling

    def step(pdf: pd.DataFrame, state: str | None):
        saved = json.loads(state) if state else {"bar": floor, "rung": []}
        bar, rung = saved["bar"], deque(saved["rung"])
        alerted, bars, recent = [], [], []
        for at, score, rank in zip(pdf["ts_us"].tolist(), pdf["score"].tolist(), pdf["rank"].tolist()):
            while rung and rung[0] < at - HOUR_US:
                rung.popleft()
            recent.append(len(rung))
            if rank >= RANK_CRITICAL:
                ring = True
            else:
                if len(rung) >= budget:
                    bar = min(ceiling, bar + 0.04)
                elif 1.0 - len(rung) / budget > 0.4:
                    bar = max(floor, bar - 0.01)
                ring = score >= bar
            if ring:
                rung.append(at)
            alerted.append(ring)
            bars.append(bar)
        out = pdf[["node_id", "event_id", "ts_us"]].assign(
            alerted=alerted, threshold=bars, alerts_last_hour=recent)
        end = int(pdf["ts_us"].iloc[-1])
        return out, json.dumps({"bar": bar, "rung": [t for t in rung if t >= end - HOUR_US]})
    return step


def _ration_rows(events: DataFrame, width: int, target_rows: int) -> DataFrame:
    return with_chunks(events.select("node_id", "event_id", "ts_us", "score", "rank"), ["node_id"], "ts_us", width, target_rows)


def ration(events: DataFrame, params: Params = DEFAULTS, width: int = 24 * HOUR_US, target_rows: int = 400_000,
           resume: DataFrame | None = None, ttl_s: float | None = None) -> DataFrame:
    """Decide every event of a node in time order.

    Needs ``node_id, event_id, ts_us, score, rank``.  Critical events always
    alert but still use budget.  Returns the keys with ``alerted``,
    ``threshold`` after adapting, and ``alerts_last_hour`` seen at decision time.
    A stream starts from ``resume``, the ``ration_states`` of what a batch has decided.
    """
    return fold(_ration_rows(events, width, target_rows), ["node_id"], ["ts_us", "event_id"], _ration_step(params), RATION, resume=resume, ttl_s=ttl_s)


def ration_states(events: DataFrame, params: Params = DEFAULTS, width: int = 24 * HOUR_US, target_rows: int = 400_000) -> DataFrame:
    """node_id and state: the bar and the alerts of the last hour after these events."""
    return last_states(_ration_rows(events, width, target_rows), ["node_id"], ["ts_us", "event_id"], _ration_step(params), RATION)


def status(decided: DataFrame, width: int = 24 * HOUR_US) -> DataFrame:
    """Alerts and suppressions of the trailing hour at every decision."""
    t = trailing_counts(decided, ["node_id"], "ts_us", HOUR_US, ["ts_us", "event_id"],
                        {"alerts": F.col("alerted").cast("int"), "suppressed": (~F.col("alerted")).cast("int")},
                        width)
    total = F.col("alerts") + F.col("suppressed")
    return t.select("node_id", "event_id", "alerts", "suppressed",
                    F.round(F.col("suppressed") / F.nullif(total, F.lit(0)), 3).alias("suppression_rate"))


def capture_gate(decided: DataFrame) -> DataFrame:
    """Heavy evidence is kept only for alerts and for high or critical events."""
    return decided.withColumn("capture", F.col("alerted") | (F.col("rank") >= 3))


def alert_rate(decided: DataFrame) -> DataFrame:
    """Share of events that alerted, per object class."""
    return decided.groupBy("object_class").agg(
        F.count("*").alias("events"), F.count(F.when(F.col("alerted"), 1)).alias("alerts")).withColumn(
        "alert_rate", F.round(F.col("alerts") / F.col("events"), 4))


def event_order(events: DataFrame) -> DataFrame:
    """Arrival position of each event on its node (1-based)."""
    rows = with_chunks(events, ["node_id"], "ts_us", 24 * HOUR_US)
    return running(rows, ["node_id"], ["ts_us", "event_id"], {"arrival": ("count", F.lit(True))}).drop("_chunk")
