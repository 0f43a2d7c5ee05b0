"""Structured Streaming jobs around the batch operators.

Order-dependent operators (governor, tracker, cooldown) accept a
streaming DataFrame directly: their fold keeps its state in the state store.
This module adds what only exists on streams: timers, watermarks and sinks.
"""
from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import notary as NT
from ..operators import sync as SY
from ..operators.rules import zone_readings
from ..session import cut
from ..sources import deltas as DL
from ..sources.sinks import exists, upsert
from ..values import DEFAULTS, Params


# --- ingest -------------------------------------------------------------------------
def ingest_events(batches: DataFrame, store: str, checkpoints: str, rejected: str, progress: str, secret: str,
                  params: Params = DEFAULTS, available_now: bool = False, compact_every: int = 50) -> StreamingQuery:
    """Idempotent ingest: classify, correct clocks, upsert, refuse rewrites, witness.

    ``store`` merges on read (``deltas``): a batch writes what it brought, and every
    ``compact_every`` batches the touched buckets are merged.  Replaying a micro-batch leaves
    the same tables: known events are duplicates, one row per event counts, and a head that
    did not move is not signed again.
    """
    def handle(batch: DataFrame, batch_no: int) -> None:
        spark = batch.sparkSession
        events = SY.correct_clock(SY.flatten(batch), params)
        events = events.withColumn("date", F.to_date(F.timestamp_micros("node_ts_us")))
        known = DL.read_keys(spark, store, events, ["event_id"], "synced_us")
        known = spark.createDataFrame([], "event_id long, sync_state string, entry_hash string") if known is None else known
        seen = spark.read.parquet(checkpoints) if exists(spark, checkpoints) else spark.createDataFrame([], NT.CHECKPOINT)
        kept = cut(known.select("event_id", "entry_hash"))
        out = cut(SY.classify(events, known, seen))  # before the store changes
        # every copy is judged by itself; of the accepted ones the first sent is kept
        fresh = out.where("outcome = 'accepted'").drop("outcome")
        fresh = fresh.groupBy("event_id").agg(F.min_by(F.struct(*[c for c in fresh.columns if c != "event_id"]), "sent_us").alias("r")).select("event_id", "r.*")
        fresh = cut(fresh.withColumns({"sync_state": F.lit("synced"), "synced_us": F.col("received_us")}))
        refused = out.where("outcome = 'rejected'").withColumn("batch_no", F.lit(batch_no))
        refused.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_no").parquet(rejected)
        DL.write_delta(store, fresh, batch_no)
        if (batch_no + 1) % compact_every == 0:
            DL.compact(spark, store, ["event_id"], "synced_us", batch_no)
        # the head can only move to an entry just accepted, or accepted by a run of this batch that
        # broke off before it signed: history is not read again
        again = out.where("outcome = 'duplicate'").join(kept, ["event_id", "entry_hash"], "left_semi")
        heads = fresh.select("node_id", "ledger_index", "entry_hash").unionByName(again.select("node_id", "ledger_index", "entry_hash")).where("ledger_index > 0")
        stamp = batch.agg(F.max("received_us")).first()[0]
        signed = NT.witness(heads.select("node_id", "ledger_index", "entry_hash"), seen, str(stamp), secret)
        signed = signed.withColumn("version", F.col("ledger_index"))
        upsert(checkpoints, signed, ["node_id", "ledger_index"], "version", ["node_id"])

    writer = batches.writeStream.foreachBatch(handle).option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# --- presence -------------------------------------------------------------------------
PRESENCE = ("camera_id string, track_id long, zone_id string, event_type string, event_id long, ts_us long")


def zone_presence(points: DataFrame, zones: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Intrusion and loitering events from a stream of track points.

    Readings are native; the settle-after-N rule and the once-only markers are a
    small state per track that ends with its inactivity timeout.
    """
    readings = zone_readings(points, zones).where("kind = 'polygon'").select(
        "camera_id", "track_id", "zone_id", "event_id", "ts_us", "ts", "inside", "is_lawful_route")
    stay_us, need = int(params.loiter_s * 1e6), params.confirm_frames

    def run(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["ts_us", "event_id"], kind="stable")
        st = json.loads(state.get[0]) if state.exists else {}
        out = []
        for zone, ev, at, inside, lawful in zip(*[pdf[c].tolist() for c in ("zone_id", "event_id", "ts_us", "inside", "is_lawful_route")]):
            z = st.setdefault(zone, {"in": False, "run": 0, "since": None, "hit": False, "sat": False})
            z["run"] = z["run"] + 1 if inside != z["in"] else 0
            if z["run"] >= need:
                z["in"], z["run"], z["since"] = inside, 0, at if inside else None
            if z["in"] and not z["hit"] and not lawful:
                z["hit"] = True
                out.append((key[0], key[1], zone, "zone_intrusion", ev, at))
            if z["in"] and not z["sat"] and at - z["since"] >= stay_us:
                z["sat"] = True
                out.append((key[0], key[1], zone, "loitering", ev, at))
        state.update((json.dumps(st),))
        # the watermark can already be past the newest row of a late batch
        state.setTimeoutTimestamp(max(int(pdf["ts_us"].max() // 1000), state.getCurrentWatermarkMs()) + 86_400_000)
        yield pd.DataFrame(out, columns=[f.strip().split(" ")[0] for f in PRESENCE.split(",")])

    return (readings.withWatermark("ts", "10 minutes").groupBy("camera_id", "track_id")
            .applyInPandasWithState(run, PRESENCE, "state string", "append", GroupStateTimeout.EventTimeTimeout))


def camera_outages(frames: DataFrame, silent_s: float = 5.0, watermark: str = "10 seconds") -> DataFrame:
    """Offline when a camera is silent past the limit (event-time timer), online on return."""
    limit_ms = int(silent_s * 1000)

    def run(key, batches, state: GroupState):
        if state.hasTimedOut:
            last, _ = state.get
            state.update((last, True))
            yield pd.DataFrame({"camera_id": [key[0]], "event_type": ["camera_offline"], "at_us": [last + limit_ms * 1000]})
            return
        pdf = pd.concat(list(batches), ignore_index=True).sort_values("ts_us")
        last, off = state.get if state.exists else (None, False)
        out = []
        for at in pdf["ts_us"].tolist():
            if last is not None and at - last > limit_ms * 1000:
                if not off:
                    out.append(("camera_offline", last + limit_ms * 1000))
                out.append(("camera_online", at))
                off = False
            elif off:
                out.append(("camera_online", at))
                off = False
            last = at if last is None else max(last, at)
        state.update((last, off))
        state.setTimeoutTimestamp(max(last // 1000 + limit_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_type", "at_us"]).assign(camera_id=key[0])[["camera_id", "event_type", "at_us"]]

    return (frames.withWatermark("ts", watermark).groupBy("camera_id").applyInPandasWithState(
        run, "camera_id string, event_type string, at_us long", "last long, off boolean", "append", GroupStateTimeout.EventTimeTimeout))


def announce_new(events: DataFrame, watermark: str = "7 days") -> DataFrame:
    """High and critical alerts, each announced once however often it is re-sent."""
    return events.withWatermark("ts", watermark).where("alerted AND rank >= 3").dropDuplicatesWithinWatermark(["event_id"])


def split_late(events: DataFrame, on_time: str, late: str, progress: str, delay_s: float = 600.0, available_now: bool = False) -> StreamingQuery:
    """Part a stream before it meets a watermark: rows too late for it go to ``late``, none vanish.

    A row is late when it lies more than ``delay_s`` before the newest ``ts_us`` of all earlier
    micro-batches, as a watermark of that delay would have it.  Read ``on_time`` as the stream
    that the stateful jobs take.  A replayed batch writes the same rows to the same places.
    """
    marks = f"{progress}/marks"

    def handle(batch: DataFrame, batch_no: int) -> None:
        spark = batch.sparkSession
        rows = cut(batch.withColumn("batch_no", F.lit(batch_no)))
        seen = spark.read.parquet(marks).where(F.col("batch_no") < batch_no).agg(F.max("top")).first()[0] if exists(spark, marks) else None
        behind = F.lit(False) if seen is None else F.coalesce(F.col("ts_us") < F.lit(seen - int(delay_s * 1e6)), F.lit(False))
        save = lambda df, path: (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                                 .partitionBy("batch_no").parquet(path))
        save(rows.where(~behind), on_time)
        save(rows.where(behind), late)
        save(rows.groupBy("batch_no").agg(F.max("ts_us").alias("top")), marks)

    writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", f"{progress}/offsets")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
