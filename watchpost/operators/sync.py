"""Edge-to-core synchronisation: queue, idempotent ingest, storage policy."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import clock_drift_s, corrected_us, drifted
from ..values import DEFAULTS, Params
from .ordered import running, with_chunks

# eviction order is one global queue: 5 ranks x time, cut into chunks when long
QUEUE_WIDTH = 86_400_000_000


# --- outbound ----------------------------------------------------------------------
def pending_queue(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Sealed, unsent events: most important first, then oldest.

    Events whose clip was evicted stay in the queue: the record always travels.
    """
    q = events.where(F.col("sync_state").isin("pending", "failed", "evidence_evicted") & F.col("sealed"))
    q = q.orderBy(F.desc("rank"), "ts_us", "event_id")
    return q.limit(limit) if limit else q


def mark_outcome(events: DataFrame, replies: DataFrame, synced_us: int) -> DataFrame:
    """Apply the core's reply: accepted rows are synced, the rest failed."""
    r = replies.select("event_id", F.col("accepted").alias("_ok"))
    return events.join(r, "event_id", "left").withColumns({
        "sync_state": F.when(F.col("_ok"), "synced").when(~F.col("_ok"), "failed").otherwise(F.col("sync_state")),
        "synced_us": F.when(F.col("_ok"), F.lit(synced_us))}).drop("_ok")


def queue_bytes(events: DataFrame, keys: tuple[str, ...] = ("node_id",)) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("sync_state") != "synced", F.col("evidence_bytes"))), F.lit(0)).alias("queue_bytes"))


def link_mode(events: DataFrame, reachable: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Transmission posture of each node from backlog and queue pressure."""
    state = events.groupBy("node_id").agg(
        F.count(F.when(F.col("sync_state") == "pending", 1)).alias("pending"),
        F.coalesce(F.sum(F.when(F.col("sync_state") != "synced", F.col("evidence_bytes"))), F.lit(0)).alias("bytes"))
    pressure = F.least(F.lit(1.0), F.col("bytes") / F.lit(max(1, params.queue_cap_bytes)))
    j = state.join(reachable, "node_id", "left").withColumn("pressure", F.round(pressure, 3))
    return j.withColumn("link_mode", F.when(~F.coalesce("reachable", F.lit(False)), "offline")
                        .when(F.col("pending") > params.sync_batch, "syncing")
                        .when(pressure > 0.75, "event_only").otherwise("online"))


def evictions(events: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Clips to drop per node: lowest rank first, oldest first, until 85 % of cap.

    Nothing is evicted while the queue fits its cap.  An event goes when the bytes
    still queued before it are above the target.
    """
    held = events.where("sync_state <> 'synced' AND evidence_bytes > 0").select(
        "node_id", "event_id", "rank", "ts_us", "evidence_bytes")
    total = held.groupBy("node_id").agg(F.sum("evidence_bytes").alias("_total")).where(
        F.col("_total") > params.queue_cap_bytes)
    held = held.join(total, "node_id")
    # rank sits above time in one ordering position, so chunks follow the queue
    held = held.withColumn("_pos", F.col("rank").cast("long") * F.lit(1 << 52) + F.col("ts_us"))
    held = running(with_chunks(held, ["node_id"], "_pos", QUEUE_WIDTH), ["node_id"], ["_pos", "event_id"],
                   {"_freed": ("sum", "evidence_bytes")})
    before = F.col("_total") - (F.col("_freed") - F.col("evidence_bytes"))
    return held.where(before > params.queue_cap_bytes * params.evict_to).select(
        "node_id", "event_id", "evidence_bytes", F.col("_freed").alias("freed_bytes"))


def bandwidth(frames: DataFrame, sent: DataFrame) -> DataFrame:
    """What streaming would have cost against what was sent, per node."""
    f = frames.groupBy("node_id").agg(F.sum("frame_bytes").alias("bytes_observed"), F.count("*").alias("frames_observed"),
                                      ((F.max("ts_us") - F.min("ts_us")) / 1e6).alias("elapsed_s"))
    s = sent.groupBy("node_id").agg(F.sum("sent_bytes").alias("bytes_transmitted"), F.count("*").alias("events_sent"))
    j = f.join(s, "node_id", "left").fillna({"bytes_transmitted": 0, "events_sent": 0})
    secs = F.greatest(F.col("elapsed_s"), F.lit(1e-6))
    saved = 1.0 - F.col("bytes_transmitted") / F.nullif("bytes_observed", F.lit(0))
    return j.withColumns({
        "stream_bps": F.floor(F.col("bytes_observed") * 8 / secs).cast("long"),
        "uplink_bps": F.floor(F.col("bytes_transmitted") * 8 / secs).cast("long"),
        "reduction_percent": F.round(F.greatest(F.lit(0.0), F.coalesce(saved, F.lit(0.0))) * 100, 2)})


# --- retention ------------------------------------------------------------------------
def expired(evidence: DataFrame, now_us: Column, params: Params = DEFAULTS) -> DataFrame:
    """Evidence days past the retention period."""
    return evidence.where(F.col("ts_us") < now_us - F.lit(params.retention_days * 86_400_000_000))


def over_cap(evidence: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Packages beyond the newest N of each node; event rows are kept."""
    e = evidence.withColumn("_age", -F.col("ts_us"))
    e = running(with_chunks(e, ["node_id"], "_age", QUEUE_WIDTH), ["node_id"], ["_age", "event_id"],
                {"_nth": ("count", F.lit(True))})
    return e.where(F.col("_nth") > params.retention_packages).drop("_age", "_nth", "_chunk")


# --- inbound ---------------------------------------------------------------------------
def flatten(batches: DataFrame) -> DataFrame:
    """Envelope rows (node, sent, received, trust flag, events array) to events."""
    return batches.select("node_id", "sent_us", "received_us", "clock_trusted", F.explode("events").alias("e")).select(
        "node_id", "sent_us", "received_us", "clock_trusted", "e.*")


def correct_clock(incoming: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Shift drifted node times by the measured drift; keep what the node said."""
    off = drifted(clock_drift_s(F.col("received_us"), F.col("sent_us")), F.col("clock_trusted"), params.drift_tolerance_s)
    return incoming.withColumns({
        "node_ts_us": F.col("ts_us"), "clock_corrected": off,
        "ts_us": corrected_us(F.col("ts_us"), F.col("received_us") - F.col("sent_us"), off)})


def classify(incoming: DataFrame, existing: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """accepted / duplicate / rejected, and idempotent under replay.

    A synced event seen again is acknowledged but not rewritten; an event whose
    index was witnessed with another hash is refused.  Of several copies in one
    batch the first is taken and the others count as duplicates.
    """
    known = existing.where("sync_state = 'synced'").select("event_id", F.lit(True).alias("_known"))
    seen = checkpoints.select("node_id", "ledger_index", F.col("entry_hash").alias("_witnessed"))
    j = incoming.join(known, "event_id", "left").join(seen, ["node_id", "ledger_index"], "left")
    rewrite = (F.col("ledger_index") > 0) & F.col("_witnessed").isNotNull() & (F.col("_witnessed") != F.col("entry_hash"))
    return j.withColumn("outcome", F.when(F.col("_known"), "duplicate").when(rewrite, "rejected")
                        .otherwise("accepted")).drop("_known", "_witnessed")


def node_registry(batches: DataFrame) -> DataFrame:
    """Last contact, clock offset and trust, and events received per node.

    One row per batch with its ``n_events``; for raw envelopes that is
    ``size(events)``.
    """
    last = F.max_by(F.struct(((F.col("received_us") - F.col("sent_us")) / 1e6).alias("offset_s"), "clock_trusted"), "received_us")
    return batches.groupBy("node_id").agg(
        F.max("received_us").alias("last_seen_us"), last.alias("l"), F.sum("n_events").alias("events_received")).select(
        "node_id", "last_seen_us", F.round("l.offset_s", 3).alias("clock_offset_s"),
        F.col("l.clock_trusted").alias("clock_trusted"), "events_received")


def verify_bundle(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Evidence files against a manifest of name and SHA-256."""
    actual = files.select("name", F.sha2("content", 256).alias("actual"))
    j = manifest.join(actual, "name", "left")
    return j.withColumn("status", F.when(F.col("actual").isNull(), "missing")
                        .when(F.col("actual") == F.col("sha256"), "ok").otherwise("mismatch"))
