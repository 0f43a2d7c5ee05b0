"""Read side of the event log."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_events(events: DataFrame, limit: int, offset: int = 0, camera_id: str | None = None, min_rank: int = 0,
                unacknowledged: bool = False, sync_state: str | None = None, alerted: bool = False,
                node_id: str | None = None) -> DataFrame:
    """Filtered page of the log, newest first.  Every filter comes before the limit."""
    q = events.where(F.col("rank") >= min_rank)
    for name, value in (("camera_id", camera_id), ("sync_state", sync_state), ("node_id", node_id)):
        if value is not None:
            q = q.where(F.col(name) == value)
    if unacknowledged:
        q = q.where("NOT acknowledged")
    if alerted:
        q = q.where("alerted")
    return q.orderBy(F.desc("ts_us"), F.desc("event_id")).offset(offset).limit(limit)


def get_event(events: DataFrame, event_id) -> DataFrame:
    return events.where(F.col("event_id") == event_id)


def counts_by_state(events: DataFrame) -> DataFrame:
    return events.groupBy("sync_state").agg(F.count("*").alias("events"))


def alerts_since(events: DataFrame, since_us, min_rank: int = 2, keys: tuple[str, ...] = ("node_id",)) -> DataFrame:
    return events.where((F.col("ts_us") >= since_us) & (F.col("rank") >= min_rank) & F.col("alerted")).groupBy(
        *keys).agg(F.count("*").alias("alerts"))


def system_status(events: DataFrame, cameras: DataFrame, since_us) -> DataFrame:
    """One pass over the log and one over the registry, per node."""
    e = events.groupBy("node_id").agg(
        F.count("*").alias("events_total"), F.count(F.when(F.col("sync_state") == "pending", 1)).alias("events_pending"),
        F.coalesce(F.sum(F.when(F.col("sync_state") != "synced", F.col("evidence_bytes"))), F.lit(0)).alias("queue_bytes"),
        F.count(F.when((F.col("ts_us") >= since_us) & (F.col("rank") >= 2) & F.col("alerted"), 1)).alias("alerts_last_hour"))
    c = cameras.groupBy("node_id").agg(F.count("*").alias("cameras_total"),
                                       F.count(F.when(F.col("health") == "online", 1)).alias("cameras_online"))
    return e.join(c, "node_id", "left").fillna(0, ["cameras_total", "cameras_online"])


def alert_queue(events: DataFrame, limit: int, include_suppressed: bool = False) -> DataFrame:
    """What an operator still has to look at, strongest first."""
    q = events.where("NOT acknowledged")
    return (q if include_suppressed else q.where("alerted")).orderBy(
        F.desc("score"), F.desc("ts_us"), F.desc("event_id")).limit(limit)


def new_alerts(events: DataFrame, seen: DataFrame, min_rank: int = 3) -> DataFrame:
    """High and critical alerts not announced yet."""
    return events.where((F.col("rank") >= min_rank) & F.col("alerted")).join(
        seen.select("event_id"), "event_id", "left_anti")


def incidents(events: DataFrame, gap_us: int) -> DataFrame:
    """Open incidents: alerts of one camera no further apart than ``gap_us``, newest first."""
    from .ordered import neighbours, running, with_chunks
    a = with_chunks(events.where("alerted"), ["camera_id"], "ts_us", 86_400_000_000)
    a = neighbours(a, ["camera_id"], ["ts_us", "event_id"], back={"_prev": "ts_us"})
    fresh = F.col("_prev").isNull() | (F.col("ts_us") - F.col("_prev") > gap_us)
    a = running(a.withColumn("_fresh", fresh), ["camera_id"], ["ts_us", "event_id"], {"incident_no": ("count", F.col("_fresh"))})
    return a.groupBy("camera_id", "incident_no").agg(
        F.min("ts_us").alias("opened_us"), F.max("ts_us").alias("updated_us"), F.count("*").alias("alerts"),
        F.max("rank").alias("max_rank")).orderBy(F.desc("updated_us"))


def delete_cameras(table: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows of a camera-keyed table that survive the removal of cameras."""
    return table.join(gone.select("camera_id"), "camera_id", "left_anti")


def config_rows(table: DataFrame, camera_id: str | None = None, active: bool | None = None) -> DataFrame:
    """Zones of a camera, or active patrols."""
    q = table if camera_id is None else table.where(F.col("camera_id") == camera_id)
    return q if active is None else q.where(F.col("active") == active)


def as_of(events: DataFrame, versions: DataFrame, key: str, valid_from: str, payload: list[str]) -> DataFrame:
    """Latest version of ``key`` in force at each event (null before the first).

    Events and versions share one timeline per key and the last version seen is carried
    along, so no event meets a version that is not its own.  A version counts from its own
    instant on; of versions of one instant the greatest payload does.
    """
    from .ordered import running, with_chunks
    rows = events.select(F.col(key).alias("_key"), F.col("ts_us").alias("_at"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in events.columns]).alias("_event"))
    news = versions.select(F.col(key).alias("_key"), F.col(valid_from).alias("_at"), F.struct(*payload).alias("_version")).groupBy("_key", "_at").agg(F.max("_version").alias("_version"))
    rows = rows.unionByName(news.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    rows = running(with_chunks(rows, ["_key"], "_at", 86_400_000_000), ["_key"], ["_at", "_side"], {"_now": ("last", F.col("_version"))})
    return rows.where("_side = 1").select("_event.*", *[F.col("_now")[c].alias(c) for c in payload])
