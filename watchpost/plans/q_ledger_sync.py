"""Queries for the ledger, the notary, synchronisation and the event log."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as EV
from ..operators import ledger as LG
from ..operators import notary as NT
from ..operators import sync as SY
from ..session import cut
from ..values import Params
from . import fixtures as X
from .registry import query

SECRET = "fixture-notary-secret"
STAMP1, STAMP2 = "2024-02-01T00:00:00Z", "2024-02-02T00:00:00Z"


def _log(spark, sf):
    return X.event_log(spark, sf).withColumn("event_type", F.col("event_kind"))


def _sealed(spark, sf):
    return _log(spark, sf).where("sealed").select(
        "node_id", "event_id", "camera_id", "event_type", "ts_us", "object_class", "track_id", "zone_id", "score",
        "evidence_bytes", "sync_state")


def _chain(spark, sf):
    # several queries read the chain more than once: link it once
    return cut(LG.append(_sealed(spark, sf)))


_Q = lambda e: f"CASE WHEN {e} IS NULL THEN 'null' ELSE '\"' || {e} || '\"' END"
BODY = f"""'{{"camera":' || {_Q('camera_id')} || ',"clip_sha256":null,"event_id":' || event_id ||
 ',"frame_sha256":null,"mono_ns":null,"node":' || {_Q('node_id')} || ',"object":' || {_Q('object_class')} ||
 ',"score":"' || CAST(CAST(score AS DECIMAL(6, 4)) AS VARCHAR) || '","track":' || track_id || ',"ts":' || ts_us ||
 ',"type":' || {_Q('event_kind')} || ',"zone":' || {_Q('zone_id')} || '}}'"""
CHAIN = "WITH RECURSIVE " + X.OBS + ",\n" + X.LOG + f""",
body AS (SELECT *, sha256({BODY}) AS body FROM log),
seq AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ts_us, event_id) AS n FROM body WHERE sealed),
chain(node_id, n, event_id, prev_hash, entry_hash) AS (
 SELECT node_id, n, event_id, '', sha256(n || '||' || body) FROM seq WHERE n = 1
 UNION ALL SELECT s.node_id, s.n, s.event_id, c.entry_hash, sha256(s.n || '|' || c.entry_hash || '|' || s.body)
 FROM chain c JOIN seq s ON s.node_id = c.node_id AND s.n = c.n + 1)"""


@query("ledger_append", CHAIN + " SELECT node_id, event_id, n AS ledger_index, prev_hash, entry_hash FROM chain")
def ledger_append(spark, sf):
    return _chain(spark, sf).select("node_id", "event_id", "ledger_index", "prev_hash", "entry_hash")


def _tampered(chain):
    """Scores edited on one node, an entry deleted on another, the rest intact."""
    edited = F.when((F.col("node_id") == "click") & (F.col("ledger_index") % 101 == 50), F.lit(0.9999)).otherwise(F.col("score"))
    gone = (F.col("node_id") == "view") & (F.col("ledger_index") == 77)
    return chain.withColumn("score", edited).where(~gone)


@query("ledger_verify", CHAIN + """ SELECT node_id, count(*) - CASE WHEN node_id = 'view' AND count(*) >= 77 THEN 1 ELSE 0 END AS entries,
 CASE WHEN node_id = 'click' THEN min(CASE WHEN n % 101 = 50 THEN n END) WHEN node_id = 'view' THEN min(CASE WHEN n = 78 THEN n END) END AS broken_at,
 CASE node_id WHEN 'click' THEN 'content' WHEN 'view' THEN 'link' END AS problem,
 max_by(entry_hash, n) AS head, node_id NOT IN ('click', 'view') AS valid FROM chain GROUP BY node_id""")
def ledger_verify(spark, sf):
    """A full chain, two kinds of tampering, and the first break per node."""
    return LG.verify(_tampered(_chain(spark, sf)))


@query("ledger_verify_at_core", CHAIN + """ SELECT node_id, count(*) - CASE WHEN node_id = 'view' THEN 1 ELSE 0 END AS entries,
 CASE WHEN node_id = 'click' THEN min(CASE WHEN n % 101 = 50 THEN n END) WHEN node_id = 'view' THEN min(CASE WHEN n = 78 THEN n END) END AS broken_at,
 node_id NOT IN ('click', 'view') AS valid FROM chain GROUP BY node_id""")
def ledger_verify_at_core(spark, sf):
    return LG.verify_at_core(_tampered(_chain(spark, sf)))


@query("ledger_sweep", CHAIN + """, loose AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY ts_us, event_id) AS k
 FROM log WHERE NOT sealed AND event_id % 4 <> 0)
SELECT l.node_id, l.event_id, l.k + h.top AS ledger_index, l.k = 1 AS follows_head FROM loose l
 JOIN (SELECT node_id, max(n) AS top FROM chain GROUP BY node_id) h USING (node_id)""")
def ledger_sweep(spark, sf):
    """Seal what was left unsealed, after the existing heads; pending clips wait."""
    chain = _chain(spark, sf)
    log = _log(spark, sf).withColumn("ledger_index", F.when(F.col("sealed"), 1).otherwise(0))
    waiting = log.where("event_id % 4 = 0").select("event_id")
    heads = LG.heads(chain)
    swept = LG.append(LG.unsealed(log, waiting), heads)
    return swept.join(heads.select("node_id", F.col("entry_hash").alias("_h")), "node_id").select(
        "node_id", "event_id", "ledger_index", (F.col("prev_hash") == F.col("_h")).alias("follows_head"))


@query("ledger_heads", CHAIN + " SELECT node_id, max(n) AS ledger_index, max_by(entry_hash, n) AS entry_hash FROM chain GROUP BY node_id")
def ledger_heads(spark, sf):
    return LG.heads(_chain(spark, sf))


@query("ledger_certificate", CHAIN + """ SELECT c.node_id, count(*) AS entries, max_by(c.entry_hash, c.n) AS head, TRUE AS valid,
 min(s.ts_us) AS from_us, max(s.ts_us) AS to_us FROM chain c JOIN seq s USING (event_id) GROUP BY c.node_id""")
def ledger_certificate(spark, sf):
    return LG.certificate(_chain(spark, sf)).select("node_id", "entries", "head", "valid", "from_us", "to_us")


@query("ledger_certificate_records", CHAIN + """ SELECT c.node_id, c.n AS ledger_index, c.event_id, c.entry_hash AS entry_sha256, s.camera_id, s.event_kind AS event_type,
 strftime(make_timestamp(s.ts_us), '%Y-%m-%dT%H:%M:%S.%f') AS timestamp FROM chain c JOIN seq s ON s.event_id = c.event_id AND s.node_id = c.node_id""")
def ledger_certificate_records(spark, sf):
    """The hash of every sealed entry and the event behind it."""
    return LG.certificate_records(_chain(spark, sf), _sealed(spark, sf))


# --- notary -------------------------------------------------------------------------
_IPAD = bytes(b ^ 0x36 for b in SECRET.encode().ljust(64, b"\0")).hex()
_OPAD = bytes(b ^ 0x5C for b in SECRET.encode().ljust(64, b"\0")).hex()
_SIGN = lambda m: f"sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode({m}))))"


def _checkpoints(spark, sf, chain):
    """Two witnessing rounds: the first half of every chain, then all of it."""
    entries = chain.select("node_id", "ledger_index", "entry_hash")
    none = spark.createDataFrame([], NT.CHECKPOINT)
    top = entries.groupBy("node_id").agg(F.max("ledger_index").alias("_t"))
    half = entries.join(top, "node_id").where(F.col("ledger_index") <= F.ceil(F.col("_t") / 2)).drop("_t")
    first = NT.witness(half, none, STAMP1, SECRET)
    return first.unionByName(NT.witness(entries, first, STAMP2, SECRET))


CPS = f""", top AS (SELECT node_id, max(n) AS t FROM chain GROUP BY node_id),
cp1 AS (SELECT c.node_id, c.n AS ledger_index, c.entry_hash, '{STAMP1}' AS witnessed_at, '' AS core_prev_sig FROM chain c
 JOIN top USING (node_id) WHERE c.n = ceil(t / 2)),
cs1 AS (SELECT *, {_SIGN("node_id || '|' || ledger_index || '|' || entry_hash || '|' || witnessed_at || '|' || core_prev_sig")} AS core_sig FROM cp1),
cp2 AS (SELECT c.node_id, c.n AS ledger_index, c.entry_hash, '{STAMP2}' AS witnessed_at, s.core_sig AS core_prev_sig FROM chain c
 JOIN top USING (node_id) JOIN cs1 s ON s.node_id = c.node_id WHERE c.n = t AND t > s.ledger_index),
cps AS (SELECT * FROM cs1 UNION ALL SELECT *,
 {_SIGN("node_id || '|' || ledger_index || '|' || entry_hash || '|' || witnessed_at || '|' || core_prev_sig")} FROM cp2)"""


@query("notary_checkpoints", CHAIN + CPS + " SELECT * FROM cps")
def notary_checkpoints(spark, sf):
    return _checkpoints(spark, sf, _chain(spark, sf))


@query("notary_verify", CHAIN + CPS + """ SELECT node_id, count(*) AS checkpoints,
 CASE WHEN node_id = 'error' THEN max(ledger_index) END AS broken_at, node_id <> 'error' AS valid,
 CASE WHEN node_id = 'error' THEN 0 ELSE max(ledger_index) END AS witnessed_up_to FROM cps GROUP BY node_id""")
def notary_verify(spark, sf):
    """One forged signature on one node's newest checkpoint."""
    c = _checkpoints(spark, sf, _chain(spark, sf))
    forged = (F.col("node_id") == "error") & (F.col("witnessed_at") == STAMP2)
    return NT.verify_checkpoints(c.withColumn("core_sig", F.when(forged, F.sha2("core_sig", 256)).otherwise(F.col("core_sig"))), SECRET)


def _restamped(spark, sf):
    """An insider edits one event of a node and re-links everything after it."""
    evil = F.when((F.col("node_id") == "signup") & (F.col("event_id") % 50 == 7), F.lit(0.0001)).otherwise(F.col("score"))
    return LG.append(_sealed(spark, sf).withColumn("score", evil))


@query("notary_audit", CHAIN + CPS + """ SELECT node_id, CASE WHEN node_id = 'signup' THEN min(ledger_index) END AS broken_at,
 node_id <> 'signup' AS no_rewrite FROM cps GROUP BY node_id""")
def notary_audit(spark, sf):
    """The re-linked chain is valid on its own but not against the checkpoints."""
    good = _chain(spark, sf)
    return NT.audit(_restamped(spark, sf).select("node_id", "ledger_index", "entry_hash"), _checkpoints(spark, sf, good))


@query("notary_latest", CHAIN + CPS + " SELECT * FROM cps QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY ledger_index DESC) = 1")
def notary_latest(spark, sf):
    return NT.latest_checkpoint(_checkpoints(spark, sf, _chain(spark, sf)))


# --- sync ------------------------------------------------------------------------------
LOGQ = X.with_sql(X.OBS, X.LOG)


@query("sync_pending_queue", LOGQ + """SELECT event_id, rank, ts_us FROM log WHERE sync_state IN ('pending', 'failed', 'evidence_evicted')
 AND sealed ORDER BY rank DESC, ts_us, event_id LIMIT 25""")
def sync_pending_queue(spark, sf):
    return SY.pending_queue(_log(spark, sf), 25).select("event_id", "rank", "ts_us")


BATCHES = """inc AS (SELECT *, event_id % 3 = 0 AS late, CASE WHEN event_id % 4 = 0 THEN 60000000 ELSE 2000000 END AS drift_us,
 event_id % 10 <> 0 AS trusted FROM log WHERE sealed)"""


def _incoming(spark, sf, chain):
    e = F.col("event_id")
    return chain.select("*", F.when(e % 4 == 0, 60_000_000).otherwise(2_000_000).alias("drift_us"),
                        (e % 10 != 0).alias("clock_trusted")).withColumns({
        "sent_us": F.col("ts_us") + 1_000_000, "received_us": F.col("ts_us") + 1_000_000 + F.col("drift_us"),
        "entry_hash": F.when((F.col("node_id") == "signup") & (e % 50 == 7), F.sha2("entry_hash", 256)).otherwise(F.col("entry_hash"))})


@query("sync_ingest", CHAIN + CPS + """ SELECT c.event_id, CASE WHEN l.sync_state = 'synced' THEN 'duplicate'
 WHEN c.node_id = 'signup' AND c.event_id % 50 = 7 AND p.ledger_index IS NOT NULL THEN 'rejected' ELSE 'accepted' END AS outcome,
 (c.event_id % 4 = 0 OR c.event_id % 10 = 0) AS clock_corrected,
 l.ts_us + CASE WHEN c.event_id % 4 = 0 THEN 60000000 WHEN c.event_id % 10 = 0 THEN 2000000 ELSE 0 END AS ts_us
FROM chain c JOIN log l USING (event_id) LEFT JOIN cps p ON p.node_id = c.node_id AND p.ledger_index = c.n""")
def sync_ingest(spark, sf):
    """Replayed batches against a core that already holds part of them."""
    chain = _chain(spark, sf)
    known = _log(spark, sf).select("event_id", "sync_state")
    out = SY.classify(SY.correct_clock(_incoming(spark, sf, chain).drop("sync_state")), known, _checkpoints(spark, sf, chain))
    return out.select("event_id", "outcome", "clock_corrected", "ts_us")


@query("sync_mark_outcome", LOGQ + """SELECT event_id, CASE WHEN sync_state IN ('pending', 'failed') AND sealed THEN
 CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'synced' END ELSE sync_state END AS sync_state FROM log""")
def sync_mark_outcome(spark, sf):
    log = _log(spark, sf)
    replies = log.where("sync_state IN ('pending', 'failed') AND sealed").select("event_id", (F.col("event_id") % 7 != 0).alias("accepted"))
    return SY.mark_outcome(log, replies, 1).select("event_id", "sync_state")


@query("sync_queue_bytes", LOGQ + """SELECT node_id, CAST(sum(CASE WHEN sync_state <> 'synced' THEN evidence_bytes ELSE 0 END) AS BIGINT) AS queue_bytes
 FROM log GROUP BY node_id""")
def sync_queue_bytes(spark, sf):
    return SY.queue_bytes(_log(spark, sf))


LINK_SETTINGS = {"as shipped": (25, 50_000_000), "large batches": (1_000_000_000, 50_000_000), "large queue": (1_000_000_000, 1_000_000_000_000_000)}


@query("sync_link_mode", LOGQ + "," + X.values_sql("settings", "setting, batch, cap", [(k, *v) for k, v in LINK_SETTINGS.items()]) + """, s AS (
 SELECT node_id, count(*) FILTER (sync_state = 'pending') AS pending, CAST(sum(CASE WHEN sync_state <> 'synced' THEN evidence_bytes ELSE 0 END) AS BIGINT) AS bytes
 FROM log GROUP BY node_id)
SELECT setting, node_id, pending, bytes, CASE WHEN node_id = 'view' THEN 'offline' WHEN pending > batch THEN 'syncing'
 WHEN least(1, bytes / cap) > 0.75 THEN 'event_only' ELSE 'online' END AS link_mode FROM s, settings""")
def sync_link_mode(spark, sf):
    """Posture of every node over its whole backlog, under three settings of the link."""
    log = _log(spark, sf)
    reach = spark.createDataFrame([(c, c != "view") for c in X.CAMERAS], "node_id string, reachable boolean")
    each = [SY.link_mode(log, reach, Params(sync_batch=b, queue_cap_bytes=c)).select(F.lit(k).alias("setting"), "node_id", "pending", "bytes", "link_mode")
            for k, (b, c) in LINK_SETTINGS.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("sync_evictions", LOGQ + """, h AS (SELECT node_id, event_id, evidence_bytes, sum(evidence_bytes) OVER (PARTITION BY node_id) AS total,
 sum(evidence_bytes) OVER (PARTITION BY node_id ORDER BY rank, ts_us, event_id ROWS UNBOUNDED PRECEDING) AS freed
 FROM log WHERE sync_state <> 'synced' AND evidence_bytes > 0)
SELECT node_id, event_id, evidence_bytes, CAST(freed AS BIGINT) AS freed_bytes FROM h WHERE total > 100000000 AND total - (freed - evidence_bytes) > 85000000""")
def sync_evictions(spark, sf):
    return SY.evictions(_log(spark, sf), Params(queue_cap_bytes=100_000_000))


@query("sync_bandwidth", X.with_sql(X.OBS, X.LOG) + """, f AS (SELECT node_id, CAST(sum(event_id % 5000 + 90000) AS BIGINT) AS bo, count(*) AS n,
  (max(ts_us) - min(ts_us)) / 1e6 AS el, CAST(sum(CASE WHEN sync_state = 'synced' THEN 2200 END) AS BIGINT) AS bt,
  count(*) FILTER (sync_state = 'synced') AS es FROM log GROUP BY node_id)
SELECT node_id, bo AS bytes_observed, n AS frames_observed, bt AS bytes_transmitted, es AS events_sent,
 CAST(floor(bo * 8 / el) AS BIGINT) AS stream_bps, CAST(floor(bt * 8 / el) AS BIGINT) AS uplink_bps,
 round(greatest(0, 1 - bt / bo) * 100, 2) AS reduction_percent FROM f""")
def sync_bandwidth(spark, sf):
    log = _log(spark, sf)
    frames = log.select("node_id", "ts_us", (F.col("event_id") % 5000 + 90000).alias("frame_bytes"))
    sent = log.where("sync_state = 'synced'").select("node_id", F.lit(2200).cast("long").alias("sent_bytes"))
    return SY.bandwidth(frames, sent).drop("elapsed_s")


@query("sync_retention_age", LOGQ + """SELECT event_id FROM log WHERE evidence_bytes > 0 AND ts_us < epoch_us(TIMESTAMP '2024-02-15') - 30 * 86400000000""")
def sync_retention_age(spark, sf):
    ev = _log(spark, sf).where("evidence_bytes > 0")
    return SY.expired(ev, F.unix_micros(F.lit("2024-02-15").cast("timestamp"))).select("event_id")


@query("sync_retention_cap", LOGQ + """SELECT event_id FROM log WHERE evidence_bytes > 0
 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY ts_us DESC, event_id) > 300""")
def sync_retention_cap(spark, sf):
    ev = _log(spark, sf).where("evidence_bytes > 0").select("node_id", "event_id", "ts_us")
    return SY.over_cap(ev, Params(retention_packages=300)).select("event_id")


@query("sync_node_registry", LOGQ + """, b AS (SELECT node_id, ts_us // 86400000000 AS day, max(ts_us) + 1000000 AS sent, count(*) AS n FROM log GROUP BY ALL),
r AS (SELECT *, sent + 1000000 * (day % 9) AS received FROM b)
SELECT node_id, max(received) AS last_seen_us, round(max_by((received - sent) / 1e6, received), 3) AS clock_offset_s,
 max_by(day % 5 <> 0, received) AS clock_trusted, CAST(sum(n) AS BIGINT) AS events_received FROM r GROUP BY node_id""")
def sync_node_registry(spark, sf):
    """Daily batches of every node, reduced to one registry row per node."""
    day = F.floor(F.col("ts_us") / 86_400_000_000).cast("long")
    b = _log(spark, sf).withColumn("day", day).groupBy("node_id", "day").agg(
        (F.max("ts_us") + 1_000_000).alias("sent_us"), F.count("*").alias("n_events"))
    b = b.withColumns({"received_us": F.col("sent_us") + F.col("day") % 9 * 1_000_000, "clock_trusted": F.col("day") % 5 != 0})
    return SY.node_registry(b)


@query("sync_bundle_check", """SELECT page_id AS name, CASE WHEN page_id % 20 = 3 THEN 'missing' WHEN page_id % 17 = 5 THEN 'mismatch' ELSE 'ok' END AS status FROM pages""")
def sync_bundle_check(spark, sf):
    """Package contents against a manifest; some files altered or lost."""
    p = X.table(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    manifest = p.select(F.col("page_id").alias("name"), F.sha2("html", 256).alias("sha256"))
    altered = F.when(F.col("page_id") % 17 == 5, F.concat("html", F.lit("!"))).otherwise(F.col("html"))
    files = p.where("page_id % 20 <> 3").select(F.col("page_id").alias("name"), altered.cast("binary").alias("content"))
    return SY.verify_bundle(files, manifest).select("name", "status")


# --- event log ----------------------------------------------------------------------------
@query("events_page", LOGQ + """SELECT event_id, ts_us FROM log WHERE rank >= 2 AND camera_id = 'click' AND NOT acknowledged
 ORDER BY ts_us DESC, event_id DESC LIMIT 100 OFFSET 20""")
def events_page(spark, sf):
    return EV.list_events(_log(spark, sf), 100, 20, camera_id="click", min_rank=2, unacknowledged=True).select("event_id", "ts_us")


@query("events_by_id", LOGQ + "SELECT event_id, camera_id, score FROM log WHERE event_id = 123")
def events_by_id(spark, sf):
    return EV.get_event(_log(spark, sf), 123).select("event_id", "camera_id", "score")


@query("events_by_state", LOGQ + "SELECT sync_state, count(*) AS events FROM log GROUP BY sync_state")
def events_by_state(spark, sf):
    return EV.counts_by_state(_log(spark, sf))


@query("events_alerts_since", LOGQ + """SELECT node_id, count(*) AS alerts FROM log WHERE ts_us >= epoch_us(TIMESTAMP '2024-01-20') AND rank >= 2 AND alerted GROUP BY node_id""")
def events_alerts_since(spark, sf):
    return EV.alerts_since(_log(spark, sf), F.unix_micros(F.lit("2024-01-20").cast("timestamp")))


def _registry(spark, sf):
    """A camera registry: suppliers as cameras, spread over the nodes."""
    s = X.table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("camera_id"), F.element_at(F.array(*[F.lit(c) for c in X.CAMERAS]),
                    (F.col("s_nationkey") % 5 + 1).cast("int")).alias("node_id"),
                    F.when(F.col("s_acctbal") > 0, "online").otherwise("offline").alias("health"))


@query("events_system_status", LOGQ + """, c AS (SELECT (['click','error','purchase','signup','view'])[s_nationkey % 5 + 1] AS node_id, s_acctbal > 0 AS up FROM supplier)
SELECT e.*, coalesce(k.cameras_total, 0) AS cameras_total, coalesce(k.cameras_online, 0) AS cameras_online FROM (
 SELECT node_id, count(*) AS events_total, count(*) FILTER (sync_state = 'pending') AS events_pending,
 CAST(sum(CASE WHEN sync_state <> 'synced' THEN evidence_bytes ELSE 0 END) AS BIGINT) AS queue_bytes,
 count(*) FILTER (ts_us >= epoch_us(TIMESTAMP '2024-01-30 23:00:00') AND rank >= 2 AND alerted) AS alerts_last_hour FROM log GROUP BY node_id) e
LEFT JOIN (SELECT node_id, count(*) AS cameras_total, count(*) FILTER (up) AS cameras_online FROM c GROUP BY node_id) k USING (node_id)""")
def events_system_status(spark, sf):
    return EV.system_status(_log(spark, sf), _registry(spark, sf), F.unix_micros(F.lit("2024-01-30 23:00:00").cast("timestamp")))


@query("events_alert_queue", LOGQ + "SELECT event_id, score FROM log WHERE alerted AND NOT acknowledged ORDER BY score DESC, ts_us DESC, event_id DESC LIMIT 50")
def events_alert_queue(spark, sf):
    return EV.alert_queue(_log(spark, sf), 50).select("event_id", "score")


@query("events_new_alerts", LOGQ + "SELECT event_id FROM log WHERE rank >= 3 AND alerted AND NOT (event_id % 5 = 0)")
def events_new_alerts(spark, sf):
    log = _log(spark, sf)
    return EV.new_alerts(log, log.where("event_id % 5 = 0")).select("event_id")


@query("events_incidents", LOGQ + """, a AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER w <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM log WHERE alerted
 WINDOW w AS (PARTITION BY camera_id ORDER BY ts_us, event_id)),
b AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY camera_id ORDER BY ts_us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS incident_no FROM a)
SELECT camera_id, incident_no, min(ts_us) AS opened_us, max(ts_us) AS updated_us, count(*) AS alerts, max(rank) AS max_rank FROM b GROUP BY ALL""")
def events_incidents(spark, sf):
    return EV.incidents(_log(spark, sf), 6 * X.HOUR_US)


@query("events_delete_camera", LOGQ + "SELECT event_id, camera_id FROM log WHERE camera_id NOT IN ('view', 'error')")
def events_delete_camera(spark, sf):
    gone = spark.createDataFrame([("view",), ("error",)], "camera_id string")
    return EV.delete_cameras(_log(spark, sf), gone).select("event_id", "camera_id")


@query("events_config_rows", """SELECT s_suppkey AS camera_id, s_acctbal > 0 AS active FROM supplier WHERE s_acctbal > 0""")
def events_config_rows(spark, sf):
    reg = _registry(spark, sf).withColumn("active", F.col("health") == "online")
    return EV.config_rows(reg, active=True).select("camera_id", "active")


@query("events_topic_filter", LOGQ + "SELECT event_id FROM log WHERE camera_id LIKE '%i%' AND node_id IN ('click', 'view')")
def events_topic_filter(spark, sf):
    """Subscription by subject glob: site.<node>.events.<camera>."""
    from ..sources.topics import subscribe
    log = _log(spark, sf).withColumn("kind", F.lit("events"))
    a = subscribe(log, "site.click.events.*i*")
    return a.unionByName(subscribe(log, "site.vie?.events.*i*")).select("event_id")


@query("events_as_of_certificate", LOGQ + """, v AS (SELECT camera_id, event_id AS version, ts_us AS issued FROM log WHERE event_id % 50 = 0)
SELECT l.event_id, max_by(v.version, v.issued) AS version FROM log l LEFT JOIN v ON v.camera_id = l.camera_id AND v.issued <= l.ts_us GROUP BY l.event_id""")
def events_as_of_certificate(spark, sf):
    """Certificate version in force on the camera when each event happened."""
    log = _log(spark, sf)
    versions = log.where("event_id % 50 = 0").select("camera_id", F.col("event_id").alias("version"), F.col("ts_us").alias("issued_us"))
    return EV.as_of(log, versions, "camera_id", "issued_us", ["version"]).select("event_id", "version")
