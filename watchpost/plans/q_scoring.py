"""Queries for scores, pattern of life, feedback and alert governance."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..operators import governor as GV
from ..operators import normalcy as N
from ..operators import rules as R
from ..operators import scoring as SC
from ..values import BASE_WEIGHT, CLASS_WEIGHT, ROUTINE_MOVEMENT, Params
from . import fixtures as X
from .q_rules import BASE, _members, _points, fenced_visits
from .registry import query

RECENT_S = 6 * 3600
HOW = "CAST((isodow(ts) - 1) * 24 + hour(ts) AS INT)"


# --- pattern of life ------------------------------------------------------------
def _counts(log):
    """Camera-wide and per-zone counts learnt from every event of the log."""
    wide = log.select("camera_id", F.lit("").alias("zone_id"), "object_class", "ts")
    zoned = log.where("zone_id IS NOT NULL").select("camera_id", "zone_id", "object_class", "ts")
    return N.learn(wide.unionByName(zoned))


COUNTS = f"""seen AS (SELECT camera_id, '' AS zone_id, object_class, ts FROM log UNION ALL
 SELECT camera_id, zone_id, object_class, ts FROM log WHERE zone_id IS NOT NULL),
counts AS (SELECT camera_id, zone_id, object_class, {HOW} AS hour_of_week, CAST(count(*) AS DOUBLE) AS cnt
 FROM seen GROUP BY ALL)"""
VERDICT = f"""totals AS (SELECT camera_id, zone_id, object_class, sum(cnt) AS total FROM counts GROUP BY ALL),
rec AS (SELECT *, coalesce(zone_id, '') AS z, {HOW} AS hour_of_week,
 count(*) OVER (PARTITION BY camera_id, coalesce(zone_id, ''), object_class ORDER BY ts
  RANGE BETWEEN INTERVAL {RECENT_S} SECONDS PRECEDING AND CURRENT ROW) - 1 AS recent FROM log),
joined AS (SELECT r.*, coalesce(c.cnt, 0) AS bucket, coalesce(t.total, 0) AS total,
  coalesce(t.total, 0) / 168 AS average FROM rec r
 LEFT JOIN counts c ON c.camera_id = r.camera_id AND c.zone_id = r.z AND c.object_class = r.object_class
  AND c.hour_of_week = r.hour_of_week
 LEFT JOIN totals t ON t.camera_id = r.camera_id AND t.zone_id = r.z AND t.object_class = r.object_class),
bursts AS (SELECT *, greatest(bucket, average) * {RECENT_S / 3600} AS due FROM joined),
verdict AS (SELECT *, round(average / greatest(bucket, 0.5) * greatest(1, sqrt(CASE WHEN due > 0 AND recent > due * 2
  AND recent >= 3 THEN recent / due ELSE 1 END)), 2) AS normalcy_ratio,
 CAST(floor(total) AS BIGINT) AS normalcy_samples, round(average, 2) AS normalcy_expected FROM bursts),
judged AS (SELECT *, normalcy_samples >= 5 AND normalcy_ratio >= 2 AS is_unusual,
 normalcy_samples >= 5 AND normalcy_ratio <= 0.6 AS is_routine FROM verdict)"""
LOGSQL = X.with_sql(X.OBS, X.LOG, COUNTS, VERDICT)


@query("normalcy_learn", BASE + f""", seen AS (SELECT camera_id, '' AS zone_id, object_class, ts FROM feat WHERE hits = 3
 UNION ALL SELECT camera_id, zone_id, object_class, ts FROM members WHERE hits = 3 AND in_zone)
SELECT camera_id, zone_id, object_class, {HOW} AS hour_of_week, CAST(count(*) AS DOUBLE) AS "count"
FROM seen GROUP BY ALL""")
def normalcy_learn(spark, sf):
    return N.learn(N.observations(_points(spark, sf), _members(spark, sf), 3))


@query("normalcy_evaluate", LOGSQL + """SELECT event_id, CAST(recent AS BIGINT) AS recent, normalcy_ratio,
 normalcy_samples, normalcy_expected, is_unusual, is_routine FROM judged""")
def normalcy_evaluate(spark, sf):
    log = X.event_log(spark, sf)
    return N.evaluate(log, _counts(log), recent_s=RECENT_S).select(
        "event_id", "recent", "normalcy_ratio", "normalcy_samples", "normalcy_expected", "is_unusual", "is_routine")


@query("normalcy_recent", X.with_sql(X.OBS, X.LOG) + """SELECT event_id, count(*) OVER (
 PARTITION BY camera_id, coalesce(zone_id, ''), object_class ORDER BY ts
 RANGE BETWEEN INTERVAL 600 SECONDS PRECEDING AND CURRENT ROW) - 1 AS recent FROM log""")
def normalcy_recent(spark, sf):
    return N.recent_counts(X.event_log(spark, sf), 600).select("event_id", "recent")


@query("normalcy_decay", X.with_sql(X.OBS, X.LOG, COUNTS) + """SELECT camera_id, zone_id, object_class, hour_of_week,
 round(cnt * pow(0.5e0, 240 / 45e0), 6) AS "count" FROM counts WHERE cnt * pow(0.5e0, 240 / 45e0) >= 0.05""")
def normalcy_decay(spark, sf):
    d = N.decay(_counts(X.event_log(spark, sf)), 240.0)
    return d.withColumn("count", X.r6(F.col("count")))


@query("normalcy_decay_on_read", X.with_sql(X.OBS) + f"""SELECT camera_id, '' AS zone_id, object_class,
 {HOW} AS hour_of_week, round(sum(pow(0.5e0, ((epoch_us(TIMESTAMP '2024-03-01') - ts_us) / 8.64e10) / 45)), 4) AS "count"
FROM obs GROUP BY ALL HAVING sum(pow(0.5e0, ((epoch_us(TIMESTAMP '2024-03-01') - ts_us) / 8.64e10) / 45)) >= 0.05""")
def normalcy_decay_on_read(spark, sf):
    o = X.obs(spark, sf).withColumn("zone_id", F.lit(""))
    d = N.decayed_on_read(o, F.lit("2024-03-01").cast("timestamp"))
    return d.withColumn("count", F.round("count", 4))


@query("normalcy_merge", X.with_sql(X.OBS, X.LOG, COUNTS) + """, weekly AS (SELECT * FROM counts UNION ALL
 SELECT p.camera_id, p.zone_id, p.object_class, CAST(h.h AS INT), CASE WHEN h.h % 24 BETWEEN 8 AND 17 THEN 40e0 ELSE 1e0 END
 FROM (SELECT DISTINCT camera_id, zone_id, object_class FROM counts) p CROSS JOIN range(168) h(h))
SELECT camera_id, zone_id, object_class, hour_of_week, sum(cnt) AS "count" FROM weekly GROUP BY ALL""")
def normalcy_merge(spark, sf):
    """A seeded weekly rhythm plus what was learnt, by additive upsert."""
    learnt = _counts(X.event_log(spark, sf))
    return N.merge_counts(N.seed(learnt.select(*N.PLACE).distinct(), 8, 18), learnt)


@query("normalcy_spread", X.with_sql(X.OBS) + """, vol AS (SELECT camera_id, '' AS zone_id, object_class,
 count(*) AS volume FROM obs GROUP BY ALL)
SELECT camera_id, zone_id, object_class, CAST(h.h AS INT) AS hour_of_week,
 round(CASE WHEN h.h % 24 BETWEEN 7 AND 18 THEN volume * 0.9e0 / 84 ELSE volume * 0.1e0 / 84 END, 6) AS "count"
FROM vol CROSS JOIN range(168) h(h)""")
def normalcy_spread(spark, sf):
    vol = X.obs(spark, sf).groupBy("camera_id", "object_class").agg(F.count("*").alias("volume"))
    out = N.spread(vol.withColumn("zone_id", F.lit("")))
    return out.withColumn("count", X.r6(F.col("count")))


def _suppressed(spark, sf):
    log = X.event_log(spark, sf).withColumn("event_type", F.col("event_kind"))
    ev = N.evaluate(log, _counts(log), recent_s=RECENT_S)
    return N.suppress_routine(ev.join(X.cameras(spark).select("camera_id", "profile"), "camera_id"))


SUPPRESS = "," + X.CAMS + """, sup AS (SELECT j.*, (c.profile = 'fenced' AND event_kind IN
 ('line_crossing', 'zone_intrusion', 'wrong_direction')) OR NOT is_routine AS kept FROM judged j JOIN cams c USING (camera_id))"""


@query("normalcy_suppression", LOGSQL + SUPPRESS + " SELECT event_id, kept FROM sup")
def normalcy_suppression(spark, sf):
    return _suppressed(spark, sf).select("event_id", "kept")


@query("eval_normalcy_before_after", LOGSQL + SUPPRESS + """ SELECT camera_id, count(*) AS raw_events,
 count(*) FILTER (alerted) AS alerts_before, count(*) FILTER (alerted AND kept) AS alerts_after,
 count(*) FILTER (NOT kept) AS suppressed, count(*) FILTER (kept) AS kept_events,
 count(*) FILTER (kept AND is_unusual) AS unusual FROM sup GROUP BY camera_id""")
def eval_normalcy_before_after(spark, sf):
    return N.before_after(_suppressed(spark, sf))


# --- feedback ---------------------------------------------------------------------
@query("feedback_summary", X.with_sql(X.VERDICTS) + """SELECT CASE WHEN grouping(camera_id) = 1 THEN 'all' ELSE camera_id END
 AS camera_id, count(*) FILTER (verdict = 'true_positive') AS true_positive,
 count(*) FILTER (verdict = 'false_alarm') AS false_alarm, count(*) AS reviewed,
 round(count(*) FILTER (verdict = 'false_alarm') / count(*), 4) AS false_alarm_rate
FROM verdicts GROUP BY ROLLUP (camera_id)""")
def feedback_summary(spark, sf):
    return N.feedback_summary(X.verdicts(spark, sf))


@query("feedback_stats", X.with_sql(X.VERDICTS) + """SELECT camera_id, event_type,
 count(*) FILTER (verdict = 'true_positive') AS fb_true, count(*) FILTER (verdict = 'false_alarm') AS fb_false
FROM verdicts GROUP BY ALL""")
def feedback_stats(spark, sf):
    return N.feedback_stats(X.verdicts(spark, sf))


def _acks(spark, sf):
    """Two rounds of operator review over the log; the later one wins."""
    o = X.obs(spark, sf).where("event_id % 3 = 0")
    return (o.select("event_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("round"))
            .where("round = 1 OR event_id % 2 = 0")
            .select("event_id", F.when((F.col("event_id") + F.col("round")) % 4 == 0, "true_positive")
                    .otherwise("false_alarm").alias("verdict"),
                    F.concat(F.lit("round "), F.col("round").cast("string")).alias("note"),
                    F.col("round").cast("long").alias("ack_us")))


ACKED = """acks AS (SELECT event_id, r.r AS ack_us, CASE WHEN (event_id + r.r) % 4 = 0 THEN 'true_positive'
  ELSE 'false_alarm' END AS verdict, 'round ' || r.r AS note FROM obs CROSS JOIN range(1, 3) r(r)
 WHERE event_id % 3 = 0 AND (r.r = 1 OR event_id % 2 = 0)),
acked AS (SELECT l.*, a.verdict, a.note FROM log l LEFT JOIN (SELECT * FROM acks QUALIFY row_number() OVER (
 PARTITION BY event_id ORDER BY ack_us DESC) = 1) a USING (event_id))"""


@query("feedback_acknowledge", X.with_sql(X.OBS, X.LOG, ACKED) + """SELECT event_id,
 acknowledged OR verdict IS NOT NULL AS acknowledged, verdict, note AS ack_note FROM acked""")
def feedback_acknowledge(spark, sf):
    return N.acknowledge(X.event_log(spark, sf), _acks(spark, sf)).select(
        "event_id", "acknowledged", "verdict", "ack_note")


# --- scores -------------------------------------------------------------------------
def scored(spark, sf):
    """Every logged event with its full scoring context."""
    log = X.event_log(spark, sf).withColumn("event_type", F.col("event_kind"))
    ev = N.evaluate(log, _counts(log), recent_s=RECENT_S)
    fb = N.feedback_stats(N.acknowledge(log, _acks(spark, sf)).where("verdict IS NOT NULL").select(
        "camera_id", "event_type", "verdict"))
    ev = ev.join(fb, ["camera_id", "event_type"], "left").join(
        X.cameras(spark).select("camera_id", "is_night"), "camera_id")
    e = F.col("event_id")
    ev = ev.withColumns({
        "capability_supported": e % 7 != 0, "group_size": e % 5, "dwell_s": (e % 100).cast("double"),
        "speed_mps": F.when(e % 3 == 0, (e % 9).cast("double")), "near_boundary": e % 2 == 0,
        "low_profile": (e % 19 == 0) & (F.col("object_class") == "person"),
        "extras": F.when(e % 10 == 0, F.array(F.struct(F.lit("inbound crossing").alias("name"),
                                                        F.lit(0.1).alias("weight"))))})
    return SC.score(ev.drop("score", "rank"))


def _case(table: dict, col: str, default: float) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in table.items()) + f" ELSE {default}e0 END"


_RM = ", ".join(f"'{t}'" for t in ROUTINE_MOVEMENT)
SCORED = ", " + ACKED + ", " + X.CAMS + f""", fb AS (SELECT camera_id, event_kind,
  count(*) FILTER (verdict = 'true_positive') AS fb_true, count(*) FILTER (verdict = 'false_alarm') AS fb_false
 FROM acked WHERE verdict IS NOT NULL GROUP BY ALL),
ctx AS (SELECT j.*, c.is_night, coalesce(fb.fb_true, 0) AS fb_true, coalesce(fb.fb_false, 0) AS fb_false,
  least(1e0, normalcy_samples / 60) AS evidence, coalesce(fb.fb_true, 0) + coalesce(fb.fb_false, 0) AS reviews
 FROM judged j JOIN cams c USING (camera_id) LEFT JOIN fb USING (camera_id, event_kind)),
parts AS (SELECT event_id, {_case(BASE_WEIGHT, 'event_kind', 0.3)} AS f1, {_case(CLASS_WEIGHT, 'object_class', 0.0)} AS f2,
 CASE WHEN is_night THEN 0.12e0 ELSE 0 END AS f3,
 CASE WHEN normalcy_samples >= 5 AND normalcy_ratio >= 2 THEN round(least(0.22e0, 0.07e0 * normalcy_ratio) * evidence, 3)
  WHEN normalcy_samples >= 5 AND normalcy_ratio <= 1.3 THEN round((-0.16e0 - CASE WHEN event_kind IN ({_RM})
   AND normalcy_expected > 3 THEN least(0.34e0, 0.045e0 * normalcy_expected) ELSE 0 END) * evidence, 3) ELSE 0 END AS f4,
 CASE WHEN reviews >= 4 AND fb_false / reviews >= 0.5 THEN round(-0.28e0 * fb_false / reviews, 3)
  WHEN reviews >= 4 AND fb_false / reviews <= 0.2 THEN 0.08e0 ELSE 0 END AS f5,
 round((confidence - 0.6e0) * 0.2e0, 3) AS f6, CASE WHEN event_id % 7 = 0 THEN -0.2e0 ELSE 0 END AS f7,
 CASE WHEN event_id % 5 >= 3 THEN least(0.18e0, 0.05e0 * (event_id % 5)) ELSE 0 END AS f8,
 CASE WHEN event_id % 100 >= 60 THEN 0.09e0 ELSE 0 END AS f9,
 CASE WHEN event_id % 3 = 0 AND event_id % 9 > 6 THEN 0.08e0 ELSE 0 END AS f10,
 CASE WHEN event_id % 2 = 0 THEN 0.07e0 ELSE 0 END AS f11,
 CASE WHEN event_id % 19 = 0 AND object_class = 'person' THEN 0.14e0 ELSE 0 END AS f12,
 CASE WHEN event_id % 10 = 0 THEN 0.1e0 ELSE 0 END AS f13 FROM ctx),
final AS (SELECT event_id, round(greatest(0e0, least(1e0,
 f1 + f2 + f3 + f4 + f5 + f6 + f7 + f8 + f9 + f10 + f11 + f12 + f13)), 3) AS score FROM parts)"""
BAND = """CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.65 THEN 'high'
 WHEN score >= 0.45 THEN 'medium' WHEN score >= 0.25 THEN 'low' ELSE 'info' END"""


@query("score_events", LOGSQL + SCORED + f" SELECT event_id, score, {BAND} AS priority FROM final")
def score_events(spark, sf):
    return scored(spark, sf).select("event_id", "score", "priority")


FACTORS = """[{'n': 'event type', 'w': f1}, {'n': 'object class', 'w': f2},
 {'n': 'night conditions', 'w': f3}, {'n': CASE WHEN f4 > 0 THEN 'unusual for this time' ELSE 'routine for this camera' END, 'w': f4},
 {'n': 'operator feedback', 'w': f5}, {'n': 'detection confidence', 'w': f6}, {'n': 'outside certified region', 'w': f7},
 {'n': 'group size', 'w': f8}, {'n': 'extended dwell', 'w': f9}, {'n': 'high speed', 'w': f10},
 {'n': 'proximity to boundary', 'w': f11}, {'n': 'low-profile posture', 'w': f12}, {'n': 'inbound crossing', 'w': f13}]"""


@query("score_factor_totals", LOGSQL + SCORED + f", u AS (SELECT unnest({FACTORS}) AS f FROM parts)" + """
SELECT f.n AS factor, count(*) AS events, round(sum(f.w), 3) AS total_weight FROM u WHERE abs(f.w) > 1e-6 GROUP BY f.n""")
def score_factor_totals(spark, sf):
    """How often each factor of the explanation applied, and its total weight."""
    f = scored(spark, sf).select(F.explode_outer("factors").alias("f"))
    shown = f.where("abs(f.weight) > 1e-6")
    return shown.groupBy(F.col("f.name").alias("factor")).agg(
        F.count("*").alias("events"), F.round(F.sum("f.weight"), 3).alias("total_weight"))


@query("score_explanations", LOGSQL + SCORED + f""", t AS (SELECT event_id, array_to_string(list_transform(list_filter({FACTORS}, lambda q: abs(q.w) > 1e-6),
 lambda q: q.n || CASE WHEN q.w < 0 THEN ' -' ELSE ' +' END || printf('%.2f', CAST(round(abs(CAST(q.w AS DECIMAL(12, 6))), 2) AS DOUBLE))), ' ') AS line FROM parts)
SELECT event_id, CASE WHEN line = '' THEN 'no contributing factors' ELSE line END AS explanation FROM t""")
def score_explanations(spark, sf):
    """One line per event that reads as the arithmetic of its score."""
    return scored(spark, sf).select("event_id", L.explain(F.col("factors")).alias("explanation"))


@query("scored_intrusions", BASE + """, hit AS (SELECT camera_id, track_id, zone_id, event_id, ts_us, object_class, confidence,
  is_night FROM members WHERE in_zone AND kind = 'polygon' AND NOT is_lawful_route AND profile = 'fenced'
 QUALIFY row_number() OVER (PARTITION BY camera_id, track_id, zone_id ORDER BY ts_us, event_id) = 1),
s AS (SELECT *, CASE WHEN object_class IN ('car', 'truck') THEN 0.26e0 ELSE 0.46e0 END
 + CASE object_class WHEN 'person' THEN 0.1e0 WHEN 'truck' THEN 0.09e0 WHEN 'car' THEN 0.06e0 ELSE -0.14e0 END
 + CASE WHEN is_night THEN 0.12e0 ELSE 0 END + round((confidence - 0.6e0) * 0.2e0, 3) AS raw FROM hit)
SELECT camera_id, track_id, zone_id, event_id, ts_us,
 CASE WHEN object_class IN ('car', 'truck') THEN 'vehicle_movement' ELSE 'zone_intrusion' END AS event_type,
 round(greatest(0e0, least(1e0, raw)), 3) AS score FROM s""")
def scored_intrusions(spark, sf):
    """Track points -> settled zone membership -> intrusions -> scores."""
    hits = R.intrusions(fenced_visits(spark, sf))
    hits = hits.join(X.cameras(spark).select("camera_id", "is_night"), "camera_id")
    return SC.score(hits).select("camera_id", "track_id", "zone_id", "event_id", "ts_us", "event_type", "score")


# --- governance -----------------------------------------------------------------------
BUDGET = Params(budget_per_hour=4)
GOV = "WITH RECURSIVE " + ",\n".join([X.OBS, X.LOG]) + """,
seq AS (SELECT node_id, event_id, ts_us, score, rank, object_class, row_number() OVER (
 PARTITION BY node_id ORDER BY ts_us, event_id) AS n FROM log),
gov(node_id, n, event_id, ts_us, bar, rung, alerted, recent) AS (
 SELECT node_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 0.25e0, CAST([] AS BIGINT[]), FALSE, CAST(0 AS BIGINT)
 FROM seq WHERE n = 1
 UNION ALL
 SELECT node_id, n, event_id, ts_us, bar, CASE WHEN rank >= 4 OR score >= bar THEN list_append(live, ts_us) ELSE live END,
  rank >= 4 OR score >= bar, CAST(len(live) AS BIGINT)
 FROM (SELECT node_id, n, event_id, ts_us, score, rank, live, CASE WHEN rank >= 4 THEN bar
    WHEN len(live) >= 4 THEN least(0.92e0, bar + 0.04e0)
    WHEN 1e0 - len(live) / 4 > 0.4 THEN greatest(0.25e0, bar - 0.01e0) ELSE bar END AS bar
  FROM (SELECT s.node_id, s.n, s.event_id, s.ts_us, s.score, s.rank, g.bar,
    list_filter(g.rung, lambda r: r >= s.ts_us - 3600000000) AS live
   FROM gov g JOIN seq s ON s.node_id = g.node_id AND s.n = g.n + 1))),
decided AS (SELECT * FROM gov WHERE n > 0)"""


def decided(spark, sf):
    return GV.ration(X.event_log(spark, sf), BUDGET)


@query("governor_decisions", GOV + """ SELECT event_id, node_id, alerted, round(bar, 4) AS threshold,
 recent AS alerts_last_hour FROM decided""")
def governor_decisions(spark, sf):
    return decided(spark, sf).select("event_id", "node_id", "alerted",
                                     F.round("threshold", 4).alias("threshold"), "alerts_last_hour")


@query("governor_status", GOV + """ SELECT node_id, event_id, count(*) FILTER (alerted) OVER w AS alerts,
 count(*) FILTER (NOT alerted) OVER w AS suppressed,
 round(count(*) FILTER (NOT alerted) OVER w / count(*) OVER w, 3) AS suppression_rate FROM decided
WINDOW w AS (PARTITION BY node_id ORDER BY ts_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)""")
def governor_status(spark, sf):
    return GV.status(decided(spark, sf))


@query("governor_capture_gate", X.with_sql(X.OBS, X.LOG) +
       "SELECT event_id, alerted OR rank >= 3 AS capture FROM log")
def governor_capture_gate(spark, sf):
    return GV.capture_gate(X.event_log(spark, sf)).select("event_id", "capture")


@query("governor_alert_rate", X.with_sql(X.OBS, X.LOG) + """SELECT object_class, count(*) AS events,
 count(*) FILTER (alerted) AS alerts, round(count(*) FILTER (alerted) / count(*), 4) AS alert_rate FROM log GROUP BY ALL""")
def governor_alert_rate(spark, sf):
    return GV.alert_rate(X.event_log(spark, sf))
