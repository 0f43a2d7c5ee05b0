"""Queries for patrol conformance and plate intelligence."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import patrol as P
from ..operators import plates as PL
from . import fixtures as X
from .registry import query

PROFILES = [
    ("P1", "night foot patrol", True, ["click", "view", "purchase"], ["click-Z1", "view-Z1", "purchase-Z2"],
     [([], 120, 300, 30)], 270.0, 70.0, ["person"], 4, 0.4, 2.2, False, [], 2, 1),
    ("P2", "ridge patrol", True, ["click", "error"], [],
     [([0, 2, 4], 1350, 75, 60), ([5], 600, 720, 20)], None, 70.0, [], 6, 0.0, 3.0, False, [], 3, 2),
    ("P3", "vehicle patrol", True, ["signup", "view", "error"], ["signup-Z1"],
     [], 90.0, 45.0, ["person", "car"], 8, 0.0, 3.0, True, ["WB 24 AB 0014", "WB 25 AB 0015"], 6, 3),
    ("P4", "stood down", False, ["click", "view"], [], [([], 0, 1439, 20)], None, 70.0, [], 8, 0.0, 3.0, False, [], 6, 4),
]
PSQL = X.values_sql("profiles", "patrol_id, active, cameras, zones, heading, htol, classes, max_group, min_speed, "
                    "max_speed, ident, plates, lim, pos, nwin",
                    [(p[0], p[2], p[3], p[4], p[6], p[7], p[8], p[9], p[10], p[11], p[12], p[13], p[14], p[15],
                      len(p[5])) for p in PROFILES])
WSQL = X.values_sql("wins", "patrol_id, widx, days, s, e, tol",
                    [(p[0], i, *w) for p in PROFILES for i, w in enumerate(p[5])])


def profiles(spark):
    return spark.createDataFrame(PROFILES, P.PROFILE_SCHEMA)


def observations(spark, sf):
    log = X.event_log(spark, sf)
    e = F.col("event_id")
    return log.select(
        "event_id", "camera_id", "ts", "ts_us", "object_class", "zone_id", "score",
        F.when(e % 9 != 0, F.pmod(F.col("value") * 11, F.lit(360.0))).alias("heading_deg"),
        F.when(e % 4 != 0, F.pmod(F.col("value"), F.lit(4.0))).alias("speed_mps"),
        (e % 7 + 1).alias("group_size"),
        F.when(e % 8 == 0, F.concat(F.lit("WB 2"), (e % 7).cast("string"), F.lit(" AB 001"), (e % 7).cast("string"))).alias("plate"),
        F.when(e % 5 == 0, F.array(F.lit("click"), F.lit("view"), F.col("camera_id")))
         .when(e % 5 == 1, F.array(F.lit("error"), F.col("camera_id"))).alias("trail"))


OBSQL = """po AS (SELECT event_id, camera_id, ts, ts_us, object_class, zone_id, score,
 CASE WHEN event_id % 9 <> 0 THEN (value * 11) % 360 END AS heading,
 CASE WHEN event_id % 4 <> 0 THEN value % 4 END AS speed, event_id % 7 + 1 AS grp,
 CASE WHEN event_id % 8 = 0 THEN 'WB2' || (event_id % 7) || 'AB001' || (event_id % 7) END AS plate,
 CASE WHEN event_id % 5 = 0 THEN ['click', 'view', camera_id] WHEN event_id % 5 = 1 THEN ['error', camera_id] END AS trail,
 hour(ts) * 60 + minute(ts) AS mi, CAST(isodow(ts) - 1 AS INT) AS wd FROM log)"""
ASSESS = X.with_sql(X.OBS, X.LOG, PSQL, WSQL, OBSQL) + """,
pairs AS (SELECT o.*, p.patrol_id, p.cameras, p.zones, p.heading AS want, greatest(1e0, p.htol) AS htol,
  p.max_group, p.min_speed, p.max_speed, p.lim, p.pos, p.nwin FROM po o JOIN profiles p ON p.active
  AND list_contains(p.cameras, o.camera_id) AND (len(p.classes) = 0 OR list_contains(p.classes, o.object_class))
 WHERE NOT (p.ident AND len(p.plates) > 0 AND o.plate IS NOT NULL AND NOT list_contains(
  list_transform(p.plates, lambda q: replace(q, ' ', '')), o.plate))),
wg AS (SELECT a.event_id, a.patrol_id, w.s, w.e, w.tol, w.widx,
  CASE WHEN len(w.days) > 0 AND NOT list_contains(w.days, wd) AND NOT (w.e < w.s AND list_contains(w.days, (wd + 6) % 7) AND mi <= w.e)
    THEN 1e9 WHEN (w.e < w.s AND (mi >= w.s OR mi <= w.e)) OR (w.e >= w.s AND mi BETWEEN w.s AND w.e) THEN 0e0
   ELSE least(least(abs(mi - w.s), 1440 - abs(mi - w.s)), least(abs(mi - w.e), 1440 - abs(mi - w.e))) END AS gap
 FROM pairs a JOIN wins w USING (patrol_id)),
bw AS (SELECT * FROM wg QUALIFY row_number() OVER (PARTITION BY event_id, patrol_id ORDER BY gap, widx) = 1),
g AS (SELECT a.*, b.s, b.e, b.gap, greatest(1, b.tol) AS tol,
  list_filter(list_transform(coalesce(trail, []), lambda t: list_position(cameras, t)), lambda q: q > 0) AS known,
  least((heading - want + 720) % 360e0, 360 - (heading - want + 720) % 360e0) AS diff
 FROM pairs a LEFT JOIN bw b USING (event_id, patrol_id) WHERE nwin = 0 OR b.gap <= greatest(1, b.tol)),
cu AS (SELECT *, CASE WHEN nwin = 0 THEN 0e0 WHEN gap = 0 THEN 1e0 ELSE greatest(0e0, 1 - gap / tol) END AS tsc,
  len(zones) > 0 AND zone_id IS NOT NULL AS zk, coalesce(list_contains(zones, zone_id), FALSE) AS zin,
  len(list_filter(zones, lambda z: starts_with(z, camera_id))) > 0 AS zhere, diff IS NOT NULL AS dk,
  len(coalesce(trail, [])) >= 2 AND len(cameras) >= 2 AS rk,
  CASE WHEN len(coalesce(trail, [])) >= 2 AND len(cameras) >= 2 AND len(known) >= 2 THEN
    len(list_filter(range(1, len(known)), lambda i: known[i + 1] > known[i])) / (len(known) - 1)
    * (1 - (len(trail) - len(known)) / len(trail)) ELSE 0e0 END AS rsc,
  greatest(0e0, 1e0 - CASE WHEN grp > max_group THEN 0.5e0 ELSE 0 END - CASE WHEN speed > max_speed * 2 THEN 0.5e0
    WHEN NOT (speed BETWEEN min_speed AND max_speed) THEN 0.25e0 ELSE 0 END) AS msc FROM g),
sc AS (SELECT *, CASE WHEN dk THEN greatest(0e0, 1 - diff / htol) ELSE 0e0 END AS dsc, CASE WHEN zk AND zin THEN 1e0 ELSE 0e0 END AS zsc,
  (CASE WHEN nwin > 0 THEN tsc * 0.6e0 ELSE 0 END + CASE WHEN rk THEN rsc * 0.4e0 ELSE 0 END)
   / nullif(CASE WHEN nwin > 0 THEN 0.6e0 ELSE 0 END + CASE WHEN rk THEN 0.4e0 ELSE 0 END, 0) AS ident0 FROM cu),
cf AS (SELECT *, coalesce(ident0, 0e0) AS ident, (CASE WHEN dk THEN dsc * 0.55e0 ELSE 0 END + CASE WHEN zk THEN zsc * 0.3e0 ELSE 0 END + msc * 0.15e0)
  / (CASE WHEN dk THEN 0.55e0 ELSE 0 END + CASE WHEN zk THEN 0.3e0 ELSE 0 END + 0.15e0) AS conf,
  (CASE WHEN dk AND diff >= 90 AND diff > htol THEN 1 ELSE 0 END) + (CASE WHEN zk AND NOT zin AND zhere THEN 1 ELSE 0 END)
  + (CASE WHEN grp > max_group THEN 1 ELSE 0 END) + (CASE WHEN speed > max_speed * 2 THEN 1 ELSE 0 END) AS ndev FROM sc),
ma AS (SELECT *, round(CASE WHEN coalesce(gap = 0, FALSE) THEN 0.5e0 * ident + 0.5e0 * conf
  ELSE least(0.5e0 * ident + 0.5e0 * conf, 0.65e0) END, 3) AS match FROM cf),
best AS (SELECT *, CASE WHEN ident >= 0.7 AND ndev > 0 THEN FALSE ELSE match >= 0.72 END AS strong,
  CASE WHEN nwin > 0 THEN patrol_id || ':' || strftime(CASE WHEN e < s AND mi <= e THEN ts - INTERVAL 1 DAY ELSE ts END, '%Y-%m-%d')
   || ':' || s END AS occ FROM ma QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY match DESC, pos) = 1),
paid AS (SELECT *, CASE WHEN strong THEN count(*) FILTER (strong) OVER (PARTITION BY occ ORDER BY ts_us, event_id) END AS nth FROM best),
fin AS (SELECT o.event_id, o.camera_id, o.object_class, o.score, b.patrol_id, b.match, b.ident AS ident0, b.conf AS conf0,
  CASE WHEN b.ident >= 0.7 AND b.ndev > 0 THEN 'deviation' WHEN b.strong AND nth <= lim THEN 'suppressed'
   WHEN b.strong THEN 'downgraded' WHEN b.match >= 0.45 THEN 'downgraded' ELSE 'not_matched' END AS decision,
  coalesce(b.strong AND nth > lim, FALSE) AS spent FROM po o LEFT JOIN paid b USING (event_id)),
adj AS (SELECT *, CASE decision WHEN 'deviation' THEN 0.16e0 WHEN 'suppressed' THEN -0.35e0 WHEN 'downgraded' THEN -0.16e0
  ELSE 0e0 END AS adjustment FROM fin)"""


def assessed(spark, sf):
    return P.assess(observations(spark, sf), profiles(spark))


@query("patrol_candidates", ASSESS + " SELECT event_id, patrol_id FROM pairs")
def patrol_candidates(spark, sf):
    return P.candidates(observations(spark, sf), profiles(spark)).select(
        "event_id", F.col("p_patrol_id").alias("patrol_id"))


@query("patrol_cues", ASSESS + """ SELECT event_id, patrol_id, round(tsc, 4) AS schedule, zsc AS route_zone,
 round(dsc, 4) AS direction, round(rsc, 4) AS route_consistency, msc AS movement FROM sc""")
def patrol_cues(spark, sf):
    s = P.cues(P.candidates(observations(spark, sf), profiles(spark)))
    return s.select("event_id", F.col("p_patrol_id").alias("patrol_id"), F.round("time_score", 4).alias("schedule"),
                    F.col("zone_score").alias("route_zone"), F.round("direction_score", 4).alias("direction"),
                    F.round("route_score", 4).alias("route_consistency"), F.col("movement_score").alias("movement"))


@query("patrol_decisions", ASSESS + """ SELECT event_id, patrol_id, decision, round(ident0, 6) AS identity_confidence, round(conf0, 6) AS conformance, spent AS budget_exhausted, adjustment FROM adj""")
def patrol_decisions(spark, sf):
    return assessed(spark, sf).select(
        "event_id", "patrol_id", "decision", X.r6(F.col("identity_raw")).alias("identity_confidence"),
        X.r6(F.col("conformance_raw")).alias("conformance"), "budget_exhausted", "adjustment")


@query("patrol_adjusted_scores", ASSESS + """, mv AS (SELECT *, CASE WHEN abs(adjustment) > 1e-6 THEN
  greatest(0e0, least(1e0, score + adjustment)) ELSE score END AS s2 FROM adj)
SELECT event_id, round(s2, 6) AS score, CASE WHEN decision = 'deviation' AND s2 < 0.45 THEN 'medium' WHEN s2 >= 0.85 THEN 'critical'
 WHEN s2 >= 0.65 THEN 'high' WHEN s2 >= 0.45 THEN 'medium' WHEN s2 >= 0.25 THEN 'low' ELSE 'info' END AS priority,
 decision <> 'suppressed' AS to_governor FROM mv""")
def patrol_adjusted_scores(spark, sf):
    return P.apply(assessed(spark, sf)).select("event_id", X.r6(F.col("score")).alias("score"), "priority", "to_governor")


@query("patrol_metrics", ASSESS + """ SELECT count(*) AS raw_events, count(*) FILTER (decision <> 'not_matched') AS matched,
 count(*) FILTER (decision = 'suppressed') AS suppressed, count(*) FILTER (decision = 'downgraded') AS downgraded,
 count(*) FILTER (decision = 'deviation') AS deviations, count(*) FILTER (decision = 'not_matched') AS unmatched,
 count(*) FILTER (spent) AS budget_exhausted,
 round(100 * count(*) FILTER (decision = 'suppressed') / count(*), 1) AS alert_reduction_percent FROM fin""")
def patrol_metrics(spark, sf):
    return P.metrics(assessed(spark, sf))


@query("patrol_roster", X.with_sql(X.OBS, PSQL) + """SELECT p.patrol_id, count(*) AS events_on_route FROM profiles p JOIN obs o
 ON p.active AND list_contains(p.cameras, o.camera_id) GROUP BY p.patrol_id""")
def patrol_roster(spark, sf):
    """Events that fall on the cameras each active profile covers."""
    cover = profiles(spark).where("active").select("patrol_id", F.explode("cameras").alias("camera_id"))
    return X.obs(spark, sf).join(cover, "camera_id").groupBy("patrol_id").agg(F.count("*").alias("events_on_route"))


@query("patrol_roster_summary", X.with_sql(X.OBS) + """, pr AS (SELECT track_id AS patrol_id, track_id % 3 <> 0 AND count(*) > 1 AS active, list(DISTINCT camera_id) AS cams FROM obs GROUP BY track_id)
SELECT count(*) FILTER (active) AS active, count(*) AS total, (SELECT string_agg(DISTINCT camera_id, ',' ORDER BY camera_id) FROM obs JOIN pr ON track_id = patrol_id WHERE active) AS cameras_covered FROM pr""")
def patrol_roster_summary(spark, sf):
    """Active and total profiles, one per observed track, and the cameras that active ones cover."""
    p = X.obs(spark, sf).groupBy(F.col("track_id").alias("patrol_id")).agg(F.collect_set("camera_id").alias("cameras"), F.count("*").alias("n"))
    return P.roster_summary(p.withColumn("active", (F.col("patrol_id") % 3 != 0) & (F.col("n") > 1)))


# --- plates ---------------------------------------------------------------------------
_BAND = lambda t: [(0.0, t), (1.0, t), (1.0, 1.0), (0.0, 1.0)]
REGIONS = [("click", _BAND(0.5)), ("error", None), ("purchase", []), ("signup", _BAND(0.3)), ("view", _BAND(0.9))]
RSQL = X.values_sql("regions", "camera_id, region", [(c, r if r else None) for c, r in REGIONS]).replace(
    "VALUES", "SELECT camera_id, CASE WHEN camera_id = 'purchase' THEN [] ELSE region END FROM (VALUES", 1)[:-1] + \
    ") AS v(camera_id, region))"


def reads(spark, sf):
    s = X.sightings(spark, sf)
    cx, cy = F.col("x") * 640, F.col("y") * 480
    return s.withColumns({"x1": cx - 40, "x2": cx + 40, "y2": cy, "y1": cy - (F.col("event_id") % 200),
                          "frame_w": F.lit(640), "frame_h": F.lit(480)})


def plated(spark, sf):
    s = X.sightings(spark, sf)
    return s.where((F.col("plate_px") >= 90) & T.plate_valid(F.col("raw"))).withColumn("plate", T.plate_spaced(F.col("raw")))


KEYED = r"""keyed AS (SELECT *, upper(regexp_replace(raw, '[^A-Za-z0-9]', '', 'g')) AS k FROM sightings),
spaced AS (SELECT *, regexp_matches(k, '^([A-Z]{2})(\d{1,2})([A-Z]{0,3})(\d{1,4})$') AS ok,
 regexp_replace(regexp_replace(k, '^([A-Z]{2})(\d{1,2})([A-Z]{0,3})(\d{1,4})$', '\1 \2 \3 \4'), ' +', ' ', 'g') AS plate FROM keyed),
good AS (SELECT * FROM spaced WHERE ok AND plate_px >= 90)"""
PL_BASE = X.with_sql(X.OBS, X.SIGHTINGS, KEYED)
ACCEPT = f""", {RSQL}, acc AS (SELECT g.* FROM good g JOIN regions r USING (camera_id)
 WHERE object_class IN ('car', 'motorcycle', 'bus', 'truck') AND region IS NOT NULL AND (len(region) < 3
  OR {X.sql_inside('(x * 640 / 640)', '(y * 480 / 480)', 'region')} OR event_id % 200 >= 0.18e0 * 480))"""


@query("plate_accepted_reads", PL_BASE + ACCEPT + " SELECT event_id, plate FROM acc")
def plate_accepted_reads(spark, sf):
    region = spark.createDataFrame(REGIONS, "camera_id string, region array<struct<x:double,y:double>>")
    return PL.accepted_reads(reads(spark, sf), region).select("event_id", "plate")


@query("plate_best_reads", PL_BASE + """ SELECT camera_id, track_id, event_id, plate, ocr_confidence FROM good
QUALIFY row_number() OVER (PARTITION BY camera_id, track_id ORDER BY ocr_confidence DESC, ts_us, event_id) = 1""")
def plate_best_reads(spark, sf):
    return PL.best_reads(plated(spark, sf).select("camera_id", "track_id", "event_id", "ts_us", "plate", "ocr_confidence")).select(
        "camera_id", "track_id", "event_id", "plate", "ocr_confidence")


@query("plate_throttle", "WITH RECURSIVE " + X.OBS + """, att AS (SELECT camera_id || ':' || track_id AS k,
 ts_us // 36000000000 AS frame, event_id FROM obs),
kept(k, frame, event_id) AS (SELECT k, min(frame), arg_min(event_id, (frame, event_id)) FROM att GROUP BY k
 UNION ALL SELECT a.k, min(a.frame), arg_min(a.event_id, (a.frame, a.event_id)) FROM kept p JOIN att a
  ON a.k = p.k AND a.frame >= p.frame + 6 GROUP BY a.k)
SELECT event_id, frame FROM kept""")
def plate_throttle(spark, sf):
    """Attempts left when a track may be tried once per six frames."""
    o = X.obs(spark, sf).withColumn("frame", F.floor(F.col("ts_us") / 36_000_000_000).cast("long"))
    return PL.throttle(o).select("event_id", "frame")


@query("plate_repeats", PL_BASE + """, n AS (SELECT *, CASE WHEN hour(ts) >= 22 OR hour(ts) < 5 THEN 1 ELSE 0 END AS night FROM good),
t AS (SELECT a.event_id, a.plate, count(*) AS sightings, CAST(sum(b.night) AS BIGINT) AS night_sightings,
  count(DISTINCT b.camera_id) AS cameras FROM n a JOIN n b ON b.plate = a.plate
  AND b.ts_us BETWEEN a.ts_us - 604800000000 AND a.ts_us AND (b.ts_us, b.event_id) <= (a.ts_us, a.event_id) GROUP BY ALL)
SELECT *, CASE WHEN night_sightings >= 3 THEN 'night' ELSE 'places' END AS pattern FROM t
WHERE night_sightings >= 3 OR (cameras >= 3 AND sightings >= 3)""")
def plate_repeats(spark, sf):
    return PL.repeat_findings(plated(spark, sf)).select(
        "event_id", "plate", "sightings", "night_sightings", "cameras", "pattern")


@query("plate_summary", PL_BASE + """ SELECT plate, count(*) AS sightings, string_agg(DISTINCT camera_id, ',' ORDER BY camera_id) AS cameras,
 min(ts_us) AS first_us, max(ts_us) AS last_us, count(*) FILTER (hour(ts) >= 22 OR hour(ts) < 5) AS night_sightings,
 round(avg(ocr_confidence), 6) AS mean_confidence FROM good GROUP BY plate""")
def plate_summary(spark, sf):
    return PL.summary(plated(spark, sf))


@query("plate_ocr_accuracy", PL_BASE + """, j AS (SELECT camera_id, k, 'WB' || lpad(CAST(track_id % 90 + 10 AS VARCHAR), 2, '0')
 || 'AB' || lpad(CAST(track_id AS VARCHAR), 4, '0') AS truth FROM spaced)
SELECT camera_id, count(*) AS reads, count(*) FILTER (k = truth) AS exact,
 round(avg(1 - levenshtein(k, truth) / greatest(length(k), length(truth))), 4) AS char_similarity FROM j GROUP BY camera_id""")
def plate_ocr_accuracy(spark, sf):
    s = X.sightings(spark, sf)
    uid = F.col("track_id")
    truth = s.select("event_id", F.concat(F.lit("WB"), F.lpad((uid % 90 + 10).cast("string"), 2, "0"), F.lit("AB"),
                                          F.lpad(uid.cast("string"), 4, "0")).alias("truth"))
    return PL.ocr_accuracy(s, truth)
