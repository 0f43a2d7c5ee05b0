"""Queries for tracking, camera integrity and evaluation metrics."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import datasets as DS
from ..operators import integrity as IN
from ..operators import matching as MA
from ..operators import metrics as M
from ..operators import reid as RE
from ..operators import tracking as TR
from ..session import cut
from ..values import Params
from . import fixtures as X
from .registry import query

B, G = ("a.x1", "a.y1", "a.x2", "a.y2"), ("b.gx1", "b.gy1", "b.gx2", "b.gy2")
BG = X.with_sql(X.BOXES, X.GT)


def pred(spark, sf):
    return X.boxes_pred(spark, sf).select("frame", F.col("box_id").alias("id"), "object_class", "score", "clip", "obj", "x1", "y1", "x2", "y2")


def truth(spark, sf):
    return X.boxes_gt(spark, sf).select("frame", F.col("gt_id").alias("id"), F.col("gt_class").alias("object_class"), "ignored", "clip", "obj",
                                        F.col("gx1").alias("x1"), F.col("gy1").alias("y1"), F.col("gx2").alias("x2"), F.col("gy2").alias("y2"))


@query("track_nms", "WITH RECURSIVE " + X.BOXES + f""", s AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, box_id) AS n FROM boxes),
k(frame, n, kept, box_id, keep) AS (SELECT frame, n, [{{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}], box_id, TRUE FROM s WHERE n = 1
 UNION ALL SELECT frame, n, CASE WHEN ok THEN list_append(kept, {{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}) ELSE kept END, box_id, ok FROM (
  SELECT b.*, k.kept, len(list_filter(k.kept, lambda q: {X.sql_iou(('q.x1', 'q.y1', 'q.x2', 'q.y2'), ('b.x1', 'b.y1', 'b.x2', 'b.y2'))} > 0.45)) = 0 AS ok
  FROM k JOIN s b ON b.frame = k.frame AND b.n = k.n + 1))
SELECT frame, box_id FROM k WHERE keep""")
def track_nms(spark, sf):
    return MA.suppress_overlaps(pred(spark, sf), ["frame"], 0.45).select("frame", F.col("id").alias("box_id"))


def detections(spark, sf):
    """Boxes of forty cameras over daily frames."""
    li = X.table(spark, sf, "lineitem")
    b = X.boxes_pred(spark, sf).select("box_id", "object_class", "score", "x1", "y1", "x2", "y2")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date")).cast("long")
    return li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("det_id"),
                     F.concat(F.lit("C"), (F.col("l_suppkey") % 40).cast("string")).alias("camera_id"), day.alias("frame"),
                     F.when(F.col("l_partkey") % 4 == 0, "car").otherwise("person").alias("object_class"),
                     (F.pmod(F.round(F.col("l_extendedprice") * 100).cast("long"), F.lit(1000)) / 1000.0).alias("confidence"),
                     (F.col("l_quantity") * 10).alias("x1"), (F.round(F.col("l_discount") * 100) * 10.0).alias("y1"),
                     (F.col("l_quantity") * 10 + 60).alias("x2"), (F.round(F.col("l_discount") * 100) * 10.0 + 120).alias("y2")).distinct()


@query("track_two_pass")
def track_two_pass(spark, sf):
    """Tracks of forty cameras; checked against a plain loop in the tests."""
    return TR.track(detections(spark, sf)).select("camera_id", "frame", "det_id", "track_key", "object_class", "hits", "confirmed")


# --- camera integrity ----------------------------------------------------------------
TAMPER = Params(baseline_frames=20, persistence=3, frozen_digests=3, frozen_streak=2)


def frame_metrics(spark, sf):
    o = X.obs(spark, sf)
    e, v = F.col("event_id"), F.col("value")
    return o.select("camera_id", e.alias("frame_id"), "ts_us", F.floor(e / 9).cast("string").alias("digest"),
                    F.when(e % 90 > 60, F.lit(2.0)).when(e % 90 > 40, F.lit(230.0)).otherwise(90 + v % 5).alias("mean"),
                    F.when(e % 90 > 40, F.lit(2.0)).otherwise(20 + v % 3).alias("std"), (v % 10).alias("focus"), (e % 7 / 10.0).alias("motion"))


FM = """fm AS (SELECT camera_id, event_id AS frame_id, ts_us, CAST(event_id // 9 AS VARCHAR) AS digest,
 CASE WHEN event_id % 90 > 60 THEN 2e0 WHEN event_id % 90 > 40 THEN 230e0 ELSE 90 + value % 5 END AS mean,
 CASE WHEN event_id % 90 > 40 THEN 2e0 ELSE 20 + value % 3 END AS std, value % 10 AS focus, event_id % 7 / 10 AS motion FROM obs),
f1 AS (SELECT *, digest = lag(digest) OVER w AS same, row_number() OVER w AS seen FROM fm WINDOW w AS (PARTITION BY camera_id ORDER BY ts_us, frame_id)),
f2 AS (SELECT *, coalesce(seen - max(CASE WHEN NOT coalesce(same, FALSE) THEN seen END) OVER w, seen) >= 3 AS frozen FROM f1
 WINDOW w AS (PARTITION BY camera_id ORDER BY ts_us, frame_id ROWS UNBOUNDED PRECEDING)),
bl AS (SELECT camera_id, avg(mean) AS bm, avg(std) AS bs, avg(motion) AS bo FROM f2 WHERE NOT frozen AND seen <= 20 GROUP BY camera_id),
f3 AS (SELECT f.*, mean < greatest(3, bm * 0.4) AND std < greatest(2.5, bs * 0.35) AND motion < greatest(0.4, bo * 0.25) AS cov,
 mean > greatest(215, bm * 2.4) AND std < greatest(6, bs * 0.45) AS bli, focus < 3 AND std > 10 AS def FROM f2 f JOIN bl USING (camera_id) WHERE NOT frozen AND seen > 20),
c1 AS (SELECT *, row_number() OVER w AS p FROM f3 WINDOW w AS (PARTITION BY camera_id ORDER BY ts_us, frame_id)),
c2 AS (SELECT *, p - coalesce(max(CASE WHEN NOT cov THEN p END) OVER w, 0) AS run FROM c1 WINDOW w AS (PARTITION BY camera_id ORDER BY ts_us, frame_id ROWS UNBOUNDED PRECEDING)),
b1 AS (SELECT * EXCLUDE (p, run), row_number() OVER w AS p FROM c2 WHERE run < 3 WINDOW w AS (PARTITION BY camera_id ORDER BY ts_us, frame_id)),
b2 AS (SELECT *, p - coalesce(max(CASE WHEN NOT bli THEN p END) OVER w, 0) AS run FROM b1 WINDOW w AS (PARTITION BY camera_id ORDER BY ts_us, frame_id ROWS UNBOUNDED PRECEDING)),
d1 AS (SELECT * EXCLUDE (p, run), row_number() OVER w AS p FROM b2 WHERE run < 3 WINDOW w AS (PARTITION BY camera_id ORDER BY ts_us, frame_id)),
d2 AS (SELECT *, p - coalesce(max(CASE WHEN NOT def THEN p END) OVER w, 0) AS run FROM d1 WINDOW w AS (PARTITION BY camera_id ORDER BY ts_us, frame_id ROWS UNBOUNDED PRECEDING)),
vd AS (SELECT camera_id, frame_id, ts_us, 'frozen' AS kind FROM f2 WHERE frozen UNION ALL SELECT camera_id, frame_id, ts_us, NULL FROM f2 WHERE NOT frozen AND seen <= 20
 UNION ALL SELECT camera_id, frame_id, ts_us, 'covered' FROM c2 WHERE run >= 3 UNION ALL SELECT camera_id, frame_id, ts_us, 'blinded' FROM b2 WHERE run >= 3
 UNION ALL SELECT camera_id, frame_id, ts_us, CASE WHEN run >= 6 THEN 'defocused' END FROM d2)"""


@query("integrity_verdicts", X.with_sql(X.OBS, FM) + "SELECT frame_id, kind FROM vd")
def integrity_verdicts(spark, sf):
    return IN.tamper_verdicts(frame_metrics(spark, sf), TAMPER).select("frame_id", "kind")


@query("integrity_events", X.with_sql(X.OBS, FM) + """, e AS (SELECT *, lag(kind IS NOT NULL) OVER (PARTITION BY camera_id ORDER BY ts_us, frame_id) AS was FROM vd)
SELECT frame_id, kind, CASE WHEN kind = 'frozen' THEN 'stream_replay_suspected' ELSE 'camera_tamper' END AS event_type FROM e WHERE kind IS NOT NULL AND NOT coalesce(was, FALSE)""")
def integrity_events(spark, sf):
    return IN.tamper_events(IN.tamper_verdicts(frame_metrics(spark, sf), TAMPER)).select("frame_id", "kind", "event_type")


@query("integrity_moved")
def integrity_moved(spark, sf):
    """Repointed cameras from small grey pictures; checked in the tests."""
    o = X.obs(spark, sf)
    day = F.floor(F.col("ts_us") / X.DAY_US).cast("long")
    thumb = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.pmod(i * 37 + F.floor(day / 5) * 91, F.lit(255)).cast("double") + F.col("x"))
    return IN.moved_verdicts(o.select("camera_id", F.col("event_id").alias("frame_id"), "ts_us", thumb.alias("thumb")), Params(persistence=5))


@query("integrity_outages", X.with_sql(X.OBS) + """, n AS (SELECT camera_id, ts_us, lead(ts_us) OVER (PARTITION BY camera_id ORDER BY ts_us, event_id) AS nx FROM obs)
SELECT camera_id, ts_us + 3600000000 AS offline_us, nx AS online_us, 'camera_offline' AS event_type FROM n WHERE (coalesce(nx, 1706659200000000) - ts_us) / 1e6 > 3600""")
def integrity_outages(spark, sf):
    return IN.outages(X.obs(spark, sf).withColumn("frame_id", F.col("event_id")), 3600.0, as_of_us=1_706_659_200_000_000)


# --- detection metrics ------------------------------------------------------------------
GREEDY = f""", pr AS (SELECT a.frame, a.box_id, b.gt_id, a.object_class AS pc, b.gt_class AS tc, {X.sql_iou(B, G)} AS iou FROM boxes a JOIN gt b ON a.frame = b.frame),
rk AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY iou DESC, box_id, gt_id) AS n FROM pr WHERE iou >= 0.4),
gm(frame, n, ps, gs, box_id, gt_id, pc, tc, ok) AS (SELECT frame, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), '', '', '', '', FALSE FROM rk WHERE n = 1
 UNION ALL SELECT r.frame, r.n, CASE WHEN list_contains(ps, r.box_id) OR list_contains(gs, r.gt_id) THEN ps ELSE list_append(ps, r.box_id) END,
  CASE WHEN list_contains(ps, r.box_id) OR list_contains(gs, r.gt_id) THEN gs ELSE list_append(gs, r.gt_id) END, r.box_id, r.gt_id, r.pc, r.tc,
  NOT (list_contains(ps, r.box_id) OR list_contains(gs, r.gt_id)) FROM gm JOIN rk r ON r.frame = gm.frame AND r.n = gm.n + 1),
mt AS (SELECT * FROM gm WHERE ok)"""


@query("eval_detection", "WITH RECURSIVE " + X.BOXES + "," + X.GT + GREEDY + """, oc AS (SELECT tc AS c, 'tp' AS o FROM mt WHERE pc = tc UNION ALL SELECT pc, 'fp' FROM mt WHERE pc <> tc
 UNION ALL SELECT tc, 'fn' FROM mt WHERE pc <> tc UNION ALL SELECT object_class, 'fp' FROM boxes WHERE box_id NOT IN (SELECT box_id FROM mt)
 UNION ALL SELECT gt_class, 'fn' FROM gt WHERE gt_id NOT IN (SELECT gt_id FROM mt)),
cn AS (SELECT CASE WHEN grouping(c) = 1 THEN 'all' ELSE c END AS object_class, count(*) FILTER (o = 'tp') AS tp, count(*) FILTER (o = 'fp') AS fp, count(*) FILTER (o = 'fn') AS fn FROM oc GROUP BY ROLLUP (c))
SELECT *, round(tp / (tp + fp), 4) AS precision, round(tp / (tp + fn), 4) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 4) AS f1 FROM cn""")
def eval_detection(spark, sf):
    return M.detection_scores(M.detection_outcomes(pred(spark, sf), truth(spark, sf)))


@query("eval_average_precision", BG + f""", pr AS (SELECT a.frame, a.box_id, a.score, b.gt_id, b.ignored, {X.sql_iou(B, G)} AS iou FROM boxes a JOIN gt b ON a.frame = b.frame),
bst AS (SELECT * FROM pr WHERE NOT ignored AND iou >= 0.5 QUALIFY row_number() OVER (PARTITION BY box_id ORDER BY iou DESC, gt_id) = 1),
tp AS (SELECT box_id FROM bst QUALIFY row_number() OVER (PARTITION BY gt_id ORDER BY score DESC, box_id) = 1),
det AS (SELECT box_id, frame, score, box_id IN (SELECT box_id FROM tp) AS hit FROM boxes WHERE box_id IN (SELECT box_id FROM tp)
 OR box_id NOT IN (SELECT box_id FROM pr WHERE ignored AND iou >= 0.5)),
cu AS (SELECT *, row_number() OVER w AS n, count(*) FILTER (hit) OVER w AS c FROM det WINDOW w AS (ORDER BY score DESC, frame, box_id ROWS UNBOUNDED PRECEDING)),
ev AS (SELECT *, max(c / n) OVER (ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS env FROM cu)
SELECT count(*) AS detections, count(*) FILTER (hit) AS tp, (SELECT count(*) FROM gt WHERE NOT ignored) AS n_true,
 round(sum(CASE WHEN hit THEN env ELSE 0 END) / (SELECT count(*) FROM gt WHERE NOT ignored), 6) AS ap,
 round(count(*) FILTER (hit) / (SELECT count(*) FROM gt WHERE NOT ignored), 6) AS recall, round(count(*) FILTER (hit) / count(*), 6) AS precision FROM ev""")
def eval_average_precision(spark, sf):
    a = M.average_precision(pred(spark, sf), truth(spark, sf))
    return a.select("detections", "tp", "n_true", *[X.r6(F.col(c)).alias(c) for c in ("ap", "recall", "precision")])


@query("eval_average_precision_free", X.with_sql(X.BOXES, X.GT).replace("WITH ", "WITH RECURSIVE ", 1) + f""", pr AS (SELECT a.frame, a.box_id, a.score, b.gt_id, b.ignored, {X.sql_iou(B, G)} AS iou FROM boxes a JOIN gt b ON a.frame = b.frame),
rk AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, box_id, iou DESC, gt_id) AS n FROM pr WHERE NOT ignored AND iou >= 0.5),
gm(frame, n, ps, gs, box_id, ok) AS (SELECT frame, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), '', FALSE FROM rk WHERE n = 1
 UNION ALL SELECT r.frame, r.n, CASE WHEN list_contains(ps, r.box_id) OR list_contains(gs, r.gt_id) THEN ps ELSE list_append(ps, r.box_id) END,
  CASE WHEN list_contains(ps, r.box_id) OR list_contains(gs, r.gt_id) THEN gs ELSE list_append(gs, r.gt_id) END, r.box_id,
  NOT (list_contains(ps, r.box_id) OR list_contains(gs, r.gt_id)) FROM gm JOIN rk r ON r.frame = gm.frame AND r.n = gm.n + 1),
tp AS (SELECT box_id FROM gm WHERE ok),
det AS (SELECT box_id, frame, score, box_id IN (SELECT box_id FROM tp) AS hit FROM boxes WHERE box_id IN (SELECT box_id FROM tp)
 OR box_id NOT IN (SELECT box_id FROM pr WHERE ignored AND iou >= 0.5)),
cu AS (SELECT *, row_number() OVER w AS n, count(*) FILTER (hit) OVER w AS c FROM det WINDOW w AS (ORDER BY score DESC, frame, box_id ROWS UNBOUNDED PRECEDING)),
ev AS (SELECT *, max(c / n) OVER (ORDER BY n DESC ROWS UNBOUNDED PRECEDING) AS env FROM cu)
SELECT count(*) AS detections, count(*) FILTER (hit) AS tp, (SELECT count(*) FROM gt WHERE NOT ignored) AS n_true,
 round(sum(CASE WHEN hit THEN env ELSE 0 END) / (SELECT count(*) FROM gt WHERE NOT ignored), 6) AS ap,
 round(count(*) FILTER (hit) / (SELECT count(*) FROM gt WHERE NOT ignored), 6) AS recall, round(count(*) FILTER (hit) / count(*), 6) AS precision FROM ev""")
def eval_average_precision_free(spark, sf):
    """Detections take the best box that is still free, strongest first."""
    a = M.average_precision(pred(spark, sf), truth(spark, sf), rule="free")
    return a.select("detections", "tp", "n_true", *[X.r6(F.col(c)).alias(c) for c in ("ap", "recall", "precision")])


@query("eval_frame_auc", X.with_sql(X.BOXES) + """, f AS (SELECT frame, max(score) AS score, CAST(max(l_linenumber) >= 6 AS INT) AS label FROM boxes GROUP BY frame),
r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM f)
SELECT round((sum(CASE WHEN label = 1 THEN rk ELSE 0 END) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * sum(1 - label)), 6) AS auc,
 CAST(sum(label) AS BIGINT) AS anomalous, CAST(sum(1 - label) AS BIGINT) AS normal FROM r""")
def eval_frame_auc(spark, sf):
    f = X.boxes_pred(spark, sf).groupBy("frame").agg(F.max("score").alias("score"), F.when(F.max("l_linenumber") >= 6, 1).otherwise(0).alias("label"))
    return M.frame_auc(f).select(X.r6(F.col("auc")).alias("auc"), "anomalous", "normal")


@query("eval_rbdc_tbdc", BG + f""", pr AS (SELECT a.box_id, a.score, b.gt_id, {X.sql_iou(B, G)} AS iou FROM boxes a JOIN gt b ON a.frame = b.frame),
hit AS (SELECT gt_id, max(score) AS best FROM pr WHERE iou >= 0.1 GROUP BY gt_id), len AS (SELECT clip, count(*) AS n FROM gt GROUP BY clip),
tot AS (SELECT count(*) AS nr, count(DISTINCT clip) AS nt FROM gt), ft AS (SELECT count(DISTINCT frame) AS nf FROM boxes),
thr AS (SELECT DISTINCT score AS t FROM boxes),
gn AS (SELECT best AS t, count(*) AS r, sum(1 / n) AS w FROM hit JOIN gt USING (gt_id) JOIN len USING (clip) GROUP BY best),
fp AS (SELECT score AS t, count(*) AS f FROM boxes WHERE box_id NOT IN (SELECT box_id FROM pr WHERE iou >= 0.1) GROUP BY score),
cv AS (SELECT t, sum(coalesce(r, 0)) OVER w / nr AS y, sum(coalesce(w, 0)) OVER w / nt AS z, sum(coalesce(f, 0)) OVER w / nf AS x FROM thr LEFT JOIN gn USING (t) LEFT JOIN fp USING (t), tot, ft WINDOW w AS (ORDER BY t DESC ROWS UNBOUNDED PRECEDING)),
sg AS (SELECT *, coalesce(lag(x) OVER w, 0) AS x0, coalesce(lag(y) OVER w, 0) AS y0, coalesce(lag(z) OVER w, 0) AS z0 FROM cv WINDOW w AS (ORDER BY t DESC)),
ar AS (SELECT *, CASE WHEN x0 >= 1 THEN 0 ELSE least(x, 1) - x0 END AS dx, CASE WHEN x > x0 THEN (least(x, 1) - x0) / (x - x0) ELSE 0 END AS sh FROM sg)
SELECT count(*) AS thresholds, round(sum(dx * (2 * y0 + (y - y0) * sh) / 2) + greatest(0, 1 - max(x)) * max(y), 6) AS rbdc,
 round(sum(dx * (2 * z0 + (z - z0) * sh) / 2) + greatest(0, 1 - max(x)) * max(z), 6) AS tbdc FROM ar""")
def eval_rbdc_tbdc(spark, sf):
    r = M.rbdc_tbdc(M.region_curves(pred(spark, sf), truth(spark, sf).withColumn("track", F.col("clip"))))
    return r.select("thresholds", X.r6(F.col("rbdc")).alias("rbdc"), X.r6(F.col("tbdc")).alias("tbdc"))


# --- tracking metrics -----------------------------------------------------------------------
def mot_tables(spark, sf):
    """Eight orders a frame, four sequences every 4,000 orders; all lines are objects and the tracker's boxes, shifted, are one label off now and then."""
    li = X.table(spark, sf, "lineitem")
    x1, y1, d = F.col("l_quantity") * 10, F.round(F.col("l_discount") * 100) * 10.0, F.col("l_linenumber") * 4.0
    cell, line = ["sequence", "frame", "who"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    base = li.select((F.floor(F.col("l_orderkey") / 4000) * 4 + F.col("l_suppkey") % 4).alias("sequence"), F.floor(F.col("l_orderkey") / 8).alias("frame"),
                     (F.col("l_partkey") % 60).alias("who"), *line, x1.alias("x1"), y1.alias("y1"), d.alias("d"))
    # lines of one cell are objects of their own
    twin = F.row_number().over(W.partitionBy(*cell).orderBy(*line)) - 1
    # read several times on both sides: numbered once
    base = cut(base.withColumn("who", F.col("who") + 1000 * twin).drop("l_orderkey", "l_partkey", "l_suppkey"))
    box = lambda dx: [(F.col("x1") + dx).alias("x1"), (F.col("y1") + dx).alias("y1"), (F.col("x1") + 60 + dx).alias("x2"), (F.col("y1") + 120 + dx).alias("y2")]
    t = base.select("sequence", "frame", F.col("who").alias("obj_id"), *box(F.lit(0.0)))
    p = base.select("sequence", "frame", (F.col("who") + F.when(F.col("l_linenumber") == 2, 100).otherwise(0)).alias("obj_id"),
                                                F.when(F.col("l_linenumber") == 5, 1).otherwise(0).alias("lost_frames"), *box(F.col("d")))
    return t, M.observed(p)


def _mot(spark, sf):
    t, p = mot_tables(spark, sf)
    return t, p, cut(M.mot_matches(t, p))


@query("eval_identified", X.with_sql(X.BOXES) + """SELECT frame, box_id, CASE WHEN clip % 3 = 0 THEN NULL ELSE obj END AS track_id, coalesce(CASE WHEN clip % 3 = 0 THEN NULL ELSE obj END,
 CASE WHEN clip % 3 = 1 THEN NULL ELSE obj + 1000 END) AS gt_id FROM boxes WHERE object_class = 'person' AND NOT (clip % 3 = 0 AND obj % 5 = 0)""")
def eval_identified(spark, sf):
    """True people that carry an identity, under the one name or the other."""
    c = F.col("clip") % 3
    t = pred(spark, sf).select("frame", F.col("id").alias("box_id"), "object_class", F.when(c != 0, F.col("obj")).alias("track_id"),
                               F.when((c != 1) & ~((c == 0) & (F.col("obj") % 5 == 0)), F.col("obj") + 1000).alias("actor_id"))
    return M.identified(t).select("frame", "box_id", "track_id", "gt_id")


@query("eval_clear_mot")
def eval_clear_mot(spark, sf):
    t, p, m = _mot(spark, sf)
    return M.clear_mot(t, p, m)


@query("eval_idf1")
def eval_idf1(spark, sf):
    t, p, m = _mot(spark, sf)
    return M.idf1(t, p, m)


@query("eval_track_quality")
def eval_track_quality(spark, sf):
    t, _, m = _mot(spark, sf)
    return M.track_quality(t, m)


@query("eval_mot_weighted")
def eval_mot_weighted(spark, sf):
    """Frame-weighted against pooled summaries of the same sequences."""
    t, p, m = _mot(spark, sf)
    c = M.clear_mot(t, p, m)
    w = M.frame_weighted(c, ["mota", "motp"]).withColumnsRenamed({"mota": "weighted_mota", "motp": "weighted_motp"})
    return M.pooled_mot(c).crossJoin(w)


@query("eval_linked_regions")
def eval_linked_regions(spark, sf):
    t, _ = mot_tables(spark, sf)
    r = t.select(F.col("sequence").alias("clip"), "frame", F.concat_ws("-", "frame", "obj_id").alias("id"), "x1", "y1", "x2", "y2")
    return M.link_regions(r)


# --- events ------------------------------------------------------------------------------------
@query("eval_event_scoring", BG + f""", ts AS (SELECT *, epoch_us(l_shipdate) AS ts_us, (l_partkey % 4 = 0) AS alerted FROM lineitem),
c AS (SELECT a.*, (l.l_partkey % 4 = 0) AS alerted, epoch_us(l.l_shipdate) AS ts_us FROM boxes a JOIN (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS box_id, l_partkey, l_shipdate FROM lineitem) l USING (box_id)),
inc AS (SELECT g.*, c.ts_us AS its FROM gt g JOIN c ON g.gt_id = 'g' || c.box_id WHERE g.ignored),
tr AS (SELECT DISTINCT a.box_id FROM c a JOIN inc b ON a.frame = b.frame WHERE {X.sql_iou(B, G)} >= 0.3), m AS (SELECT *, box_id IN (SELECT box_id FROM tr) AS t FROM c)
SELECT count(*) AS total_events, count(*) FILTER (alerted) AS alerted_events, count(*) FILTER (t) AS true_events, count(*) FILTER (t AND alerted) AS alerted_true_events,
 count(*) FILTER (NOT t) AS false_alarm_events, count(*) FILTER (NOT t AND alerted) AS alerted_false_alarms, round((min(ts_us) FILTER (t) - (SELECT min(its) FROM inc)) / 1e6, 2) AS detection_latency_s,
 round(count(*) FILTER (NOT t) / 100, 1) AS raw_false_alarms_per_hour, round(count(*) FILTER (NOT t AND alerted) / 100, 1) AS false_alarms_per_hour,
 round(1 - count(*) FILTER (alerted) / count(*), 3) AS alert_suppression_rate FROM m""")
def eval_event_scoring(spark, sf):
    li = X.table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
                                               (F.col("l_partkey") % 4 == 0).alias("alerted"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("ts_us"))
    c = pred(spark, sf).join(li, "id")
    inc = truth(spark, sf).where("ignored").join(li.select(F.concat(F.lit("g"), "id").alias("id"), "ts_us"), "id")
    return M.event_scores(c, inc, 360_000.0)


@query("eval_scenarios", X.with_sql(X.OBS, X.LOG) + """, s AS (SELECT track_id % 50 AS scenario, list(DISTINCT event_kind) AS fired, bool_or(alerted AND rank >= 4) AS rang FROM log GROUP BY ALL),
x AS (SELECT DISTINCT track_id % 50 AS scenario FROM log), y AS (SELECT scenario, scenario % 2 = 0 AS expected_alert, CASE WHEN scenario % 5 = 0 THEN [] ELSE ['loitering', 'camera_offline'] END AS ex FROM x)
SELECT scenario, (len(ex) = 0 OR coalesce(list_has_any(ex, fired), FALSE)) AS types_ok, coalesce(rang, FALSE) = expected_alert AS alert_ok,
 (len(ex) = 0 OR coalesce(list_has_any(ex, fired), FALSE)) AND coalesce(rang, FALSE) = expected_alert AS passed FROM y LEFT JOIN s USING (scenario)""")
def eval_scenarios(spark, sf):
    log = X.event_log(spark, sf).withColumn("scenario", F.col("track_id") % 50)
    want = log.select("scenario").distinct().select(
        "scenario", (F.col("scenario") % 2 == 0).alias("expected_alert"),
        F.when(F.col("scenario") % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("loitering"), F.lit("camera_offline"))).alias("expected_event_types"))
    fired = log.select("scenario", F.col("event_kind").alias("event_type"), (F.col("alerted") & (F.col("rank") >= 4)).alias("alerted"))
    return M.scenario_verdicts(fired, want)


# --- re-identification ----------------------------------------------------------------------------
SIM = """nrm AS (SELECT *, sqrt(list_sum(list_transform(vector, lambda q: CAST(q AS DOUBLE) * q))) AS nn FROM crops),
sm AS (SELECT a.vec_id AS q, a.identity AS qi, a.camera AS qc, b.vec_id AS g, b.identity AS gi, b.camera AS gc,
 list_sum(list_transform(range(1, len(a.vector) + 1), lambda i: CAST(a.vector[i] AS DOUBLE) * b.vector[i])) / (a.nn * b.nn) AS sim FROM nrm a, nrm b WHERE {where})"""


def _reid_sql(where: str, junk: str, group: str = "") -> str:
    part = f"{group}, " if group else ""
    return X.with_sql(X.CROPS, SIM.replace("{where}", where)) + f""", rk AS (SELECT *{', ' + GROUPS[group] if group else ''}, gi = qi AS hit FROM sm WHERE {junk}),
r2 AS (SELECT *, row_number() OVER w AS n, count(*) FILTER (hit) OVER w AS h FROM rk WINDOW w AS (PARTITION BY {part}q ORDER BY round(sim, 6) DESC, sim DESC, g ROWS UNBOUNDED PRECEDING)),
pq AS (SELECT {part}q, min(n) AS f, avg(h / n) AS ap FROM r2 WHERE hit GROUP BY {part}q)
SELECT {part}count(*) AS queries, round(avg(CASE WHEN f = 1 THEN 1 ELSE 0 END), 6) AS rank1, round(avg(ap), 5) AS "map" FROM pq {'GROUP BY ' + group if group else ''}"""


GROUPS = {"direction": "CASE WHEN qc % 2 = 0 THEN 'visible_to_thermal' ELSE 'thermal_to_visible' END AS direction"}


def _shown(df, *group):
    return df.select(*group, "queries", X.r6(F.col("rank1")).alias("rank1"), F.round("map", 5).alias("map"))


@query("eval_reid_junk_rules", _reid_sql("a.vec_id % 5 = 0 AND b.vec_id % 5 <> 0", "NOT (gi = qi AND gc = qc) AND gi NOT IN (0, -1)"))
def eval_reid_junk_rules(spark, sf):
    c = X.crops(spark, sf)
    return _shown(RE.reid_scores(RE.ranked_answers(c.where("vec_id % 5 = 0"), c.where("vec_id % 5 <> 0"))))


@query("eval_reid_first_query", _reid_sql(
    "a.vec_id IN (SELECT min(vec_id) FROM crops GROUP BY identity) AND b.vec_id NOT IN (SELECT min(vec_id) FROM crops GROUP BY identity)", "TRUE"))
def eval_reid_first_query(spark, sf):
    q, g = RE.first_as_query(X.crops(spark, sf))
    return _shown(RE.reid_scores(RE.ranked_answers(q, g, junk=False)))


@query("eval_reid_cross_modal", _reid_sql("a.camera % 2 <> b.camera % 2", "TRUE", "direction"))
def eval_reid_cross_modal(spark, sf):
    """Both directions between two modalities, no camera rule."""
    return _shown(_cross_modal(spark, sf), "direction")


MODAL = _reid_sql("a.camera % 2 <> b.camera % 2", "TRUE", "direction")


DIRECTIONS = ("visible_to_thermal", "thermal_to_visible")


def _cross_modal(spark, sf):
    c = X.crops(spark, sf)
    return RE.reid_scores(RE.both_directions(c.where("camera % 2 = 0"), c.where("camera % 2 = 1"), DIRECTIONS, each=False), ["direction"])


@query("eval_modality_gap", f"""WITH s AS ({MODAL.replace('round(avg(CASE WHEN f = 1 THEN 1 ELSE 0 END), 6) AS rank1, round(avg(ap), 5) AS "map"', 'avg(CASE WHEN f = 1 THEN 1 ELSE 0 END) AS rank1, avg(ap) AS "map"')})
SELECT round(a.rank1 - b.rank1, 4) AS rank1_drop, round(a."map" - b."map", 4) AS map_drop FROM s a, s b
WHERE a.direction = 'visible_to_thermal' AND b.direction = 'thermal_to_visible'""")
def eval_modality_gap(spark, sf):
    """What is lost between the two directions of matching across modalities."""
    g = RE.modality_gap(_cross_modal(spark, sf), *DIRECTIONS, "direction")
    return g.select(F.round("rank1_drop", 4).alias("rank1_drop"), F.round("map_drop", 4).alias("map_drop"))


TRIALS = 3
IN_TRIAL = "substr(sha256(CAST(t AS VARCHAR) || '|' || CAST({} AS VARCHAR)), 1, 1) < '8'"


@query("eval_reid_trials", X.with_sql(X.CROPS, SIM.replace("{where}", "a.camera % 2 <> b.camera % 2")) + f""", rk AS (SELECT *, gi = qi AS hit, {GROUPS['direction']}
 FROM sm, (SELECT unnest(range({TRIALS})) AS t) AS tr WHERE {IN_TRIAL.format('qi')} AND {IN_TRIAL.format('gi')}),
r2 AS (SELECT *, row_number() OVER w AS n, count(*) FILTER (hit) OVER w AS h FROM rk WINDOW w AS (PARTITION BY t, q ORDER BY round(sim, 6) DESC, sim DESC, g ROWS UNBOUNDED PRECEDING)),
pq AS (SELECT t, direction, q, min(n) AS f, avg(h / n) AS ap FROM r2 WHERE hit GROUP BY t, direction, q),
s AS (SELECT t, direction, avg(CASE WHEN f = 1 THEN 1 ELSE 0 END) AS r, avg(ap) AS m FROM pq GROUP BY t, direction)
SELECT direction, count(*) AS trials, round(avg(r), 4) AS rank1, round(avg(m), 4) AS "map" FROM s GROUP BY direction""")
def eval_reid_trials(spark, sf):
    """Repeated trials over all crops: each draws its identities, scores both directions, and scores are averaged."""
    ranks = RE.trial_ranks(X.crops(spark, sf), range(TRIALS), F.col("camera") % 2 == 0, DIRECTIONS, each=False)
    m = RE.mean_of_trials(RE.reid_scores(ranks, ["trial", "direction"]), ["direction"])
    return m.select("direction", "trials", F.round("rank1", 4).alias("rank1"), F.round("map", 4).alias("map"))


@query("eval_similarity_best", X.with_sql(X.CROPS, SIM.replace("{where}", "a.vec_id % 7 = 0 AND b.vec_id % 7 <> 0")) + """SELECT q AS q_id, count(*) AS compared,
 round(max(sim), 5) AS best FROM sm GROUP BY q""")
def eval_similarity_best(spark, sf):
    c = X.crops(spark, sf)
    return RE.best_matches(c.where("vec_id % 7 = 0"), c.where("vec_id % 7 <> 0")).select("q_id", "compared", F.round("best", 5).alias("best"))


# --- splits ------------------------------------------------------------------------------------------
_KEY = lambda *c: f"sha256({' || chr(124) || '.join(f'CAST({x} AS VARCHAR)' for x in c)})"


@query("split_identity", X.with_sql(X.BOXES) + f""", ok AS (SELECT obj AS identity, box_id, {_KEY('obj', 'box_id')} AS k FROM boxes WHERE frame % 2 = 0 AND x2 - x1 >= 32 AND y2 - y1 >= 64),
cp AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY identity ORDER BY k) <= 10),
ids AS (SELECT identity FROM cp GROUP BY identity HAVING count(*) >= 4),
ho AS (SELECT identity, CASE WHEN row_number() OVER (ORDER BY {_KEY('identity')}) <= greatest(1, floor((SELECT count(*) FROM ids) * 0.15e0)) THEN 'val' ELSE 'train' END AS split FROM ids)
SELECT cp.identity, box_id AS crop_id, split FROM cp JOIN ho USING (identity)""")
def split_identity(spark, sf):
    b = pred(spark, sf).select(F.col("obj").alias("identity"), F.col("id").alias("crop_id"), "frame", "x1", "y1", "x2", "y2")
    return DS.identity_split(b, stride=2, per_identity=10).select("identity", "crop_id", "split")


@query("split_cross_camera", X.with_sql(X.BOXES) + f""", c AS (SELECT obj AS identity, box_id, clip % 6 AS camera FROM boxes),
ids AS (SELECT identity FROM c WHERE identity NOT IN (0, -1) GROUP BY identity HAVING count(*) >= 4 AND count(DISTINCT camera) >= 2),
ho AS (SELECT identity, CASE WHEN row_number() OVER (ORDER BY {_KEY('identity')}) <= greatest(1, floor((SELECT count(*) FROM ids) * 0.1e0)) THEN 'val' ELSE 'train' END AS split FROM ids)
SELECT c.identity, box_id AS crop_id, split FROM c JOIN ho USING (identity)""")
def split_cross_camera(spark, sf):
    b = pred(spark, sf).select(F.col("obj").alias("identity"), F.col("id").alias("crop_id"), (F.col("clip") % 6).alias("camera"))
    return DS.cross_camera_split(b).select("identity", "crop_id", "split")


_ROLES = [(i, "held_out" if i < 2 else "val" if i == 2 else "train") for i in range(6)]


@query("split_detector_set", X.with_sql(X.BOXES) + """SELECT box_id AS id, CASE WHEN clip % 6 = 2 THEN 'val' ELSE 'train' END AS role, round((x1 + least(500, x2)) / 2 / 500, 6) AS cx,
 round((y1 + least(200, y2)) / 2 / 200, 6) AS cy FROM boxes WHERE frame % 3 = 0 AND clip % 6 >= 2 AND least(500, x2) - x1 >= 4 AND least(200, y2) - y1 >= 8""")
def split_detector_set(spark, sf):
    roles = spark.createDataFrame(_ROLES, "sequence long, role string")
    t = pred(spark, sf).select((F.col("clip") % 6).alias("sequence"), "frame", "id", "x1", "y1", "x2", "y2",
                               F.lit(500).alias("frame_w"), F.lit(200).alias("frame_h"))
    return DS.detector_boxes(t, roles, 3).select("id", "role", "cx", "cy")
