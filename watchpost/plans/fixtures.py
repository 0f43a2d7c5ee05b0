"""Surveillance-shaped views over the given tables, in Spark and as SQL text.

The given tables hold no cameras or boxes, so each view derives its columns from
real columns of a table by a fixed rule.  Every view keeps all rows of its table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
CAMERAS = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- obs: one track point per event ------------------------------------------
def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int") % 5
    ts = F.col("ts").cast("timestamp")
    return e.select(
        "event_id", F.col("event_type").alias("camera_id"), F.col("user_id").alias("track_id"),
        ts.alias("ts"), F.unix_micros(ts).alias("ts_us"),
        (F.pmod(F.col("value") * 7, F.lit(100.0)) / 100.0).alias("x"),
        (F.pmod(F.col("event_id") * 13, F.lit(100)) / 100.0).alias("y"),
        F.when(k == 0, "cattle").when(k == 1, "car").when(k == 2, "truck")
         .otherwise("person").alias("object_class"),
        ((F.col("event_id") % 70 + 30) / 100.0).alias("confidence"), "value")


OBS = """obs AS (SELECT event_id, event_type AS camera_id, user_id AS track_id, ts,
 epoch_us(ts) AS ts_us, ((value * 7) % 100) / 100 AS x, ((event_id * 13) % 100) / 100 AS y,
 CASE CAST(regexp_extract(props, '[0-9]+') AS INT) % 5 WHEN 0 THEN 'cattle' WHEN 1 THEN 'car'
   WHEN 2 THEN 'truck' ELSE 'person' END AS object_class,
 (event_id % 70 + 30) / 100 AS confidence, value FROM events)"""


# --- site: cameras, zones, routes (a site file, fixed in size) ----------------
_P1 = [(0.15, 0.10), (0.85, 0.20), (0.75, 0.90), (0.20, 0.80)]
_P2 = [(0.40, 0.35), (0.95, 0.40), (0.60, 0.95)]
_LINE = [(0.50, 0.0), (0.55, 1.0)]
_ROUTE = [(0.0, 0.5), (0.4, 0.45), (1.0, 0.55)]
_LAWFUL = [(0.05, 0.55), (0.95, 0.6), (0.95, 0.7), (0.05, 0.65)]
FENCED = ["click", "purchase", "view"]


def _zone_rows():
    rows = []
    for cam in CAMERAS:
        rows.append((f"{cam}-Z1", cam, f"{cam} yard", "polygon", _P1, None, 60.0, True, False))
        rows.append((f"{cam}-Z2", cam, f"{cam} gate", "polygon", _P2, 90.0, 60.0, True, False))
        rows.append((f"{cam}-L1", cam, f"{cam} wire", "line", _LINE, None, 60.0, True, False))
        rows.append((f"{cam}-R1", cam, f"{cam} path", "route", _ROUTE, None, 60.0, True, True))
        rows.append((f"{cam}-R2", cam, f"{cam} lane", "polygon", _LAWFUL, None, 60.0, cam != "view", True))
    return rows


ZONE_SCHEMA = ("zone_id string, camera_id string, zone_name string, kind string, "
               "points array<struct<x:double,y:double>>, zone_deg double, tolerance double, "
               "enabled boolean, is_lawful_route boolean")
CAMERA_SCHEMA = "camera_id string, profile string, role string, is_night boolean, direction_granted boolean"


def zones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_zone_rows(), ZONE_SCHEMA)


def _camera_rows():
    roles = ["perimeter", "approach", "chokepoint", "riverine", "perimeter"]
    return [(c, "fenced" if c in FENCED else "open", roles[i], c in ("error", "view"), c != "view")
            for i, c in enumerate(CAMERAS)]


def cameras(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_camera_rows(), CAMERA_SCHEMA)


def _lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    if isinstance(v, list):
        return "[" + ", ".join("{'x': " + _lit(float(a)) + ", 'y': " + _lit(float(b)) + "}"
                               if isinstance(v[0], tuple) else _lit(a)
                               for a, b in ((t if isinstance(t, tuple) else (t, None)) for t in v)) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def values_sql(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)
    return f"{name}({columns}) AS (VALUES {body})"


ZONES = values_sql("zones", "zone_id, camera_id, zone_name, kind, points, zone_deg, tolerance, "
                   "enabled, is_lawful_route", _zone_rows())
CAMS = values_sql("cams", "camera_id, profile, role, is_night, direction_granted", _camera_rows())


# SQL text for the geometry the twins need
def sql_inside(px: str, py: str, pts: str) -> str:
    a, b = f"{pts}[i]", f"{pts}[CASE WHEN i = 1 THEN len({pts}) ELSE i - 1 END]"
    return (f"(len({pts}) >= 3 AND len(list_filter(range(1, len({pts}) + 1), lambda i: "
            f"(({a}.y > {py}) <> ({b}.y > {py})) AND {px} < ({b}.x - {a}.x) * ({py} - {a}.y) "
            f"/ ({b}.y - {a}.y) + {a}.x)) % 2 = 1)")


def sql_distance(px: str, py: str, pts: str) -> str:
    a, b = f"{pts}[i]", f"{pts}[i + 1]"
    dx, dy = f"({b}.x - {a}.x)", f"({b}.y - {a}.y)"
    t = (f"greatest(0e0, least(1e0, (({px} - {a}.x) * {dx} + ({py} - {a}.y) * {dy}) / "
         f"({dx} * {dx} + {dy} * {dy})))")
    return (f"list_min(list_transform(range(1, len({pts})), lambda i: sqrt("
            f"pow({px} - ({a}.x + {t} * {dx}), 2) + pow({py} - ({a}.y + {t} * {dy}), 2))))")


def sql_side(px: str, py: str, pts: str) -> str:
    v = f"(({pts}[2].x - {pts}[1].x) * ({py} - {pts}[1].y) - ({pts}[2].y - {pts}[1].y) * ({px} - {pts}[1].x))"
    return f"CASE WHEN {v} > 1e-9 THEN 1 WHEN {v} < -1e-9 THEN -1 ELSE 0 END"


# --- boxes: one predicted and one true box per order line ----------------------
def _box_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    x1, y1 = F.col("l_quantity") * 10, F.round(F.col("l_discount") * 100).cast("int") * 10.0
    return li.select(
        F.col("l_orderkey").alias("frame"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("box_id"),
        "l_linenumber", "l_returnflag", F.col("l_suppkey").alias("clip"), F.col("l_partkey").alias("obj"),
        F.when(F.col("l_partkey") % 4 == 0, "car").otherwise("person").alias("object_class"),
        x1.alias("x1"), y1.alias("y1"), (x1 + 60.0).alias("x2"), (y1 + 120.0).alias("y2"),
        (F.pmod(cents, F.lit(1000)) / 1000.0).alias("score"))


def boxes_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _box_base(spark, sf_dir)


def boxes_gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True boxes of all lines, shifted by the line number so that some are missed; R is ignored area."""
    b = _box_base(spark, sf_dir)
    d = F.col("l_linenumber") * 4.0
    return b.select("frame", F.concat(F.lit("g"), "box_id").alias("gt_id"), "clip", "obj",
                    F.when(F.col("l_linenumber") == 3, "car").otherwise(F.col("object_class")).alias("gt_class"),
                    (F.col("x1") + d).alias("gx1"), (F.col("y1") + d).alias("gy1"),
                    (F.col("x2") + d).alias("gx2"), (F.col("y2") + d).alias("gy2"),
                    (F.col("l_returnflag") == "R").alias("ignored"))


BOXES = """boxes AS (SELECT l_orderkey AS frame,
 concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS box_id, l_linenumber,
 l_returnflag, l_suppkey AS clip, l_partkey AS obj,
 CASE WHEN l_partkey % 4 = 0 THEN 'car' ELSE 'person' END AS object_class,
 l_quantity * 10 AS x1, CAST(round(l_discount * 100) AS INT) * 10e0 AS y1,
 l_quantity * 10 + 60 AS x2, CAST(round(l_discount * 100) AS INT) * 10e0 + 120 AS y2,
 (CAST(round(l_extendedprice * 100) AS BIGINT) % 1000) / 1000 AS score FROM lineitem)"""
GT = """gt AS (SELECT frame, 'g' || box_id AS gt_id, clip, obj,
 CASE WHEN l_linenumber = 3 THEN 'car' ELSE object_class END AS gt_class,
 x1 + l_linenumber * 4e0 AS gx1, y1 + l_linenumber * 4e0 AS gy1,
 x2 + l_linenumber * 4e0 AS gx2, y2 + l_linenumber * 4e0 AS gy2,
 l_returnflag = 'R' AS ignored FROM boxes)"""


def sql_iou(a: tuple, b: tuple) -> str:
    iw = f"greatest(0e0, least({a[2]}, {b[2]}) - greatest({a[0]}, {b[0]}))"
    ih = f"greatest(0e0, least({a[3]}, {b[3]}) - greatest({a[1]}, {b[1]}))"
    aa = f"(({a[2]} - {a[0]}) * ({a[3]} - {a[1]}))"
    bb = f"(({b[2]} - {b[0]}) * ({b[3]} - {b[1]}))"
    return f"({iw} * {ih}) / ({aa} + {bb} - {iw} * {ih})"


# --- sightings: one plate read per event ----------------------------------------
def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = obs(spark, sf_dir)
    uid = F.col("track_id")
    raw = F.concat(F.lit("WB"), F.lpad((uid % 90 + 10).cast("string"), 2, "0"), F.lit("AB"),
                   F.lpad(uid.cast("string"), 4, "0"))
    return o.select("event_id", "camera_id", "track_id", "ts", "ts_us", "x", "y", "object_class",
                    F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("?"), F.substring(raw, 3, 9)))
                     .when(F.col("event_id") % 5 == 0, F.concat_ws(" ", F.substring(raw, 1, 4), F.substring(raw, 5, 6)))
                     .otherwise(raw).alias("raw"),
                    F.col("confidence").alias("ocr_confidence"),
                    (F.col("event_id") % 60 + 70).cast("double").alias("plate_px"))


SIGHTINGS = """sightings AS (SELECT event_id, camera_id, track_id, ts, ts_us, x, y, object_class,
 CASE WHEN event_id % 17 = 0 THEN '?' || substr(raw0, 3, 9)
      WHEN event_id % 5 = 0 THEN substr(raw0, 1, 4) || ' ' || substr(raw0, 5, 6) ELSE raw0 END AS raw,
 confidence AS ocr_confidence, CAST(event_id % 60 + 70 AS DOUBLE) AS plate_px
 FROM (SELECT *, 'WB' || lpad(CAST(track_id % 90 + 10 AS VARCHAR), 2, '0') || 'AB'
   || lpad(CAST(track_id AS VARCHAR), 4, '0') AS raw0 FROM obs))"""


# --- crops: one appearance vector per embedding -----------------------------------
def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").alias("identity"),
                    (F.col("vec_id") % 6).cast("int").alias("camera"), F.col("embedding").alias("vector"))


CROPS = """crops AS (SELECT vec_id, label AS identity, CAST(vec_id % 6 AS INT) AS camera,
 embedding AS vector FROM embeddings)"""


# --- verdicts: operator feedback per reviewed document ------------------------------
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return (table(spark, sf_dir, "labels").join(d, "doc_id")
            .select("doc_id", F.col("lang").alias("camera_id"), F.col("source").alias("event_type"),
                    F.when(F.col("quality") == 1, "true_positive").otherwise("false_alarm").alias("verdict")))


VERDICTS = """verdicts AS (SELECT doc_id, lang AS camera_id, source AS event_type,
 CASE WHEN quality = 1 THEN 'true_positive' ELSE 'false_alarm' END AS verdict
 FROM labels JOIN documents USING (doc_id))"""


# --- scored_obs: an event log with every promoted column ------------------------------
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accumulated event log the read-side queries run on."""
    o = obs(spark, sf_dir)
    score = (F.col("event_id") * 37 % 1000) / 1000.0
    state = F.col("event_id") % 11
    return o.withColumns({
        "node_id": F.col("camera_id"),
        "score": score,
        "rank": F.when(score >= 0.85, 4).when(score >= 0.65, 3).when(score >= 0.45, 2)
                 .when(score >= 0.25, 1).otherwise(0),
        "zone_id": F.when(F.col("event_id") % 3 == 0, F.concat("camera_id", F.lit("-Z1")))
                    .when(F.col("event_id") % 3 == 1, F.concat("camera_id", F.lit("-Z2"))),
        "event_kind": F.element_at(F.array(*[F.lit(t) for t in EVENT_KINDS]),
                                   (F.col("event_id") % len(EVENT_KINDS) + 1).cast("int")),
        "sync_state": F.when(state < 3, "pending").when(state == 3, "failed")
                       .when(state == 4, "evidence_evicted").otherwise("synced"),
        "alerted": (F.col("event_id") % 4 == 0) & (score >= 0.25),
        "acknowledged": F.col("event_id") % 6 == 0,
        "evidence_bytes": F.when(score >= 0.45, F.col("event_id") % 997 * 1000).otherwise(0),
        "sealed": F.col("event_id") % 13 != 0,
    })


EVENT_KINDS = ["line_crossing", "zone_intrusion", "loitering", "vehicle_movement",
               "night_movement", "suspicious_activity", "camera_tamper", "wrong_direction"]
LOG = """log AS (SELECT *, CASE WHEN score >= 0.85 THEN 4 WHEN score >= 0.65 THEN 3
   WHEN score >= 0.45 THEN 2 WHEN score >= 0.25 THEN 1 ELSE 0 END AS rank,
   (event_id % 4 = 0) AND score >= 0.25 AS alerted,
   CASE WHEN score >= 0.45 THEN event_id % 997 * 1000 ELSE 0 END AS evidence_bytes
 FROM (SELECT *, camera_id AS node_id, (event_id * 37 % 1000) / 1000 AS score,
   CASE event_id % 3 WHEN 0 THEN camera_id || '-Z1' WHEN 1 THEN camera_id || '-Z2' END AS zone_id,
   (""" + str(EVENT_KINDS) + """)[event_id % 8 + 1] AS event_kind,
   CASE WHEN event_id % 11 < 3 THEN 'pending' WHEN event_id % 11 = 3 THEN 'failed'
        WHEN event_id % 11 = 4 THEN 'evidence_evicted' ELSE 'synced' END AS sync_state,
   event_id % 6 = 0 AS acknowledged, event_id % 13 <> 0 AS sealed FROM obs))"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def r6(c: Column) -> Column:
    return F.round(c, 6)
