"""File sources: ground truth, sequence metadata, crops, annotations, site files."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import crop_camera, crop_identity
from ..operators.patrol import PROFILE_SCHEMA
from . import schemas as S

PEDESTRIAN = 1


def _sequence(path) -> F.Column:
    return F.element_at(F.split(path, "/"), -3)


def read_mot_truth(spark: SparkSession, path: str, min_visibility: float = 0.25) -> DataFrame:
    """Comma-separated tracking truth ``frame,id,left,top,w,h[,conf,class,visibility]``.

    Short rows take confidence, class and visibility as 1; rows that do not parse
    are skipped.  Keeps active pedestrians that are visible enough.
    """
    raw = spark.read.text(path).select(F.split(F.trim("value"), ",").alias("p"), F.col("_metadata.file_path").alias("path"))
    num = lambda i, kind="double": F.get("p", F.lit(i)).try_cast(kind)
    has = lambda i: F.size("p") > i
    r = raw.where(F.size("p") >= 6).select(
        _sequence(F.col("path")).alias("sequence"), num(0, "long").alias("frame"), num(1, "long").alias("track_id"),
        num(2).alias("x"), num(3).alias("y"), num(4).alias("w"), num(5).alias("h"),
        F.when(has(6), num(6)).otherwise(1.0).alias("conf"), F.when(has(7), num(7)).otherwise(float(PEDESTRIAN)).alias("cls"),
        F.when(has(8), num(8)).otherwise(1.0).alias("vis"))
    r = r.na.drop()
    r = r.where((F.col("conf") != 0) & (F.col("cls").cast("int") == PEDESTRIAN) & (F.col("vis") >= min_visibility))
    return r.select("sequence", "frame", "track_id", F.lit("person").alias("object_class"), F.col("x").alias("x1"),
                    F.col("y").alias("y1"), (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"))


def read_sequence_info(spark: SparkSession, path: str) -> DataFrame:
    """``key=value`` metadata files, one row per file; key case is kept."""
    kv = spark.read.text(path).select(
        F.element_at(F.split("_metadata.file_path", "/"), -2).alias("sequence"),
        F.regexp_extract("value", r"^\s*([^=\s\[]+)\s*=", 1).alias("k"),
        F.trim(F.regexp_extract("value", r"^[^=]+=(.*)$", 1)).alias("v")).where("k <> ''")
    keys = ["name", "imDir", "frameRate", "seqLength", "imWidth", "imHeight", "imExt"]
    wide = kv.groupBy("sequence").pivot("k", keys).agg(F.first("v"))
    return wide.withColumns({k: F.col(k).try_cast("int") for k in keys if k not in ("name", "imDir", "imExt")})


def discover_sequences(spark: SparkSession, root: str) -> DataFrame:
    """Sequences under ``root`` that carry ground truth."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "gt.txt").load(root))
    return files.select(_sequence(F.col("path")).alias("sequence"), "path").distinct().orderBy("sequence")


def list_crops(spark: SparkSession, path: str) -> DataFrame:
    """Re-identification crops: identity and camera come from the file name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jpg").load(path).select("path")
    return files.select("path", crop_identity(F.col("path")).alias("identity"), crop_camera(F.col("path")).alias("camera")).where(
        "identity IS NOT NULL AND camera IS NOT NULL")


def read_annotations(spark: SparkSession, path: str, split: str, labels: list[str] | None = None) -> DataFrame:
    """Annotated samples with split tags and normalised xywh boxes."""
    box = "struct<label:string,bounding_box:array<double>>"
    schema = (f"samples array<struct<filepath:string,tags:array<string>,metadata:struct<width:int,height:int>,"
              f"ground_truth:struct<detections:array<{box}>>>>")
    s = spark.read.schema(schema).option("multiLine", "true").json(path).select(F.explode("samples").alias("s"))
    s = s.where(F.array_contains("s.tags", split))
    d = s.select(F.col("s.filepath").alias("image"), F.col("s.metadata.width").alias("w"), F.col("s.metadata.height").alias("h"),
                 F.explode("s.ground_truth.detections").alias("d"))
    if labels:
        d = d.where(F.col("d.label").isin(*labels))
    b = F.col("d.bounding_box")
    return d.select("image", F.col("d.label").alias("label"), (b[0] * F.col("w")).alias("x1"), (b[1] * F.col("h")).alias("y1"),
                    ((b[0] + b[2]) * F.col("w")).alias("x2"), ((b[1] + b[3]) * F.col("h")).alias("y2"))


#: Weekday names of site files, Monday first, and the defaults of a patrol.
WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")
PATROL = {"heading_tolerance": 70.0, "max_group": 8, "min_speed": 0.0, "max_speed": 3.0, "max_suppressions": 6, "tolerance_min": 20}
DIRECTIONS = {"left_to_right": 0.0, "right_to_left": 180.0, "away": 90.0, "towards": 270.0}


def _minute(text: str) -> int:
    hour, minute = str(text).strip().split(":")[:2]
    return int(hour) * 60 + int(minute)


def _windows(patrol: dict) -> list[tuple]:
    """Weekly windows (days, start, end, tolerance) from ``windows`` or a ``HH:MM-HH:MM`` schedule; no days: every day."""
    given = patrol.get("windows") or ([{"time": patrol["schedule"]}] if patrol.get("schedule") else [])
    out = []
    for w in given:
        start, end = (w["time"].split("-", 1) if "time" in w else (w["start"], w["end"]))
        days = [WEEKDAYS.index(str(d).lower()[:3]) if not isinstance(d, int) else d for d in w.get("days", [])]
        out.append((days, _minute(start), _minute(end), int(w.get("tolerance_min", PATROL["tolerance_min"]))))
    return out


def read_site(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Declarative site file (YAML, or JSON, which YAML contains): cameras, zones and patrols.

    The file is read by Spark, so it may lie wherever the session reads from.  Zones and
    patrols stand beside the cameras or, zones, under them.  A camera is thermal if its
    capabilities say so and visible otherwise, unless it names its sensor.
    """
    text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())  # one configuration file
    try:
        import yaml
        site = yaml.safe_load(text)
    except ImportError:
        site = json.loads(text)
    cams, zones, patrols = [], [], []
    for c in site.get("cameras", []):
        name, can = c.get("camera_id", c.get("id")), c.get("capabilities") or {}
        cams.append((name, c.get("name"), c.get("node_id", site.get("node_id")), c.get("profile", "fenced"), c.get("role", "perimeter"),
                     c.get("sensor_type", "thermal" if can.get("thermal") else "visible"), c.get("stream_url", c.get("source")), c.get("claimed_width", 1920),
                     c.get("claimed_height", 1080), float(c.get("claimed_fps", c.get("fps", 12))), c.get("enabled", True)))
        zones += [{**z, "camera_id": name} for z in c.get("zones", [])]
    rows = []
    for z in [*zones, *site.get("zones", [])]:
        name, corners = z.get("zone_id", z.get("id")), z.get("points", z.get("polygon"))
        if not corners or len(corners) < 2:
            raise ValueError(f"zone {name} needs at least two points")
        rows.append((name, z["camera_id"], z.get("name", name), z.get("kind", "polygon"), [(float(p[0]), float(p[1])) for p in corners], z.get("direction_deg"),
                     float(z.get("tolerance", 60)), z.get("enabled", True), z.get("is_lawful_route", False)))
    for n, p in enumerate(site.get("patrols", []), 1):
        path_ = p.get("path", [])
        heading = p.get("expected_heading", next((DIRECTIONS[s["direction"]] for s in path_ if s.get("direction") in DIRECTIONS), None))
        plates = list(p.get("plates", []))
        patrols.append((p.get("patrol_id", p.get("id")), p.get("name"), p.get("active", True), list(p.get("cameras", [s["camera_id"] for s in path_])), list(p.get("zones", [])),
                        _windows(p), None if heading is None else float(heading), float(p.get("heading_tolerance", PATROL["heading_tolerance"])), list(p.get("classes", ["person"])),
                        int(p.get("max_group", PATROL["max_group"])), float(p.get("min_speed", PATROL["min_speed"])), float(p.get("max_speed", PATROL["max_speed"])),
                        bool(plates), plates, int(p.get("max_suppressions", PATROL["max_suppressions"])), n))
    return {"cameras": spark.createDataFrame(cams, S.CAMERAS), "zones": spark.createDataFrame(rows, S.ZONES), "patrols": spark.createDataFrame(patrols, PROFILE_SCHEMA)}


def read_event_batches(spark: SparkSession, path: str, streaming: bool = False, files_per_trigger: int = 100) -> DataFrame:
    """Batch envelopes written by the nodes as JSON lines."""
    if streaming:
        return spark.readStream.schema(S.BATCH).option("maxFilesPerTrigger", files_per_trigger).json(path)
    return spark.read.schema(S.BATCH).option("mode", "FAILFAST").json(path)
