"""Library functions for plain SQL: native SQL functions of a session, inlined by the optimizer."""
from __future__ import annotations

from pyspark.sql import SparkSession

_POINTS = "ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>"


def _to_segment(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    """Distance to a segment, as SQL text: a function cannot be called on what a lambda binds."""
    dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
    share = f"greatest(0D, least(1D, (({px} - {ax}) * {dx} + ({py} - {ay}) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0D)))"
    share = f"CASE WHEN abs({dx}) < 1e-12 AND abs({dy}) < 1e-12 THEN 0D ELSE {share} END"
    return f"sqrt(power({px} - ({ax} + {share} * {dx}), 2) + power({py} - ({ay} + {share} * {dy}), 2))"


#: Name, parameters, result and body.  Bodies state what the column functions of the same name do.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "point_in_polygon": (f"px DOUBLE, py DOUBLE, pts {_POINTS}", "BOOLEAN", """
        CASE WHEN size(pts) < 3 THEN FALSE ELSE size(filter(sequence(0, size(pts) - 1), i -> coalesce(
            (pts[i].y > py) <> (pts[pmod(i - 1, size(pts))].y > py) AND px < (pts[pmod(i - 1, size(pts))].x - pts[i].x) * (py - pts[i].y)
            / nullif(pts[pmod(i - 1, size(pts))].y - pts[i].y, 0D) + pts[i].x, FALSE))) % 2 = 1 END"""),
    "segment_distance": ("px DOUBLE, py DOUBLE, ax DOUBLE, ay DOUBLE, bx DOUBLE, by DOUBLE", "DOUBLE", _to_segment("px", "py", "ax", "ay", "bx", "by")),
    "distance_to_polyline": (f"px DOUBLE, py DOUBLE, pts {_POINTS}", "DOUBLE", f"""
        CASE WHEN size(pts) >= 2 THEN array_min(transform(sequence(1, greatest(size(pts) - 1, 1)),
            i -> {_to_segment("px", "py", "pts[i - 1].x", "pts[i - 1].y", "pts[i].x", "pts[i].y")}))
        WHEN size(pts) = 1 THEN sqrt(power(px - pts[0].x, 2) + power(py - pts[0].y, 2)) ELSE 1D END"""),
    "minutes_outside": ("ts TIMESTAMP, days ARRAY<INT>, from_minute INT, to_minute INT", "DOUBLE", """
        CASE WHEN NOT (size(days) = 0 OR array_contains(days, weekday(ts))
            OR to_minute < from_minute AND array_contains(days, CAST(pmod(weekday(ts) - 1, 7) AS INT)) AND hour(ts) * 60 + minute(ts) <= to_minute) THEN DOUBLE('Infinity')
        WHEN to_minute < from_minute AND (hour(ts) * 60 + minute(ts) >= from_minute OR hour(ts) * 60 + minute(ts) <= to_minute)
            OR to_minute >= from_minute AND hour(ts) * 60 + minute(ts) BETWEEN from_minute AND to_minute THEN 0D
        ELSE CAST(least(abs(hour(ts) * 60 + minute(ts) - from_minute), 1440 - abs(hour(ts) * 60 + minute(ts) - from_minute),
            abs(hour(ts) * 60 + minute(ts) - to_minute), 1440 - abs(hour(ts) * 60 + minute(ts) - to_minute)) AS DOUBLE) END"""),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to ``spark.sql`` of this session; returns their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
