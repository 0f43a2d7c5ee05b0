"""Image-space geometry as Spark columns (boxes, zones, headings).

``pts`` arguments are ``array<struct<x:double,y:double>>`` in 0..1 image space.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import COMPASS


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


# --- boxes -------------------------------------------------------------------
def box_width(x1, x2) -> Column:
    return F.greatest(F.lit(0.0), x2 - x1)


def box_height(y1, y2) -> Column:
    return F.greatest(F.lit(0.0), y2 - y1)


def box_area(x1, y1, x2, y2) -> Column:
    return box_width(x1, x2) * box_height(y1, y2)


def box_centre(x1, y1, x2, y2) -> Column:
    return F.struct(((x1 + x2) / 2.0).alias("x"), ((y1 + y2) / 2.0).alias("y"))


def box_foot(x1, y1, x2, y2) -> Column:
    """Bottom centre: where the object meets the ground."""
    return F.struct(((x1 + x2) / 2.0).alias("x"), y2.alias("y"))


def box_iou(a: tuple, b: tuple) -> Column:
    """Intersection over union of ``(x1, y1, x2, y2)`` column tuples."""
    iw = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    ih = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    inter = iw * ih
    union = box_area(*a) + box_area(*b) - inter
    return F.when(union > 0, inter / F.nullif(union, F.lit(0.0))).otherwise(F.lit(0.0))


# --- points, lines, zones ----------------------------------------------------
def normalised(x, y, width, height) -> Column:
    return F.struct((x / F.greatest(F.lit(1), width)).alias("x"),
                    (y / F.greatest(F.lit(1), height)).alias("y"))


def point_in_polygon(px, py, pts) -> Column:
    """Even-odd crossing test; fewer than three points is never inside."""
    n = F.size(pts)
    before = F.concat(F.slice(pts, n, F.lit(1)), F.slice(pts, F.lit(1), n - 1))
    edges = F.arrays_zip(pts.alias("a"), before.alias("b"))

    def crosses(e):
        a, b = e["a"], e["b"]
        straddles = (a["y"] > py) != (b["y"] > py)
        at = (b["x"] - a["x"]) * (py - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]
        return F.coalesce(straddles & (px < at), F.lit(False))

    return F.when(n < 3, F.lit(False)).otherwise(
        F.size(F.filter(edges, crosses)) % 2 == 1)


def orientation(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segments_intersect(p1, p2, q1, q2) -> Column:
    """Each segment's ends lie on different sides of the other segment."""
    left = lambda a, b, c: orientation(a[0], a[1], b[0], b[1], c[0], c[1]) > 0
    return (left(q1, q2, p1) != left(q1, q2, p2)) & (left(p1, p2, q1) != left(p1, p2, q2))


def side_of_line(px, py, a, b) -> Column:
    """-1, 0 or 1 relative to the directed line a->b, with a 1e-9 dead band."""
    cross = orientation(a["x"], a["y"], b["x"], b["y"], px, py)
    return F.when(cross > 1e-9, 1).when(cross < -1e-9, -1).otherwise(0)


def heading_deg(x0, y0, x1, y1) -> Column:
    """0 = East, counter-clockwise, image y negated; null when stationary."""
    dx, dy = x1 - x0, y0 - y1
    still = (F.abs(dx) < 1e-9) & (F.abs(dy) < 1e-9)
    return F.when(~still, F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0)))


def angular_difference(a, b) -> Column:
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, 360.0 - d)


def compass_label(deg) -> Column:
    octant = (F.floor((F.pmod(deg, F.lit(360.0)) + 22.5) / 45.0) % 8).cast("int")
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in COMPASS]), octant), F.lit("stationary"))


def _hypot(dx, dy) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def _segments(pts) -> Column:
    n = F.size(pts)
    return F.arrays_zip(F.slice(pts, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"),
                        F.slice(pts, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"))


def polyline_length(pts) -> Column:
    return F.aggregate(_segments(pts), F.lit(0.0), lambda acc, s: acc + _hypot(
        s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]))


def segment_distance(px, py, ax, ay, bx, by) -> Column:
    dx, dy = bx - ax, by - ay
    degenerate = (F.abs(dx) < 1e-12) & (F.abs(dy) < 1e-12)
    t = ((px - ax) * dx + (py - ay) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.when(degenerate, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)))
    return _hypot(px - (ax + t * dx), py - (ay + t * dy))


def distance_to_polyline(px, py, pts) -> Column:
    """Distance to the nearest segment; to the point when there is only one."""
    first = F.get(pts, F.lit(0))
    return (F.when(F.size(pts) >= 2, F.array_min(F.transform(_segments(pts), lambda s: segment_distance(
                px, py, s["a"]["x"], s["a"]["y"], s["b"]["x"], s["b"]["y"]))))
            .when(F.size(pts) == 1, _hypot(px - first["x"], py - first["y"]))
            .otherwise(F.lit(1.0)))


def off_route_distance(px, py, pts) -> Column:
    """Zero inside the route's polygon, else the distance to its outline."""
    return F.when(point_in_polygon(px, py, pts), 0.0).otherwise(distance_to_polyline(px, py, pts))
