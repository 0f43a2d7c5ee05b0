"""Class, priority and density labels, and small scored predicates."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import (CAPABILITY_OF_CLASS, CLASS_OF_INDEX, DORI_BANDS, DORI_PX, PRIORITIES,
                      PRIORITY_BANDS, VEHICLES)
from .geometry import box_height, box_width, point_in_polygon


def _lookup(mapping: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for v in chain(*mapping.items())]), key)


def is_vehicle(cls) -> Column:
    return cls.isin(*VEHICLES)


def priority_of_score(score) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for band, floor in PRIORITY_BANDS:
        out = out.when(score >= floor, band)
    return out.otherwise("info")


def priority_rank(priority) -> Column:
    return (F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), priority) - 1).cast("int")


def dori_of_density(ppm) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for band, floor in DORI_BANDS:
        out = out.when(ppm >= floor, band)
    return out.otherwise("monitor")


def dori_density(band) -> Column:
    return _lookup(DORI_PX, band)


def dori_satisfies(achieved, required) -> Column:
    return dori_density(achieved) >= dori_density(required)


def class_of_index(index) -> Column:
    """Detector class index to object class; null for classes not carried."""
    return _lookup(CLASS_OF_INDEX, index)


def capability_of_class(cls) -> Column:
    """Capability that authorises a class; null (never allowed) for unknown."""
    return _lookup(CAPABILITY_OF_CLASS, cls)


def class_allowed(cls, granted) -> Column:
    """``granted`` is an array of capabilities, or null when nothing is gated."""
    return F.when(granted.isNull(), True).otherwise(
        F.coalesce(F.array_contains(granted, F.coalesce(capability_of_class(cls), F.lit(""))),
                   F.lit(False)))


def mean_confidence(values) -> Column:
    """Mean of a confidence list; 0 when empty or null."""
    kept = F.filter(values, lambda v: v.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda a, v: a + v)
    return F.coalesce(total / F.nullif(F.size(kept), F.lit(0)), F.lit(0.0))


def low_profile(cls, x1, y1, x2, y2) -> Column:
    """Prone posture: a person box nearly as wide as tall, and not a speck."""
    w, h = box_width(x1, x2), box_height(y1, y2)
    return F.coalesce((cls == "person") & (w >= 24) & (h >= 12)
                      & (h / F.nullif(w, F.lit(0.0)) < 0.9), F.lit(False))


def plate_gate(x1, y1, x2, y2, frame_w, frame_h, region) -> Column:
    """May this vehicle be read?  Foot inside the certified band, or very close.

    A null region means the camera holds no plate grant at all; a region of
    fewer than three points means the whole frame.
    """
    fx = (x1 + x2) / 2.0 / F.greatest(F.lit(1), frame_w)
    fy = y2 / F.greatest(F.lit(1), frame_h)
    inside = F.when(F.size(region) < 3, True).otherwise(point_in_polygon(fx, fy, region))
    return F.when(region.isNull(), False).otherwise(inside | ((y2 - y1) >= 0.18 * frame_h))


def refinement_adjustment(mask_fraction, contact_in_zone, box_in_zone) -> Column:
    """How much a segmentation mask confirms or weakens a zone event."""
    return (F.when((mask_fraction >= 0.5) & contact_in_zone, 0.08)
            .when(mask_fraction >= 0.15, 0.03)
            .when(box_in_zone & (mask_fraction < 0.05), -0.06)
            .otherwise(0.0))


def explain(factors) -> Column:
    """One line of ``name +w.ww`` parts from ``array<struct<name,weight,..>>``."""
    shown = F.filter(factors, lambda f: F.abs(f["weight"]) > 1e-6)
    parts = F.transform(shown, lambda f: F.format_string("%s %+.2f", f["name"], f["weight"]))
    return F.coalesce(F.nullif(F.array_join(parts, " "), F.lit("")), F.lit("no contributing factors"))
