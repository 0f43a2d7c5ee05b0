"""Deterministic evaluation splits from labelled crops and boxes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running, with_chunks


def spread_key(*parts: str) -> Column:
    """A reproducible pseudo-random order: SHA-256 of the parts."""
    return F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256)


def _first_by_key(df: DataFrame, keys: list[str], limit: int, position: str) -> DataFrame:
    pos = F.conv(F.substring(position, 1, 10), 16, 10).cast("long")
    d = with_chunks(df.withColumn("_kp", pos), keys, "_kp", 1 << 30)
    return running(d, keys, ["_kp", position], {"_nth": ("count", F.lit(True))}).where(F.col("_nth") <= limit).drop("_nth", "_kp", "_chunk")


def identity_split(crops: DataFrame, stride: int = 1, min_w: float = 32, min_h: float = 64, per_identity: int = 40,
                   min_crops: int = 4, val_fraction: float = 0.15) -> DataFrame:
    """Identity-disjoint train / val crops: stride, size floor, cap, minimum."""
    ok = crops.where((F.col("frame") % stride == 0) & (F.col("x2") - F.col("x1") >= min_w) & (F.col("y2") - F.col("y1") >= min_h))
    ok = _first_by_key(ok.withColumn("_k", spread_key("identity", "crop_id")), ["identity"], per_identity, "_k").drop("_k")
    ids = ok.groupBy("identity").agg(F.count("*").alias("n")).where(F.col("n") >= min_crops)
    return ok.join(_hold_out(ids, val_fraction, None), "identity")


def cross_camera_split(crops: DataFrame, min_cameras: int = 2, min_crops: int = 4, val_cap: int | None = None) -> DataFrame:
    """Identities seen on several cameras; 10 % (with ``val_cap``: at most so many) held out."""
    ids = crops.where("identity NOT IN (0, -1)").groupBy("identity").agg(
        F.count("*").alias("n"), F.count_distinct("camera").alias("cams")).where(
        (F.col("n") >= min_crops) & (F.col("cams") >= min_cameras))
    return crops.join(_hold_out(ids, 0.1, val_cap), "identity")


def _hold_out(ids: DataFrame, fraction: float, cap: int | None) -> DataFrame:
    """First share of the identities in hash order goes to validation."""
    i = ids.select("identity", spread_key("identity").alias("_k"), F.lit(0).alias("_one"))
    i = i.withColumn("_kp", F.conv(F.substring("_k", 1, 10), 16, 10).cast("long"))
    i = running(with_chunks(i, ["_one"], "_kp", 1 << 30), ["_one"], ["_kp", "_k"], {"_nth": ("count", F.lit(True))})
    n = ids.agg(F.greatest(F.lit(1), F.floor(F.count("*") * fraction)).alias("_val"))
    if cap is not None:
        n = n.withColumn("_val", F.least(F.col("_val"), F.lit(cap)))
    return i.crossJoin(F.broadcast(n)).select(
        "identity", F.when(F.col("_nth") <= F.col("_val"), "val").otherwise("train").alias("split"))


def detector_boxes(truth: DataFrame, roles: DataFrame, stride: int, min_w: float = 4, min_h: float = 8) -> DataFrame:
    """Clipped, normalised centre boxes of the sequences not held out."""
    j = truth.where(F.col("frame") % stride == 0).join(roles.where("role <> 'held_out'"), "sequence")
    w, h = F.col("frame_w"), F.col("frame_h")
    j = j.withColumns({"x1": F.greatest(F.lit(0.0), "x1"), "y1": F.greatest(F.lit(0.0), "y1"),
                       "x2": F.least(w.cast("double"), "x2"), "y2": F.least(h.cast("double"), "y2")})
    j = j.where((F.col("x2") - F.col("x1") >= min_w) & (F.col("y2") - F.col("y1") >= min_h))
    return j.select("sequence", "frame", "id", "role", F.round((F.col("x1") + F.col("x2")) / 2 / w, 6).alias("cx"),
                    F.round((F.col("y1") + F.col("y2")) / 2 / h, 6).alias("cy"),
                    F.round((F.col("x2") - F.col("x1")) / w, 6).alias("bw"), F.round((F.col("y2") - F.col("y1")) / h, 6).alias("bh"))
