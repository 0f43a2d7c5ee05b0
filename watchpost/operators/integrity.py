"""Camera integrity from per-frame measurements: tampering and outages."""
from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..values import DEFAULTS, Params
from .fold import fold
from .ordered import neighbours, running, with_chunks

CAM, ORDER, WIDTH_US = ["camera_id"], ["ts_us", "frame_id"], 86_400_000_000


def _run_length(frames: DataFrame, same, out: str) -> DataFrame:
    """Length of the current run of rows for which ``same`` holds (0 when it breaks)."""
    f = running(frames.withColumn("_same", same), CAM, ORDER, {"_pos": ("count", F.lit(True))})
    f = running(f, CAM, ORDER, {"_brk": ("max", F.when(~F.col("_same"), F.col("_pos")))})
    return f.withColumn(out, F.col("_pos") - F.coalesce("_brk", F.lit(0))).drop("_same", "_pos", "_brk")


def tamper_verdicts(frames: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    """Frozen, covered, blinded and defocused frames of each camera.

    Checks run in that order, and a frame that fails one does not reach the next.
    The camera's own first frames are its baseline; nothing but a frozen feed is
    judged before that.  ``frames``: camera_id, frame_id, ts_us, digest, mean,
    std, focus, motion.  Adds ``kind`` (null when clean).
    """
    f = with_chunks(frames, CAM, "ts_us", WIDTH_US)
    f = neighbours(f, CAM, ORDER, back={"_prev": "digest"})
    f = _run_length(f, F.coalesce(F.col("_prev") == F.col("digest"), F.lit(False)), "_still")
    f = running(f, CAM, ORDER, {"_seen": ("count", F.lit(True))})
    frozen = F.col("_still") + 1 >= params.frozen_digests + params.frozen_streak - 1
    f = f.withColumn("_frozen", frozen)
    learn = ~F.col("_frozen") & (F.col("_seen") <= params.baseline_frames)
    f = running(f, CAM, ORDER, {"_n": ("count", learn), **{
        f"_s{c}": ("sum", F.when(learn, F.col(c)).otherwise(0.0)) for c in ("mean", "std", "motion")}})
    base = lambda c: F.col(f"_s{c}") / F.nullif("_n", F.lit(0))
    bm, bs, bo = F.coalesce(base("mean"), F.lit(1.0)), F.coalesce(base("std"), F.lit(1.0)), F.coalesce(base("motion"), F.lit(0.0))
    g = f.withColumns({
        "_cov": (F.col("mean") < F.greatest(F.lit(3.0), bm * 0.40)) & (F.col("std") < F.greatest(F.lit(2.5), bs * 0.35))
        & (F.col("motion") < F.greatest(F.lit(0.4), bo * 0.25)),
        "_bli": (F.col("mean") > F.greatest(F.lit(215.0), bm * 2.4)) & (F.col("std") < F.greatest(F.lit(6.0), bs * 0.45)),
        "_def": (F.col("focus") < 3.0) & (F.col("std") > 10)})
    kept = ["camera_id", "frame_id", "ts_us"]
    parts = [g.where("_frozen").select(*kept, F.lit("frozen").alias("kind"))]
    g = g.where(~F.col("_frozen"))
    early = F.col("_seen") <= params.baseline_frames
    parts.append(g.where(early).select(*kept, F.lit(None).cast("string").alias("kind")))
    g = g.where(~early)
    for flag, kind, need in (("_cov", "covered", params.persistence), ("_bli", "blinded", params.persistence),
                             ("_def", "defocused", params.persistence * 2)):
        g = _run_length(g, F.col(flag), "_run")
        parts.append(g.where(F.col("_run") >= need).select(*kept, F.lit(kind).alias("kind")))
        g = g.where(F.col("_run") < need).drop("_run")
    parts.append(g.select(*kept, F.lit(None).cast("string").alias("kind")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def moved_verdicts(frames: DataFrame, params: Params = DEFAULTS, width: int = WIDTH_US, target_rows: int = 50_000) -> DataFrame:
    """Frames on which a camera is found repointed.

    The reference picture follows slow change and is replaced when a new view has
    persisted.  ``frames`` carries ``thumb``, a small grey image as floats.
    """
    rows = with_chunks(frames.select("camera_id", "frame_id", "ts_us", "thumb"), CAM, "ts_us", width, target_rows)

    def step(pdf: pd.DataFrame, state: str | None):
        st = json.loads(state) if state else {"ref": None, "n": 0}
        ref, n, hit = (None if st["ref"] is None else np.array(st["ref"], dtype=np.float32)), st["n"], []
        for thumb in pdf["thumb"]:
            img = np.asarray(thumb, dtype=np.float32)
            moved = False
            if ref is None:
                ref = img
            elif float(np.abs(img - ref).mean()) > params.moved_divergence:
                n += 1
                if n >= params.persistence:
                    ref, n, moved = img, 0, True
            else:
                n = 0
                ref = ((1 - params.reference_alpha) * ref + params.reference_alpha * img).astype(np.float32)
            hit.append(moved)
        return (pdf.loc[hit, ["camera_id", "frame_id", "ts_us"]],
                json.dumps({"ref": None if ref is None else [float(v) for v in ref], "n": n}))

    return fold(rows, CAM, ORDER, step, "camera_id string, frame_id long, ts_us long")


def tamper_events(verdicts: DataFrame) -> DataFrame:
    """One event when tampering starts; it re-arms when the picture is clean."""
    v = with_chunks(verdicts, CAM, "ts_us", WIDTH_US)
    v = neighbours(v.withColumn("_bad", F.col("kind").isNotNull()), CAM, ORDER, back={"_was": "_bad"})
    v = v.where(F.col("_bad") & ~F.coalesce("_was", F.lit(False)))
    kind = F.when(F.col("kind") == "frozen", "stream_replay_suspected").otherwise("camera_tamper")
    return v.select("camera_id", "frame_id", "ts_us", "kind", kind.alias("event_type"),
                    F.concat_ws(":", "camera_id", F.lit("tamper"), "kind").alias("dedupe_key"))


def outages(frames: DataFrame, silent_s: float = 5.0, as_of_us: int | None = None) -> DataFrame:
    """Gaps longer than ``silent_s``: when a camera went offline and came back.

    With ``as_of_us`` a camera that is still silent then is reported with no return.
    """
    f = with_chunks(frames, CAM, "ts_us", WIDTH_US)
    f = neighbours(f, CAM, ORDER, ahead={"_next": "ts_us"})
    until = F.col("_next") if as_of_us is None else F.coalesce("_next", F.lit(as_of_us))
    gap = (until - F.col("ts_us")) / 1e6
    return f.where(gap > silent_s).select("camera_id", (F.col("ts_us") + F.lit(int(silent_s * 1e6))).alias("offline_us"),
                                          F.col("_next").alias("online_us"), F.lit("camera_offline").alias("event_type"))
