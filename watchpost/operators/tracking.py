"""Detections to tracks."""
from __future__ import annotations

import heapq
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut
from ..values import DEFAULTS, OBJECT_CLASSES, Params
from .fold import fold
from .metrics import overlap_matrix
from .ordered import CHUNK, running, with_chunks
from .rules import ORDER, TRACK, WIDTH_US


def class_vote(points: DataFrame) -> DataFrame:
    """Running majority class per track (``voted_class``).

    One running count per class of the closed vocabulary; ties go to the class
    whose name sorts first.
    """
    p = with_chunks(points, TRACK, "ts_us", WIDTH_US)
    p = running(p, TRACK, ORDER, {f"_v_{c}": ("count", F.col("object_class") == c) for c in OBJECT_CLASSES})
    tally = F.array(*[F.struct((-F.col(f"_v_{c}")).alias("n"), F.lit(c).alias("c"))
                      for c in sorted(OBJECT_CLASSES)])
    return p.withColumn("voted_class", F.array_min(tally)["c"]).drop(
        "_chunk", *[f"_v_{c}" for c in OBJECT_CLASSES])


#: Up to so many pairs of boxes are looked at all at once.
FEW_PAIRS = 4_096
#: A crowded frame is matched band by band: pairs that overlap by so much come first.
BANDS = (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2)


def best_first(a: np.ndarray, b: np.ndarray, floor: float) -> list[tuple[int, int]]:
    """One-to-one pairs of boxes by falling overlap (at least ``floor``), then by place in ``a``, then in ``b``.

    A crowd is not met pair by pair.  Equal boxes are one group that pairs member by member, and
    groups meet band by band of overlap: an overlap of t needs sides that differ by at most
    the share 1 - t, so a band only looks at near neighbours along one axis, and later, wider
    bands only at what the earlier ones left.
    """
    if not len(a) or not len(b):
        return []
    if len(a) * len(b) <= FEW_PAIRS or floor <= 0:
        iou = overlap_matrix(a, b)
        ai, bi = np.nonzero(iou >= floor)
        order = np.lexsort((bi, ai, -iou[ai, bi]))
        used_a, used_b, out = set(), set(), []
        for i, j in zip(ai[order].tolist(), bi[order].tolist()):
            if i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                out.append((i, j))
        return out
    (ua, free_a), (ub, free_b) = _alike(a), _alike(b)
    left_a, left_b, out = np.arange(len(ua)), np.arange(len(ub)), []
    for band in [t for t in BANDS if t > floor] + [floor]:
        gi, gj, iou = _neighbours(ua, ub, left_a, left_b, band)
        order = np.lexsort((gj, gi, -iou))
        gi, gj, iou = gi[order].tolist(), gj[order].tolist(), iou[order].tolist()
        lo = 0
        while lo < len(gi):
            hi = lo + 1
            while hi < len(gi) and iou[hi] == iou[lo]:
                hi += 1
            _take(gi[lo:hi], gj[lo:hi], free_a, free_b, out)
            lo = hi
        left_a = np.array([i for i in left_a.tolist() if free_a[i]], dtype=int)
        left_b = np.array([j for j in left_b.tolist() if free_b[j]], dtype=int)
        if not len(left_a) or not len(left_b):
            break
    return out


def _alike(boxes: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """Different boxes that can overlap at all, and the places of each, last one first."""
    with np.errstate(invalid="ignore"):
        solid = np.isfinite(boxes).all(axis=1) & (boxes[:, 2] > boxes[:, 0]) & (boxes[:, 3] > boxes[:, 1])
    at = np.flatnonzero(solid)
    order = at[np.lexsort((-at, *boxes[at].T))]
    rows = boxes[order]
    starts = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]) if len(rows) else np.empty(0, int)
    places = order.tolist()
    return rows[starts], [places[lo:hi] for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(places)])]


def _neighbours(ua: np.ndarray, ub: np.ndarray, left_a: np.ndarray, left_b: np.ndarray, band: float, slice_pairs: int = 1 << 20):
    """Groups (places in ``ua`` and ``ub``, overlap) of those left that overlap by at least ``band``."""
    if not len(left_a) or not len(left_b):
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    a, b, best = ua[left_a], ub[left_b], None
    for axis in (0, 1):
        size = (a[:, axis + 2] - a[:, axis]) * (1 + 1e-6)
        slack = np.abs(a[:, axis]) * 1e-9
        order = np.argsort(b[:, axis], kind="stable")
        start = np.searchsorted(b[order, axis], a[:, axis] - (1 / band - 1) * size - slack - size * 1e-6, "left")
        n = np.searchsorted(b[order, axis], a[:, axis] + (1 - band) * size + slack + size * 1e-6, "right") - start
        if best is None or n.sum() < best[2].sum():
            best = order, start, n
    order, start, n = best
    found, ends, lo = [], np.cumsum(n), 0
    while lo < len(a):  # a slice of rows at a time
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + slice_pairs, "right")))
        i = np.repeat(np.arange(lo, hi), n[lo:hi])
        j = order[np.arange(len(i)) - np.repeat(ends[lo:hi] - n[lo:hi] - (ends[lo - 1] if lo else 0), n[lo:hi]) + np.repeat(start[lo:hi], n[lo:hi])]
        p, q = a[i], b[j]
        w = np.clip(np.minimum(p[:, 2], q[:, 2]) - np.maximum(p[:, 0], q[:, 0]), 0, None)
        h = np.clip(np.minimum(p[:, 3], q[:, 3]) - np.maximum(p[:, 1], q[:, 1]), 0, None)
        iou = w * h / ((p[:, 2] - p[:, 0]) * (p[:, 3] - p[:, 1]) + (q[:, 2] - q[:, 0]) * (q[:, 3] - q[:, 1]) - w * h)
        near = iou >= band
        found.append((left_a[i[near]], left_b[j[near]], iou[near]))
        lo = hi
    return tuple(np.concatenate(c) for c in zip(*found))


def _take(gi: list[int], gj: list[int], free_a: list[list[int]], free_b: list[list[int]], out: list[tuple[int, int]]) -> None:
    """Pair the free members of groups that overlap by one and the same share, smallest places first."""
    if len(gi) == 1 or (len(set(gi)) == len(gi) and len(set(gj)) == len(gj)):
        for i, j in zip(gi, gj):
            a, b = free_a[i], free_b[j]
            for _ in range(min(len(a), len(b))):
                out.append((a.pop(), b.pop()))
        return
    wishes: dict[int, list[int]] = {}
    for i, j in zip(gi, gj):
        if free_a[i] and free_b[j]:
            wishes.setdefault(i, []).append(j)
    turns = [(free_a[i][-1], i) for i in wishes]
    heapq.heapify(turns)
    while turns:
        place, i = heapq.heappop(turns)
        wishes[i] = [j for j in wishes[i] if free_b[j]]
        if wishes[i]:
            free_a[i].pop()
            out.append((place, free_b[min(wishes[i], key=lambda j: free_b[j][-1])].pop()))
            if free_a[i]:
                heapq.heappush(turns, (free_a[i][-1], i))


TRACK_SCHEMA = ("camera_id string, frame long, det_id string, track_key string, object_class string, confidence double, "
                "x1 double, y1 double, x2 double, y2 double, hits long, lost_frames long, confirmed boolean, "
                "vx double, vy double")


def track(detections: DataFrame, params: Params = DEFAULTS, coasted: bool = False, width: int = 100_000,
          target_rows: int = 200_000) -> DataFrame:
    """Two-pass tracking by detection, one state per camera.

    Confident detections are matched first, then weak ones may still continue a
    track; only confident ones start a track.  A track is named after the
    detection that started it.  Frames without rows count as frames in which
    nothing was seen.  With ``coasted`` the predicted boxes of lost tracks are
    returned too (``lost_frames`` > 0, no detection id).

    Tracks are held in order of their last sighting and box, so equal overlaps are settled
    alike whatever came before.  What chunks of a long timeline hand on is boxes, velocities
    and last frames only: a parked object that was always there leaves the same state as one
    that a chunk has just found.  Names, hits and class votes are worked out afterwards, by
    doubling the step back over chunk borders (``_named``).

    ``detections``: camera_id, frame, det_id, object_class, confidence, box.
    """
    p = params
    rows = with_chunks(detections.select("camera_id", "frame", "det_id", "object_class", "confidence", "x1", "y1", "x2", "y2"),
                       ["camera_id"], "frame", width, target_rows)
    chunked = CHUNK in rows.columns

    def step(pdf: pd.DataFrame, state: str | None):
        st = json.loads(state) if state else {"frame": None, "meta": [], "box": [], "vel": [], "seen": []}
        # a lost track moves on with its velocity: its box at any frame follows
        # from the last observed one, so nothing is updated while it is lost
        meta, last = st["meta"], st["frame"]
        if chunked:
            meta = [{"key": f"{INHERITED}{i}", "cls": None, "conf": None, "hits": 0, "votes": {}} for i in range(len(st["seen"]))]
        box = np.array(st["box"], dtype=float).reshape(-1, 4)
        vel = np.array(st["vel"], dtype=float).reshape(-1, 2)
        seen = np.array(st["seen"], dtype=np.int64)
        cam, out, sighted = pdf["camera_id"].iloc[0], [], []

        def in_order():
            nonlocal meta, box, vel, seen
            order = np.lexsort((box[:, 3], box[:, 2], box[:, 1], box[:, 0], seen))
            meta, box, vel, seen = [meta[i] for i in order.tolist()], box[order], vel[order], seen[order]

        def report(i, frame, det, at, lost):
            m = meta[i]
            out.append((cam, frame, det, m["key"], m["cls"], m["conf"], *at, m["hits"], lost, m["hits"] >= p.min_hits,
                        float(vel[i, 0]), float(vel[i, 1])))

        def report_lost(frame, skip=()):
            for i in np.flatnonzero((seen < frame) & (frame - seen <= p.max_lost)).tolist():
                if i not in skip:
                    lost = int(frame - seen[i])
                    report(i, frame, None, (box[i] + np.tile(vel[i], 2) * lost).tolist(), lost)

        frames = pdf["frame"].to_numpy()
        boxes, conf = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float), pdf["confidence"].to_numpy(float)
        dets, classes = pdf["det_id"].tolist(), pdf["object_class"].tolist()
        edges = np.flatnonzero(np.diff(frames)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(frames)]):
            frame = int(frames[lo])
            if coasted and last is not None:
                for gap in range(last + 1, min(frame, last + p.max_lost + 2)):
                    report_lost(gap)
            keep = frame - 1 - seen <= p.max_lost
            if not keep.all():
                meta = [m for m, k in zip(meta, keep.tolist()) if k]
                box, vel, seen = box[keep], vel[keep], seen[keep]
            in_order()
            lost = (frame - 1 - seen)[:, None]
            drift = np.hstack([vel, vel])
            ahead = box + drift * (lost + 1)
            here = np.arange(lo, hi)
            strong = conf[here] >= p.high_confidence
            high, low = here[strong], here[~strong]
            got = [(a, int(high[b])) for a, b in best_first(ahead, boxes[high], p.match_iou)]
            if len(low):
                matched = {a for a, _ in got}
                rest = np.array([i for i in range(len(meta)) if i not in matched], dtype=int)
                got += [(int(rest[a]), int(low[b])) for a, b in best_first(ahead[rest], boxes[low], p.low_match_iou)]
            if got:
                at, by = (np.array(x, dtype=int) for x in zip(*got))
                was, now = box[at] + drift[at] * lost[at], boxes[by]
                vel[at, 0] = 0.7 * vel[at, 0] + 0.3 * ((now[:, 0] + now[:, 2]) / 2 - (was[:, 0] + was[:, 2]) / 2)
                vel[at, 1] = 0.7 * vel[at, 1] + 0.3 * (now[:, 3] - was[:, 3])
                box[at], seen[at] = now, frame
                if chunked:
                    sighted.append((by, [meta[a]["key"] for a, _ in got], vel[at]))
            for a, d in () if chunked else got:
                m = meta[a]
                m["conf"] = float(conf[d])
                m["hits"] += 1
                m["votes"][classes[d]] = m["votes"].get(classes[d], 0) + 1
                m["cls"] = min(m["votes"], key=lambda c: (-m["votes"][c], c))
                report(a, frame, dets[d], boxes[d].tolist(), 0)
            if coasted:
                report_lost(frame, {a for a, _ in got})
            taken = {d for _, d in got}
            fresh = [d for d in high.tolist() if d not in taken]
            if fresh:
                box, vel = np.vstack([box, boxes[fresh]]), np.vstack([vel, np.zeros((len(fresh), 2))])
                seen = np.concatenate([seen, np.full(len(fresh), frame)])
                for d in fresh:
                    meta.append({"key": str(dets[d]), "cls": classes[d], "conf": float(conf[d]), "hits": 1, "votes": {classes[d]: 1}})
                    if not chunked:
                        report(len(meta) - 1, frame, dets[d], boxes[d].tolist(), 0)
                if chunked:
                    sighted.append((np.array(fresh), [str(dets[d]) for d in fresh], np.zeros((len(fresh), 2))))
            last = frame
        in_order()
        live = last - seen <= p.max_lost
        left = [m for m, k in zip(meta, live.tolist()) if k]
        done = pd.DataFrame(out, columns=[f.strip().split(" ")[0] for f in TRACK_SCHEMA.split(",")])
        if chunked:  # where each name went: the place of the track among those handed on
            if sighted:  # hits, votes and confidence so far are worked out in ``_named``
                at, vels = np.concatenate([x[0] for x in sighted]), np.concatenate([x[2] for x in sighted])
                rows_ = pdf[["frame", "det_id", "object_class", "confidence", "x1", "y1", "x2", "y2"]].iloc[at].reset_index(drop=True)
                rows_ = rows_.assign(camera_id=cam, track_key=[k for x in sighted for k in x[1]], hits=1, lost_frames=0, confirmed=False, vx=vels[:, 0], vy=vels[:, 1])
                done = pd.concat([rows_[done.columns].astype(object), done.astype(object)], ignore_index=True) if len(done) else rows_[done.columns].astype(object)
            done["part"], done["slot"] = pdf[CHUNK].iloc[0], None
            slots = pd.DataFrame({"camera_id": cam, "track_key": [m["key"] for m in left], "part": pdf[CHUNK].iloc[0], "slot": range(len(left))})
            done = pd.concat([done.astype(object), slots.astype(object)], ignore_index=True)
        return done, json.dumps({"frame": last, "meta": [] if chunked else left, "box": box[live].tolist(), "vel": vel[live].tolist(), "seen": seen[live].tolist()}, sort_keys=True)

    if not chunked:
        return fold(rows, ["camera_id"], ["frame", "det_id"], step, TRACK_SCHEMA)
    return _named(fold(rows, ["camera_id"], ["frame", "det_id"], step, f"{TRACK_SCHEMA}, part long, slot int"), p)


#: Marks the name of a track that a chunk got from the one before: the place it had there follows.
INHERITED = "\x00"


def _named(found: DataFrame, params: Params) -> DataFrame:
    """Tracks of chunks under their first detection's name, with hits, votes and last confidence over all chunks."""
    chunk = ["camera_id", "part"]
    before = found.select(*chunk).distinct().withColumn("_prev", F.lag("part").over(W.partitionBy("camera_id").orderBy("part")))
    inherited = F.col("track_key").startswith(INHERITED)
    slot = F.when(inherited, F.substring("track_key", F.lit(2), F.length("track_key")).cast("int"))
    steps = found.where("slot IS NOT NULL").join(before, chunk).select(
        *chunk, "slot", F.when(~inherited, F.col("track_key")).alias("name"), F.when(inherited, F.col("_prev")).alias("to_part"), slot.alias("to_slot"))
    steps = cut(steps)
    while not steps.where("name IS NULL").isEmpty():  # twice as far back each time
        back = steps.select("camera_id", F.col("part").alias("to_part"), F.col("slot").alias("to_slot"), F.col("name").alias("_n"), F.col("to_part").alias("_p"), F.col("to_slot").alias("_s"))
        steps = cut(steps.join(back, ["camera_id", "to_part", "to_slot"], "left").select(
            *chunk, "slot", F.coalesce("name", "_n").alias("name"), F.col("_p").alias("to_part"), F.col("_s").alias("to_slot")))
    names = steps.select("camera_id", F.col("part").alias("_prev"), F.col("slot").alias("_slot"), "name")
    rows = found.where("slot IS NULL").join(before, chunk).withColumn("_slot", slot).join(names, ["camera_id", "_prev", "_slot"], "left")
    rows = rows.withColumn("track_key", F.coalesce("name", "track_key")).select(*[c for c in found.columns if c not in ("part", "slot")])
    key, own = ["camera_id", "track_key"], F.col("det_id").isNotNull()
    rows = rows.withColumns({"object_class": F.when(own, F.col("object_class")), "confidence": F.when(own, F.col("confidence"))})
    tally = {f"_v_{c}": ("count", own & (F.col("_det_class") == c)) for c in OBJECT_CLASSES}
    rows = running(with_chunks(rows.withColumn("_det_class", F.col("object_class")), key, "frame", WIDTH_US), key, ["frame"],
                   {"_hits": ("count", own), "_conf": ("last", F.col("confidence")), "_last": ("last", F.col("_det_class")), **tally})
    votes = F.array(*[F.struct((-F.col(f"_v_{c}")).alias("n"), F.lit(c).alias("c")) for c in sorted(OBJECT_CLASSES)])
    known = F.greatest(*[F.col(f"_v_{c}") for c in OBJECT_CLASSES]) > 0
    return rows.select(
        "camera_id", "frame", "det_id", "track_key", F.when(known, F.array_min(votes)["c"]).otherwise(F.col("_last")).alias("object_class"), F.col("_conf").alias("confidence"),
        "x1", "y1", "x2", "y2", F.col("_hits").alias("hits"), "lost_frames", (F.col("_hits") >= params.min_hits).alias("confirmed"), "vx", "vy")
