"""Detection, tracking, anomaly and re-identification metrics."""
from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import ordered
from .fold import fold
from .graph import connected
from .matching import face_to_face, greedy_pairs, overlaps, small_frames, take_turns
from .ordered import largest_key, neighbours, running, with_chunks


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(empty))


_LOW = 40


def _place(first, then) -> Column:
    """One sortable number from a value within some millions and a number that settles its ties."""
    return first.cast("long") * (1 << _LOW) + F.least(F.greatest(then, F.lit(0)), F.lit((1 << _LOW) - 1)).cast("long")


# --- detection ------------------------------------------------------------------------
def detection_outcomes(pred: DataFrame, truth: DataFrame, min_iou: float = 0.4) -> DataFrame:
    """One row per counted outcome: ``object_class`` and tp / fp / fn.

    Matching ignores class; a matched pair with different classes is a false
    positive of one class and a false negative of the other.
    Inputs: frame, id, object_class and a box.
    """
    m = greedy_pairs(overlaps(pred, truth, ["frame"], min_iou), ["frame"])
    p = pred.select("frame", F.col("id").alias("a_id"), F.col("object_class").alias("pc"))
    t = truth.select("frame", F.col("id").alias("b_id"), F.col("object_class").alias("tc"))
    both = p.join(m, ["frame", "a_id"], "full").join(t, ["frame", "b_id"], "full")
    same = F.col("pc") == F.col("tc")
    return both.select(F.explode(F.array_compact(F.array(
        F.when(same, F.struct(F.col("tc").alias("object_class"), F.lit("tp").alias("outcome"))),
        F.when(~F.coalesce(same, F.lit(False)) & F.col("pc").isNotNull(), F.struct(F.col("pc").alias("object_class"), F.lit("fp").alias("outcome"))),
        F.when(~F.coalesce(same, F.lit(False)) & F.col("tc").isNotNull(), F.struct(F.col("tc").alias("object_class"), F.lit("fn").alias("outcome")))))).alias("o")).select("o.*")


def detection_scores(outcomes: DataFrame) -> DataFrame:
    """Counts, precision, recall and F1 per class and overall (``all``)."""
    n = lambda k: F.count(F.when(F.col("outcome") == k, 1)).alias(k)
    t = outcomes.rollup("object_class").agg(n("tp"), n("fp"), n("fn"), F.grouping("object_class").alias("_g"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return t.select(F.when(F.col("_g") == 1, "all").otherwise(F.col("object_class")).alias("object_class"), "tp", "fp", "fn",
                    F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"))


def average_precision(pred: DataFrame, truth: DataFrame, min_iou: float = 0.5, rule: str = "widest") -> DataFrame:
    """All-point AP with ignore regions.  ``truth`` carries ``ignored``.

    ``widest``: a detection goes for the true box it overlaps most and the strongest claimant
    is a hit.  ``free``: detections from the strongest on take the box they overlap most among
    those not taken yet.  Others are misses unless they cover an ignored region.
    """
    if small_frames(pred, truth):
        return _all_point(pred, truth, _outcomes_by_frame(pred, truth, min_iou, rule))
    pos = pred.select("frame", F.col("id").alias("a_id"), "score")
    real = overlaps(pred, truth.where("NOT ignored"), ["frame"], min_iou)
    if rule == "free":
        asks = real.join(pos, ["frame", "a_id"]).select(
            F.struct("frame", "a_id").alias("taker"), F.struct((-F.col("score")).alias("s"), "frame", "a_id").alias("turn"),
            F.struct("frame", "b_id").alias("item"), F.struct((-F.col("iou")).alias("o"), "b_id").alias("wish"))
        best = take_turns(asks).select("taker.frame", "taker.a_id", F.lit(True).alias("_tp"))
    else:
        best = _strongest(real, pos)
    shade = overlaps(pred, truth.where("ignored"), ["frame"], min_iou).select("frame", "a_id").distinct().withColumn("_ig", F.lit(True))
    d = pos.join(best, ["frame", "a_id"], "left").join(shade, ["frame", "a_id"], "left")
    return _all_point(pred, truth, d.where(F.col("_tp").isNotNull() | F.col("_ig").isNull()).select(
        "score", "frame", "a_id", F.coalesce("_tp", F.lit(False)).alias("tp")))


def _outcomes_by_frame(pred: DataFrame, truth: DataFrame, min_iou: float, rule: str) -> DataFrame:
    """Counted detections of frames that are all small: score, frame, place in the frame (``a_id``) and tp."""
    f = face_to_face(pred, truth, min_iou, ["ignored"])
    f = f.withColumns({"_real": F.filter("_pairs", lambda q: ~q["t"]["ignored"]), "_shade": F.transform(F.filter("_pairs", lambda q: q["t"]["ignored"]), lambda q: q["a"])})
    wishes = lambda a, free: F.array_min(F.transform(F.filter("_real", lambda q: (q["a"] == a) & free(q["t"]["id"])), lambda q: F.struct(q["o"], q["t"]["id"].alias("b"))))["b"]
    if rule == "free":
        name, kinds = f.schema["_p"].dataType.elementType["id"].dataType.simpleString(), f.schema["_t"].dataType.elementType["id"].dataType.simpleString()
        start = F.struct(F.array().cast(f"array<{name}>").alias("won"), F.array().cast(f"array<{kinds}>").alias("gone"))

        def walk(acc, p):
            b = F.when(~F.array_contains(acc["won"], p["id"]), wishes(p["id"], lambda t: ~F.array_contains(acc["gone"], t)))
            return F.when(b.isNull(), acc).otherwise(F.struct(F.array_append(acc["won"], p["id"]).alias("won"), F.array_append(acc["gone"], b).alias("gone")))
        f = f.withColumn("_took", F.aggregate("_p", start, walk)).withColumn("_won", F.col("_took.won"))
        # rows given twice ask, and are paired, once for each copy
        took = lambda a: F.get(F.col("_took.gone"), (F.array_position("_won", a) - 1).cast("int"))
        turn = lambda a: F.array_min(F.transform(F.filter("_p", lambda p: p["id"] == a), lambda p: p["o"]))
        copies = lambda a: F.size(F.filter("_real", lambda q: (q["a"] == a) & (q["t"]["id"] == took(a)))) * F.size(F.filter("_p", lambda p: (p["id"] == a) & p["o"].eqNullSafe(turn(a))))
    else:
        f = f.withColumn("_claim", F.transform("_p", lambda p: F.struct(p["id"].alias("a"), wishes(p["id"], lambda t: F.lit(True)).alias("b"))))
        # of the claimants of a box, who come strongest first, the first is a hit
        first = F.filter("_claim", lambda c, i: c["b"].isNotNull() & ~F.exists(F.slice("_claim", F.lit(1), i), lambda e: e["b"].eqNullSafe(c["b"])))
        f = f.withColumn("_won", F.transform(first, lambda c: c["a"]))
        copies = lambda a: F.lit(1)
    each = F.transform("_p", lambda p, i: F.struct((-p["o"]).alias("score"), i.alias("a_id"), F.array_contains("_won", p["id"]).alias("tp"), F.array_contains("_shade", p["id"]).alias("ig"),
                                                  F.when(F.array_contains("_won", p["id"]), copies(p["id"])).otherwise(1).alias("n")))
    each = F.flatten(F.transform(each, lambda e: F.array_repeat(e, e["n"])))
    return f.select("frame", F.explode(each).alias("e")).where("e.tp OR NOT e.ig").select("e.score", "frame", "e.a_id", "e.tp")


def _strongest(real: DataFrame, pos: DataFrame) -> DataFrame:
    claim = real.groupBy("frame", "a_id").agg(F.min_by("b_id", F.struct((-F.col("iou")).alias("o"), "b_id")).alias("b_id"))
    return claim.join(pos, ["frame", "a_id"]).groupBy("frame", "b_id").agg(
        F.min_by("a_id", F.struct((-F.col("score")).alias("s"), "a_id")).alias("a_id")).select("frame", "a_id", F.lit(True).alias("_tp"))


def _all_point(pred: DataFrame, truth: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The curve and its area; ``outcomes``: score, frame, a_id (settles ties of a frame) and tp of each counted detection."""
    d = outcomes.select(F.lit(0).alias("k"), "score", "frame", "a_id", "tp")
    if largest_key(pred, []) > ordered.TARGET_ROWS:  # counted, cut and read below: worked out once
        d = cut(d)
    # score first, then frame: detections of one score still fall into chunks
    d = d.withColumn("_at", _place(-F.round(F.col("score") * 1_000_000), F.col("frame"))).withColumn("_neg", -F.col("score"))
    d = with_chunks(d, ["k"], "_at", 1000 << _LOW, bound=(pred, []))
    d = running(d, ["k"], ["_at", "_neg", "frame", "a_id"], {"ctp": ("count", F.col("tp")), "n": ("count", F.lit(True))})
    n_true = truth.where("NOT ignored").agg(F.count("*").alias("n_true"))
    d = d.withColumns({"precision_at": F.col("ctp") / F.col("n"), "_back": -F.col("n")}).drop("_chunk")
    d = with_chunks(d, ["k"], "_back", 1_000_000, bound=(pred, []))
    d = running(d, ["k"], ["_back"], {"env": ("max", "precision_at")})
    s = d.groupBy("k").agg(F.count(F.when(F.col("tp"), 1)).alias("tp"), F.count("*").alias("detections"),
                           F.sum(F.when(F.col("tp"), F.col("env")).otherwise(0.0)).alias("_area"))
    return s.crossJoin(n_true).select(
        "detections", "tp", "n_true", (F.col("_area") / F.greatest(F.col("n_true"), F.lit(1))).alias("ap"),
        ratio(F.col("tp"), F.col("n_true")).alias("recall"), ratio(F.col("tp"), F.col("detections")).alias("precision"))


# --- tracking ----------------------------------------------------------------------------
def observed(tracks: DataFrame) -> DataFrame:
    """Only what the tracker saw: coasting boxes are hypotheses, not output."""
    return tracks.where("lost_frames = 0")


def identified(truth: DataFrame, object_class: str = "person") -> DataFrame:
    """True boxes that carry an identity, under either of its two names."""
    t = truth.withColumn("gt_id", F.coalesce("track_id", "actor_id"))
    return t.where(F.col("gt_id").isNotNull() & (F.col("object_class") == object_class))


def _assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """Best one-to-one assignment of a small gain matrix (shortest augmenting paths)."""
    if max(gain.shape) > FEW_PAIRS:
        return _assign_many(gain)
    flip = gain.shape[0] > gain.shape[1]
    cost = (-(gain.T if flip else gain)).tolist()
    n, m = len(cost), len(cost[0])
    far = float("inf")
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, came, used, free = [far] * (m + 1), [0] * (m + 1), [], list(range(1, m + 1))
        while True:
            used.append(j0)
            if j0:
                free.remove(j0)
            row, base = cost[owner[j0] - 1], u[owner[j0]]
            j1, delta = 0, far
            for j in free:
                slack = row[j - 1] - base - v[j]
                if slack < least[j]:
                    least[j], came[j] = slack, j0
                if least[j] < delta:
                    j1, delta = j, least[j]
            for j in used:
                u[owner[j]] += delta
                v[j] -= delta
            for j in free:
                least[j] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[came[j0]]
            j0 = came[j0]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return [(b, a) for a, b in pairs] if flip else pairs


def _assign_many(gain: np.ndarray) -> list[tuple[int, int]]:
    """The same for a larger matrix, a row at a time."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used, came = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while True:
            used[j0] = True
            slack = cost[owner[j0] - 1] - u[owner[j0]] - v[1:]
            free = ~used[1:]
            better = free & (slack < least[1:])
            least[1:][better] = slack[better]
            came[1:][better] = j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[came[j0]]
            j0 = came[j0]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return [(b, a) for a, b in pairs] if flip else pairs


def _best_total(gain: np.ndarray) -> float:
    """What the best one-to-one assignment of non-negative gains adds up to.

    Rows whose best column no earlier row wants start assigned, which is nearly all of them
    where identities hold; the others are brought in by shortest augmenting paths.
    """
    cost = -(gain.T if gain.shape[0] > gain.shape[1] else gain)
    n, m = cost.shape
    u, v = cost.min(axis=1), np.zeros(m)
    wish = cost.argmin(axis=1)
    column, row = np.full(n, -1), np.full(m, -1)  # the column of a row, the row of a column
    taken, first = np.unique(wish, return_index=True)
    column[first], row[taken] = taken, first
    for start in np.flatnonzero(column < 0):
        least, came, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        rows, reached, i, low = [start], [], start, 0.0
        while True:
            slack = np.where(done, np.inf, low + cost[i] - u[i] - v)
            better = slack < least
            least[better], came[better] = slack[better], i
            j = int(np.argmin(np.where(done, np.inf, least)))
            low = least[j]
            done[j] = True
            if row[j] < 0:
                break
            reached.append(j)
            i = row[j]
            rows.append(i)
        u[start] += low
        for k in reached:
            u[row[k]] += low - least[k]
            v[k] -= low - least[k]
        while j >= 0:  # turn the path over
            i = came[j]
            row[j], column[i], j = i, j, column[i]
            if i == start:
                break
    return float(-cost[np.arange(n), column].sum())


def overlap_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = np.clip(np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]), 0, None)
    h = np.clip(np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]), 0, None)
    area = lambda q: (q[:, 2] - q[:, 0]) * (q[:, 3] - q[:, 1])
    union = area(a)[:, None] + area(b)[None, :] - w * h
    return np.where(union > 0, w * h / np.where(union > 0, union, 1), 0.0)


#: Up to so many pairs of boxes are looked at one by one; more in one array.
FEW_PAIRS = 64


def overlap(a: Sequence[float], b: Sequence[float]) -> float:
    """``overlap_matrix`` of two boxes."""
    w = (a[2] if a[2] < b[2] else b[2]) - (a[0] if a[0] > b[0] else b[0])
    h = (a[3] if a[3] < b[3] else b[3]) - (a[1] if a[1] > b[1] else b[1])
    if not (w > 0 and h > 0):
        return 0.0
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / union if union > 0 else 0.0


MATCH = "sequence long, frame long, gt_id long, pred_id long, iou double, switched boolean"


def mot_matches(truth: DataFrame, pred: DataFrame, min_iou: float = 0.5, width: int = 1 << 20,
                target_rows: int = 200_000) -> DataFrame:
    """Frame by frame matches of one sequence, keeping last frame's pairs first.

    Both inputs: sequence, frame, obj_id and a box.
    """
    side = lambda d, s: d.select("sequence", "frame", "obj_id", *("x1 y1 x2 y2".split()), F.lit(s).alias("side"))
    rows = with_chunks(side(truth, 0).unionByName(side(pred, 1)), ["sequence"], "frame", width, target_rows)

    def best_rest(box, corners, rest, free):
        """Pairs of the best assignment of what last frame's pairs left."""
        if len(rest) * len(free) <= FEW_PAIRS:
            touch = {}
            for r, g in enumerate(rest):
                for c, p in enumerate(free):
                    iou = overlap(corners[g], corners[p])
                    if iou > 0:
                        touch[r, c] = iou
            rows_, cols_ = Counter(r for r, _ in touch), Counter(c for _, c in touch)
        else:
            sub = overlap_matrix(box[rest], box[free])
            rr, cc = np.nonzero(sub > 0)
            touch = dict(zip(zip(rr.tolist(), cc.tolist()), sub[rr, cc].tolist()))
            rows_, cols_ = Counter(rr.tolist()), Counter(cc.tolist())
        # two boxes that touch nothing else are matched in any optimum
        picked = [(r, c) for r, c in touch if rows_[r] == 1 and cols_[c] == 1]
        done_r, done_c = {r for r, _ in picked}, {c for _, c in picked}
        r_left, c_left = sorted(set(rows_) - done_r), sorted(set(cols_) - done_c)
        if r_left and c_left:
            gain = np.zeros((len(r_left), len(c_left)))
            r_at, c_at = {r: i for i, r in enumerate(r_left)}, {c: i for i, c in enumerate(c_left)}
            for (r, c), iou in touch.items():
                if r in r_at and c in c_at:
                    gain[r_at[r], c_at[c]] = iou
            picked += [(r_left[r], c_left[c]) for r, c in _assign(gain)]
        return [(rest[r], free[c], touch[r, c]) for r, c in picked if touch.get((r, c), 0.0) >= min_iou]

    def step(pdf: pd.DataFrame, state: str | None):
        last = {int(k): int(v) for k, v in json.loads(state).items()} if state else {}
        mine = {}
        box = pdf[["x1", "y1", "x2", "y2"]].to_numpy(float)
        frames = pdf["frame"].to_numpy()
        edges = np.flatnonzero(np.diff(frames)) + 1
        truths = np.cumsum(np.r_[0, pdf["side"].to_numpy() == 0])
        ids, at = pdf["obj_id"].tolist(), frames.tolist()
        corners = box.tolist()
        out = []
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(at)]):
            cut_at = lo + int(truths[hi] - truths[lo])
            if cut_at in (lo, hi):
                continue
            # last frame's pairs first: the first prediction of that name, while it is free
            places: dict[int, list[int]] = {}
            for p in range(hi - 1, cut_at - 1, -1):
                places.setdefault(ids[p], []).append(p)
            rest, got = [], []
            for g in range(lo, cut_at):
                want = last.get(ids[g])
                spots = places.get(want) if want is not None else None
                if spots and (iou := overlap(corners[g], corners[spots[-1]])) >= min_iou:
                    got.append((g, spots.pop(), iou))
                else:
                    rest.append(g)
            free = sorted(p for spots in places.values() for p in spots)
            if rest and free:
                got += best_rest(box, corners, rest, free)
            for g, p, iou in got:
                name, now = ids[g], ids[p]
                before = last.get(name)
                out.append((at[lo], name, now, iou, before is not None and before != now))
                last[name] = mine[name] = now
        done = pd.DataFrame(out, columns=["frame", "gt_id", "pred_id", "iou", "switched"])
        done.insert(0, "sequence", pdf["sequence"].iloc[0])
        return done, json.dumps({str(k): mine[k] for k in sorted(mine)})

    # a chunk depends on the last match of the identities it holds, and of no others
    identity = F.when(F.col("side") == 0, F.col("obj_id").cast("string"))
    return fold(rows, ["sequence"], ["frame", "side", "obj_id", "x1", "y1"], step, MATCH, part=identity)


def clear_mot(truth: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """MOTA, MOTP, misses, false positives and switches per sequence."""
    g = truth.groupBy("sequence").agg(F.count("*").alias("gt"), F.count_distinct("frame").alias("frames"))
    p = pred.groupBy("sequence").agg(F.count("*").alias("predicted"))
    m = matches.groupBy("sequence").agg(F.count("*").alias("matches"), F.sum("iou").alias("_iou"),
                                        F.count(F.when(F.col("switched"), 1)).alias("id_switches"))
    j = g.join(p, "sequence", "full").join(m, "sequence", "left").fillna(0)
    j = j.withColumns({"misses": F.col("gt") - F.col("matches"), "false_positives": F.col("predicted") - F.col("matches")})
    return j.withColumns({
        "mota": F.when(F.col("gt") > 0, 1.0 - (F.col("misses") + F.col("false_positives") + F.col("id_switches")) / F.nullif("gt", F.lit(0))).otherwise(0.0),
        "motp": ratio(F.col("_iou"), F.col("matches"))}).drop("_iou")


def idf1(truth: DataFrame, pred: DataFrame, matches: DataFrame) -> DataFrame:
    """Global identity assignment per sequence over the pair counts.

    Counting is native.  Identities that share no match do not touch each other's choice,
    so each connected group of (gt, pred) pairs is assigned by itself, in a task of its own.
    """
    node = lambda side, c: F.concat_ws(":", "sequence", F.lit(side), c)
    pairs = cut(matches.groupBy("sequence", "gt_id", "pred_id").agg(F.count("*").alias("n")).withColumn("node", node("g", "gt_id")))
    groups = connected(pairs.select(F.col("node").alias("src"), node("p", "pred_id").alias("dst")))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        g, gi = np.unique(pdf["gt_id"], return_inverse=True)
        p, pi = np.unique(pdf["pred_id"], return_inverse=True)
        gain = np.zeros((len(g), len(p)))
        gain[gi, pi] = pdf["n"].to_numpy()
        return pd.DataFrame({"sequence": [pdf["sequence"].iloc[0]], "idtp": [int(_best_total(gain))]})

    tp = pairs.join(groups, "node").groupBy("root").applyInPandas(best, "sequence long, idtp long").groupBy("sequence").agg(F.sum("idtp").alias("idtp"))
    g = truth.groupBy("sequence").agg(F.count("*").alias("gt"))
    p = pred.groupBy("sequence").agg(F.count("*").alias("predicted"))
    j = g.join(p, "sequence", "full").join(tp, "sequence", "left").fillna(0)
    return j.select("sequence", "idtp", (F.col("gt") - F.col("idtp")).alias("idfn"), (F.col("predicted") - F.col("idtp")).alias("idfp"),
                    ratio(2.0 * F.col("idtp"), F.col("gt") + F.col("predicted")).alias("idf1"))


def track_quality(truth: DataFrame, matches: DataFrame) -> DataFrame:
    """Mostly tracked (>= 0.8), partially tracked and mostly lost (<= 0.2)."""
    seen = truth.groupBy("sequence", F.col("obj_id").alias("gt_id")).agg(F.count("*").alias("present"))
    hit = matches.groupBy("sequence", "gt_id").agg(F.count("*").alias("matched"))
    c = seen.join(hit, ["sequence", "gt_id"], "left").withColumn("c", F.coalesce(F.col("matched"), F.lit(0)) / F.col("present"))
    return c.groupBy("sequence").agg(
        F.count(F.when(F.col("c") >= 0.8, 1)).alias("mostly_tracked"),
        F.count(F.when((F.col("c") < 0.8) & (F.col("c") > 0.2), 1)).alias("partially_tracked"),
        F.count(F.when(F.col("c") <= 0.2, 1)).alias("mostly_lost"))


def frame_weighted(per_sequence: DataFrame, values: Sequence[str]) -> DataFrame:
    """Mean of per-sequence ratios, weighted by frames."""
    return per_sequence.agg(*[(F.sum(F.col(v) * F.col("frames")) / F.sum("frames")).alias(v) for v in values])


def pooled_mot(per_sequence: DataFrame) -> DataFrame:
    """Ratios from summed counts, so a short sequence weighs what it holds."""
    s = per_sequence.agg(*[F.sum(c).alias(c) for c in ("gt", "predicted", "matches", "id_switches")])
    miss = F.col("gt") - F.col("matches") + F.col("predicted") - F.col("matches") + F.col("id_switches")
    p, r = ratio(F.col("matches"), F.col("predicted")), ratio(F.col("matches"), F.col("gt"))
    return s.select("gt", "predicted", "matches", "id_switches", F.round(1.0 - miss / F.nullif("gt", F.lit(0)), 4).alias("mota"),
                    F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"))


# --- events ---------------------------------------------------------------------------------
def event_scores(candidates: DataFrame, incidents: DataFrame, run_seconds: float, min_iou: float = 0.3) -> DataFrame:
    """Did the right alarm ring, how late, and how many wrong ones did?

    ``candidates``: frame, id, box, ts_us, alerted.  ``incidents``: frame, id, box, ts_us.
    """
    true = overlaps(candidates, incidents, ["frame"], min_iou).select("frame", F.col("a_id").alias("id")).distinct().withColumn("_true", F.lit(True))
    c = candidates.join(true, ["frame", "id"], "left").withColumn("_true", F.coalesce("_true", F.lit(False)))
    began = incidents.agg(F.min("ts_us").alias("_began"))
    hours = max(run_seconds / 3600.0, 1e-9)
    s = c.agg(F.count("*").alias("total_events"), F.count(F.when(F.col("alerted"), 1)).alias("alerted_events"),
              F.count(F.when(F.col("_true"), 1)).alias("true_events"), F.count(F.when(F.col("_true") & F.col("alerted"), 1)).alias("alerted_true_events"),
              F.count(F.when(~F.col("_true"), 1)).alias("false_alarm_events"), F.count(F.when(~F.col("_true") & F.col("alerted"), 1)).alias("alerted_false_alarms"),
              F.min(F.when(F.col("_true"), F.col("ts_us"))).alias("_first"))
    return s.crossJoin(began).select(
        "total_events", "alerted_events", "true_events", "alerted_true_events", "false_alarm_events", "alerted_false_alarms",
        F.round((F.col("_first") - F.col("_began")) / 1e6, 2).alias("detection_latency_s"),
        F.round(F.col("false_alarm_events") / hours, 1).alias("raw_false_alarms_per_hour"),
        F.round(F.col("alerted_false_alarms") / hours, 1).alias("false_alarms_per_hour"),
        F.round(1.0 - ratio(F.col("alerted_events"), F.col("total_events"), 1.0), 3).alias("alert_suppression_rate"))


def scenario_verdicts(events: DataFrame, expected: DataFrame) -> DataFrame:
    """Did a scenario fire one of its expected types, and alert as expected?"""
    fired = events.groupBy("scenario").agg(F.collect_set("event_type").alias("_fired"), F.bool_or("alerted").alias("_rang"))
    j = expected.join(fired, "scenario", "left")
    kinds = F.coalesce(F.arrays_overlap("expected_event_types", "_fired"), F.lit(False)) | (F.size("expected_event_types") == 0)
    alert = F.coalesce("_rang", F.lit(False)) == F.col("expected_alert")
    return j.select("scenario", kinds.alias("types_ok"), alert.alias("alert_ok"), (kinds & alert).alias("passed"))


# --- anomaly -----------------------------------------------------------------------------------
def frame_auc(scored: DataFrame) -> DataFrame:
    """ROC-AUC by rank sums over pre-counted scores; null for a single class."""
    c = scored.groupBy(F.lit(0).alias("k"), "score").agg(F.count(F.when(F.col("label") == 1, 1)).alias("pos"),
                                                          F.count(F.when(F.col("label") == 0, 1)).alias("neg"))
    c = c.withColumn("_at", F.floor(F.col("score") * 1_000_000).cast("long"))
    c = running(with_chunks(c, ["k"], "_at", 1000), ["k"], ["_at", "score"], {"_cum": ("sum", "neg")})
    s = c.groupBy("k").agg(F.sum(F.col("pos") * (F.col("_cum") - F.col("neg") / 2.0)).alias("_u"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return s.select((F.col("_u") / F.nullif(F.col("p") * F.col("n"), F.lit(0))).alias("auc"), F.col("p").alias("anomalous"), F.col("n").alias("normal"))


def region_curves(pred: DataFrame, truth: DataFrame, min_iou: float = 0.1) -> DataFrame:
    """TPR of regions and of tracks against false positives per frame, per threshold.

    ``truth`` carries ``track``.  Lowering the threshold only adds hits, so each
    region counts from its best matching score on: one sweep, no loop.
    """
    length = truth.groupBy("track").agg(F.count("*").alias("_len"))
    if small_frames(pred, truth):
        counts = cut(_found_by_frame(pred, truth, min_iou).groupBy("real", "track", "score").agg(F.count("*").alias("_n")))
        gains = counts.where("real AND score IS NOT NULL").join(length, "track").groupBy("score").agg(F.sum("_n").alias("r"), F.sum(F.col("_n") / F.col("_len")).alias("t"))
        wrong = counts.where("NOT real").groupBy("score").agg(F.sum("_n").alias("f"))
    else:
        o = overlaps(pred, truth, ["frame"], min_iou).join(pred.select("frame", F.col("id").alias("a_id"), "score"), ["frame", "a_id"])
        found = o.groupBy("frame", "b_id").agg(F.max("score").alias("score"))
        hit = o.select("frame", F.col("a_id").alias("id")).distinct()
        tr = truth.select("frame", F.col("id").alias("b_id"), "track").join(length, "track")
        gains = found.join(tr, ["frame", "b_id"]).groupBy("score").agg(F.count("*").alias("r"), F.sum(1.0 / F.col("_len")).alias("t"))
        wrong = pred.join(hit, ["frame", "id"], "left_anti").groupBy("score").agg(F.count("*").alias("f"))
    tracks = truth.agg(F.count_distinct("track").alias("_nt"), F.count("*").alias("_nr"))
    grid = pred.select("score").distinct().join(gains, "score", "left").join(wrong, "score", "left").fillna(0)
    grid = grid.withColumns({"k": F.lit(0), "_at": (-F.round(F.col("score") * 1_000_000)).cast("long"), "_neg": -F.col("score")})
    if largest_key(pred, []) > ordered.TARGET_ROWS:  # counted and read below: worked out once
        grid = cut(grid)
    grid = running(with_chunks(grid, ["k"], "_at", 1000, bound=(pred, [])), ["k"], ["_at", "_neg"], {"cr": ("sum", "r"), "ct": ("sum", "t"), "cf": ("sum", "f")})
    frames = pred.agg(F.count_distinct("frame").alias("_nf"))
    return grid.drop("_chunk").crossJoin(tracks).crossJoin(frames).select(
        "k", "_at", "_neg", (F.col("cr") / F.col("_nr")).alias("region_tpr"), (F.col("ct") / F.col("_nt")).alias("track_tpr"),
        (F.col("cf") / F.greatest(F.col("_nf"), F.lit(1))).alias("fp_rate"))


def _found_by_frame(pred: DataFrame, truth: DataFrame, min_iou: float) -> DataFrame:
    """Of frames that are all small: each true region (``real``) with its track and best matching score, null if none, and each detection that hits nothing."""
    f = face_to_face(pred, truth, min_iou, ["track"])
    hits = lambda p, t: F.exists("_pairs", lambda q: (q["a"] == p["id"]) & (q["t"]["id"] == t["id"]))
    best = lambda t: -F.array_min(F.transform(F.filter("_p", lambda p: hits(p, t)), lambda p: p["o"]))
    regions = F.transform("_t", lambda t: F.struct(F.lit(True).alias("real"), t["track"].alias("track"), best(t).alias("score")))
    missed = F.filter("_p", lambda p: ~F.exists("_pairs", lambda q: q["a"] == p["id"]))
    none = F.lit(None).cast(truth.schema["track"].dataType)
    wrong = F.transform(missed, lambda p: F.struct(F.lit(False).alias("real"), none.alias("track"), (-p["o"]).alias("score")))
    return f.select(F.explode(F.concat(regions, wrong)).alias("e")).select("e.real", "e.track", "e.score")


def rbdc_tbdc(curve: DataFrame, cap: float = 1.0) -> DataFrame:
    """Areas under both curves on [0, cap] false positives per frame, over cap."""
    c = with_chunks(cut(curve), ["k"], "_at", 1000)   # one row per threshold, read twice
    c = neighbours(c, ["k"], ["_at", "_neg"], back={"_x": "fp_rate", "_r": "region_tpr", "_t": "track_tpr"})
    x0, x1 = F.coalesce("_x", F.lit(0.0)), F.col("fp_rate")
    end = F.least(x1, F.lit(cap))
    share = F.coalesce((end - x0) / F.nullif(x1 - x0, F.lit(0.0)), F.lit(0.0))

    def area(y, before):
        y0 = F.coalesce(before, F.lit(0.0))
        return F.when(x0 >= cap, 0.0).otherwise((end - x0) * (2 * y0 + (F.col(y) - y0) * share) / 2)
    s = c.groupBy("k").agg(F.sum(area("region_tpr", "_r")).alias("a"), F.sum(area("track_tpr", "_t")).alias("b"),
                           F.max("fp_rate").alias("top"), F.max("region_tpr").alias("r"), F.max("track_tpr").alias("t"), F.count("*").alias("thresholds"))
    tail = F.greatest(F.lit(0.0), F.lit(cap) - F.col("top"))
    return s.select("thresholds", ((F.col("a") + tail * F.col("r")) / cap).alias("rbdc"), ((F.col("b") + tail * F.col("t")) / cap).alias("tbdc"))


def link_regions(regions: DataFrame, min_iou: float = 0.3, width: int = 1 << 20, target_rows: int = 200_000) -> DataFrame:
    """Join true regions of consecutive frames of a clip into tracks by overlap.

    ``regions``: clip, frame, id and a box; frames without regions end tracks.
    A track is named after its first region.
    """
    rows = with_chunks(regions.select("clip", "frame", "id", "x1", "y1", "x2", "y2"), ["clip"], "frame", width, target_rows)

    def step(pdf: pd.DataFrame, state: str | None):
        st = json.loads(state) if state else {"frame": None, "live": []}
        live, prev = st["live"], st["frame"]
        frames, box, ids = pdf["frame"].to_numpy(), pdf[["x1", "y1", "x2", "y2"]].to_numpy(float), pdf["id"].tolist()
        tracks = [None] * len(ids)
        edges = np.flatnonzero(np.diff(frames)) + 1
        for lo, hi in zip([0, *edges], [*edges, len(frames)]):
            frame, used, nxt = int(frames[lo]), set(), []
            if prev is not None and frame != prev + 1:
                live = []
            over = overlap_matrix(np.array([b for _, b in live]), box[lo:hi]) if live else ()
            for (name, _), row in zip(live, over):
                free = [(v, i) for i, v in enumerate(row.tolist()) if v >= min_iou and lo + i not in used]
                if free:
                    i = lo + max(free)[1]
                    used.add(i)
                    tracks[i] = name
                    nxt.append((name, box[i].tolist()))
            for i in range(lo, hi):
                if i not in used:
                    tracks[i] = str(ids[i])
                    nxt.append((str(ids[i]), box[i].tolist()))
            live, prev = nxt, frame
        out = pdf[["clip", "frame", "id"]].assign(track=tracks)
        return out, json.dumps({"frame": prev, "live": live})

    return fold(rows, ["clip"], ["frame", "id"], step, "clip long, frame long, id string, track string")
