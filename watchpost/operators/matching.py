"""Greedy box matching and suppression.

Overlaps are found by a grid join.  While every frame is small (measured first),
a frame's candidates are walked from best to worst in one array expression.  With
a crowded frame the choices are resolved in rounds instead: in each round every
pair that is the best choice of *both* its sides is final, which gives the same
result with the frame spread over the cluster.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geometry import box_area, box_iou
from ..session import cut
from .ordered import largest_key

BOX = ("x1", "y1", "x2", "y2")
FRAME_LIMIT = 2_000      # candidates of one frame that may be walked in place


def _on_grid(boxes: DataFrame, cell: float, names: Sequence[str], out: Sequence[str]) -> DataFrame:
    x1, y1, x2, y2 = [F.col(n) for n in names]
    cells = lambda lo, hi: F.sequence(F.floor(lo / cell).cast("long"), F.floor(hi / cell).cast("long"))
    return boxes.withColumn(out[0], F.explode(cells(x1, x2))).withColumn(out[1], F.explode(cells(y1, y2)))


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], min_iou: float, cell: float = 512.0,
             strict: bool = False) -> DataFrame:
    """Pairs (``a_id``, ``b_id``, ``iou``) of the same key that overlap enough.

    Both sides carry ``keys``, ``id`` and a box.  Each pair is produced once, in
    the cell that holds the corner of its intersection; boxes that never touch
    never meet.
    """
    def side(boxes, p):
        named = boxes.select(*keys, F.col("id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}{c}") for c in BOX],
                             box_area(*[F.col(c) for c in BOX]).alias(f"{p}_area"))
        return _on_grid(named, cell, [f"{p}{c}" for c in BOX], ("_cx", "_cy"))

    # spread by cell first: the join and everything after it runs in parallel
    a = side(left, "a").repartition(*keys, "_cx", "_cy")
    j = a.join(side(right, "b"), [*keys, "_cx", "_cy"])
    corner = (F.floor(F.greatest("ax1", "bx1") / cell) == F.col("_cx")) & (F.floor(F.greatest("ay1", "by1") / cell) == F.col("_cy"))
    # areas come with the boxes, so the pair expression stays small enough to compile
    shared = (F.greatest(F.lit(0.0), F.least("ax2", "bx2") - F.greatest("ax1", "bx1"))
              * F.greatest(F.lit(0.0), F.least("ay2", "by2") - F.greatest("ay1", "by1")))
    j = j.where(corner).withColumn("_in", shared).where("_in > 0")
    j = j.withColumn("iou", F.col("_in") / (F.col("a_area") + F.col("b_area") - F.col("_in")))
    return j.where(F.col("iou") > min_iou if strict else F.col("iou") >= min_iou).select(*keys, "a_id", "b_id", "iou")


SMALL_FRAME = 48         # boxes a side of a frame that may meet in one array


def small_frames(pred: DataFrame, truth: DataFrame) -> bool:
    """No frame of either side is crowded (measured)."""
    return largest_key(pred, ["frame"]) <= SMALL_FRAME and largest_key(truth, ["frame"]) <= SMALL_FRAME


def face_to_face(pred: DataFrame, truth: DataFrame, min_iou: float, of_truth: Sequence[str]) -> DataFrame:
    """One row per frame: its predictions (``_p``, strongest first, then by id), true boxes (``_t``) and ``_pairs`` that overlap enough.

    For small frames.  Each side is shuffled once, by frame, and all that follows happens in
    the row.  A pair holds o (minus the overlap), a (the prediction's id) and t (the
    true box).  Boxes without a frame or a corner are kept and meet nothing.
    """
    p = F.struct((-F.col("score")).alias("o"), "id", *BOX)
    t = F.struct("id", *of_truth, *BOX)
    both = pred.select("frame", p.alias("_p")).unionByName(truth.select("frame", t.alias("_t")), allowMissingColumns=True)
    f = both.groupBy("frame").agg(F.array_sort(F.collect_list("_p")).alias("_p"), F.collect_list("_t").alias("_t"))

    def pair(p, t):
        whole = F.lit(True)
        for c in BOX:
            whole = whole & p[c].isNotNull() & t[c].isNotNull()
        iou = F.when(whole, box_iou(tuple(p[c] for c in BOX), tuple(t[c] for c in BOX)))
        return F.struct((-iou).alias("o"), p["id"].alias("a"), t.alias("t"))
    pairs = F.flatten(F.transform("_p", lambda p: F.filter(F.transform("_t", lambda t: pair(p, t)), lambda q: q["o"] <= -min_iou)))
    return f.withColumn("_pairs", F.when(F.col("frame").isNull(), F.slice(pairs, 1, 0)).otherwise(pairs))


def greedy_pairs(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-to-one pairs, best IoU first; ties go to the smaller ids."""
    keys = list(keys)
    pairs = cut(pairs)
    if largest_key(pairs, keys) <= FRAME_LIMIT:
        kinds = dict(pairs.dtypes)
        none = f"struct<a:array<{kinds['a_id']}>,b:array<{kinds['b_id']}>,won:array<struct<o:double,a_id:{kinds['a_id']},b_id:{kinds['b_id']}>>>"
        start = F.struct(F.array().alias("a"), F.array().alias("b"), F.array().alias("won")).cast(none)

        def walk(acc, p):
            free = ~F.array_contains(acc["a"], p["a_id"]) & ~F.array_contains(acc["b"], p["b_id"])
            return F.when(free, F.struct(F.array_append(acc["a"], p["a_id"]).alias("a"), F.array_append(acc["b"], p["b_id"]).alias("b"),
                                         F.array_append(acc["won"], p).alias("won"))).otherwise(acc)
        best_first = F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("o"), "a_id", "b_id")))
        won = pairs.groupBy(*keys).agg(best_first.alias("_p")).select(
            *keys, F.explode(F.aggregate("_p", start, walk, lambda acc: acc["won"])).alias("w"))
        return won.select(*keys, "w.a_id", "w.b_id", (-F.col("w.o")).alias("iou"))
    alive = cut(pairs.withColumn("_r", F.struct((-F.col("iou")).alias("o"), "a_id", "b_id")))
    taken = None
    while True:
        best_a = alive.groupBy(*keys, "a_id").agg(F.min("_r").alias("_ra"))
        best_b = alive.groupBy(*keys, "b_id").agg(F.min("_r").alias("_rb"))
        won = cut(alive.join(best_a, [*keys, "a_id"]).join(best_b, [*keys, "b_id"]).where(
            (F.col("_r") == F.col("_ra")) & (F.col("_r") == F.col("_rb"))).select(*keys, "a_id", "b_id", "iou"))
        taken = won if taken is None else taken.unionByName(won)
        alive = cut(alive.join(won.select(*keys, "a_id"), [*keys, "a_id"], "left_anti").join(
            won.select(*keys, "b_id"), [*keys, "b_id"], "left_anti"))
        if alive.isEmpty():
            return taken


def suppress_overlaps(boxes: DataFrame, keys: Sequence[str], max_iou: float, cell: float = 512.0) -> DataFrame:
    """Greedy non-maximum suppression: keep a box unless a kept, better-scored box
    of the same key overlaps it by more than ``max_iou``.

    Round by round: boxes nobody alive beats are kept and their victims go.
    """
    keys = list(keys)
    if largest_key(boxes, keys) <= FRAME_LIMIT:
        rest = [c for c in boxes.columns if c not in (*keys, "score", "id")]
        row = F.struct((-F.col("score")).alias("_o"), "id", *rest)
        shape = boxes.select(row.alias("r")).schema["r"].dataType.simpleString()
        hits = lambda k, b: box_iou(tuple(k[c] for c in BOX), tuple(b[c] for c in BOX)) > max_iou
        kept = F.aggregate("_b", F.array().cast(f"array<{shape}>"), lambda acc, b: F.when(
            F.exists(acc, lambda k: hits(k, b)), acc).otherwise(F.array_append(acc, b)))
        walked = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("_b")).select(*keys, F.explode(kept).alias("_k"))
        return walked.select(*keys, "_k.*").withColumn("score", -F.col("_o")).select(*boxes.columns)
    rank = boxes.select(*keys, "id", "score")
    e = overlaps(boxes, boxes, keys, max_iou, cell, strict=True).where("a_id <> b_id")
    e = e.join(rank.select(*keys, F.col("id").alias("a_id"), F.col("score").alias("_sa")), [*keys, "a_id"]).join(
        rank.select(*keys, F.col("id").alias("b_id"), F.col("score").alias("_sb")), [*keys, "b_id"])
    beats = (F.col("_sa") > F.col("_sb")) | ((F.col("_sa") == F.col("_sb")) & (F.col("a_id") < F.col("b_id")))
    edges = cut(e.where(beats).select(*keys, "a_id", "b_id"))
    gone = None
    while not edges.isEmpty():
        losers = edges.select(*keys, F.col("b_id").alias("a_id")).distinct()
        sure = edges.join(losers, [*keys, "a_id"], "left_anti")
        out = cut(sure.select(*keys, F.col("b_id").alias("id")).distinct())
        gone = out if gone is None else gone.unionByName(out)
        edges = cut(edges.join(out.withColumnRenamed("id", "a_id"), [*keys, "a_id"], "left_anti").join(
            out.withColumnRenamed("id", "b_id"), [*keys, "b_id"], "left_anti"))
    return boxes if gone is None else boxes.join(gone, [*keys, "id"], "left_anti")


def take_turns(candidates: DataFrame) -> DataFrame:
    """taker, item: takers in order of ``turn`` take the item of least ``wish`` that is left.

    ``candidates`` has taker, turn, item, wish; turns and wishes are sortable and all
    different for a taker.  Instead of a loop all takers ask for their best item at once; an
    item refuses everyone later than its earliest asker, for good, and the refused ask again.
    Items rank takers by turn alone, so this ends in the outcome of the loop.
    """
    left = cut(candidates.select("taker", "turn", "item", "wish"))
    while True:
        asked = left.withColumn("_asks", F.col("wish") == F.min("wish").over(W.partitionBy("taker")))
        asked = asked.withColumn("_first", F.min(F.when(F.col("_asks"), F.col("turn"))).over(W.partitionBy("item")))
        asked = cut(asked.where(F.col("_first").isNull() | (F.col("turn") <= F.col("_first"))).withColumn("_held", F.col("_asks") & (F.col("turn") == F.col("_first"))))
        # settled once every taker's wish is held
        if asked.groupBy("taker").agg(F.max("_held").alias("held")).where("NOT held").isEmpty():
            return asked.where("_held").select("taker", "item")
        left = asked.drop("_asks", "_first", "_held")
