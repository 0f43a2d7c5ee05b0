"""Median of all pairwise slopes, by counting: within a task, and over a cluster.

How many pairs are no steeper than a slope s?  With rest = y - s x, a pair (i left of j) is no
steeper when rest_j <= rest_i, so the answer is a count of inversions.  Within a task it is
counted by merging.  Over a cluster the points are parted twice, into chunks by x and into
buckets by rest, and every pair of points is one of three kinds:

* same bucket: counted where the bucket is;
* same chunk, other bucket: counted where the chunk is;
* other chunk and other bucket: which of the two is left and which has the larger rest follows
  from the numbers alone, so a table of counts by (chunk, bucket) tells.

Chunk and bucket limits come from a few sampled points; they only balance the work.  A value
that equals a limit has a chunk or bucket to itself, so a crowded x or rest is never dealt to
one task: pairs of one x never count, and those of one rest follow from sums.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .ordered import running, with_chunks

#: Trial slopes that one job counts for each camera and middle slope, and sampled points that set the limits.
TRIALS, SAMPLED = 7, 512
TOLERANCE = 1e-13
_WHOLE = "decimal(38,0)"


def weighted_median(values: np.ndarray, n: np.ndarray) -> float:
    """Middle value (mean of the two middle ones) of values that occur ``n`` times."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(n[order])
    low, high = (int(upto[-1]) - 1) // 2, int(upto[-1]) // 2
    return float(values[order][np.searchsorted(upto, low, "right")] + values[order][np.searchsorted(upto, high, "right")]) / 2


def no_steeper(x: np.ndarray, y: np.ndarray, n: np.ndarray, slope: float) -> int:
    """How many pairs of samples with different ``x`` (points in order of x, then y) have at most this slope."""
    rest, total, width = y - slope * x, 0, 1
    _, rank = np.unique(rest, return_inverse=True)
    place = np.arange(len(x))
    while width < len(x):
        block, right = place // (2 * width), (place // width) % 2 == 1
        order = np.lexsort((~right, rank, block))  # of equal rests the right one counts for the left one
        seen = np.cumsum(np.where(right[order], n[order], 0))
        start = np.concatenate([[0], seen])[np.searchsorted(block[order], block[order], "left")]
        left = ~right[order]
        total += int((n[order][left] * (seen - start)[left]).sum())
        width *= 2
    return total


def median_slope(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float | None:
    """Median of the slopes of all pairs with different ``x``; None where there is no such pair."""
    _, first = np.unique(x, return_index=True)
    per_x = np.add.reduceat(n, first).astype(object)
    pairs = int((int(n.sum()) ** 2 - int((per_x ** 2).sum())) // 2)
    if not pairs:
        return None

    def nth(k: int) -> float:
        low, high = -1.0, 1.0
        while no_steeper(x, y, n, low) >= k:
            low *= 4
        while no_steeper(x, y, n, high) < k:
            high *= 4
        while high - low > 1e-13 * max(1.0, abs(low), abs(high)):
            middle = (low + high) / 2
            low, high = (low, middle) if no_steeper(x, y, n, middle) >= k else (middle, high)
        return high
    return nth((pairs + 1) // 2) if pairs % 2 else (nth(pairs // 2) + nth(pairs // 2 + 1)) / 2


# --- over a cluster ---------------------------------------------------------------------
def _between(value: Column, limits: Column) -> Column:
    """Place of a value among limits: odd when it equals one, so that one has a place of its own."""
    return F.when(F.size(limits) == 0, F.lit(0)).otherwise(
        F.size(F.filter(limits, lambda v: v < value)) + F.size(F.filter(limits, lambda v: v <= value)))


def _limits(values: Column, parts: Column) -> Column:
    """``parts`` - 1 limits, evenly spaced among sorted sampled values."""
    ordered = F.array_sort(values)
    at = lambda k: F.element_at(ordered, F.least(F.size(ordered), F.greatest(F.lit(1), (k * F.size(ordered) / parts).cast("int"))))
    return F.when(parts <= 1, F.array().cast("array<double>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(parts - 1, F.lit(1))), at)))


def _inversions(kind: str, within: bool):
    """Per group: pairs no steeper.  ``within`` leaves out those of one bucket."""
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values(["x", "rest"], kind="stable", ascending=[True, True])
        total = no_steeper(p["x"].to_numpy(float), p["rest"].to_numpy(float), p["n"].to_numpy(np.int64), 0.0)
        if within:
            total -= sum(no_steeper(q["x"].to_numpy(float), q["rest"].to_numpy(float), q["n"].to_numpy(np.int64), 0.0) for _, q in p.groupby("bucket", sort=False))
        head = pdf.iloc[0]
        return pd.DataFrame({"camera_id": [head["camera_id"]], "trial": [head["trial"]], "pairs": [str(total)]})
    return count, f"camera_id {kind}, trial int, pairs string"


def counted(points: DataFrame, trials: DataFrame) -> DataFrame:
    """camera_id, trial, pairs: how many pairs of samples are no steeper than each trial's slope.

    ``points``: camera_id, x, y, n, chunk; ``trials``: camera_id, trial, slope, sampled
    (points, as an array of x and y), parts (buckets to make).
    """
    kind = points.schema["camera_id"].dataType.simpleString()
    limits = trials.withColumn("limits", _limits(F.transform("sampled", lambda q: q["y"] - F.col("slope") * q["x"]), F.col("parts"))).select("camera_id", "trial", "slope", "limits")
    rows = points.join(limits, "camera_id").withColumn("rest", F.col("y") - F.col("slope") * F.col("x"))
    rows = cut(rows.withColumn("bucket", _between(F.col("rest"), F.col("limits"))).select("camera_id", "trial", "chunk", "bucket", "x", "rest", "n"))
    key = ["camera_id", "trial"]
    count, schema = _inversions(kind, False)
    found = [rows.where("bucket % 2 = 0").groupBy(*key, "bucket").applyInPandas(count, schema).select(*key, F.col("pairs").cast(_WHOLE).alias("pairs"))]
    # of one rest all pairs of different x are no steeper
    level = rows.where("bucket % 2 = 1").groupBy(*key, "bucket", "x").agg(F.sum("n").cast(_WHOLE).alias("n"))
    square = lambda c: (c.cast("decimal(19,0)") * c.cast("decimal(19,0)")).cast(_WHOLE)
    level = level.groupBy(*key, "bucket").agg(F.sum("n").alias("all"), F.sum(square(F.col("n"))).cast(_WHOLE).alias("same"))
    found.append(level.select(*key, ((square(F.col("all")) - F.col("same")) / 2).cast(_WHOLE).alias("pairs")))
    # of one x (odd chunks) no pair counts
    count, schema = _inversions(kind, True)
    found.append(rows.where("chunk % 2 = 0").groupBy(*key, "chunk").applyInPandas(count, schema).select(*key, F.col("pairs").cast(_WHOLE).alias("pairs")))
    table = rows.groupBy(*key, "chunk", "bucket").agg(F.sum("n").alias("n"))

    def crossed(pdf: pd.DataFrame) -> pd.DataFrame:
        chunks, c = np.unique(pdf["chunk"], return_inverse=True)
        buckets, b = np.unique(pdf["bucket"], return_inverse=True)
        n = np.zeros((len(chunks), len(buckets)), object)
        n[c, b] = [int(v) for v in pdf["n"]]
        left = np.cumsum(n, axis=0) - n                                     # of earlier chunks, this bucket
        above = np.cumsum(left[:, ::-1], axis=1)[:, ::-1] - left            # ... and of a larger bucket
        head = pdf.iloc[0]
        return pd.DataFrame({"camera_id": [head["camera_id"]], "trial": [head["trial"]], "pairs": [str(int((n * above).sum()))]})
    found.append(table.groupBy(*key).applyInPandas(crossed, schema).select(*key, F.col("pairs").cast(_WHOLE).alias("pairs")))
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    return every.groupBy(*key).agg(F.sum("pairs").cast(_WHOLE).alias("pairs"))


def median_lines(points: DataFrame, part_points: int = 500_000) -> DataFrame:
    """camera_id, slope, intercept from camera_id, foot_v, px_height, n (samples at that point).

    All cameras are narrowed in the same jobs, ``TRIALS`` slopes a camera and job; the driver
    keeps an interval per camera that is still open and has over ``part_points`` different points.
    """
    points = points.select("camera_id", F.col("foot_v").cast("double").alias("x"), F.col("px_height").cast("double").alias("y"), "n")
    near = F.pmod(F.xxhash64("x", "y"), F.lit(1 << 30)) / float(1 << 30)
    size = points.groupBy("camera_id").agg(F.count(F.lit(1)).alias("different"))
    some = points.join(size, "camera_id").where(near < F.lit(float(SAMPLED)) / F.col("different")).groupBy("camera_id").agg(F.collect_list(F.struct("x", "y")).alias("sampled"))
    parts = F.ceil(F.col("different") / part_points).cast("int")
    plan = cut(size.join(some, "camera_id", "left").select("camera_id", F.coalesce("sampled", F.array().cast("array<struct<x:double,y:double>>")).alias("sampled"), parts.alias("parts")))
    limits = plan.select("camera_id", _limits(F.transform("sampled", lambda q: q["x"]), F.col("parts")).alias("limits"))
    points = cut(points.join(limits, "camera_id").withColumn("chunk", _between(F.col("x"), F.col("limits"))).drop("limits"))
    # pairs of different x, and which of them are the middle ones
    per_x = points.groupBy("camera_id", "x").agg(F.sum("n").alias("n"))
    square = F.col("n").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
    sums = per_x.groupBy("camera_id").agg(F.sum("n").alias("all"), F.sum(square.cast(_WHOLE)).cast(_WHOLE).alias("same")).collect()
    goals, spark = {}, points.sparkSession
    for r in sums:
        pairs = (int(r["all"]) ** 2 - int(r["same"])) // 2
        if pairs:
            goals.update({(r["camera_id"], k): None for k in {(pairs + 1) // 2, pairs // 2 + 1}})
    open_ = {goal: (None, None) for goal in goals}
    kind = points.schema["camera_id"].dataType.simpleString()
    while open_:
        asked = {}
        for (camera, k), (low, high) in open_.items():
            if low is None or high is None:  # powers of four until the slope lies between two
                grid = [-1.0, 1.0] if low is high else [high * f if high < 0 else -1.0 for f in (4.0, 16.0, 64.0)] if low is None else [low * f if low > 0 else 1.0 for f in (4.0, 16.0, 64.0)]
            else:
                grid = [low + (high - low) * i / (TRIALS + 1) for i in range(1, TRIALS + 1)]
            asked[camera, k] = sorted(set(grid))
        flat = sorted({(camera, v) for (camera, _), grid in asked.items() for v in grid}, key=lambda q: (str(q[0]), q[1]))
        numbered = {q: n for n, q in enumerate(flat)}
        trials = spark.createDataFrame([(camera, n, v) for (camera, v), n in numbered.items()], f"camera_id {kind}, trial int, slope double").join(plan, "camera_id")
        got = {r["trial"]: int(r["pairs"]) for r in counted(points, trials).collect()}
        for (camera, k), grid in asked.items():
            low, high = open_[camera, k]
            for v in grid:
                if got.get(numbered[camera, v], 0) >= k:
                    high = v if high is None else min(high, v)
                    break
                low = v if low is None else max(low, v)
            open_[camera, k] = (low, high)
            if low is not None and high is not None and high - low <= TOLERANCE * max(1.0, abs(low), abs(high)):
                goals[camera, k] = high
                del open_[camera, k]
    slopes: dict = {}
    for (camera, _), v in goals.items():
        slopes.setdefault(camera, []).append(v)
    total = {r["camera_id"]: int(r["all"]) for r in sums}
    fitted = spark.createDataFrame([(c, float(np.mean(v)), (total[c] - 1) // 2, total[c] // 2) for c, v in slopes.items()],
                                   f"camera_id {kind}, slope double, low long, high long")
    rests = points.join(fitted, "camera_id").withColumn("rest", F.col("y") - F.col("slope") * F.col("x"))
    rests = rests.select("camera_id", "slope", "low", "high", "rest", "n", F.floor(F.col("rest") * 1_000_000).cast("long").alias("place"))
    rests = running(with_chunks(rests, ["camera_id"], "place", 1_000_000, part_points), ["camera_id"], ["place", "rest"], {"upto": ("sum", F.col("n"))})
    middle = lambda k: F.min(F.when(F.col("upto") > F.col(k), F.col("rest")))
    return rests.groupBy("camera_id", "slope").agg(((middle("low") + middle("high")) / 2).alias("intercept")).select("camera_id", "slope", "intercept")
