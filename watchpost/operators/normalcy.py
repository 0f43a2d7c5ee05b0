"""Pattern of life: learnt hourly traffic, deviation from it, and feedback."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefn import hour_of_week
from ..values import DEFAULTS, HARD_TRIPWIRES, HOURS_PER_WEEK, Params
from .ordered import trailing_counts

BUCKET = ["camera_id", "zone_id", "object_class", "hour_of_week"]
PLACE = ["camera_id", "zone_id", "object_class"]
WIDTH_US = 86_400_000_000


def observations(points: DataFrame, members: DataFrame, hits: int) -> DataFrame:
    """One observation per track at its N-th hit, plus one per zone it is in."""
    at = points.where(F.col("hits") == hits).select(
        "camera_id", F.lit("").alias("zone_id"), "object_class", "ts")
    inside = members.where((F.col("hits") == hits) & F.col("in_zone")).select(
        "camera_id", "zone_id", "object_class", "ts")
    return at.unionByName(inside)


def learn(seen: DataFrame, weight: Column | None = None) -> DataFrame:
    """Additive counts per camera, zone, class and hour of week."""
    seen = seen.withColumn("hour_of_week", hour_of_week(F.col("ts")))
    return seen.groupBy(*BUCKET).agg(F.sum(weight if weight is not None else F.lit(1.0)).alias("count"))


def merge_counts(base: DataFrame, increment: DataFrame) -> DataFrame:
    """``count = count + x`` upsert."""
    return base.unionByName(increment).groupBy(*BUCKET).agg(F.sum("count").alias("count"))


def decay(counts: DataFrame, days: float, params: Params = DEFAULTS) -> DataFrame:
    """Age counts by half-lives; forget the ones that faded away."""
    aged = counts.withColumn("count", F.col("count") * (0.5 ** (days / params.half_life_days)))
    return aged.where(F.col("count") >= params.drop_below) if days > 0 else counts


def decayed_on_read(seen: DataFrame, as_of: Column, params: Params = DEFAULTS) -> DataFrame:
    """Counts weighted by age, straight from the observations."""
    days = (F.unix_micros(as_of) - F.unix_micros("ts")) / 8.64e10
    return learn(seen, F.pow(F.lit(0.5), days / params.half_life_days)).where(
        F.col("count") >= params.drop_below)


def recent_counts(events: DataFrame, span_s: int) -> DataFrame:
    """Earlier events of the same camera, zone and class in the trailing span."""
    keyed = events.withColumn("_zone", F.coalesce("zone_id", F.lit("")))
    out = trailing_counts(keyed, ["camera_id", "_zone", "object_class"], "ts_us", span_s * 1_000_000,
                          ["ts_us", "event_id"], {"recent": F.lit(1)}, WIDTH_US)
    return out.withColumn("recent", F.col("recent") - 1).drop("_zone")


def evaluate(events: DataFrame, counts: DataFrame, params: Params = DEFAULTS, recent_s: int = 600) -> DataFrame:
    """Ratio, samples and expectation of each event against its own bucket.

    The ratio is the average hour over this hour, raised by the square root of a
    current burst.  ``samples`` is the zone's whole history, as the evidence the
    ratio rests on.
    """
    totals = counts.groupBy(*PLACE).agg(F.sum("count").alias("_total"))
    e = recent_counts(events, recent_s).withColumns({
        "_zone": F.coalesce("zone_id", F.lit("")), "hour_of_week": hour_of_week(F.col("ts"))})
    b = counts.select("camera_id", F.col("zone_id").alias("_zone"), "object_class", "hour_of_week",
                      F.col("count").alias("_bucket"))
    t = totals.select("camera_id", F.col("zone_id").alias("_zone"), "object_class", "_total")
    e = e.join(b, ["camera_id", "_zone", "object_class", "hour_of_week"], "left").join(
        t, ["camera_id", "_zone", "object_class"], "left")
    bucket, total = F.coalesce("_bucket", F.lit(0.0)), F.coalesce("_total", F.lit(0.0))
    average = total / HOURS_PER_WEEK
    due = F.greatest(bucket, average) * (recent_s / 3600.0)
    burst = F.when((due > 0) & (F.col("recent") > due * 2) & (F.col("recent") >= 3),
                   F.col("recent") / F.nullif(due, F.lit(0.0))).otherwise(1.0)
    ratio = average / F.greatest(bucket, F.lit(0.5)) * F.greatest(F.lit(1.0), F.sqrt(burst))
    known = total > 0
    out = e.withColumns({
        "normalcy_ratio": F.when(known, F.round(ratio, 2)).otherwise(1.0),
        "normalcy_samples": F.when(known, F.floor(total)).otherwise(0).cast("long"),
        "normalcy_expected": F.when(known, F.round(average, 2)).otherwise(0.0),
    })
    return with_verdict(out, params).drop("_zone", "_bucket", "_total")


def with_verdict(df: DataFrame, params: Params = DEFAULTS) -> DataFrame:
    enough = F.col("normalcy_samples") >= params.min_samples
    return df.withColumns({
        "is_unusual": enough & (F.col("normalcy_ratio") >= params.unusual_ratio),
        "is_routine": enough & (F.col("normalcy_ratio") <= params.routine_ratio)})


def suppress_routine(events: DataFrame) -> DataFrame:
    """Drop routine events; on a fenced border hard tripwires always stay."""
    exempt = (F.col("profile") == "fenced") & F.col("event_type").isin(*HARD_TRIPWIRES)
    return events.withColumn("kept", exempt | ~F.col("is_routine"))


def seed(places: DataFrame, busy_from: int, busy_to: int, busy: float = 40.0, quiet: float = 1.0) -> DataFrame:
    """A weekly rhythm for every place: one row per hour of week."""
    hours = F.explode(F.sequence(F.lit(0), F.lit(HOURS_PER_WEEK - 1)))
    out = places.select(*PLACE, hours.alias("hour_of_week"))
    hour = F.col("hour_of_week") % 24
    return out.withColumn("count", F.when((hour >= busy_from) & (hour < busy_to), busy).otherwise(quiet))


def spread(volumes: DataFrame, day_from: int = 7, day_to: int = 19, day_share: float = 0.9) -> DataFrame:
    """Spread an observed volume per place over a day-heavy week."""
    day_hours = 7 * (day_to - day_from)
    night_hours = HOURS_PER_WEEK - day_hours
    hours = F.explode(F.sequence(F.lit(0), F.lit(HOURS_PER_WEEK - 1)))
    out = volumes.select(*PLACE, "volume", hours.alias("hour_of_week"))
    hour = F.col("hour_of_week") % 24
    by_day = (hour >= day_from) & (hour < day_to)
    return out.withColumn("count", F.when(by_day, F.col("volume") * day_share / day_hours)
                          .otherwise(F.col("volume") * (1 - day_share) / night_hours)).drop("volume")


# --- feedback --------------------------------------------------------------------
def feedback_stats(verdicts: DataFrame) -> DataFrame:
    """True and false verdicts per camera and event type."""
    return verdicts.groupBy("camera_id", "event_type").agg(
        F.count(F.when(F.col("verdict") == "true_positive", 1)).alias("fb_true"),
        F.count(F.when(F.col("verdict") == "false_alarm", 1)).alias("fb_false"))


def feedback_summary(verdicts: DataFrame) -> DataFrame:
    """Totals per camera and overall; the rate is over reviewed alerts only."""
    t = verdicts.rollup("camera_id").agg(
        F.count(F.when(F.col("verdict") == "true_positive", 1)).alias("true_positive"),
        F.count(F.when(F.col("verdict") == "false_alarm", 1)).alias("false_alarm"),
        F.grouping("camera_id").alias("_all"))
    reviewed = F.col("true_positive") + F.col("false_alarm")
    return t.select(F.when(F.col("_all") == 1, "all").otherwise(F.col("camera_id")).alias("camera_id"),
                    "true_positive", "false_alarm", reviewed.alias("reviewed"),
                    F.round(F.col("false_alarm") / F.nullif(reviewed, F.lit(0)), 4).alias("false_alarm_rate"))


def acknowledge(events: DataFrame, acks: DataFrame) -> DataFrame:
    """Merge operator verdicts into the event log; the latest verdict wins."""
    newest = acks.groupBy("event_id").agg(F.max_by(F.struct("verdict", "note", "ack_us"), "ack_us").alias("_a"))
    return (events.join(newest, "event_id", "left")
            .withColumns({"acknowledged": F.col("acknowledged") | F.col("_a").isNotNull(),
                          "verdict": F.col("_a.verdict"), "ack_note": F.col("_a.note")}).drop("_a"))


def before_after(decided: DataFrame) -> DataFrame:
    """Alerts with and without routine suppression, per camera."""
    alert, kept = F.col("alerted"), F.col("kept")
    return decided.groupBy("camera_id").agg(
        F.count("*").alias("raw_events"), F.count(F.when(alert, 1)).alias("alerts_before"),
        F.count(F.when(alert & kept, 1)).alias("alerts_after"),
        F.count(F.when(~kept, 1)).alias("suppressed"), F.count(F.when(kept, 1)).alias("kept_events"),
        F.count(F.when(kept & F.col("is_unusual"), 1)).alias("unusual"))
