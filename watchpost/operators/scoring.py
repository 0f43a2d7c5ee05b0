"""Additive, explainable event scores."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import priority_of_score
from ..values import BASE_WEIGHT, CLASS_WEIGHT, DEFAULT_BASE, ROUTINE_MOVEMENT

FACTOR = "struct<name:string,weight:double,detail:string>"


def _weights(table: dict, key: Column, default: float) -> Column:
    m = F.create_map(*[F.lit(v) for v in chain(*table.items())])
    return F.coalesce(F.element_at(m, key), F.lit(default))


def _terms() -> list[tuple[str, Column, Column]]:
    """(name, weight or null when it does not apply, detail) in a fixed order."""
    c = F.col
    evidence = F.least(F.lit(1.0), c("normalcy_samples") / 60.0)
    learnt = c("normalcy_samples") >= 5
    unusual = learnt & (c("normalcy_ratio") >= 2.0)
    routine = learnt & (c("normalcy_ratio") <= 1.3)
    busy = c("event_type").isin(*ROUTINE_MOVEMENT) & (c("normalcy_expected") > 3.0)
    calm = F.lit(-0.16) - F.when(busy, F.least(F.lit(0.34), 0.045 * c("normalcy_expected"))).otherwise(0.0)
    reviews = c("fb_true") + c("fb_false")
    fa = c("fb_false") / F.nullif(reviews, F.lit(0))
    cls = _weights(CLASS_WEIGHT, c("object_class"), 0.0)
    say = F.format_string
    return [
        ("event type", _weights(BASE_WEIGHT, c("event_type"), DEFAULT_BASE),
         F.concat(F.lit("base weight of "), F.replace(c("event_type"), F.lit("_"), F.lit(" ")))),
        ("object class", F.when(c("object_class").isNotNull() & (F.abs(cls) > 1e-6), cls),
         F.concat(F.lit("classified as "), c("object_class"))),
        ("night conditions", F.when(c("is_night"), 0.12), F.lit("seen in darkness")),
        ("unusual for this time",
         F.when(unusual, F.round(F.least(F.lit(0.22), 0.07 * c("normalcy_ratio")) * evidence, 3)),
         say("%.1f times the usual traffic of this hour, %d observations", "normalcy_ratio", "normalcy_samples")),
        ("routine for this camera", F.when(~unusual & routine, F.round(calm * evidence, 3)),
         say("normal traffic here at this hour, about %.0f expected", "normalcy_expected")),
        ("pattern of life", F.when(~learnt & (c("normalcy_samples") > 0), 0.0),
         say("only %d observations learnt so far", "normalcy_samples")),
        ("operator feedback", F.when((reviews >= 4) & (fa >= 0.5), F.round(-0.28 * fa, 3))
         .when((reviews >= 4) & (fa <= 0.2), 0.08),
         say("%d of %d marked false alarm", "fb_false", reviews)),
        ("detection confidence", F.when(c("confidence") > 0, F.round((c("confidence") - 0.6) * 0.20, 3)),
         say("detector confidence %.0f%%", c("confidence") * 100)),
        ("outside certified region", F.when(~c("capability_supported"), -0.20),
         F.lit("outside the image region certified for this analytic")),
        ("group size", F.when(c("group_size") >= 3, F.round(F.least(F.lit(0.18), 0.05 * c("group_size")), 3)),
         say("%d moving together", "group_size")),
        ("extended dwell", F.when(c("dwell_s") >= 60, 0.09), say("present for %.0f s", "dwell_s")),
        ("high speed", F.when(c("speed_mps") > 6.0, 0.08), say("about %.1f m/s", "speed_mps")),
        ("proximity to boundary", F.when(c("near_boundary"), 0.07), F.lit("close to the border line")),
        ("low-profile posture", F.when(c("low_profile"), 0.14), F.lit("wide, flat silhouette of a person")),
    ]


DEFAULT_INPUTS = {
    "is_night": "false", "normalcy_ratio": "1.0D", "normalcy_samples": "0L", "normalcy_expected": "0.0D",
    "fb_true": "0L", "fb_false": "0L", "confidence": "0.0D", "capability_supported": "true",
    "group_size": "1L", "dwell_s": "0.0D", "speed_mps": "CAST(NULL AS DOUBLE)", "near_boundary": "false",
    "low_profile": "false", "object_class": "CAST(NULL AS STRING)",
    "extras": "CAST(NULL AS ARRAY<STRUCT<name:STRING,weight:DOUBLE>>)"}


def score(events: DataFrame) -> DataFrame:
    """Add ``factors``, ``score`` (0..1, three decimals) and ``priority``.

    Context columns that are absent take their neutral value; null context in a
    present column counts as neutral too.
    """
    filled = {}
    for name, neutral in DEFAULT_INPUTS.items():
        keep_null = name in ("speed_mps", "object_class", "extras")
        if name not in events.columns:
            filled[name] = F.expr(neutral)
        elif not keep_null:
            filled[name] = F.coalesce(F.col(name), F.expr(neutral))
    terms = _terms()
    names = [f"_w{i}" for i in range(len(terms))]
    out = events.withColumns(filled)
    # weights first, as plain columns: the sum and the explanation share them
    out = out.withColumns({n: w.cast("double") for n, (_, w, _) in zip(names, terms)})
    given = F.coalesce(F.col("extras"), F.array().cast("array<struct<name:string,weight:double>>"))
    parts = F.array(*[F.when(F.col(n).isNotNull(), F.struct(F.lit(name).alias("name"), F.col(n).alias("weight"),
                                                            detail.alias("detail")))
                      for n, (name, _, detail) in zip(names, terms)])
    extra = F.transform(given, lambda e: F.struct(
        e["name"].alias("name"), F.round(e["weight"], 3).alias("weight"), F.lit("contribution of the rule").alias("detail")))
    total = F.aggregate(given, F.lit(0.0), lambda a, e: a + F.round(e["weight"], 3))
    for n in reversed(names):
        total = F.coalesce(F.col(n), F.lit(0.0)) + total
    out = out.withColumns({
        "factors": F.concat(F.array_compact(parts), extra).cast(f"array<{FACTOR}>"),
        "score": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 3)}).drop(*names)
    return out.withColumn("priority", priority_of_score(F.col("score")))


def adjust(events: DataFrame, amount: str, name: str, detail: str) -> DataFrame:
    """Apply a later score adjustment and record it as one more factor."""
    moved = F.abs(F.col(amount)) > 1e-6
    new = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score") + F.col(amount)))
    factor = F.struct(F.lit(name).alias("name"), F.round(amount, 3).alias("weight"), F.col(detail).alias("detail"))
    out = events.withColumns({
        "score": F.when(moved, new).otherwise(F.col("score")),
        "factors": F.when(moved, F.concat("factors", F.array(factor.cast(FACTOR)))).otherwise(F.col("factors"))})
    return out.withColumn("priority", F.when(moved, priority_of_score(F.col("score"))).otherwise(F.col("priority")))
