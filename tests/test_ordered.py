"""Chunked plans must give exactly the rows of plain windows."""
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from watchpost.operators import ordered as O
from watchpost.plans import fixtures as X

KEY, ORDER = ["camera_id"], ["ts_us", "event_id"]


def _pick():
    return F.when(F.col("track_id") % 5 == 0, F.col("track_id"))


def test_running_neighbours_lags_on_hot_keys(spark, sf, hot):
    o = X.obs(spark, sf)
    c = O.with_chunks(o, KEY, "ts_us", 5 * X.DAY_US)
    assert O.CHUNK in c.columns
    r = O.running(c, KEY, ORDER, {"n": ("count", F.lit(True)), "s": ("sum", "track_id"), "m": ("max", "value"),
                                  "l": ("last", _pick()), "f": ("first", _pick())})
    r = O.neighbours(r, KEY, ORDER, back={"p": "value"}, ahead={"q": "value"})
    r = O.lags(r, KEY, ORDER, {"l8": ("value", 8), "l2": ("x", 2)})
    w = W.partitionBy(*KEY).orderBy(*ORDER)
    u = w.rowsBetween(W.unboundedPreceding, 0)
    r = r.withColumns({
        "n2": F.row_number().over(w), "s2": F.sum("track_id").over(u), "m2": F.max("value").over(u),
        "f2": F.first(_pick(), ignorenulls=True).over(u), "l_2": F.last(_pick(), ignorenulls=True).over(u),
        "p2": F.lag("value").over(w), "q2": F.lead("value").over(w), "l82": F.lag("value", 8).over(w), "l22": F.lag("x", 2).over(w)})
    same = "n<=>n2 and s<=>s2 and m<=>m2 and l<=>l_2 and f<=>f2 and p<=>p2 and q<=>q2 and l8<=>l82 and l2<=>l22"
    assert r.count() == o.count()
    assert r.where(f"NOT ({same})").count() == 0


def test_trailing_windows_match_brute_force(spark, sf, hot):
    o = X.obs(spark, sf)
    span = 6 * X.HOUR_US
    got = {r.event_id: (r.d, r.c) for r in O.trailing_distinct(
        o, KEY, "track_id", "ts_us", span, ORDER, "d", X.DAY_US, {"c": F.lit(1)}).collect()}
    rows = sorted((r.camera_id, r.ts_us, r.event_id, r.track_id) for r in o.collect())
    for cam, at, ev, _ in rows[::7]:
        seen = [t for c, a, e, t in rows if c == cam and at - span <= a and (a, e) <= (at, ev)]
        assert got[ev] == (len(set(seen)), len(seen))


def test_quantiles_hot_equals_native(spark, sf, hot):
    o = X.obs(spark, sf)
    want = {r.camera_id: (r.a, r.b) for r in O.quantiles(o, KEY, {"a": ("value", 0.05), "b": ("value", 0.5)}, largest=1).collect()}
    got = {r.camera_id: (r.a, r.b) for r in O.quantiles(o, KEY, {"a": ("value", 0.05), "b": ("value", 0.5)}).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert all(abs(x - y) < 1e-9 for x, y in zip(got[k], want[k]))


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(times=st.lists(st.integers(0, 400), min_size=1, max_size=60), gap=st.integers(1, 60), width=st.integers(20, 90))
def test_cooldown_fold_equals_loop(spark, times, gap, width):
    from watchpost.operators.cooldown import suppress_repeats
    rows = [(f"k{i % 2}", t, i) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "k string, at long, i long")
    got = {r.i for r in suppress_repeats(df, "k", "at", gap, "i", width, shards=1, target_rows=25).collect()}
    last, want = {}, set()
    for t, i, k in sorted((t, i, k) for k, t, i in rows):
        if k not in last or t - last[k] >= gap:
            last[k] = t
            want.add(i)
    assert got == want


def test_crowded_bucket_is_split(spark, hot):
    df = spark.range(200).select(F.lit("k").alias("k"), (F.col("id") % 100).alias("at"))
    c = O.with_chunks(df, ["k"], "at", 1000)
    per = c.groupBy(O.CHUNK).count().collect()
    assert len(per) == 5 and max(r["count"] for r in per) <= 40
