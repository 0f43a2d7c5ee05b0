"""Line fit, as-of join, sealing, outages, turn-taking, late rows and fixed rules against plain versions."""
import itertools
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchpost.functions import crypto
from watchpost.operators import events as EV
from watchpost.operators import integrity as IN
from watchpost.operators import ledger as LG
from watchpost.operators import metrics as M
from watchpost.operators import normalcy as N
from watchpost.operators import profiling as P
from watchpost.operators import reid as RE
from watchpost.operators import slopes as SL
from watchpost.operators.matching import take_turns
from watchpost.streaming import jobs as J


@pytest.mark.parametrize("seed,size", [(1, 2), (2, 3), (3, 40), (4, 61)])
def test_median_slope_of_all_pairs(spark, seed, size):
    r = random.Random(seed)
    rows = [(c, float(r.randrange(12)), float(r.randrange(9)) + c) for c in (0, 1) for _ in range(size)]
    rows += [(0, 1.0, 2.0)] * 5
    got = {x["camera_id"]: x for x in P.line_fit(spark.createDataFrame(rows, "camera_id int, foot_v double, px_height double")).collect()}
    for c in (0, 1):
        own = [(x, y) for k, x, y in rows if k == c]
        slopes = [(b[1] - a[1]) / (b[0] - a[0]) for a, b in itertools.combinations(own, 2) if a[0] != b[0]]
        if not slopes:
            assert c not in got
            continue
        slope = statistics.median(slopes)
        assert got[c]["slope"] == pytest.approx(slope, abs=1e-9)
        assert got[c]["intercept"] == pytest.approx(statistics.median(y - slope * x for x, y in own), abs=1e-8)


def test_median_slope_over_many_tasks(spark, monkeypatch):
    """A camera parted in chunks and buckets, with a crowded foot row and a crowded line, fits as in one task."""
    monkeypatch.setattr(SL, "TOLERANCE", 1e-9)  # fewer steps for this check
    monkeypatch.setattr(SL, "TRIALS", 31)
    r = random.Random(9)
    line = [(0, float(x), 2.0 * x + 1) for x in range(40)]
    rows = [(0, r.uniform(0, 50), r.uniform(0, 90)) for _ in range(150)] + [(0, 17.0, r.uniform(0, 90)) for _ in range(120)] + line * 2
    rows += [(1, float(r.randrange(6)), float(r.randrange(9))) for _ in range(60)] + [(2, 5.0, float(k)) for k in range(50)]
    df = spark.createDataFrame(rows, "camera_id int, foot_v double, px_height double")
    whole = {x["camera_id"]: x for x in P.line_fit(df).collect()}
    parted = {x["camera_id"]: x for x in P.line_fit(df, task_points=30).collect()}
    assert set(whole) == set(parted) == {0, 1}
    for c in (0, 1):
        assert parted[c]["slope"] == pytest.approx(whole[c]["slope"], abs=1e-8) and parted[c]["intercept"] == pytest.approx(whole[c]["intercept"], abs=1e-6)


@pytest.mark.parametrize("slope", [-1.5, 0.0, 0.31, 2.0])
def test_pairs_counted_by_chunk_and_bucket(spark, slope):
    r = random.Random(5)
    pts = sorted({(float(r.randrange(15)), float(r.randrange(12))) for _ in range(90)} | {(float(x), 2.0 * x) for x in range(9)})
    own = [(1, x, y, r.randrange(1, 4)) for x, y in pts]
    want = sum(a[3] * b[3] for a in own for b in own if a[1] < b[1] and b[2] - slope * b[1] <= a[2] - slope * a[1])
    points = spark.createDataFrame(own, "camera_id int, x double, y double, n long").withColumn("chunk", SL._between(F.col("x"), F.array(F.lit(3.0), F.lit(7.0), F.lit(7.5))))
    trials = spark.createDataFrame([(1, 0, slope, [(x, y) for x, y in pts[::9]], 4)], "camera_id int, trial int, slope double, sampled array<struct<x:double,y:double>>, parts int")
    assert [int(x["pairs"]) for x in SL.counted(points, trials).collect()] == [want]


def test_no_steeper_counts_pairs():
    rng = np.random.default_rng(0)
    p = sorted({(float(a), float(b)) for a, b in rng.integers(0, 8, (30, 2))})
    n = rng.integers(1, 4, len(p))
    x, y = np.array([a for a, _ in p]), np.array([b for _, b in p])
    for slope in (-2.0, -0.3, 0.0, 0.37, 5.0):
        want = sum(int(n[i] * n[j]) for i in range(len(p)) for j in range(i + 1, len(p)) if x[i] < x[j] and (y[j] - y[i]) <= slope * (x[j] - x[i]))
        assert SL.no_steeper(x, y, n, slope) == want


def test_as_of(spark, hot):
    r = random.Random(5)
    ev = [(i, r.choice(["a", "b", "c"]), r.randrange(500)) for i in range(300)]
    vs = [(k, t, 1000 + t) for k in ("a", "b") for t in sorted(r.sample(range(20, 480), 25))]
    got = EV.as_of(spark.createDataFrame(ev, "event_id long, cam string, ts_us long"), spark.createDataFrame(vs, "cam string, since long, version long"),
                   "cam", "since", ["version"]).collect()
    assert len(got) == len(ev)
    for x in got:
        assert x["version"] == max((v for k, t, v in vs if k == x["cam"] and t <= x["ts_us"]), default=None)


def _log(spark, n, first=0):
    rows = [(i, "n1" if i % 3 else "n2", i * 10) for i in range(first, first + n)]
    return spark.createDataFrame(rows, "event_id long, node_id string, ts_us long").withColumns({
        "camera_id": F.lit("c"), "event_type": F.lit("loitering"), "object_class": F.lit("person"), "track_id": F.lit(1).cast("long"),
        "zone_id": F.lit("z"), "score": F.lit(0.5)})


def test_sealed_events_stay_sealed(spark):
    once = LG.append(_log(spark, 12), segment_rows=3)
    new = once.unionByName(_log(spark, 6, 12), allowMissingColumns=True)
    twice = LG.append(new)
    before = {r["event_id"]: (r["ledger_index"], r["entry_hash"]) for r in once.collect()}
    after = {r["event_id"]: (r["ledger_index"], r["entry_hash"]) for r in twice.collect()}
    assert len(after) == 18 and all(after[k] == v for k, v in before.items())
    assert all(r["valid"] for r in LG.verify(twice).collect())
    assert {r["node_id"]: r["entries"] for r in LG.verify(twice).collect()} == {"n1": 12, "n2": 6}


def test_outage_that_lasts(spark):
    f = spark.createDataFrame([("a", i, i * 1_000_000) for i in (0, 1, 2, 20)] + [("b", 0, 1_000_000)], "camera_id string, frame_id long, ts_us long")
    found = lambda **k: sorted(((r["camera_id"], r["offline_us"], r["online_us"]) for r in IN.outages(f, 5.0, **k).collect()), key=str)
    assert found() == [("a", 7_000_000, 20_000_000)]
    assert found(as_of_us=22_000_000) == [("a", 7_000_000, 20_000_000), ("b", 6_000_000, None)]


def test_turns_equal_a_loop(spark):
    r = random.Random(3)
    rows = [(t, i, r.randrange(6)) for t in range(40) for i in r.sample(range(25), r.randrange(0, 6))]
    df = spark.createDataFrame(rows, "taker long, item long, w long").select(
        "taker", F.struct("taker").alias("turn"), "item", F.struct("w", "item").alias("wish"))
    want, taken = {}, set()
    for t in range(40):
        free = [(w, i) for k, i, w in rows if k == t and i not in taken]
        if free:
            want[t] = min(free)[1]
            taken.add(want[t])
    assert {x["taker"]: x["item"] for x in take_turns(df).collect()} == want


def test_hard_tripwires_are_never_routine(spark):
    kinds = ["line_crossing", "zone_intrusion", "wrong_direction", "loitering"]
    df = spark.createDataFrame([(k, p, True) for k in kinds for p in ("fenced", "open")], "event_type string, profile string, is_routine boolean")
    kept = {(r["event_type"], r["profile"]) for r in N.suppress_routine(df).collect() if r["kept"]}
    assert kept == {(k, "fenced") for k in kinds[:3]}


BOX = "frame long, id string, object_class string, x1 double, y1 double, x2 double, y2 double"


def test_average_precision_rules(spark, hot):
    t = spark.createDataFrame([(0, "g1", "p", 0.0, 0.0, 10.0, 10.0, False), (0, "g2", "p", 0.0, 3.0, 10.0, 13.0, False)], BOX + ", ignored boolean")
    p = spark.createDataFrame([(0, "a", "p", 0.0, 0.0, 10.0, 10.0, 0.9), (0, "b", "p", 0.0, 1.0, 10.0, 11.0, 0.8)], BOX + ", score double")
    tp = {rule: M.average_precision(p, t, 0.5, rule).first()["tp"] for rule in ("widest", "free")}
    assert tp == {"widest": 1, "free": 2}  # the second box takes what is left
    many = spark.createDataFrame([(f, f"a{f}", "p", 0.0, 0.0, 10.0, 10.0, 0.5) for f in range(200)], BOX + ", score double")
    true = spark.createDataFrame([(f, f"g{f}", "p", 0.0, 0.0, 10.0, 10.0, False) for f in range(0, 200, 2)], BOX + ", ignored boolean")
    one = M.average_precision(many, true, 0.5).first()  # a single score, in several chunks
    assert (one["detections"], one["tp"]) == (200, 100)
    hits, area = 0, []
    for n in range(1, 201):
        hits += n % 2
        area.append((hits / n, n % 2))
    env = [max(q for q, _ in area[i:]) for i in range(200)]
    assert one["ap"] == pytest.approx(sum(e for e, (_, h) in zip(env, area) if h) / 100)


def test_regions_are_linked_frame_by_frame(spark):
    rows = [(1, f, f"r{f}", 5.0 * f, 0.0, 5.0 * f + 40, 40.0) for f in range(4)] + [(1, 5, "late", 20.0, 0.0, 60.0, 40.0), (1, 1, "far", 500.0, 0.0, 540.0, 40.0)]
    df = spark.createDataFrame(rows, "clip long, frame long, id string, x1 double, y1 double, x2 double, y2 double")
    for target in (1_000, 2):
        got = {r["id"]: r["track"] for r in M.link_regions(df, width=1, target_rows=target).collect()}
        assert got == {"r0": "r0", "r1": "r0", "r2": "r0", "r3": "r0", "late": "late", "far": "far"}


def test_weighted_pooled_gap_and_trials(spark):
    s = spark.createDataFrame([(1, 10, 8, 8, 1, 0.4, 100), (2, 30, 33, 27, 0, 0.8, 300)], "sequence long, gt long, predicted long, matches long, id_switches long, mota double, frames long")
    assert M.frame_weighted(s, ["mota"]).first()["mota"] == pytest.approx(0.7)
    p = M.pooled_mot(s).first()
    assert p["mota"] == pytest.approx(round(1 - (40 - 35 + 41 - 35 + 1) / 40, 4)) and p["recall"] == 0.875
    r = spark.createDataFrame([("a", 0.9, 0.5), ("b", 0.6, 0.1)], "way string, rank1 double, map double")
    g = RE.modality_gap(r, "a", "b", "way").first()
    assert g["rank1_drop"] == pytest.approx(0.3) and g["map_drop"] == pytest.approx(0.4)
    t = RE.mean_of_trials(r.withColumn("k", F.lit(1)), ["k"]).first()
    assert (t["trials"], t["rank1"], t["map"]) == (2, pytest.approx(0.75), pytest.approx(0.3))


def test_the_signing_key_is_in_no_plan(spark):
    df = spark.range(2).select(crypto.hmac_sha256("very-secret-key", F.col("id").cast("string")).alias("s"))
    plan = df._jdf.queryExecution().toString()
    assert "very-secret" not in plan and "very-secret-key".encode().hex() not in plan.lower()
    assert len({r["s"] for r in df.collect()}) == 2


def test_late_rows_go_to_their_own_table(spark, tmp_path):
    src = tmp_path / "src"
    q = None
    for n, rows in enumerate([[(1, 100), (2, 1000)], [(3, 990), (4, 300)], [(5, 2000), (6, None)]]):
        spark.createDataFrame([(i, None if t is None else t * 1_000_000) for i, t in rows], "event_id long, ts_us long").coalesce(1).write.mode("append").parquet(str(src))
        q = J.split_late(spark.readStream.schema("event_id long, ts_us long").parquet(str(src)), str(tmp_path / "on"), str(tmp_path / "late"), str(tmp_path / "p"), 60.0, True)
        q.awaitTermination(120)
    ids = lambda p: sorted(r["event_id"] for r in spark.read.parquet(str(tmp_path / p)).collect())
    assert ids("on") == [1, 2, 3, 5, 6] and ids("late") == [4]


def test_matches_in_chunks_equal_whole_and_settle_fast(spark, monkeypatch):
    from watchpost.operators import fold as FD
    r = random.Random(8)
    truth, found = [], []
    for f in range(120):
        for who in r.sample(range(30), 6):
            x = 100.0 * (who % 10) + r.randrange(3)
            truth.append((1, f, who, x, 50.0 * (who // 10), x + 40, 50.0 * (who // 10) + 40))
            if r.random() < 0.9:
                found.append((1, f, who + (100 if (f // 40 + who) % 3 == 0 else 0), x + 4, 50.0 * (who // 10), x + 44, 50.0 * (who // 10) + 40))
    box = "sequence long, frame long, obj_id long, x1 double, y1 double, x2 double, y2 double"
    t, p = spark.createDataFrame(truth, box), spark.createDataFrame(found, box)
    whole = sorted(map(tuple, M.mot_matches(t, p).collect()))
    calls = []
    monkeypatch.setattr(FD, "cut", lambda df, cut=FD.cut: calls.append(1) or cut(df))
    rounds = {}
    for target in (400, 60):
        calls.clear()
        assert sorted(map(tuple, M.mot_matches(t, p, width=1, target_rows=target).collect())) == whole
        rounds[target] = (len(calls) - 3) // 2
    assert rounds[60] <= rounds[400] + 2  # seven times the chunks, hardly more rounds


def plain_ranks(queries, gallery, junk):
    out = {}
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-12)
    for q, qi, qc, qv in queries:
        row = [(-round(float(unit(qv) @ unit(v)), 10), g, gi) for g, gi, gc, v in gallery if not junk or not (gi == qi and gc == qc or gi in (0, -1))]
        out.update({(q, g): n for n, (_, g, gi) in enumerate(sorted(row), 1) if gi == qi})
    return out


@pytest.mark.parametrize("junk", [True, False])
@pytest.mark.parametrize("small", [True, False])
def test_places_of_right_answers_from_counts(spark, monkeypatch, junk, small):
    """Equal vectors, one identity that holds a third of all rows, nobodies; blocks of five rows and rows of three thresholds."""
    if small:
        for name, value in (("BLOCK", 5), ("CHUNK", 3), ("BLOCK_THRESHOLDS", 11)):
            monkeypatch.setattr(RE, name, value)
    r = random.Random(7)
    vectors = [[float(r.randrange(-2, 3)) for _ in range(4)] for _ in range(25)]
    rows = [(i, 7 if i % 3 == 0 else r.randrange(-1, 9), r.randrange(3), r.choice(vectors)) for i in range(90)]
    table = lambda rs: spark.createDataFrame(rs, "vec_id long, identity int, camera int, vector array<float>").repartition(3)
    queries, gallery = rows[::4], [x for k, x in enumerate(rows) if k % 4]
    got = RE.ranked_answers(table(queries), table(gallery), junk)
    want = plain_ranks(queries, gallery, junk)
    assert {(x["q_id"], x["g_id"]): x["rank"] for x in got.collect()} == want and got.count() == len(want)
    score = RE.reid_scores(got).first()
    per = {}
    for (q, _), n in sorted(want.items(), key=lambda x: x[1]):
        per.setdefault(q, []).append(n)
    assert score["queries"] == len(per) and score["rank1"] == pytest.approx(np.mean([n[0] == 1 for n in per.values()]))
    assert score["map"] == pytest.approx(np.mean([np.mean([k / n for k, n in enumerate(ns, 1)]) for ns in per.values()]))


def test_every_right_answer_is_placed_once(spark):
    vector = ", ".join(f"CAST(xxhash64(id, {k}) % 1000 AS FLOAT)" for k in range(3))
    rows = spark.range(400).selectExpr("id AS vec_id", "CAST(id % 40 AS INT) AS identity", "CAST(id % 3 AS INT) AS camera", f"array({vector}) AS vector")
    queries, gallery = rows.where("vec_id div 40 % 2 = 0"), rows.where("vec_id div 40 % 2 = 1")
    got = RE.ranked_answers(queries, gallery, junk=False)
    assert got.count() == got.select("q_id", "g_id").distinct().count() == 40 * 5 * 5
    assert got.groupBy("q_id").agg(F.countDistinct("rank").alias("n")).where("n <> 5").isEmpty()


def test_trials_hold_all_crops_and_both_directions(spark):
    crops = spark.range(300).selectExpr("id AS vec_id", "CAST(id % 30 AS INT) AS identity", "CAST((id div 30) % 2 AS INT) AS camera", "array(CAST(id % 7 AS FLOAT), CAST(1 AS FLOAT)) AS vector")
    got = RE.trial_ranks(crops, range(4), F.col("camera") == 0, ("there", "back"))
    per = {(x["trial"], x["direction"]): x["n"] for x in got.groupBy("trial", "direction").agg(F.countDistinct("q_id").alias("n")).collect()}
    assert len(per) == 8 and all(per[t, "there"] == per[t, "back"] for t in range(4)) and len({per[t, "there"] for t in range(4)}) > 1
    assert RE.trial_ranks(crops, [2], F.col("camera") == 0, ("there", "back")).groupBy("q_id", "direction").count().agg(F.min("count"), F.max("count")).first() == (5, 5)


def test_trials_add_up_a_query_in_its_task(spark):
    crops = spark.range(200).selectExpr("id AS vec_id", "CAST(id % 9 AS INT) AS identity", "CAST((id div 9) % 2 AS INT) AS camera", "array(CAST(id * 7 % 11 AS FLOAT), CAST(id % 5 AS FLOAT), CAST(1 AS FLOAT)) AS vector")
    key = ["trial", "direction"]
    each, added = [RE.trial_ranks(crops, range(3), F.col("camera") == 0, ("there", "back"), each=e) for e in (True, False)]
    assert added.count() == each.select(*key, "q_id").distinct().count() < each.count() / 5
    want, got = [{(x["trial"], x["direction"]): (x["queries"], x["rank1"], round(x["map"], 9)) for x in RE.reid_scores(r, key).collect()} for r in (each, added)]
    assert got == want and len(got) == 6


def test_scores_add_up_where_answers_are_made(spark):
    """One identity, so every pair is a right answer: none of them may be sorted, joined or shuffled."""
    crops = spark.range(600).selectExpr("id AS vec_id", "5 AS identity", "CAST(id % 2 AS INT) AS camera", "array(CAST(id % 11 AS FLOAT), CAST(1 AS FLOAT), CAST(id % 3 AS FLOAT)) AS vector")
    got = RE.ranked_answers(crops.where("camera = 0"), crops.where("camera = 1"), junk=False)
    assert got.count() == 300 * 300 and got.where("rank <> hits").isEmpty()
    scores = RE.reid_scores(got)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and plan.count("Exchange") <= 4
    assert tuple(scores.first()) == (300, 1.0, 1.0)


@pytest.mark.parametrize("junk,held", [(True, 0), (False, 64)])
def test_answers_of_a_query_add_up_in_its_task(spark, monkeypatch, junk, held):
    """One row a query leaves the task, with the scores of its answers one by one; vectors and ids given twice, some not read again."""
    for name, value in (("BLOCK", 7), ("HELD", held), ("CHUNK", 3), ("BLOCK_THRESHOLDS", 100)):
        monkeypatch.setattr(RE, name, value)
    r = random.Random(11)
    vectors = [[float(r.randrange(-2, 3)) for _ in range(4)] for _ in range(25)]
    rows = [(i, r.randrange(-1, 5), r.randrange(3), r.choice(vectors)) for i in range(80)]
    schema = "vec_id long, identity int, camera int, vector array<float>"
    for twice in ([], rows[10:30]):
        queries, gallery = spark.createDataFrame(rows[::3] + twice[::3], schema), spark.createDataFrame([x for x in rows if x[0] % 3] + twice, schema)
        each, added = RE.ranked_answers(queries, gallery, junk), RE.ranked_answers(queries, gallery, junk, each=False)
        want = {q["q_id"]: tuple(q)[1:] for q in each.groupBy("q_id").agg(F.min("rank"), F.count("*"), F.round(F.sum(F.col("hits") / F.col("rank")), 9)).collect()}
        got = {q["q_id"]: tuple(q)[1:] for q in added.withColumn("precision", F.round("precision", 9)).collect()}
        assert got == want and added.count() == len(want) > 15
        assert tuple(RE.reid_scores(added).first()) == pytest.approx(tuple(RE.reid_scores(each).first()))


@pytest.mark.parametrize("spread", [3, 500, 1 << 36])
def test_places_from_upper_bits_and_from_whole_keys(monkeypatch, spread):
    """Keys that share their upper bits, or are equal, stand in order of key, then row."""
    rng, whole = np.random.default_rng(4), RE._answers_in_order
    for n in range(1, 200, 3):
        keys, right = rng.integers(-spread, spread, n), rng.random(n) < (0.05, 0.5, 1)[n % 3]
        want = np.flatnonzero(right[np.lexsort((np.arange(n), keys))])
        assert RE._places_in_order(keys, right).tolist() == whole(keys, right)[0].tolist() == want.tolist()
    monkeypatch.setattr(RE, "_answers_in_order", None)  # a few shared upper bits need no second sort
    keys = np.concatenate([np.arange(100) << 20, (7 << 20) + np.arange(3)])
    right = np.arange(103) % 2 == 1
    assert RE._places_in_order(keys, right).tolist() == np.flatnonzero(right[np.argsort(keys, kind="stable")]).tolist()


def test_best_total_of_an_assignment():
    r = np.random.default_rng(3)
    for _ in range(200):
        n, m = r.integers(1, 9, 2)
        gain = r.integers(0, 5, (n, m)).astype(float)
        assert M._best_total(gain) == sum(gain[a, b] for a, b in M._assign(gain))
    # three of a row's rivals give way in turn; rows and columns may outnumber each other
    assert M._best_total(np.array([[5.0, 4, 0], [5, 0, 3], [5, 4, 3]])) == M._best_total(np.array([[5.0, 4, 0], [5, 0, 3], [5, 4, 3]]).T) == 12
