"""What keeps a task's memory from growing with the input."""
import os
import re
import uuid

import numpy as np
from pyspark.sql import functions as F

from watchpost.operators import ledger as LG
from watchpost.operators import ordered as O
from watchpost.operators import rules as R
from watchpost.operators import tracking as TR
from watchpost.operators.fold import fold, last_states
from watchpost.operators import matching as MA
from watchpost.operators import metrics as M
from watchpost.operators.metrics import overlap_matrix
from watchpost.plans import fixtures as X
from watchpost.plans import q_eval as Q


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_link_streams_through_the_worker(spark, sf):
    """Chains in batches of seven rows equal chains in one; no worker gets a node whole."""
    log = X.event_log(spark, sf).withColumn("event_type", F.col("event_kind")).where("event_id < 400")
    assert "FlatMapGroupsInPandas" not in plan_of(LG.append(log))
    whole = sorted(map(tuple, LG.append(log).select("node_id", "ledger_index", "prev_hash", "entry_hash").collect()))
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = sorted(map(tuple, LG.append(log, segment_rows=30).select("node_id", "ledger_index", "prev_hash", "entry_hash").collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert small == whole
    for (node, index, _, entry), (after, nxt, prev, _) in zip(whole, whole[1:]):
        assert (prev == entry and nxt == index + 1) if after == node else (prev == "" and nxt == 1)


def test_bounded_keys_are_dealt_by_rows(spark, monkeypatch):
    """Tables of many rows get tasks of a bounded number of rows, small ones the session's partitions."""
    rows = spark.range(3000).selectExpr("id % 300 AS k", "id AS at")
    assert O.with_chunks(rows, ["k"], "at", 100).rdd.getNumPartitions() == rows.rdd.getNumPartitions()
    monkeypatch.setattr(O, "TASK_ROWS", 100)
    dealt = O.with_chunks(rows, ["k"], "at", 100)
    assert dealt.rdd.getNumPartitions() == 30 and dealt.count() == 3000
    assert sorted(map(tuple, O.running(dealt, ["k"], ["at"], {"n": ("count", F.lit(True))}).collect())) == sorted(
        map(tuple, O.running(rows, ["k"], ["at"], {"n": ("count", F.lit(True))}).collect()))


def test_rows_of_a_camera_are_not_gathered(spark):
    """Zones made in the session join beside the rows: one shuffle by track serves the features and the membership."""
    points = spark.range(200).selectExpr("'click' AS camera_id", "id % 20 AS track_id", "id AS ts_us", "id AS event_id", "(id % 10) / 10.0D AS x", "(id % 7) / 7.0D AS y",
                                         "'person' AS object_class", "0.5D AS confidence")
    plan = plan_of(R.membership(R.track_features(points), X.zones(spark)))
    by = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert by and all("track_id" in x for x in by) and "SortMergeJoin" not in plan


def test_crowded_boxes_pair_as_a_plain_greedy_loop_does(monkeypatch):
    rng = np.random.default_rng(3)
    crowd = lambda n, step: (lambda x: np.hstack([x, x + [60.0, 120.0]]))(np.floor(rng.random((n, 2)) * [500, 100] / step) * step)
    for step in (0.01, 10, 50):  # all different, some equal, mostly equal
        a, b = crowd(120, step), crowd(90, step)
        iou = overlap_matrix(a, b)
        want, used_a, used_b = [], set(), set()
        for _, i, j in sorted((-iou[i, j], i, j) for i in range(len(a)) for j in range(len(b)) if iou[i, j] >= 0.3):
            if i not in used_a and j not in used_b:
                want.append((i, j))
                used_a.add(i)
                used_b.add(j)
        with monkeypatch.context() as m:
            m.setattr(TR, "overlap_matrix", None)  # a crowd is not met all with all
            assert sorted(TR.best_first(a, b, 0.3)) == sorted(want)


def test_chunks_whose_guesses_never_settle_run_few_times(spark, tmp_path):
    folder = str(tmp_path)

    def step(pdf, state):
        before = int(state or 0)
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return pdf[["k", "at"]].assign(total=range(before + 1, before + len(pdf) + 1)), str(before + len(pdf))

    rows = O.with_chunks(spark.range(160).select(F.lit("a").alias("k"), F.col("id").alias("at")), ["k"], "at", 10, 10)
    assert rows.select(O.CHUNK).distinct().count() == 16
    got = fold(rows, ["k"], ["at"], step, "k string, at long, total long").collect()
    assert sorted((r["at"], r["total"]) for r in got) == [(i, i + 1) for i in range(160)]
    assert len(os.listdir(folder)) <= 3 * 16  # not once more for every chunk before


def test_lines_are_numbered_once_and_small_frames_need_no_matrix(spark, sf):
    t, p = Q.mot_tables(spark, sf)
    assert "Window" not in plan_of(t) and "Window" not in plan_of(p)
    rng = np.random.default_rng(5)
    a, b = rng.random((9, 4)) * 50, rng.random((7, 4)) * 50
    a[:, 2:] += a[:, :2]
    want = M.overlap_matrix(a, b)
    assert [[M.overlap(x, y) for y in b.tolist()] for x in a.tolist()] == want.tolist()
    for gain in (want, want.T, np.round(want, 1)):
        assert M._assign(gain) == M._assign_many(gain)


def test_small_frames_are_met_by_frame_and_give_the_rows_of_the_wide_plan(spark, monkeypatch):
    rng = np.random.default_rng(7)

    def side(name, n):
        at = np.floor(rng.random((n, 2)) * 8) * 12
        rows = [(None if k % 23 == 5 else k // 9, f"{name}{k - k % 31 // 30}", float(k * 7 % 10) / 10, None if k % 29 == 3 else k % 5 == 0, k % 7,
                 None if k % 19 == 4 else float(x), float(y), float(x) + 40, float(y) + 40) for k, (x, y) in enumerate(at.tolist())]
        return rows + rows[10:25]  # some given twice
    cols = "frame long, id string, score double, ignored boolean, track long, x1 double, y1 double, x2 double, y2 double"
    p, t = (spark.createDataFrame(side(n, 120), cols) for n in "pt")
    run = {"widest": lambda: M.average_precision(p, t, 0.3).collect(), "free": lambda: M.average_precision(p, t, 0.3, "free").collect(),
           "areas": lambda: M.rbdc_tbdc(M.region_curves(p, t)).select(*[F.round(c, 9) for c in ("thresholds", "rbdc", "tbdc")]).collect()}
    by_frame = {n: f() for n, f in run.items()}
    monkeypatch.setattr(MA, "SMALL_FRAME", 0)
    wide = {n: f() for n, f in run.items()}
    assert by_frame == wide and by_frame["widest"][0]["tp"] > 5
    monkeypatch.setattr(MA, "SMALL_FRAME", 48)
    for df in (M._outcomes_by_frame(p, t, 0.3, "free"), M._outcomes_by_frame(p, t, 0.3, "widest"), M._found_by_frame(p, t, 0.1)):
        assert plan_of(df).split("Initial Plan")[-1].count("Exchange") == 1  # both sides once, by frame


def test_keys_whose_guesses_never_settle_run_once(spark, tmp_path):
    """Two chunks of a key are probed, then each chunk runs once, from the state of the one before."""
    folder = str(tmp_path)

    def step(pdf, state):
        before = int(state or 0)
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return pdf[["k", "at"]].assign(total=range(before + 1, before + len(pdf) + 1)), str(before + len(pdf))

    rows = spark.range(500).select(F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (F.col("id") % 3 + 1).cast("int")).alias("k"), F.col("id").alias("at"))
    rows = O.with_chunks(rows.where("k <> 'c' OR at < 60").repartition(4), ["k"], "at", 10, 20)
    assert rows.select("k", O.CHUNK).distinct().count() > 16
    got = sorted((r["k"], r["at"], r["total"]) for r in fold(rows, ["k"], ["at"], step, "k string, at long, total long").collect())
    want = [(k, at, n) for k, first, end in (("a", 0, 500), ("b", 1, 500), ("c", 2, 60)) for n, at in enumerate(range(first, end, 3), 1)]
    assert got == want
    assert len(os.listdir(folder)) <= rows.select("k", O.CHUNK).distinct().count() + 2 * 3
    ends = last_states(rows, ["k"], ["at"], step, "k string, at long, total long").collect()
    assert {r["k"]: r["state"] for r in ends} == {"a": "167", "b": "167", "c": "20"}
