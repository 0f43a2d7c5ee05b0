"""Streams that take over from a batch, interval joins of streams, and timers."""
import random

import pytest

from watchpost.operators import cooldown as CD
from watchpost.operators import corridor as C
from watchpost.operators import governor as GV
from watchpost.streaming import corridor as SC

S = 1_000_000
EDGES = [("gate", "yard", 30.0, 6.0), ("yard", "gate", 30.0, 6.0), ("yard", "dock", 20.0, 4.0), ("dock", "gate", 300.0, 40.0)]


def stream(spark, folder, batches, schema):
    """A stream that brings one of ``batches`` (lists of rows) per micro-batch, in this order."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{folder}/{n:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{folder}/*")


def drained(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


@pytest.mark.parametrize("target_rows", [400_000, 20])
def test_governor_goes_on_from_a_batch(spark, tmp_path, target_rows):
    r = random.Random(target_rows)
    schema = "node_id string, event_id long, ts_us long, score double, rank int"
    rows = sorted([(r.choice("ab"), i, r.randrange(0, 9 * 3600) * S, r.random(), r.randrange(1, 5)) for i in range(300)], key=lambda x: x[2])
    before, after = rows[:170], rows[170:]
    want = {x["event_id"]: tuple(x) for x in GV.ration(spark.createDataFrame(rows, schema)).collect()}
    states = GV.ration_states(spark.createDataFrame(before, schema), width=3600 * S, target_rows=target_rows)
    assert {x["node_id"] for x in states.collect()} == {"a", "b"}
    live = stream(spark, str(tmp_path / "in"), [after[:60], after[60:]], schema)
    got = {x["event_id"]: tuple(x) for x in drained(GV.ration(live, resume=states), tmp_path, f"rationed{target_rows}")}
    assert got == {i: x for i, x in want.items() if i in {a[1] for a in after}}
    without = {x["event_id"]: tuple(x) for x in drained(GV.ration(live), tmp_path, f"cold{target_rows}")}
    assert without != got  # the hand-over matters


def test_cooldown_goes_on_from_a_batch(spark, tmp_path):
    schema = "k string, at long, id long"
    rows = [(f"k{i % 5}", i * 7, i) for i in range(120)]
    call = dict(key="k", position="at", gap=60, tie="id", width=100, shards=3)
    want = {x["id"] for x in CD.suppress_repeats(spark.createDataFrame(rows, schema), **call).collect()}
    states = CD.cooldown_states(spark.createDataFrame(rows[:61], schema), **call, target_rows=15)
    live = stream(spark, str(tmp_path / "in"), [rows[61:90], rows[90:]], schema)
    got = {x["id"] for x in drained(CD.suppress_repeats(live, **call, resume=states), tmp_path, "cooled")}
    assert got == {i for i in want if i > 60}


def test_state_with_a_time_to_live(spark, tmp_path):
    rows = [("k", i * 7, i) for i in range(20)]
    live = stream(spark, str(tmp_path / "in"), [rows[:10], rows[10:]], "k string, at long, id long")
    call = dict(key="k", position="at", gap=20, tie="id", width=100, shards=1)
    want = {x["id"] for x in CD.suppress_repeats(spark.createDataFrame(rows, "k string, at long, id long"), **call).collect()}
    assert {x["id"] for x in drained(CD.suppress_repeats(live, **call, ttl_s=3600.0), tmp_path, "cooled_ttl")} == want


def test_candidates_of_streams_equal_those_of_tables(spark, tmp_path):
    r = random.Random(3)
    schema = "event_id long, ts_us long, camera_id string, object_class string, signature array<double>"
    look = lambda: None if r.random() < 0.3 else [x / 2 for x in (0.5, 0.5, 0.5, 0.5)]
    make = lambda n: sorted([(n + i, r.randrange(0, 900) * S, r.choice(["gate", "yard", "dock"]), r.choice(["person", "car"]), look()) for i in range(60)], key=lambda x: x[1])
    exits, arrivals = make(0), make(1000)
    edges = spark.createDataFrame(EDGES, C.EDGE_SCHEMA)
    key = lambda rows: sorted((x["exit_id"], x["arrival_id"], x["src"], x["dst"], round(x["score"], 9)) for x in rows)
    want = key(C.handoff_candidates(spark.createDataFrame(exits, schema), spark.createDataFrame(arrivals, schema), edges).collect())
    parts = lambda rows: [rows[:20], rows[20:40], rows[40:]]
    got = SC.handoff_candidates(stream(spark, str(tmp_path / "ex"), parts(exits), schema), stream(spark, str(tmp_path / "ar"), parts(arrivals), schema),
                                edges, delay="20 minutes")
    assert key(drained(got, tmp_path, "candidates")) == want and len(want) > 10


def test_dropouts_are_told_by_timers(spark, tmp_path):
    edges = spark.createDataFrame(EDGES, C.EDGE_SCHEMA)
    ex = "event_id long, ts_us long, camera_id string, handoffs long"
    exits = [(1, 10 * S, "gate", 1), (2, 20 * S, "yard", 2), (3, 30 * S, "gate", 0), (4, 40 * S, "dock", 1), (5, 50 * S, "yard", 1), (6, 60 * S, "lone", 3)]
    claims = [(2, 45 * S), (5, 52 * S)]
    cl = "exit_id long, ts_us long"
    # later batches bring rows of other exits only: what moves time on, not the dropouts' own keys
    more = [(90, 200 * S, "gate", 0)], [(91, 400 * S, "gate", 0)], [(92, 401 * S, "gate", 0)]
    left = stream(spark, str(tmp_path / "ex"), [exits, *[[(i, t, c, 1) for i, t, c, _ in m] for m in more]], ex)
    # a claim may come before its exit does
    came = stream(spark, str(tmp_path / "cl"), [[claims[1]], [claims[0]]], cl)
    got = drained(SC.dropouts(left, came, edges, delay="30 seconds"), tmp_path, "gone")
    known = spark.createDataFrame(exits, ex)
    want = C.dropouts(known, spark.createDataFrame(claims, cl), edges, 360 * S).collect()
    assert sorted((x["exit_id"], x["camera_id"], x["expected_at"], x["exit_us"]) for x in got if x["exit_id"] < 90) == \
        sorted((x["event_id"], x["camera_id"], x["expected_at"], x["ts_us"]) for x in want)
    assert {x["exit_id"] for x in got} >= {1, 90} and 4 not in {x["exit_id"] for x in got} and all(x["due_us"] > x["exit_us"] for x in got)
