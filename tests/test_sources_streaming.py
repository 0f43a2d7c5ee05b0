import json

from pyspark.sql import functions as F

from watchpost.operators import governor as GV
from watchpost.operators import rules as R
from watchpost.operators.cooldown import suppress_repeats
from watchpost.plans import fixtures as X
from watchpost.sources import deltas as DL
from watchpost.sources import files as FS
from watchpost.sources import sinks as SK
from watchpost.streaming import jobs as J
from watchpost.values import Params


def test_mot_truth_and_metadata(spark, tmp_path):
    seq = tmp_path / "S1" / "gt"
    seq.mkdir(parents=True)
    (seq / "gt.txt").write_text("1,1,10,20,30,40,1,1,0.9\n1,2,10,20,30,40,0,1,0.9\n2,3,1,1,5,5,1,7,1\n2,4,1,1,5,5,1,1,0.1\n3,5,1,2,3,4\nbad,row\nx,1,2,3,4,5\n")
    (tmp_path / "S1" / "seqinfo.ini").write_text("[Sequence]\nname=S1\nframeRate=25\nseqLength=12\nimWidth=640\nimHeight=480\n")
    got = sorted((r.sequence, r.frame, r.track_id, r.x2, r.y2) for r in FS.read_mot_truth(spark, f"{tmp_path}/*/gt/gt.txt").collect())
    assert got == [("S1", 1, 1, 40.0, 60.0), ("S1", 3, 5, 4.0, 6.0)]
    i = FS.read_sequence_info(spark, f"{tmp_path}/*/seqinfo.ini").first()
    assert (i.sequence, i.imWidth, i.imHeight, i.frameRate, i.seqLength) == ("S1", 640, 480, 25, 12)
    assert [r.sequence for r in FS.discover_sequences(spark, str(tmp_path)).collect()] == ["S1"]


def test_crops_annotations_and_site(spark, tmp_path):
    for n in ("0002_c1s1_0.jpg", "-1_c3s2_0.jpg", "notes.jpg"):
        (tmp_path / n).write_bytes(b"x")
    assert sorted((r.identity, r.camera) for r in FS.list_crops(spark, str(tmp_path)).collect()) == [(-1, 3), (2, 1)]
    det = {"label": "person", "bounding_box": [0.1, 0.2, 0.5, 0.25]}
    sample = lambda tag: {"filepath": "a.jpg", "tags": [tag], "metadata": {"width": 100, "height": 200}, "ground_truth": {"detections": [det]}}
    (tmp_path / "s.json").write_text(json.dumps({"samples": [sample("val"), sample("train")]}))
    rows = FS.read_annotations(spark, f"{tmp_path}/s.json", "val").collect()
    assert len(rows) == 1 and abs(rows[0].x2 - 60) < 1e-9 and abs(rows[0].y2 - 90) < 1e-9
    (tmp_path / "site.json").write_text(json.dumps({"node_id": "N", "cameras": [{"camera_id": "C", "zones": [
        {"zone_id": "Z", "points": [[0, 0], [1, 0], [1, 1]]}]}]}))
    site = FS.read_site(spark, f"{tmp_path}/site.json")
    assert site["zones"].first().kind == "polygon" and site["cameras"].first().node_id == "N"


def test_upsert_replaces_only_touched_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    mk = lambda rows: spark.createDataFrame(rows, "k long, v string, ver long, day string")
    SK.upsert(path, mk([(1, "a", 1, "d1"), (2, "b", 1, "d2")]), ["k"], "ver", ["day"])
    for _ in range(2):
        SK.upsert(path, mk([(1, "a2", 2, "d1"), (3, "c", 1, "d1")]), ["k"], "ver", ["day"])
    got = sorted((r.k, r.v) for r in spark.read.parquet(path).collect())
    assert got == [(1, "a2"), (2, "b"), (3, "c")]
    audit = str(tmp_path / "audit")
    SK.append_audit(audit, "op", "ack", spark.createDataFrame([(1, "x"), (2, "y")], "at_us long, detail string"))
    assert SK.list_audit(spark, audit, 1).first().at_us == 2


def _stream(spark, df, tmp_path, parts, order="ts_us"):
    """The same rows as a file stream of ``parts`` micro-batches in time order."""
    src = tmp_path / "src"
    rows = df.orderBy(order).toPandas()
    step = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows.iloc[i * step:(i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(f"{src}/p{i:02d}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))


def _drain(q, name, spark):
    w = q.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    w.awaitTermination(120)
    return spark.table(name)


def test_governor_and_cooldown_stream_equals_batch(spark, sf, tmp_path):
    log = X.event_log(spark, sf).select("node_id", "event_id", "ts_us", "score", "rank").withColumn("rank", F.col("rank").cast("int"))
    key = lambda r: (r.event_id, r.alerted)
    p = Params(budget_per_hour=2)
    batch = sorted(map(key, GV.ration(log, p).collect()))
    assert sorted(map(key, _drain(GV.ration(_stream(spark, log, tmp_path, 3), p), "gov", spark).collect())) == batch
    c = log.select(F.col("node_id").alias("k"), "event_id", "ts_us")
    gap = 6 * X.HOUR_US
    batch = sorted(r.event_id for r in suppress_repeats(c, "k", "ts_us", gap, "event_id", X.DAY_US, shards=2).collect())
    s = suppress_repeats(_stream(spark, c, tmp_path / "c", 2), "k", "ts_us", gap, "event_id", X.DAY_US, shards=2)
    assert sorted(r.event_id for r in _drain(s, "cool", spark).collect()) == batch


def test_presence_stream_equals_batch_rules(spark, sf, tmp_path):
    p = Params(confirm_frames=2, loiter_s=86_400.0)
    pts = X.obs(spark, sf).select("event_id", "camera_id", "track_id", "ts", "ts_us", "x", "y", "object_class", "confidence")
    m = R.membership(pts, X.zones(spark), p).where("kind = 'polygon'")
    batch = sorted((r.track_id, r.zone_id, r.event_id) for r in R.intrusions(m).collect())
    got = _drain(J.zone_presence(_stream(spark, pts, tmp_path, 2), X.zones(spark), p), "pres", spark)
    assert sorted((r.track_id, r.zone_id, r.event_id) for r in got.where("event_type = 'zone_intrusion'").collect()) == batch
    loiter = sorted((r.track_id, r.zone_id, r.event_id) for r in R.loitering(m, p).collect())
    assert sorted((r.track_id, r.zone_id, r.event_id) for r in got.where("event_type = 'loitering'").collect()) == loiter


def test_ingest_is_idempotent_and_refuses_rewrites(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def event(i, entry):
        return {"event_id": i, "camera_id": "C", "event_type": "loitering", "object_class": "person", "track_id": 1, "zone_id": "Z",
                "score": 0.5, "rank": 2, "ts_us": i * 1_000_000, "ledger_index": i, "prev_hash": "", "entry_hash": entry}

    def batch(name, events, drift=1_000_000):
        (src / name).write_text(json.dumps({"node_id": "N", "sent_us": 10, "received_us": 10 + drift, "clock_trusted": True, "events": events}))

    def drain():
        q = J.ingest_events(FS.read_event_batches(spark, str(src), streaming=True), *[str(tmp_path / n) for n in ("store", "cps", "bad", "prog")],
                            "secret", available_now=True, compact_every=2)
        q.awaitTermination(120)

    def stored():
        return DL.read_latest(spark, str(tmp_path / "store"), ["event_id"], "synced_us")

    batch("a.json", [event(1, "h1"), event(2, "h2")])
    drain()
    batch("b.json", [event(1, "h1"), event(2, "h2"), event(3, "h3")], drift=60_000_000)
    drain()
    store = {r.event_id: r for r in stored().collect()}
    assert sorted(store) == [1, 2, 3] and store[3].clock_corrected and not store[1].clock_corrected
    assert store[3].ts_us == 63_000_000 and store[3].node_ts_us == 3_000_000
    assert sorted(r.ledger_index for r in spark.read.parquet(str(tmp_path / "cps")).collect()) == [2, 3]
    batch("c.json", [{**event(9, "forged"), "ledger_index": 3}])
    drain()
    assert [r.event_id for r in spark.read.parquet(str(tmp_path / "bad")).collect()] == [9]
    assert stored().count() == 3
    # of two copies of one event the first is refused and the second taken
    batch("d.json", [{**event(4, "forged"), "ledger_index": 3}, event(4, "h4")])
    drain()
    assert {r.event_id: r.entry_hash for r in stored().collect()}[4] == "h4"
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == [4, 9]
    assert sorted(r.ledger_index for r in spark.read.parquet(str(tmp_path / "cps")).collect()) == [2, 3, 4]


def test_camera_outage_timer(spark, tmp_path):
    base = spark.createDataFrame([("A", 0), ("A", 1), ("A", 2), ("B", 2), ("B", 30), ("A", 40), ("B", 41)], "camera_id string, s long")
    d = base.select("camera_id", (F.col("s") * 1_000_000).alias("ts_us"), F.timestamp_micros(F.col("s") * 1_000_000).alias("ts"))
    got = _drain(J.camera_outages(_stream(spark, d, tmp_path, 3)), "outage", spark)
    assert ("A", "camera_offline", 7_000_000) in {(r.camera_id, r.event_type, r.at_us) for r in got.collect()}
    assert ("A", "camera_online", 40_000_000) in {(r.camera_id, r.event_type, r.at_us) for r in got.collect()}


def test_deltas_merge_on_read_and_compact(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v string, ver long"
    mk = lambda rows: spark.createDataFrame(rows, schema)
    latest = lambda: sorted(map(tuple, DL.read_latest(spark, path, ["k"], "ver").select("k", "v", "ver").collect()))
    written = lambda n: spark.read.parquet(f"{path}/deltas/batch_no={n:012d}").count()
    assert DL.read_latest(spark, path, ["k"], "ver") is None
    DL.write_delta(path, mk([(k, "a", 1) for k in range(40)]), 0)
    for _ in range(2):  # a batch that runs again
        DL.write_delta(path, mk([(3, "b", 2)]), 1)
    want = [(k, "b", 2) if k == 3 else (k, "a", 1) for k in range(40)]
    assert latest() == want and written(1) == 1  # one event written, nothing rewritten
    for _ in range(2):  # so may a compaction
        DL.compact(spark, path, ["k"], "ver", 1, buckets=8)
    assert latest() == want and spark.read.parquet(f"{path}/base").count() == 40
    DL.write_delta(path, mk([(5, "late", 0), (41, "new", 1)]), 2)
    want = sorted([*want, (41, "new", 1)])
    assert latest() == want
    found = DL.read_keys(spark, path, mk([(3, "", 0), (41, "", 0), (99, "", 0)]), ["k"], "ver", buckets=8)
    assert sorted((r.k, r.v) for r in found.collect()) == [(3, "b"), (41, "new")]
    DL.compact(spark, path, ["k"], "ver", 2, buckets=8)
    assert latest() == want
    gens = spark.read.parquet(f"{path}/base").groupBy("gen").agg(F.count_distinct("bucket").alias("n")).collect()
    assert {r.gen: r.n for r in gens}[2] <= 2  # only what the last deltas touch was written anew


def test_evidence_layout_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(7, "C1", 1_700_000_000), (8, "C2", 1_700_086_400)], "event_id long, camera_id string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert [r.d for r in rows.select(SK.evidence_dir(F.col("ts"), F.col("camera_id"), F.col("event_id")).alias("d")).collect()] == ["2023/11/14/C1/7", "2023/11/15/C2/8"]
    SK.write_evidence_index(rows, str(tmp_path / "ev"))
    back = spark.read.parquet(str(tmp_path / "ev")).where("date = DATE'2023-11-15' AND camera_id = 'C2'")
    assert [r.event_id for r in back.collect()] == [8]
    SK.write_report(rows.select("event_id", "s"), str(tmp_path / "rep"))
    assert spark.read.parquet(str(tmp_path / "rep/parquet")).count() == spark.read.json(str(tmp_path / "rep/json")).count() == 2


SITE = """
node_id: N1
cameras:
  - {id: C1, name: North, source: "rtsp://x/1", fps: 12, capabilities: {thermal: false}}
  - {id: C2, name: East, source: "rtsp://x/2", fps: 10, capabilities: {thermal: true}, zones: [{zone_id: Z2, kind: line, points: [[0, 0], [1, 1]]}]}
zones:
  - {id: Z1, name: Approach, camera_id: C1, polygon: [[100, 200], [500, 200], [500, 600]]}
patrols:
  - {id: P1, name: Walk, schedule: "06:00-07:00", path: [{camera_id: C2, direction: left_to_right}, {camera_id: C1}]}
  - {id: P2, name: Night, cameras: [C1], windows: [{days: [mon, Fri], start: "22:30", end: "01:15", tolerance_min: 45}, {time: "10:00-12:00"}], plates: [A1], active: false}
"""


def test_site_file_with_patrols(spark, tmp_path):
    (tmp_path / "site.yaml").write_text(SITE)
    site = FS.read_site(spark, f"file://{tmp_path}/site.yaml")
    cams = {r.camera_id: r for r in site["cameras"].collect()}
    assert (cams["C1"].sensor_type, cams["C2"].sensor_type, cams["C1"].node_id, cams["C2"].claimed_fps) == ("visible", "thermal", "N1", 10.0)
    zones = {r.zone_id: (r.camera_id, r.kind, len(r.points)) for r in site["zones"].collect()}
    assert zones == {"Z1": ("C1", "polygon", 3), "Z2": ("C2", "line", 2)}
    p = {r.patrol_id: r for r in site["patrols"].collect()}
    assert (p["P1"].cameras, [tuple(w) for w in p["P1"].windows], p["P1"].expected_heading) == (["C2", "C1"], [([], 360, 420, 20)], 0.0)
    assert [tuple(w) for w in p["P2"].windows] == [([0, 4], 1350, 75, 45), ([], 600, 720, 20)]
    assert (p["P2"].active, p["P2"].identity_enabled, p["P2"].plates, p["P2"].roster_pos) == (False, True, ["A1"], 2)
