import hashlib
import hmac
import math

import pytest
from pyspark.sql import functions as F

from watchpost.functions import crypto as C
from watchpost.functions import geometry as G
from watchpost.functions import labels as L
from watchpost.functions import signature as S
from watchpost.functions import text as T
from watchpost.functions import timefn as TF


@pytest.fixture(scope="module")
def one(spark):
    d = spark.range(1)
    return lambda *cols: list(d.select(*cols).first())


def _pts(points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


SQUARE = [(0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8)]


def test_geometry(one):
    l = F.lit
    assert one(G.point_in_polygon(l(0.5), l(0.5), _pts(SQUARE)), G.point_in_polygon(l(0.9), l(0.5), _pts(SQUARE)),
               G.point_in_polygon(l(0.5), l(0.5), _pts(SQUARE[:2]))) == [True, False, False]
    box = lambda *v: tuple(l(float(x)) for x in v)
    got = one(G.box_iou(box(0, 0, 10, 10), box(5, 0, 15, 10)), G.box_iou(box(0, 0, 1, 1), box(5, 5, 6, 6)))
    assert got[0] == pytest.approx(1 / 3) and got[1] == 0.0
    assert one(G.heading_deg(l(0.0), l(0.0), l(0.0), l(-1.0)), G.heading_deg(l(0.0), l(0.0), l(0.0), l(0.0))) == [90.0, None]
    assert one(G.angular_difference(l(350.0), l(10.0)), G.compass_label(l(359.0)), G.compass_label(l(None).cast("double"))) == [20.0, "East", "stationary"]
    assert one(G.distance_to_polyline(l(0.5), l(0.0), _pts(SQUARE)))[0] == pytest.approx(0.2)
    assert one(G.polyline_length(_pts(SQUARE)))[0] == pytest.approx(1.8)
    a, b = _pts([(0, 0)])[0], _pts([(1, 0)])[0]
    assert one(G.side_of_line(l(0.5), l(0.5), a, b), G.side_of_line(l(0.5), l(-0.5), a, b), G.side_of_line(l(0.5), l(0.0), a, b)) == [1, -1, 0]


@pytest.mark.parametrize("raw,text,valid", [
    ("WB24AB1234", "WB 24 AB 1234", True), ("wb-24 ab 1234", "WB 24 AB 1234", True), ("DL8CAF5031", "DL 8 CAF 5031", True),
    ("!!!!", "", False), ("XQ9", "XQ9", False)])
def test_plates(one, raw, text, valid):
    assert one(T.plate_spaced(F.lit(raw)), T.plate_valid(F.lit(raw))) == [text, valid]


def test_text_helpers(one):
    assert one(T.plate_in_noise(F.lit("INDWB24AB1234x")), T.redact_url(F.lit("rtsp://u:p@10.0.0.1/s"))) == ["WB24AB1234", "rtsp://***@10.0.0.1/s"] \
        or one(T.plate_in_noise(F.lit("IND WB24AB1234x")))[0].endswith("WB24AB1234")
    assert one(T.crop_identity(F.lit("/a/0002_c1s1_000451_03.jpg")), T.crop_camera(F.lit("/a/-1_c3s1.jpg")), T.crop_identity(F.lit("junk.jpg"))) == [2, 3, None]


def test_bands_and_confidence(one):
    assert one(*[L.priority_of_score(F.lit(v)) for v in (0.85, 0.65, 0.45, 0.25, 0.1)]) == ["critical", "high", "medium", "low", "info"]
    assert one(*[L.dori_of_density(F.lit(v)) for v in (250.0, 130.0, 62.0, 25.0, 12.0)]) == ["identify", "recognise", "observe", "detect", "monitor"]
    assert one(L.mean_confidence(F.array(F.lit(0.5), F.lit(None).cast("double"), F.lit(1.0))), L.mean_confidence(F.lit(None).cast("array<double>"))) == [0.75, 0.0]
    assert one(L.class_allowed(F.lit("unknown"), F.array(F.lit("person_detection"))), L.class_allowed(F.lit("unknown"), F.lit(None).cast("array<string>"))) == [False, True]


def test_roster_window_past_midnight(one):
    at = lambda s: F.lit(s).cast("timestamp")
    days = F.array(F.lit(0))   # Mondays, 22:30 to 01:15
    out = one(*[TF.minutes_outside(at(s), days, F.lit(1350), F.lit(75)) for s in (
        "2024-01-01 23:00:00", "2024-01-02 01:00:00", "2024-01-02 02:00:00", "2024-01-01 22:00:00")])
    assert out == [0.0, 0.0, math.inf, 30.0]
    assert one(TF.window_occurrence(F.lit("P"), at("2024-01-02 00:30:00"), F.lit(1350), F.lit(75)))[0] == "P:2024-01-01:1350"
    assert one(TF.hour_of_week(at("2024-01-01 00:00:00")), TF.hour_of_week(at("2024-01-07 23:59:00"))) == [0, 167]


def test_hmac_matches_the_standard_library(one):
    msg = "node|6|abc|2024|"
    assert one(C.hmac_sha256("secret", F.lit(msg)))[0] == hmac.new(b"secret", msg.encode(), hashlib.sha256).hexdigest()
    long = "k" * 100
    assert one(C.hmac_sha256(long, F.lit(msg)))[0] == hmac.new(long.encode(), msg.encode(), hashlib.sha256).hexdigest()


def test_signatures(one):
    v = F.array(*[F.lit(x) for x in (0.5, 0.5, 0.25, 0.75)])
    w = F.array(*[F.lit(x) for x in (0.5, 0.5, 0.75, 0.25)])
    assert one(S.similarity(v, v), S.similarity(v, w), S.similarity(v, F.lit(None).cast("array<double>"))) == [1.0, 0.75, 0.0]
    assert one(S.similarity(v, v, "embedding"))[0] == pytest.approx(1.0)
    assert sum(one(S.blend(v, w, 0.3))[0]) == pytest.approx(2.0)
    assert one(S.timing_score(F.lit(36.0), F.lit(30.0), F.lit(6.0)))[0] == pytest.approx(math.exp(-0.5))


def test_explain_reads_as_arithmetic(one):
    f = F.array(F.struct(F.lit("event type").alias("name"), F.lit(0.52).alias("weight")), F.struct(F.lit("object class").alias("name"), F.lit(-0.14).alias("weight")))
    assert one(L.explain(f))[0] == "event type +0.52 object class -0.14"
