import math

import pytest
from pyspark.sql import functions as F

from landshift.config import ChangeThresholds
from landshift.functions import bands, change as ch, geo, labels as lb, model as md
from landshift.operators import scenes as sc
from landshift.operators.patches import split_for_sequence
from landshift.config import PatchPolicy

C = F.col


def one(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_change_classes_follow_rule_order(spark):
    t = ChangeThresholds(-0.18, 0.12, 0.18, 0.15)
    rows = [(-0.2, 0.0, 0.0, 0.0), (-0.2, 0.2, 0.0, 0.0), (0.0, 0.0, 0.3, 0.0), (0.0, 0.0, 0.0, 0.2), (None, 0.2, 0.3, 0.2)]
    got = one(spark, rows, "a double, b double, c double, d double", ch.classify_change(C("a"), C("b"), C("c"), C("d"), t))
    assert [g[0] for g in got] == [1, 2, 3, 4, 0]


def test_nodata_never_classifies(spark):
    rows = [(float("nan"),), (float("inf"),), (-9999.0,), (0.5,)]
    got = one(spark, rows, "v double", bands.finite(C("v")), ch.landcover_state(bands.finite(C("v")), F.lit(0.0), F.lit(0.3)))
    assert got == [(None, "unknown")] * 3 + [(0.5, "water_moisture")]


def test_index_denominators(spark):
    got = one(spark, [(2.0, 1.0), (1.0, -1.0), (1.0, 0.0)], "a double, b double",
              bands.normalized_difference(C("a"), C("b")), bands.safe_ratio(C("a"), C("b")))
    assert got[0] == (pytest.approx(1 / 3), 2.0)
    assert got[1][0] is None
    assert got[2][1] is None


def test_landcover_states(spark):
    rows = [(0.65, 0.05, -0.1), (0.1, 0.2, -0.1), (0.1, -0.1, 0.25), (0.1, 0.0, -0.1), (None, 0.0, 0.0), (0.3, 0.05, 0.0)]
    got = one(spark, rows, "a double, b double, c double", ch.landcover_state(C("a"), C("b"), C("c")))
    assert [g[0] for g in got] == ["vegetation", "built_up", "water_moisture", "bare_sparse", "unknown", "mixed"]


def test_magnitude_skips_missing(spark):
    rows = [(-0.3, 0.2, 0.1, 0.4), (None, None, None, None), (None, 0.3, None, None)]
    got = one(spark, rows, "a double, b double, c double, d double", ch.change_magnitude(C("a"), C("b"), C("c"), C("d")))
    assert got[0][0] == pytest.approx(math.sqrt(0.075))
    assert got[1][0] is None and got[2][0] == pytest.approx(0.3)


def test_group_adjustment_and_labels(spark):
    rows = [("vegetation_loss", "vegetation", "mixed"), ("built_up_gain", "bare_sparse", "built_up"),
            ("moisture_change", "mixed", "water_moisture"), ("radar_change", "mixed", "mixed"), ("radar_change", "unknown", "built_up")]
    got = one(spark, rows, "k string, b string, a string", ch.monitored_land_cover(C("k"), C("b"), C("a")))
    assert [g[0] for g in got] == ["vegetation", "built_up", "water_moisture", "mixed", "built_up"]
    adj = one(spark, [("radar_change", "mixed", "mixed", "mixed")], "k string, g string, b string, a string",
              ch.confidence_adjustment(C("k"), C("g"), C("b"), C("a")))
    assert adj[0][0] == pytest.approx(-0.25)
    rel = one(spark, [(0.9,), (0.85,), (0.7,), (0.65,), (0.4,)], "s double", ch.reliability_label(C("s")))
    assert [r[0] for r in rel] == ["high", "high", "medium", "medium", "low"]
    tr = one(spark, [("a_to_b",), ("odd",)], "t string", ch.transition_before(C("t")), ch.transition_after(C("t")))
    assert tr == [("a", "b"), ("unknown", "unknown")]


def test_soft_probabilities_sum_to_one(spark):
    rows = [(0.6, -0.5, -0.2, 1.0), (-0.3, 0.4, 0.1, 5.0), (None, 0.1, 0.1, 1.0)]
    p = lb.soft_probabilities(C("a"), C("b"), C("c"), C("d"))
    got = one(spark, rows, "a double, b double, c double, d double", p, lb.argmax_class(p))
    assert sum(got[0][0]) == pytest.approx(1) and sum(got[1][0]) == pytest.approx(1)
    assert got[0][1] == 3 and got[1][1] == 5 and got[2] == (None, 0)


def test_tag_classes_and_remap(spark):
    rows = [({"building": "yes", "landuse": "forest"},), ({"landuse": "Forest"},), ({"landuse": "quarry"},), ({"natural": "wood"},)]
    got = one(spark, rows, "t map<string,string>", lb.tag_class(C("t")))
    assert [g[0] for g in got] == [1, 3, 4, None]
    got = one(spark, [(1,), (3,), (6,), (9,)], "c int", lb.harmonized_to_model(C("c")))
    assert [g[0] for g in got] == [1, 2, 5, 0]


def test_entropy_and_dominant(spark):
    got = one(spark, [([0.2] * 5,), ([1.0, 0.0, 0.0, 0.0, 0.0],)], "p array<double>", md.predictive_entropy(C("p"), 5))
    assert got[0][0] == pytest.approx(1) and got[1][0] == pytest.approx(0, abs=1e-4)
    rows = [({2: 5, 1: 5, 3: 1},), ({4: 2},)]
    best = md.dominant_entry(C("h"))
    got = one(spark, rows, "h map<int,bigint>", best["class_id"], best["count"], md.histogram_entropy(F.map_values("h")))
    assert got[0][:2] == (1, 5) and got[1] == (4, 2, 0.0)


def test_review_zone_last_rule_wins(spark):
    rows = [(0.5, 0.7, True), (0.5, 0.7, False), (0.5, 0.1, False), (0.9, 0.1, False), (None, 0.9, True)]
    got = one(spark, rows, "c double, e double, d boolean", md.review_zone(C("c"), C("e"), C("d")))
    assert [g[0] for g in got] == [3, 2, 1, 0, 0]


def test_split_policy_and_tags(spark):
    got = one(spark, [(0,), (6,), (9,)], "s bigint", split_for_sequence(C("s"), PatchPolicy()))
    assert [g[0] for g in got] == ["train", "validation", "test"]
    got = one(spark, [("scene_20250102_x",), ("scene_2025_x",)], "t string", sc.tag_day(C("t"), 1).cast("string"))
    assert [g[0] for g in got] == ["2025-01-02", None]


def test_projection_hits_published_corners(spark):
    # fixed values: corners of the area of interest and their grid positions
    rows = [(830650.0, 9794800.0, 29.971674588098654, -1.8539907197602912), (850740.0, 9794800.0, 30.15205257721712, -1.8536766484566063),
            (850740.0, 9774830.0, 30.152387520306693, -2.034074211175956), (830650.0, 9774830.0, 29.9719904347848, -2.0344188710956463)]
    lon, lat = geo.utm_to_lonlat(C("x"), C("y"))
    x, y = geo.lonlat_to_utm(C("lon"), C("lat"))
    for (a, b, u, v), (ex, ey, elon, elat) in zip(
        one(spark, rows, "x double, y double, lon double, lat double", lon, lat, x, y), rows, strict=True
    ):
        assert abs(a - elon) < 1e-8 and abs(b - elat) < 1e-8
        assert abs(u - ex) < 1e-3 and abs(v - ey) < 1e-3


def test_point_in_ring(spark):
    ring = "array(named_struct('x',0D,'y',0D), named_struct('x',4D,'y',0D), named_struct('x',4D,'y',4D), named_struct('x',2D,'y',1D), named_struct('x',0D,'y',4D), named_struct('x',0D,'y',0D))"
    rows = [(1.0, 0.5), (2.0, 3.0), (3.9, 3.0), (5.0, 1.0)]
    got = one(spark, rows, "x double, y double", geo.point_in_ring(C("x"), C("y"), F.expr(ring)))
    assert [g[0] for g in got] == [True, False, True, False]
