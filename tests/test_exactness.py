"""Cases in which rounding or narrow constants once decided a result."""

import datetime as dt
import itertools
import random
import sys
from fractions import Fraction
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import compare  # noqa: E402
from landshift.functions import geo  # noqa: E402
from landshift.operators import embed as em, outlines, overlay, raster as rs, regions as rg, terrain as tr  # noqa: E402
from landshift.operators.overlay import INDICES  # noqa: E402
from landshift.plans import catalog, labels, raster  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, tmp_path):
    """Tables by name, written for both engines."""
    con = duckdb.connect()

    def write(**frames):
        for name, df in frames.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
            con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
        return con, str(tmp_path)

    return write


def touched(a, b, cell):
    """Whether an edge crosses the inside of a cell (x, y), in exact numbers."""
    first, last = Fraction(0), Fraction(1)
    for s, e, c in zip(a, b, cell):
        s, e = Fraction(s), Fraction(e)
        if s == e:
            if not c < s < c + 1:
                return False
            continue
        p, q = sorted(((c - s) / (e - s), (c + 1 - s) / (e - s)))
        first, last = max(first, p), min(last, q)
    return first < last


def test_ring_cells_at_corners_of_tall_rasters(spark):
    """An edge of a raster of 150,000 rows passes through corners of cells; a rounded slope once moved it into the next cell."""
    a, b = (30.0, 150000.0), (5.0, 90000.0)
    df = spark.createDataFrame([([a, b, a],)], "ring array<struct<x: double, y: double>>")
    near = {(150000 - 2400 * i + j, 30 - i + k) for i in range(26) for j in (-2, -1, 0, 1) for k in (-2, -1, 0, 1)}
    got = {(r.y, r.x) for r in tr.ring_cells(df).where(F.col("y").isin(sorted({y for y, _ in near}))).collect()}
    assert got & near == {(y, x) for y, x in near if touched(a, b, (x, y))}


def test_reliability_of_a_sum_on_the_limit(spark, tables):
    """0.85 less 0.12 and 0.08 is 0.65, but less in doubles if the penalties are added up first."""
    cents = next(n for n in range(850, 10**6, 1000) if n % 13 == 0)
    orders = spark.createDataFrame([(1, 1, cents / 100, "4-LOW", dt.datetime(1995, 1, 1))],
                                   "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string, o_orderdate timestamp_ntz")
    con, d = tables(orders=orders, customer=spark.createDataFrame([(1, "MACHINERY")], "c_custkey bigint, c_mktsegment string"))
    assert [r.reliability for r in catalog.QUERIES["scored_changes"](spark, d).collect()] == ["medium"]
    for name in ("scored_changes", "scored_summary"):
        assert compare.compare(spark, con, name, d).startswith("ok")


def test_block_numbers_beyond_five_digits(spark, tables):
    events = spark.createDataFrame([(i, "view", dt.datetime(2024, 1, 5), 1.0, u, "{}") for i, u in ((7, 3), (99999, 1499), (100000, 12), (1234567, 123456))],
                                   "event_id bigint, event_type string, ts timestamp_ntz, value double, user_id bigint, props string")
    con, d = tables(events=events)
    assert compare.compare(spark, con, "tag_roundtrip", d).startswith("ok")
    assert {r.block_seq for r in catalog.QUERIES["tag_roundtrip"](spark, d).collect()} == {"00007", "99999", "100000", "1234567"}


def test_outlines_hold_all_rings_of_a_region(spark):
    runs = {(r.after_scene, r.region): r["count"] for r in catalog.QUERIES["region_runs"](spark, SF).groupBy("after_scene", "region").count().collect()}
    got = catalog.QUERIES["region_outlines"](spark, SF).select(
        "after_scene", "region", "run_count", F.size(F.from_json("rings", "array<array<array<double>>>")).alias("rings")).collect()
    assert len(got) == len(runs) and max(runs.values()) > 1
    assert {(r.after_scene, r.region): r.rings for r in got} == runs == {(r.after_scene, r.region): r.run_count for r in got}


def test_mean_ambiguity_ignores_the_order_of_clusters(spark):
    """The exact mean, 0.940065, is a tie of the rounding."""
    scored = spark.createDataFrame([(1.0, 0.0)], "fraction double, anomaly double")
    for values in list(itertools.permutations((0.919885, 0.954004, 0.927106, 0.943963, 0.955367)))[::30]:
        profile = spark.createDataFrame([(v, 0.5) for v in values], "mix_entropy double, dominant_share double").coalesce(1)
        assert em.track_metrics(scored, profile).first().mean_ambiguity == 0.94007


def test_sweep_in_many_tasks_finds_each_touching_pair_once(spark, monkeypatch):
    """Runs with equal starts, ends and many neighbours; the number of tasks follows the number of runs."""
    rng = random.Random(4)
    cells = {(s, y, x): rng.choice((1, 1, 1, 2)) for s in (0, 1) for y in range(12) for x in range(30) if rng.random() < 0.8}
    px = spark.createDataFrame([(*k, v) for k, v in cells.items()], "scene int, y bigint, x int, v int")
    monkeypatch.setattr(rg, "RUNS_PER_TASK", 20)
    runs = rg.pixel_runs(px, "scene", "v").persist()
    rows = runs.collect()
    want = sorted((r.scene, r.node, q.node) for r in rows for q in rows
                  if (q.scene, q.v, q.y) == (r.scene, r.v, r.y + 1) and q.x0 <= r.x1 and r.x0 <= q.x1)
    edges = rg.run_edges(runs, "scene", "v")
    assert sorted(map(tuple, edges.collect())) == want
    assert edges.rdd.getNumPartitions() == 1 + len(rows) // 20


def test_outline_and_label_tasks_follow_the_runs(spark, monkeypatch):
    """Ends of runs, links and labels go into tasks by their number; rings stay the same, however many there are."""
    rng = random.Random(5)
    cells = [(s, y, x, rng.choice((1, 1, 1, 2))) for s in (0, 1) for y in range(12) for x in range(30) if rng.random() < 0.8]
    px = spark.createDataFrame(cells, "scene int, y bigint, x int, v int")
    one = rg.label_runs(px, "scene", "v").persist()
    want = sorted(map(str, outlines.region_rings(one, "scene").collect()))
    monkeypatch.setattr(rg, "RUNS_PER_TASK", 20)
    runs = rg.label_runs(px, "scene", "v")
    assert runs.rdd.getNumPartitions() == 1 + one.count() // 20
    assert outlines.boundary_links(one, "scene").rdd.getNumPartitions() == 1 + 2 * one.count() // 20
    steps = outlines.ring_order(outlines.boundary_links(one, "scene").persist(), "scene")
    assert steps.rdd.getNumPartitions() > 1
    assert sorted(map(str, outlines.region_rings(runs.persist(), "scene").collect())) == want


def test_classifier_stages_only_what_is_read(spark, monkeypatch):
    sf, staged = "/root/testdata/sf0.001", []

    def keeping(df):
        staged.append(df.columns)
        return df

    want = sorted(map(tuple, raster.pixel_classifier(spark, sf).collect()))
    monkeypatch.setattr(raster, "cut_lineage", keeping, raising=False)
    monkeypatch.setattr(raster, "store", keeping, raising=False)
    assert sorted(map(tuple, raster.pixel_classifier(spark, sf).collect())) == want and len(want) == 5
    assert staged == [[*INDICES, "truth", "trainable"]]


def test_nearest_centroids_are_compiled(spark):
    """Squares are written out, so that no function over arrays is interpreted per pixel; nodata stays 0."""
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 3.5]), (3, None), (4, [1.5, 2.0]), (5, [None, 1.0])], "id int, v array<double>")
    out = em.assign_clusters(df, "v", [[0.0, 1.0], [3.0, 3.0], [0.0, 1.0]])
    assert [(r.id, r.cluster, r.center_distance) for r in out.orderBy("id").collect()] == [
        (1, 1, 0.0), (2, 2, 0.5), (3, 0, None), (4, 1, 3.25**0.5), (5, 0, None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "zip_with" not in plan


def test_filter_on_long_expressions_stays_behind_them(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(50)], "id int, a double").withColumn("b", F.col("a") * F.col("a") + F.col("a"))
    df = df.withColumn("c", F.col("b") * F.col("b") + F.col("b"))
    kept = overlay.keep_where(df, F.when(F.col("c") > 40, F.col("c")) > 50, ["id", "c"])
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.where("c > 50").select("id", "c").collect()))
    filters = [line for line in kept._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line]
    assert not any("* a#" in line for line in filters)


def test_soft_scores_are_summed_once_and_compiled(spark):
    px = spark.createDataFrame([(1, 0.3, -0.1, 0.2, 1.5), (2, None, 0.1, 0.2, 1.0)], "id int, ndvi double, ndwi double, ndbi double, ratio double")
    out = labels.soft(px)
    one, none = out.orderBy("id").collect()
    assert abs(sum(one.probs) - 1) < 1e-12 and none.probs is None and (none.dominant, none.max_probability) == (0, None)
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_features_meet_their_cells_in_compiled_tasks_of_bounded_size(spark, monkeypatch):
    """Against the tests of whole rings and lines; two features share an id, which must not cancel what they fill."""
    monkeypatch.setattr(rs, "CELLS_PER_TASK", 100, raising=False)
    rng = random.Random(7)

    def shape(i, kind):
        points = [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(rng.randint(3, 6))]
        return i, i % 5 + 1, kind, points + points[:1] if kind == "polygon" else points

    same = [(50, 2, "polygon", [(20.0, 20.0), (24.0, 20.0), (24.0, 24.0), (20.0, 24.0), (20.0, 20.0)])] * 2
    rows = [shape(i, kind) for i, kind in enumerate(("polygon", "line") * 6)] + same
    shapes = spark.createDataFrame(rows, "id bigint, class_id int, shape string, points array<struct<x:double,y:double>>")
    got = rs.rasterize(shapes, 0.8, block=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "exists(" not in plan and "hashpartitioning(id" in plan
    assert int(plan.split("hashpartitioning(id")[1].split("REPARTITION_BY_NUM")[0].split(")")[0].split(",")[-1]) > 4
    grid = shapes.crossJoin(spark.range(-3, 27).select(F.col("id").alias("y"))).crossJoin(spark.range(-3, 27).select(F.col("id").alias("x")))
    cx, cy = F.col("x").cast("double"), F.col("y").cast("double")
    ring = geo.point_in_ring(cx + 0.5, cy + 0.5, F.col("points")) | geo.any_segment(
        F.col("points"), lambda a, b: geo.segment_hits_cell(a["x"], a["y"], b["x"], b["y"], cx, cy))
    line = geo.any_segment(F.col("points"), lambda a, b: geo.segment_cell_distance(a["x"], a["y"], b["x"], b["y"], cx, cy) <= 0.8)
    want = grid.where(F.when(F.col("shape") == "polygon", ring).otherwise(line)).groupBy("y", "x").agg(
        F.max_by("class_id", "id").alias("class_id"), F.max("id").alias("feature_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
