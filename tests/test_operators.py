import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landshift.config import SceneSearch
from landshift.operators import audit as au, embed as em, experiments as ex, fits, outlines, overlay, patches as pt, quantiles, ranking, raster as rs, regions as rg, review as rv, scenes as sc, terrain as tr, votes
from landshift.sources.sinks import upsert_scenes


def label_grid(spark, grid, partitions=4):
    rows = [(1, r, c, v) for r, line in enumerate(grid) for c, v in enumerate(line) if v]
    df = spark.createDataFrame(rows, "layer int, y bigint, x int, v int").repartition(partitions)
    return {(r.y, r.x): r.region for r in rg.label_regions(df, "layer", "v").collect()}


def flood(grid):
    out, seen = [], set()
    for r, line in enumerate(grid):
        for c, v in enumerate(line):
            if not v or (r, c) in seen:
                continue
            stack, comp = [(r, c)], set()
            while stack:
                a, b = stack.pop()
                if (a, b) in comp or not (0 <= a < len(grid) and 0 <= b < len(grid[0])) or grid[a][b] != v:
                    continue
                comp.add((a, b))
                stack += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
            seen |= comp
            out.append(frozenset(comp))
    return set(out)


def as_sets(labels):
    by = {}
    for k, v in labels.items():
        by.setdefault(v, set()).add(k)
    return {frozenset(s) for s in by.values()}


def test_components_snake_and_diagonal(spark):
    snake = [[1] * 9 if r % 2 == 0 else ([0] * 8 + [1] if r % 4 == 1 else [1] + [0] * 8) for r in range(9)]
    assert len(as_sets(label_grid(spark, snake))) == 1
    assert len(as_sets(label_grid(spark, [[1, 0], [0, 1]]))) == 2


def test_components_match_flood_fill_for_any_partitioning(spark):
    rng = random.Random(3)
    grid = [[rng.choice([0, 1, 1, 2]) for _ in range(14)] for _ in range(12)]
    want = flood(grid)
    assert as_sets(label_grid(spark, grid, 1)) == want
    assert as_sets(label_grid(spark, grid, 7)) == want


def test_row_numbers_spread_hot_group(spark):
    rows = [("hot" if i % 3 else "cold", (i * 7919) % 50, i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v int, id int")
    got = ranking.row_numbers(df, ["k"], [F.col("v").desc(), "id"], "rn").collect()
    want = {}
    for k in ("hot", "cold"):
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2])), 1):
            want[r[2]] = n
    assert {r.id: r.rn for r in got} == want


def test_exact_quantiles_with_a_dominant_value(spark):
    vals = [0.0] * 500 + [float(i) / 7 for i in range(1, 998)]
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "v double").repartition(5)
    got = quantiles.exact_quantiles(df, "v", [0.02, 0.05, 0.5, 0.95, 1.0]).first()["q"]
    assert got == pytest.approx(np.percentile(vals, [2, 5, 50, 95, 100]).tolist())


def test_capped_strata_equals_greedy_selection(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), round(rng.random(), 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, s string, score double")
    got = [r.id for r in ranking.capped_strata(df, ["s"], [F.col("score").desc(), F.col("id")], 5, 12).orderBy("sample_rank").collect()]
    taken, counts = [], {}
    for i, s, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        if counts.get(s, 0) < 5:
            counts[s] = counts.get(s, 0) + 1
            taken.append(i)
        if len(taken) == 12:
            break
    assert got == taken


def test_sampling_ignores_partitioning(spark):
    df = spark.range(500)
    a = sorted(r.id for r in ranking.hash_sample(df.repartition(1), "id", 40, 9).collect())
    b = sorted(r.id for r in ranking.hash_sample(df.repartition(7), "id", 40, 9).collect())
    assert a == b and len(a) == 40


def test_oversample_expectation(spark):
    df = spark.createDataFrame([(i, 3.0 if i < 10 else 1.0) for i in range(200)], "id int, w double")
    rows = pt.oversample(df, "id", "w", 2.0, 5).collect()
    assert abs(sum(r.copies for r in rows) - 400) < 40
    assert all(r.copies in (5, 6) for r in rows if r.id < 10)


def test_nearest_radar_matches_search(spark):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    radar = [(i, start + dt.timedelta(minutes=rng.randrange(0, 20 * 1440)), rng.choice(["ascending", "descending"]),
              ["VV"] if rng.random() < 0.2 else ["VV", "VH"]) for i in range(60)]
    days = [(start.date() + dt.timedelta(days=i),) for i in range(0, 20, 3)]
    r = spark.createDataFrame(radar, "id bigint, acquired_at timestamp_ntz, orbit string, polarizations array<string>").withColumn("day", F.to_date("acquired_at"))
    s = SceneSearch(("T0",), radar_days=2)
    got = {x.day: x.radar_id for x in sc.nearest_radar(spark.createDataFrame(days, "day date"), r, s, 30.0).collect()}
    want = {}
    for (day,) in days:
        mid = dt.datetime.combine(day, dt.time())
        cand = []
        for i, t, orbit, pol in radar:
            off = (t.date() - day).days
            gap = abs((t - mid).total_seconds())
            if abs(off) <= 2 and len(pol) == 2 and gap <= 30 * 3600:
                cand.append((orbit != "ascending", gap, abs(off), off, i))
        if cand:
            want[day] = min(cand)[-1]
    assert got == want


def test_upsert_changes_only_mutable_columns(spark):
    schema = "id int, collection string, cloud_cover double, assets string, properties string"
    old = spark.createDataFrame([(1, "a", 5.0, "x", "p"), (2, "b", 6.0, "y", "q")], schema)
    new = spark.createDataFrame([(2, "CHANGED", None, "z", "r"), (3, "c", 7.0, "w", "s")], schema)
    got = {r.id: tuple(r)[1:] for r in upsert_scenes(old, new).collect()}
    assert got == {1: ("a", 5.0, "x", "p"), 2: ("b", None, "z", "r"), 3: ("c", 7.0, "w", "s")}


def test_comparison_does_not_bridge_gaps(spark):
    rows = [(0, 0, 0, 0.1), (1, 0, 0, 0.3), (0, 0, 1, 0.1), (2, 0, 1, 0.9)]
    f = spark.createDataFrame(rows, "scene int, y bigint, x int, ndvi double")
    got = overlay.compare_scenes(f, overlay.consecutive_pairs(f), ["ndvi"]).collect()
    assert [(r.before_scene, r.after_scene, r.x) for r in got] == [(0, 1, 0)]


def test_terrain_matches_dense_arrays(spark):
    rng = np.random.default_rng(2)
    z = np.round(rng.normal(size=(6, 7)) * 50, 3)
    rows = [(r, c, float(z[r, c])) for r in range(6) for c in range(7)]
    df = spark.createDataFrame(rows, "y bigint, x int, elevation double")
    got = tr.terrain_derivatives(df, F.lit(6), F.lit(7)).collect()
    gy, gx = np.gradient(z, 10.0, 10.0)
    slope = np.degrees(np.arctan(np.hypot(gx, gy)))
    p = np.pad(z, 1, mode="edge")
    w = np.stack([p[i:i + 6, j:j + 7] for i in range(3) for j in range(3)])
    for r in got:
        assert r.slope == pytest.approx(slope[r.y, r.x], abs=1e-9)
        assert r.ruggedness == pytest.approx(np.abs(w[:, r.y, r.x] - z[r.y, r.x]).max(), abs=1e-9)
        assert r.tpi == pytest.approx(z[r.y, r.x] - w[:, r.y, r.x].mean(), abs=1e-6)


def test_rasterize_matches_dense_sampling(spark):
    rng = random.Random(11)
    shapes = []
    for i in range(12):
        x, y = rng.uniform(0, 8), rng.uniform(0, 8)
        if i % 3 == 0:
            pts = [(x, y), (x + rng.uniform(-3, 3), y + rng.uniform(-3, 3))]
            shapes.append((i, i % 6 + 1, "line", pts))
        else:
            pts = [(x, y), (x + rng.uniform(1, 4), y + rng.uniform(-1, 1)), (x + rng.uniform(0, 2), y + rng.uniform(1, 4)), (x, y)]
            shapes.append((i, i % 6 + 1, "polygon", pts))
    df = spark.createDataFrame([(i, c, s, [{"x": a, "y": b} for a, b in p]) for i, c, s, p in shapes],
                               "id bigint, class_id int, shape string, points array<struct<x:double,y:double>>")
    got = {(r.y, r.x): r.feature_id for r in rs.rasterize(df, 0.8, block=4).collect()}

    def inside(px, py, ring):
        hit = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
                hit = not hit
        return hit

    def dist(px, py, path):
        best = 9e9
        for (ax, ay), (bx, by) in zip(path, path[1:]):
            dx, dy = bx - ax, by - ay
            t = max(0, min(1, ((px - ax) * dx + (py - ay) * dy) / (dx * dx + dy * dy)))
            best = min(best, ((px - ax - t * dx) ** 2 + (py - ay - t * dy) ** 2) ** 0.5)
        return best

    n = 24
    sure = {}
    for cy in range(-6, 18):
        for cx in range(-6, 18):
            for i, _, s, p in shapes:
                if any((inside(cx + (a + 0.5) / n, cy + (b + 0.5) / n, p) if s == "polygon" else dist(cx + (a + 0.5) / n, cy + (b + 0.5) / n, p) <= 0.8)
                       for a in range(n) for b in range(n)):
                    sure[(cy, cx)] = i
    # every cell the dense samples find is burnt with the same or a later feature; extra cells are slivers only
    assert all(got.get(k, -1) >= v for k, v in sure.items())
    assert sum(1 for k in got if k not in sure) <= 0.05 * len(got)


def test_overlap_with_stride_equal_to_window_is_identity(spark):
    px = spark.createDataFrame([(0, y, x) for y in range(9) for x in range(9)], "scene int, y bigint, x int")
    assert rs.covering_windows(px, 4, 4).groupBy("y", "x").count().where("count <> 1").isEmpty()
    got = {(r.y, r.x): r["count"] for r in rs.covering_windows(px, 4, 2).groupBy("y", "x").count().collect()}
    assert got[(0, 0)] == 1 and got[(2, 2)] == 4 and got[(2, 0)] == 2


def test_vote_ignores_source_order(spark):
    rng = random.Random(4)
    rows = [tuple(rng.randrange(0, 7) for _ in range(4)) for _ in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    cols = ["mode_label", "mode_count", "agreement", "disagreement", "source_count"]
    one = [tuple(r) for r in votes.majority_vote(df, ["a", "b", "c", "d"]).select(*cols).collect()]
    two = [tuple(r) for r in votes.majority_vote(df, ["d", "b", "a", "c"]).select(*cols).collect()]
    assert one == two
    for r, (label, n, agreed, dis, total) in zip(rows, one, strict=True):
        used = [v for v in r if v]
        counts = {k: used.count(k) for k in used}
        best = max(counts.values(), default=0)
        want = min((k for k in counts if counts[k] == best), default=0)
        assert (label, n, total) == (want, best, len(used))
        assert agreed == (want if best >= 2 else 0) and dis == (len(used) >= 2 and best < len(used))


def test_silhouette_brute_force(spark):
    rng = np.random.default_rng(8)
    pts = np.concatenate([rng.normal(size=(20, 3)), rng.normal(size=(15, 3)) + 4])
    lab = [1] * 20 + [2] * 15
    df = spark.createDataFrame([(i, p.tolist(), k) for i, (p, k) in enumerate(zip(pts, lab, strict=True))], "id int, v array<double>, c int")
    got = em.silhouette(df, "id", "v", "c", 100, 1).first()["silhouette"]
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    lab = np.array(lab)
    s = []
    for i in range(35):
        a = d[i, lab == lab[i]].sum() / ((lab == lab[i]).sum() - 1)
        b = d[i, lab != lab[i]].mean()
        s.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(s), abs=1e-5)


def test_resampling_at_scale_one_is_identity(spark):
    rows = [(y, x, round(float((y * 13 + x * 7) % 11), 3)) for y in range(5) for x in range(6)]
    df = spark.createDataFrame(rows, "y bigint, x int, v double")
    for fn in (rs.resample_nearest, rs.resample_bilinear):
        got = {(r.ty, r.tx): r.v for r in fn(df, "v", 1.0, F.lit(5), F.lit(6)).collect()}
        assert got == {(y, x): v for y, x, v in rows}


def test_box_search_looks_at_both_axes(spark):
    rows = [(1, 0, 0), (2, 0, 90), (3, 90, 0), (4, 40, 40)]
    df = spark.createDataFrame(rows, "id int, x0 int, y0 int").withColumns({
        "collection": F.lit("optical"), "day": F.to_date(F.lit("2024-01-01")), "cloud_cover": F.lit(1.0)})
    found = sc.search(df, "optical", (5.0, 5.0, 45.0, 45.0), "2024-01-01", "2024-01-01", 2.0)
    assert {r.id for r in found.collect()} == {1, 4}


def test_missing_scenes_are_named_in_order(spark):
    wanted = spark.createDataFrame([(0, 7), (1, 1), (2, 9)], "position int, id int")
    have = spark.createDataFrame([(1, "optical", "T0")], "id int, collection string, tile string")
    with pytest.raises(LookupError, match="7, 9"):
        sc.require_all(wanted, have)
    assert [r.id for r in sc.require_all(wanted.where("id = 1"), have).collect()] == [1]


def test_quotas_add_up():
    assert rv.largest_remainders(150, {"a": 0.35, "b": 0.35, "c": 0.3}) == {"a": 53, "b": 52, "c": 45}
    assert sum(rv.largest_remainders(7, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}).values()) == 7


def test_modal_label_bounds(spark):
    one = spark.createDataFrame([(0, 0, 70000)], "y int, x int, label int").withColumn("day", F.to_date(F.lit("2024-01-01")))
    with pytest.raises(ValueError):
        votes.modal_label(one, "2025-01-01", "2025-02-01")
    with pytest.raises(Exception, match="label out of range"):
        votes.modal_label(one, "2024-01-01", "2024-02-01").collect()


def test_gate_holds_without_a_temporal_report(spark):
    ok = spark.createDataFrame([("passed",)], "status string")
    none = spark.createDataFrame([], "mean_consensus double, unstable_fraction double")
    rel = spark.createDataFrame([(0.9, 0.9, 0.1)], "mean_confidence double, mean_compatible_fraction double, mean_review_fraction double")
    r = au.publish_gate(ok, none, rel).first()
    assert r.temporal_status == "missing" and r.recommendation.startswith("hold")


def trace(cells):
    """Closed rings of a set of pixels, walked side by side: interior to the right, left turns where two pixels meet at a corner only."""
    step = [(1, 0), (0, 1), (-1, 0), (0, -1)]
    sides = {}
    for y, x in cells:
        for d, (start, other) in enumerate([((x, y), (y - 1, x)), ((x + 1, y), (y, x + 1)), ((x + 1, y + 1), (y + 1, x)), ((x, y + 1), (y, x - 1))]):
            if other not in cells:
                sides[start, d] = (start[0] + step[d][0], start[1] + step[d][1])
    rings = []
    while sides:
        (start, d), corners = min(sides), []
        first = (start, d)
        while True:
            end = sides.pop((start, d))
            turn = next((t for t in (d + 3, d, d + 1) if (end, t % 4) in sides or (end, t % 4) == first)) % 4
            if turn != d:
                corners.append(end)
            start, d = end, turn
            if (start, d) == first:
                break
        rings.append(corners)
    return rings


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]])) / 2


def turned(ring):
    at = ring.index(min(ring))
    return tuple(ring[at:] + ring[:at])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rings_match_a_walk_around_each_region(spark, seed):
    """Random rasters with holes, nested regions and pixels that meet at corners."""
    rng = random.Random(seed)
    grid = [[rng.choice([0, 1, 1, 1, 2]) for _ in range(17)] for _ in range(15)]
    rows = [(1, r, c, v) for r, line in enumerate(grid) for c, v in enumerate(line) if v]
    runs = rg.label_runs(spark.createDataFrame(rows, "layer int, y bigint, x int, v int").repartition(5), "layer", "v")
    found = {}
    for r in outlines.ring_vertices(runs, "layer").orderBy("ring", "place").collect():
        found.setdefault(r.ring, []).extend([(r.x_first, r.line), (r.x_second, r.line)])
    want = [tuple(ring) for comp in flood(grid) for ring in trace(comp)]
    # the operator runs against the walk, so that outer rings are counterclockwise with north up
    assert sorted(turned(r) for r in found.values()) == sorted(turned(list(reversed(r))) for r in want)
    for r in found.values():
        assert len(set(r)) == len(r)  # no ring touches itself
    areas = {}
    for r in outlines.region_rings(runs, "layer").collect():
        assert r.hole == (r.pixel_area < 0) and len(r.coordinates) == r.corner_count + 1 and r.coordinates[0] == r.coordinates[-1]
        areas.setdefault(r.region, []).append(r.pixel_area)
    assert sorted(map(sum, areas.values())) == sorted(map(len, flood(grid)))
    assert all(sum(a > 0 for a in v) == 1 for v in areas.values())
    outer = [r for r in outlines.region_rings(runs, "layer").where("NOT hole").collect()]
    assert all(area([tuple(p) for p in r.coordinates[:-1]]) > 0 for r in outer)
    polygons = outlines.region_polygons(outlines.region_rings(runs, "layer"), "layer").collect()
    assert sorted(len(p.polygon) for p in polygons) == sorted(map(len, areas.values()))


def test_long_ring_and_empty_layer(spark):
    """A comb whose outline has hundreds of sides, and no pixels at all."""
    rows = [(1, y, x, 1) for y in range(60) for x in range(21) if y == 0 or x % 2 == 0]
    df = spark.createDataFrame(rows, "layer int, y bigint, x int, v int")
    runs = rg.label_runs(df, "layer", "v")
    ring = outlines.region_rings(runs, "layer").collect()
    assert len(ring) == 1 and ring[0].pixel_area == len(rows) and ring[0].corner_count == 44
    assert outlines.region_rings(rg.label_runs(df.limit(0), "layer", "v"), "layer").collect() == []


@pytest.mark.parametrize("side", [4, 64])
def test_shift_correlations_over_block_borders(spark, side):
    """Blocks smaller than the raster see what lies beyond their border; holes take no part."""
    rng = np.random.default_rng(4)
    base = rng.random((22, 19))
    base[rng.random(base.shape) < 0.1] = np.nan
    moved = np.roll(base, (2, -1), (0, 1)) + rng.random(base.shape) * 0.01

    def df(m):
        rows = [(r, c, None if np.isnan(m[r, c]) else float(m[r, c])) for r in range(m.shape[0]) for c in range(m.shape[1])]
        return spark.createDataFrame(rows, "y bigint, x int, v double").repartition(3)

    got = {(r.dy, r.dx): r for r in tr.shift_correlations(df(base), df(moved), "v", 3, 250, side).collect()}
    assert len(got) == 49
    for dy in range(-3, 4):
        for dx in range(-3, 4):
            pairs = [(base[r, c], moved[r - dy, c - dx]) for r in range(22) for c in range(19) if 0 <= r - dy < 22 and 0 <= c - dx < 19]
            pairs = np.array([p for p in pairs if not np.isnan(p).any()])
            assert got[dy, dx].samples == len(pairs)
            if len(pairs) >= 250:
                assert got[dy, dx].correlation == pytest.approx(np.corrcoef(pairs.T)[0, 1], abs=2e-8)
            else:
                assert got[dy, dx].correlation is None
    assert max((r for r in got.values() if r.correlation is not None), key=lambda r: r.correlation)[:2] == (-2, 1)


def test_shift_correlations_of_flat_rasters(spark):
    df = spark.createDataFrame([(y, x, 1.0) for y in range(6) for x in range(6)], "y bigint, x int, v double")
    assert all(r.correlation is None for r in tr.shift_correlations(df, df, "v", 1, 1).collect())
    assert tr.shift_correlations(df.limit(0), df, "v").collect() == []


def test_principal_axes_match_a_full_decomposition(spark):
    rng = np.random.default_rng(7)
    rows, want = [], {}
    for key in ("a", "b"):
        v = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6)) + 3
        rows += [(key, r.tolist()) for r in v] + [(key, None)]
        values, vectors = np.linalg.eigh(np.cov(v.T, bias=True))
        want[key] = values[::-1], vectors[:, ::-1].T
    got = fits.principal_axes(spark.createDataFrame(rows, "k string, v array<double>").repartition(5), "v", 6, 3, F.col("k")).collect()
    assert {r.key for r in got} == {"a", "b"}
    for r in got:
        values, vectors = want[r.key]
        assert r.n == 60 and r.explained == pytest.approx(values[:3].sum() / values.sum())
        for axis, vector in zip(r.axes, vectors):
            assert max(axis, key=abs) > 0
            assert np.allclose(axis, vector * np.sign(vector[np.abs(vector).argmax()]), atol=1e-8)
    assert fits.principal_axes(spark.createDataFrame([], "v array<double>"), "v", 6, 3).collect() == []


def plain_lloyd(points, centroids, steps):
    for _ in range(steps):
        own = ((points[:, None] - centroids[None]) ** 2).sum(2).argmin(1)
        centroids = np.array([points[own == k].mean(0) if (own == k).any() else centroids[k] for k in range(len(centroids))])
    return centroids


def test_lloyd_runs_all_configurations_at_once(spark):
    """Two spaces, several cluster counts, an empty cluster, a space without rows; silhouettes against all distances."""
    rng = np.random.default_rng(8)
    data = {"s": np.concatenate([rng.normal(m, 0.3, (40, 3)) for m in (0, 2, 5)]), "t": rng.normal(size=(50, 3))}
    df = spark.createDataFrame([(s, i, p.tolist()) for s, pts in data.items() for i, p in enumerate(pts)], "space string, id int, v array<double>").repartition(6)
    first = fits.first_centres(df, "space", F.concat_ws("_", "space", "id"), "v", 5, 1)
    assert {s: len(v) for s, v in first.items()} == {"s": 5, "t": 5}
    runs = [fits.Configuration(s, k, first[s][:k]) for s in data for k in (2, 3, 5)]
    runs += [fits.Configuration("t", 2, np.array([data["t"].mean(0), [1e3] * 3])), fits.Configuration("none", 2)]
    starts = [run.centroids for run in runs]
    fits.lloyd(df, runs, 6)
    scores = fits.silhouettes(df, runs)
    for run, start, (n, held, score) in zip(runs[:-1], starts, scores):
        points = data[run.space]
        assert np.allclose(run.centroids, plain_lloyd(points, start, 6))
        d2 = ((points[:, None] - points[None]) ** 2).sum(2)
        own = fits.nearest(points, run.centroids)
        assert n == len(points) and held == len(set(own))
        if held < 2:
            assert score is None and run.settled
            continue
        each = []
        for i in range(len(points)):
            mine = own == own[i]
            a = d2[i][mine].sum() / max(mine.sum() - 1, 1)
            b = min(d2[i][own == k].mean() for k in set(own) if k != own[i])
            each.append((b - a) / max(a, b) if mine.sum() > 1 else 0)
        assert score == pytest.approx(np.mean(each))
    assert scores[-1] == (0, 0, None)


def test_experiment_grid_skips_spaces_without_pixels(spark):
    rng = np.random.default_rng(9)
    rows = [(1, i // 8, i % 8, float(rng.random()), float(rng.random()) if i % 9 else None, False) for i in range(64)]
    px = spark.createDataFrame(rows, "scene int, y int, x int, a double, b double, high boolean")
    sets = {"one": ("a",), "two": ("a", "b")}
    points, axes = ex.feature_spaces(px, {**sets, "wide": ("a", "b", "a")}, "high")
    found, runs = ex.run_experiments(spark, points, axes, [1, 2], list(sets), (2, 3), 1, 3)
    ranked = ex.ranked_experiments(found)
    got = ranked.orderBy("rank").collect()
    assert len(got) == 2 * 2 * 2 * 2 * 2 and [r.rank for r in got] == list(range(1, 33))
    ok = [r for r in got if r.status == "ok"]
    assert len(ok) == 8 and got[:8] == ok and all(r.scene == 1 and r.mask_mode == "all" for r in ok)
    assert {(r.feature_set, r.pixel_count) for r in ok} == {("one", 64), ("two", 56)}
    assert [r.silhouette for r in ok] == sorted((r.silhouette for r in ok), reverse=True)
    assert all(r.reason == "no valid pixels" and r.silhouette is None for r in got[8:])
    clusters = ex.best_clusters(points, ranked, runs).collect()
    assert len(clusters) == ok[0].pixel_count and {c.cluster for c in clusters} <= set(range(1, ok[0].k + 1))


def test_ring_cells_match_an_exact_walk(spark):
    """Slanted, steep, flat and vertical edges, some of them along cell borders; cells by dense sampling of every edge."""
    ring = [(1.3, 0.2), (6.7, 2.9), (6.7, 7.4), (4.0, 7.0), (2.0, 7.0), (0.5, 5.5), (1.3, 0.2)]
    df = spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in ring],)], "ring array<struct<x:double,y:double>>")
    got = {(r.y, r.x) for r in tr.ring_cells(df).collect()}
    want = set()
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        for i in range(1, 20_000):
            x, y = ax + (bx - ax) * i / 20_000, ay + (by - ay) * i / 20_000
            if x != int(x) and y != int(y):
                want.add((int(y), int(x)))
    assert got == want
    px = spark.createDataFrame([(1, y, x) for y in range(9) for x in range(9)], "scene int, y bigint, x int")
    inside = {(r.y, r.x) for r in tr.inside_ring(px, df.scalar()).where("in_aoi").collect()}
    assert {(r.y, r.x) for r in tr.touched_by_ring(px, df).where("in_aoi").collect()} == inside | want


def test_passes_over_points_read_spaces_and_vectors_only(spark):
    rows = [("s", [float(i % 3), float(i % 5)]) for i in range(30)]
    df = spark.createDataFrame(rows, "space string, v array<double>").withColumn("id", F.raise_error(F.concat(F.lit("read "), "space")).cast("string"))
    run = fits.Configuration("s", 2, np.array([[0.0, 0.0], [2.0, 4.0]]))
    fits.lloyd(df, [run], 1)
    points = np.array([v for _, v in rows])
    own = ((points[:, None] - np.array([[0.0, 0.0], [2.0, 4.0]])[None]) ** 2).sum(2).argmin(1)
    assert np.allclose(run.centroids, [points[own == c].mean(0) for c in (0, 1)])
    assert fits.silhouettes(df, [run])[0][:2] == (30, 2)
