"""SQL definitions of the observation tables, used only by the reference SQL."""

from __future__ import annotations

from landshift.functions import geo
from landshift.plans.registry import view

ND = "CASE WHEN abs(({a})+({b})) > 1e-6 THEN (({a})-({b}))/(({a})+({b})) END"


def nd(a: str, b: str) -> str:
    return ND.format(a=a, b=b)


def number(v: float) -> str:
    """A literal that SQL reads as a double."""
    return repr(v) if "e" in repr(v) else f"{v!r}e0"


def lonlat_ctes(source: str, name: str) -> str:
    """Table expressions that add lon and lat to the map coordinates mx and my of `source` (zone 35 south)."""
    scale = number(geo._K0 * geo._AA)
    xi1 = " ".join(f"- {number(b)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(geo._BETA, 1))
    eta1 = " ".join(f"- {number(b)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(geo._BETA, 1))
    lat = " ".join(f"+ {number(d)} * sin({2 * j} * chi)" for j, d in enumerate(geo._DELTA, 1))
    return f"""{name}_a AS (SELECT *, (my - 1e7) / {scale} AS xi, (mx - 5e5) / {scale} AS eta FROM {source}),
{name}_b AS (SELECT *, xi {xi1} AS xi1, eta {eta1} AS eta1 FROM {name}_a),
{name}_c AS (SELECT *, asin(sin(xi1) / cosh(eta1)) AS chi FROM {name}_b),
{name} AS (SELECT * EXCLUDE (xi, eta, xi1, eta1, chi), 27 + degrees(atan2(sinh(eta1), cos(xi1))) AS lon, degrees(chi {lat}) AS lat FROM {name}_c)"""


view("px", """
SELECT year(l_shipdate) - 1995 AS scene, l_partkey // 8 AS y,
       CAST((l_partkey % 8) * 7 + l_linenumber - 1 AS INTEGER) AS x, count(*) AS n,
       sum(CAST(round(l_discount * 100) AS BIGINT)) / (count(*) * 10e0) AS red,
       sum(CAST(round(l_tax * 100) AS BIGINT)) / (count(*) * 8e0) AS green,
       sum(CAST(l_quantity AS BIGINT)) / (count(*) * 50e0) AS nir,
       sum(CAST(round(l_extendedprice * 100) AS BIGINT) % 97 + 1) / (count(*) * 97e0) AS swir,
       sum(l_suppkey % 100 + 1) / (count(*) * 100e0) AS vv,
       sum(l_orderkey % 50 + 1) / (count(*) * 50e0) AS vh,
       CAST(sum(l_suppkey) % 7 AS INTEGER) AS s1, CAST(sum(l_orderkey) % 7 AS INTEGER) AS s2,
       CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) % 7 AS INTEGER) AS s3,
       CAST(sum(CAST(l_quantity AS BIGINT)) % 7 AS INTEGER) AS s4,
       CAST(sum(l_suppkey) AS BIGINT) AS sum_supp, CAST(sum(l_orderkey) AS BIGINT) AS sum_ord
FROM lineitem GROUP BY 1, 2, 3""")

view("feat", f"""
SELECT *, {nd('nir', 'red')} AS ndvi, {nd('green', 'nir')} AS ndwi, {nd('swir', 'nir')} AS ndbi,
       CASE WHEN abs(vh) > 1e-6 THEN vv / vh END AS ratio FROM px""")

view("pairs", """
SELECT before_scene, after_scene FROM (
  SELECT scene AS before_scene, lead(scene) OVER (ORDER BY scene) AS after_scene
  FROM (SELECT DISTINCT scene FROM px)) WHERE after_scene IS NOT NULL""")

view("delta", """
SELECT p.before_scene, p.after_scene, a.y, a.x,
       b.ndvi AS b_ndvi, b.ndbi AS b_ndbi, b.ndwi AS b_ndwi, b.ratio AS b_ratio,
       a.ndvi AS a_ndvi, a.ndbi AS a_ndbi, a.ndwi AS a_ndwi, a.ratio AS a_ratio,
       a.ndvi - b.ndvi AS d_ndvi, a.ndbi - b.ndbi AS d_ndbi, a.ndwi - b.ndwi AS d_ndwi, a.ratio - b.ratio AS d_ratio
FROM pairs p JOIN feat b ON b.scene = p.before_scene JOIN feat a ON a.scene = p.after_scene AND a.y = b.y AND a.x = b.x""")

view("classed", """
SELECT *, CASE
    WHEN d_ndvi IS NULL OR d_ndbi IS NULL OR d_ndwi IS NULL OR d_ratio IS NULL THEN 0
    WHEN d_ndvi <= -0.22e0 AND d_ndbi >= 0.16e0 THEN 2
    WHEN d_ndvi <= -0.22e0 THEN 1
    WHEN abs(d_ndwi) >= 0.25e0 THEN 3
    WHEN abs(d_ratio) >= 0.3e0 THEN 4 ELSE 0 END AS raw_class FROM delta""")

view("scored", """
SELECT *, CASE WHEN raw_class = 0 THEN 0e0 ELSE
    0.65e0 * least(greatest(abs(d_ndvi) / 0.22e0, abs(d_ndbi) / 0.16e0, abs(d_ndwi) / 0.25e0), 1e0)
  + 0.35e0 * least(abs(d_ratio) / 0.3e0, 1e0) END AS raw_confidence FROM classed""")

view("detected", """
SELECT *, CASE WHEN raw_confidence >= 0.75e0 THEN raw_class ELSE 0 END AS change_class,
       CASE WHEN raw_confidence >= 0.75e0 THEN raw_confidence ELSE 0e0 END AS confidence FROM scored""")

view("terrain", """
SELECT vec_id AS y, i - 1 AS x, round(CAST(embedding[i] AS DOUBLE) * 1000, 3) AS elevation
FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""")

view("scene_rows", """
SELECT event_id AS id, CASE WHEN event_type IN ('view', 'signup') THEN 'optical' ELSE 'radar' END AS collection,
       ts AS acquired_at, CAST(ts AS DATE) AS day, weekofyear(ts) AS period, value AS cloud_cover,
       'T' || (user_id % 2) AS tile,
       CASE event_type WHEN 'click' THEN 'ascending' WHEN 'purchase' THEN 'descending' END AS orbit,
       event_id % 5 <> 0 AS has_both, event_id % 7 <> 0 AS has_nir, user_id AS x0, event_id % 97 AS y0, props AS properties
FROM events""")

STATE = """CASE c_mktsegment WHEN 'BUILDING' THEN 'built_up' WHEN 'AUTOMOBILE' THEN 'bare_sparse'
    WHEN 'MACHINERY' THEN 'mixed' WHEN 'HOUSEHOLD' THEN 'vegetation' WHEN 'FURNITURE' THEN 'water_moisture' END"""

view("raw_changes", f"""
SELECT o_orderkey AS id,
       CASE left(o_orderpriority, 1) WHEN '1' THEN 'vegetation_loss' WHEN '2' THEN 'built_up_gain'
            WHEN '3' THEN 'moisture_change' ELSE 'radar_change' END AS change_type,
       {STATE} AS before_state,
       CASE o_custkey % 6 WHEN 0 THEN 'built_up' WHEN 1 THEN 'bare_sparse' WHEN 2 THEN 'mixed'
            WHEN 3 THEN 'vegetation' WHEN 4 THEN 'water_moisture' END AS after_state,
       (CAST(round(o_totalprice * 100) AS BIGINT) % 1000) / 1000e0 AS base_confidence,
       CASE WHEN CAST(round(o_totalprice * 100) AS BIGINT) % 13 <> 0
            THEN (CAST(round(o_totalprice * 100) AS BIGINT) % 701) / 501e0 END AS change_magnitude,
       (CAST(round(o_totalprice * 100) AS BIGINT) % 900 + 10) * 100e0 AS area_m2,
       CAST(o_orderdate AS DATE) AS before_date, CAST(o_orderdate AS DATE) + 45 AS after_date
FROM orders JOIN customer ON o_custkey = c_custkey""")

view("changes", """
WITH g AS (
  SELECT *, CASE change_type WHEN 'vegetation_loss' THEN 'vegetation' WHEN 'built_up_gain' THEN 'built_up'
           WHEN 'moisture_change' THEN 'water_moisture' ELSE before_state END AS monitored_land_cover
  FROM raw_changes),
s AS (
  SELECT *, least(greatest(base_confidence
       + CASE WHEN change_type = 'radar_change' THEN -0.12e0 ELSE 0e0 END
       + CASE WHEN monitored_land_cover = 'mixed' THEN -0.08e0 ELSE 0e0 END
       + CASE WHEN before_state IS NOT DISTINCT FROM after_state THEN -0.05e0 ELSE 0e0 END
       + least(coalesce(change_magnitude, 0e0), 1e0) * 0.05e0, 0e0), 1e0) AS adjusted FROM g)
SELECT * EXCLUDE (adjusted), round(adjusted, 3) AS confidence,
       CASE WHEN adjusted >= 0.85e0 THEN 'high' WHEN adjusted >= 0.65e0 THEN 'medium' ELSE 'low' END AS reliability,
       round(adjusted, 3) >= 0.75e0 AS publish_ready FROM s""")

WEIGHTS = ", ".join(
    f"(SELECT v * v * v FROM (SELECT (sum_supp * {k} + sum_ord) % 11 + 1 AS v)) AS w{k}" for k in range(1, 6)
)
LN = " + ".join(
    f"least(greatest(w{k} / CAST(wt AS DOUBLE), 1e-7), 1e0) * ln(least(greatest(w{k} / CAST(wt AS DOUBLE), 1e-7), 1e0))"
    for k in range(1, 6)
)

view("model_w", f"SELECT scene, y, x, s1, s2, s3, s4, {WEIGHTS} FROM px")
view("model_out", f"""
SELECT scene, y, x, s1, s2, s3, s4, w1, w2, w3, w4, w5, wt,
       CASE greatest(w1, w2, w3, w4, w5) WHEN w1 THEN 1 WHEN w2 THEN 2 WHEN w3 THEN 3 WHEN w4 THEN 4 ELSE 5 END AS model_class,
       greatest(w1, w2, w3, w4, w5) / CAST(wt AS DOUBLE) AS confidence,
       round(-({LN}) / ln(5e0), 6) AS entropy
FROM (SELECT *, w1 + w2 + w3 + w4 + w5 AS wt FROM model_w)""")

# votes over the four weak sources
CNT = ", ".join(
    f"(CASE WHEN s1={k} THEN 1 ELSE 0 END + CASE WHEN s2={k} THEN 1 ELSE 0 END"
    f" + CASE WHEN s3={k} THEN 1 ELSE 0 END + CASE WHEN s4={k} THEN 1 ELSE 0 END) AS c{k}"
    for k in range(1, 7)
)
view("vote_counts", f"SELECT scene, y, x, {CNT} FROM px")
view("votes", """
SELECT scene, y, x, sc AS source_count, mode_label, mc AS mode_count,
       CASE WHEN mc >= 2 THEN mode_label ELSE 0 END AS agreement,
       sc >= 2 AND mc < sc AS disagreement
FROM (SELECT scene, y, x, c1+c2+c3+c4+c5+c6 AS sc, greatest(c1,c2,c3,c4,c5,c6) AS mc,
             CASE WHEN greatest(c1,c2,c3,c4,c5,c6) = 0 THEN 0
                  ELSE CASE greatest(c1,c2,c3,c4,c5,c6) WHEN c1 THEN 1 WHEN c2 THEN 2 WHEN c3 THEN 3
                       WHEN c4 THEN 4 WHEN c5 THEN 5 ELSE 6 END END AS mode_label FROM vote_counts)""")

view("consensus", """
SELECT y, x, valid_count, CASE WHEN valid_count = 0 THEN 0 ELSE
         CASE m WHEN k1 THEN 1 WHEN k2 THEN 2 WHEN k3 THEN 3 WHEN k4 THEN 4 ELSE 5 END END AS mode_class,
       CASE WHEN valid_count > 0 THEN m / CAST(valid_count AS DOUBLE) END AS consensus
FROM (SELECT *, greatest(k1, k2, k3, k4, k5) AS m FROM (
  SELECT y, x, count(*) FILTER (model_class > 0) AS valid_count,
         count(*) FILTER (model_class = 1) AS k1, count(*) FILTER (model_class = 2) AS k2,
         count(*) FILTER (model_class = 3) AS k3, count(*) FILTER (model_class = 4) AS k4,
         count(*) FILTER (model_class = 5) AS k5 FROM model_out GROUP BY y, x))""")

H2M = "CASE agreement WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 4 WHEN 6 THEN 5 ELSE 0 END"

view("evidence", f"""
SELECT m.scene, m.y, m.x, m.model_class, m.confidence, m.entropy, v.source_count, v.agreement, v.disagreement, c.consensus,
       v.agreement > 0 AND ({H2M}) = m.model_class AS is_compatible
FROM model_out m JOIN votes v USING (scene, y, x) JOIN consensus c USING (y, x)""")


def axes_sql(source: str, d: int, k: int, sweeps: int = 8) -> str:
    """(key, r, axis, explained): the first k principal axes of the covariances (key, i, j, v) in `source`, by Jacobi rotations."""
    rows, cols = f"e // {d}", f"e % {d}"

    def turned(of: str, where: str, one: str, other: str) -> str:
        return (f"list_transform(range({d * d}), lambda e: CASE WHEN {where} = p THEN c * {of}[{one}] - s * {of}[{other}] "
                f"WHEN {where} = q THEN s * {of}[{one}] + c * {of}[{other}] ELSE {of}[e + 1] END)")

    by_row = turned("a", rows, f"p * {d} + {cols} + 1", f"q * {d} + {cols} + 1")
    by_col = [turned(m, cols, f"({rows}) * {d} + p + 1", f"({rows}) * {d} + q + 1") for m in ("b", "v")]
    return f"""
WITH RECURSIVE turns AS MATERIALIZED (SELECT p, q, row_number() OVER (ORDER BY sweep, p, q) AS n
  FROM (SELECT unnest(range({sweeps})) AS sweep), (SELECT unnest(range({d})) AS p), (SELECT unnest(range({d})) AS q) WHERE p < q),
jac AS (
  SELECT CAST(0 AS BIGINT) AS n, key, list(v ORDER BY i, j) AS a, list(CASE WHEN i = j THEN 1e0 ELSE 0e0 END ORDER BY i, j) AS v FROM {source} GROUP BY key
  UNION ALL
  SELECT n, key, {by_col[0]}, {by_col[1]}
  FROM (SELECT n, key, p, q, c, s, v, {by_row} AS b
    FROM (SELECT n, key, p, q, a, v, 1 / sqrt(t * t + 1) AS c, t / sqrt(t * t + 1) AS s
      FROM (SELECT *, CASE WHEN abs(apq) < 1e-150 THEN 0e0 ELSE (CASE WHEN theta >= 0 THEN 1 ELSE -1 END) / (abs(theta) + sqrt(theta * theta + 1)) END AS t
        FROM (SELECT *, CASE WHEN abs(apq) < 1e-150 THEN 0e0 ELSE (a[q * {d} + q + 1] - a[p * {d} + p + 1]) / (2 * apq) END AS theta
          FROM (SELECT turns.n, key, p, q, a, v, a[p * {d} + q + 1] AS apq FROM jac JOIN turns ON turns.n = jac.n + 1))))))
SELECT key, r, CASE WHEN axis[list_position(size, list_max(size))] < 0 THEN list_transform(axis, lambda x: -x) ELSE axis END AS axis, explained
FROM (SELECT *, list_transform(axis, lambda x: abs(x)) AS size, sum(value) FILTER (r < {k}) OVER (PARTITION BY key) / sum(value) OVER (PARTITION BY key) AS explained
  FROM (SELECT key, a[j * {d} + j + 1] AS value, list_transform(range({d}), lambda i: v[i * {d} + j + 1]) AS axis,
      row_number() OVER (PARTITION BY key ORDER BY a[j * {d} + j + 1] DESC, j) - 1 AS r
    FROM jac, (SELECT unnest(range({d})) AS j) WHERE n = {sweeps * d * (d - 1) // 2})) WHERE r < {k}"""


def squared(d: int) -> str:
    return " + ".join(f"(f{i} - c{i}) * (f{i} - c{i})" for i in range(1, d + 1))


def lloyd_sql(points: str, centres: str, d: int, steps: int) -> str:
    """(config, space, place, c1...): centroids after the steps, from points (space, id, f1...) and first centres.

    The row without an id in each space carries the centroid of a cluster that no point is nearest to.
    """
    fs, cs = ", ".join(f"f{i}" for i in range(1, d + 1)), ", ".join(f"c{i}" for i in range(1, d + 1))
    means = ", ".join(f"coalesce(avg(f{i}), any_value(c{i}))" for i in range(1, d + 1))
    nothing = ", ".join(["NULL"] * d)
    return f"""
WITH RECURSIVE moving AS MATERIALIZED (SELECT space, id, {fs} FROM {points} UNION ALL SELECT DISTINCT space, NULL, {nothing} FROM {points}),
cent AS (
  SELECT 0 AS step, config, space, place, {cs} FROM {centres}
  UNION ALL
  SELECT step + 1, config, any_value(space), place, {means} FROM (
    SELECT c.step, c.config, c.space, c.place, {cs}, {fs}, id, row_number() OVER (PARTITION BY c.config, id ORDER BY {squared(d)}, place) AS rn
    FROM cent c JOIN moving m ON m.space = c.space WHERE c.step < {steps}) WHERE rn = 1 OR id IS NULL GROUP BY step, config, place)
SELECT config, space, place, {cs} FROM cent WHERE step = {steps}"""
