import json

from pyspark.sql import functions as F

from landshift.operators import audit as au
from landshift.sources import grid as gr, observations as obs, sinks
from landshift.streaming import catalogue

RING = [[29.971674588098654, -1.8539907197602912], [30.15205257721712, -1.8536766484566063], [30.152387520306693, -2.034074211175956],
        [29.9719904347848, -2.0344188710956463], [29.971674588098654, -1.8539907197602912]]


def test_aoi_and_grid_outline_agree(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "a"}, "geometry": {"type": "Polygon", "coordinates": [RING]}}]}
    path = tmp_path / "aoi.json"
    path.write_text(json.dumps(doc, indent=1))
    aoi = gr.load_aoi(spark, str(path)).first()
    assert aoi.left == RING[0][0] and aoi.top == RING[1][1] and len(aoi.ring) == 5
    gap = gr.outline_differs(gr.grid_outline(gr.grid_row(spark)), RING, 1e-8).first()
    assert not gap.differs


def test_band_sink_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([(s, "nir", y, x, 0.5) for s in (1, 2) for y in range(4) for x in range(4)], "scene int, band string, y bigint, x int, value double")
    sinks.write_band(df, str(tmp_path / "px"))
    back = spark.read.parquet(str(tmp_path / "px")).where("scene = 2 and band = 'nir' and y <= 1")
    assert back.count() == 8
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(scene" in plan and "LessThanOrEqual(y,1)" in plan


def test_features_and_publish(spark, tmp_path):
    df = spark.createDataFrame([(1, "radar_change", 0.8, 0.7, 500.0, True, "high", [[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]])],
                               "id int, change_type string, confidence double, base_confidence double, area_m2 double, publish_ready boolean, reliability string, ring array<array<double>>")
    sinks.write_features(df, "ring", ["id", "change_type"], str(tmp_path / "f"))
    f = json.loads(spark.read.text(str(tmp_path / "f")).first()[0])
    assert f["type"] == "Feature" and f["properties"]["id"] == 1 and f["geometry"]["coordinates"][0][1] == [1.0, 0.0]
    out = str(tmp_path / "p")
    sinks.publish(df.drop("ring"), out, "run-a")
    sinks.publish(df.drop("ring"), out, "run-b", replace=False)
    sinks.publish(df.drop("ring"), out, "run-b", replace=False)  # a retry adds nothing
    assert sinks.run_row(df, "run-b").first() == ("run-b", "published", 1, 0)
    runs = spark.read.parquet(out + "_runs").select("run_id", "status", "published_count", "held_count").collect()
    assert sorted(map(tuple, runs)) == [("run-a", "published", 1, 0), ("run-b", "published", 1, 0)]
    rows = spark.read.parquet(out).collect()
    assert {r.run_id for r in rows} == {"run-a", "run-b"} and len({r.publish_id for r in rows}) == 2
    assert json.loads(rows[0].properties) == {"publish_ready": True, "reliability": "high"}


def test_asset_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PNG").write_bytes(b"12345")
    (tmp_path / "a" / "y.json").write_bytes(b"12")
    inv = {r.suffix: r for r in au.asset_inventory(au.scan_assets(spark, str(tmp_path)), 3, (".json",)).collect()}
    assert inv[".png"].oversized_count == 1 and not inv[".png"].allowed and inv[".json"].total_bytes == 2


def test_scene_stream_upserts(spark, tmp_path):
    schema = "id int, collection string, acquired_at timestamp, cloud_cover double, assets string, properties string"
    src, out = str(tmp_path / "in"), str(tmp_path / "cat")

    def arrive(rows):
        spark.createDataFrame(rows, "id int, collection string, t string, cloud_cover double, assets string, properties string").select(
            "id", "collection", F.to_timestamp("t").alias("acquired_at"), "cloud_cover", "assets", "properties").coalesce(1).write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(schema).parquet(src)
        catalogue.keep_current(stream, out, str(tmp_path / "ck")).awaitTermination(60)

    arrive([(1, "a", "2024-01-01", 5.0, "x", "p"), (1, "a", "2024-01-02", 4.0, "x2", "p2"), (2, "b", "2024-01-01", 9.0, "y", "q")])
    run()
    arrive([(2, "OTHER", "2024-01-03", 1.0, "y2", "q2"), (3, "c", "2024-01-03", 2.0, "z", "r")])
    run()
    got = {r.id: (r.collection, r.cloud_cover, r.assets) for r in catalogue.read_catalogue(spark, out).collect()}
    assert got == {1: ("a", 4.0, "x2"), 2: ("b", 1.0, "y2"), 3: ("c", 2.0, "z")}


def test_manifest_is_written_in_order(spark, tmp_path):
    rows = [("train", "b", 2), ("test", "a", 9), ("train", "a", 3), ("train", "b", 1)]
    sinks.write_manifest(spark.createDataFrame(rows, "split string, tag string, patch_id int").repartition(3), str(tmp_path / "m"))
    lines = [json.loads(line) for f in sorted((tmp_path / "m").glob("part-*")) for line in f.read_text().splitlines()]
    assert [(r["split"], r["tag"], r["patch_id"]) for r in lines] == sorted(rows)


def test_terrain_drops_what_is_no_number(spark, tmp_path):
    spark.createDataFrame([(0, [1.0, float("nan"), float("inf"), None])], "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.x: r.elevation for r in obs.terrain(spark, str(tmp_path)).collect()}
    assert got == {0: 1000.0, 1: None, 2: None, 3: None}


def test_pixel_tasks_follow_the_line_items_and_keep_rows_together(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(obs, "ROWS_PER_TASK", 500, raising=False)
    px = obs.pixels(spark, sf)
    tasks = 1 + obs.table(spark, sf, "lineitem").count() // 500
    assert tasks > 8 and px.rdd.getNumPartitions() == tasks
    placed = px.groupBy("y", F.spark_partition_id().alias("task")).count()
    assert placed.count() == placed.select("y").distinct().count()
