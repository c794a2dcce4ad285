import pytest
from pyspark.sql import functions as F

from strataspark.operators.gates import GateError
from strataspark.sources import geojson, tables
from strataspark.sources.geotiff import Header, register
from strataspark.streaming.updates import fold_posterior, tumbling


def test_csv(spark, tmp_path):
    path = tmp_path / "cores.csv"
    head = ",".join(tables.FIELD_COLUMNS)
    path.write_text(head + "\n2024, PM-03-A ,PM-03-A-2,56.1,87.6,8.75,NA,73.1,,NaN\n")
    r = tables.read_segments(spark, str(path)).first()
    assert r["core_id"] == "PM-03-A" and r["bulk_density_gcm3"] is None and r["soc_pct"] is None and r["ocd_supplied"] is None and r["year"] == 2024
    with pytest.raises(GateError):
        tables.read_csv_verbatim(spark, str(tmp_path / "none.csv"))
    with pytest.raises(GateError):
        tables.require(spark, str(tmp_path / "none"), "stage one")
    c = spark.createDataFrame([("PM-1",), ("FS-1",)], "id string").select(tables.campaign("id", {"PM": "peat", "FS": "mineral"}).alias("c"))
    assert [x["c"] for x in c.collect()] == ["peat", "mineral"]
    tables.write_csv(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    assert tables.read_csv_verbatim(spark, str(tmp_path / "out")).first()["b"] is None


def test_geojson(spark, tmp_path):
    path = tmp_path / "aoi_boundary.geojson"
    path.write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"w":[1,2]},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1]]]}}]}')
    ring, kind = geojson.read_aoi(spark, str(tmp_path))
    assert kind == "geojson" and ring[0] == ring[-1] and len(ring) == 5
    path.write_text(geojson.polygon(ring[:-1]))
    assert geojson.read_ring(spark, str(path)) == ring
    for bad in ('{"type":"x"}', geojson.polygon([(0, 0), (1, 1)]), geojson.polygon([(0, 0), (400, 0), (1, 1)])):
        path.write_text(bad)
        with pytest.raises(GateError):
            geojson.read_ring(spark, str(path))
    assert geojson.ee_literal([(1, 2)]) == "ee.Geometry.Polygon([[[1.00000000, 2.00000000]]])"
    doc = geojson.collection(spark.createDataFrame([(1.5, 2.5, None, 'a"b')], "x double, y double, n string, s string"), "x", "y", ["n", "s"])
    assert '"n":null' in doc and r"a\"b" in doc


def test_geotiff(spark, tmp_path):
    register(spark)
    path = str(tmp_path / "a.tif")
    px = spark.range(30).select((F.col("id") / 6).cast("int").alias("row"), (F.col("id") % 6).cast("int").alias("col"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.when(F.col("id") != 7, F.col("id").cast("double")).alias("z"))
    px.repartition(3).write.format("geotiff").mode("append").options(path=path, nx=6, ny=5, xres=0.5, yres=0.25, xmin=-88.0, ymax=56.0, epsg=3978, striprows=2).save()
    back = {(r["row"], r["col"]): r for r in spark.read.format("geotiff").load(path).collect()}
    assert len(back) == 30 and back[1, 1]["z"] is None and back[4, 5]["z"] == 29.0 and back[0, 0]["x"] == -87.75
    data = open(path, "rb").read()
    h = Header.decode(data)
    assert data[:4] == b"II*\0" and (h.nx, h.ny, h.epsg, h.nodata) == (6, 5, 3978, -9999.0)
    with pytest.raises(ValueError):
        Header(1, 1, 1, 1, 0, 0, 9999).encode()


def test_versions_and_reports(spark, tmp_path):
    root = str(tmp_path / "v")
    assert tables.snapshot(spark.range(1), root) == 1 and tables.snapshot(spark.range(2), root) == 2
    assert tables.latest(spark, root).count() == 2
    text = tables.report("t", {"a": spark.createDataFrame([("x|y", 1.23456)], "k string, v double"), "b": None})
    assert r"x\|y" in text and "1.235" in text and "## b" not in text
    assert tables.manifest(spark, [{"file": "a"}, {"file": "b", "units": "kg"}]).filter("units is null").count() == 1
    assert tables.catalogue(spark).count() > 10


def test_posterior_stream(spark, tmp_path):
    inbox, root = tmp_path / "in", str(tmp_path / "state")
    rows = [("a", "2024-06-01 00:00:00", 10.0), ("b", "2024-06-02 00:00:00", 20.0), ("a", "2024-06-01 00:00:00", 10.0)]
    obs = spark.createDataFrame(rows, "core string, t string, y double").withColumn("t", F.col("t").cast("timestamp"))
    obs.write.parquet(str(inbox))
    stream = spark.readStream.schema(obs.schema).parquet(str(inbox))
    pairs = lambda df: df.select(F.lit(1).alias("pixel"), "y", F.lit(1.0).alias("w"), F.lit(2.0).alias("sigma"))
    for _ in range(2):  # the second run finds nothing new
        fold_posterior(stream, pairs, root, ["pixel"], "core", "t").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    state = tables.latest(spark, root).first()
    assert state["tau"] == pytest.approx(0.5) and state["tau_y"] == pytest.approx(7.5)


def test_stream_windows(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(2).write.parquet(str(tmp_path / "e"))
    stream = tumbling(spark.readStream.schema(src.schema).parquet(str(tmp_path / "e")).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 hour", ["event_type"], "value", "10 minutes")
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == src.count()
