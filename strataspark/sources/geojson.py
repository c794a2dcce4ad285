"""GeoJSON rings and points."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gates import GateError

_RING = "array<array<array<double>>>"
_SCHEMA = f"type string, geometry struct<type:string,coordinates:{_RING}>, coordinates {_RING}, features array<struct<geometry:struct<type:string,coordinates:{_RING}>>>"


def read_ring(spark: SparkSession, path: str) -> list[tuple[float, float]]:
    """The outer ring of the first polygon, closed; four vertices at least, within the globe."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", _SCHEMA).alias("g"))
    r = text.select(F.coalesce("g.coordinates", "g.geometry.coordinates", F.get("g.features", F.lit(0))["geometry"]["coordinates"]).alias("c")).first()
    if r is None or not r["c"] or not r["c"][0]:
        raise GateError(f"{path} holds no polygon")
    ring = [(p[0], p[1]) for p in r["c"][0]]
    if any(not (-180 <= x <= 180 and -90 <= y <= 90) for x, y in ring):
        raise GateError(f"{path}: a vertex lies off the globe")
    if ring[0] != ring[-1]:
        ring.append(ring[0])
    if len(ring) < 4:
        raise GateError(f"{path}: a ring needs three corners")
    return ring


def read_aoi(spark: SparkSession, directory: str) -> tuple[list[tuple[float, float]], str]:
    """Vertex table if there is one, else the GeoJSON file; and which it was."""
    from .tables import _exists, read_csv_verbatim

    table = f"{directory}/aoi_vertices.csv"
    if _exists(spark, table):
        rows = read_csv_verbatim(spark, table).select(F.col("vertex").try_cast("int").alias("v"), F.col("lon").try_cast("double").alias("x"), F.col("lat").try_cast("double").alias("y")).orderBy("v").limit(10_000).collect()
        return [(r["x"], r["y"]) for r in rows], "vertices"
    return read_ring(spark, f"{directory}/aoi_boundary.geojson"), "geojson"


def point_feature(lon: Column | str, lat: Column | str, properties: list[str]) -> Column:
    """One Feature as JSON; NULL properties stay as null."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    geometry = F.struct(F.lit("Point").alias("type"), F.array(c(lon), c(lat)).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"})


def write_points(df: DataFrame, path: str, lon: str, lat: str, properties: list[str]) -> None:
    """One Feature a line (GeoJSON text sequence), written in parallel."""
    df.select(point_feature(lon, lat, properties).alias("value")).write.mode("overwrite").text(path)


def collection(df: DataFrame, lon: str, lat: str, properties: list[str], most: int = 100_000) -> str:
    """A FeatureCollection of a small table."""
    rows = df.select(point_feature(lon, lat, properties)).limit(most + 1).collect()
    if len(rows) > most:
        raise GateError("too many points for one document", remedy="use write_points")
    return '{"type":"FeatureCollection","features":[' + ",".join(r[0] for r in rows) + "]}"


def polygon(ring: list[tuple[float, float]], properties: dict | None = None) -> str:
    """A closed polygon as a FeatureCollection, eight decimals."""
    if ring[0] != ring[-1]:
        ring = [*ring, ring[0]]
    points = ",".join(f"[{x:.8f},{y:.8f}]" for x, y in ring)
    return '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[' + points + "]]}," + f'"properties":{json.dumps(properties or {})}' + "}]}"


def box(bbox: tuple[float, float, float, float], properties: dict | None = None) -> str:
    x0, y0, x1, y1 = bbox
    return polygon([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], properties)


def ee_literal(ring: list[tuple[float, float]]) -> str:
    """The ring as a geometry literal of the Earth Engine script language."""
    return "ee.Geometry.Polygon([[" + ", ".join(f"[{x:.8f}, {y:.8f}]" for x, y in ring) + "]])"
