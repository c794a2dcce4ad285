"""Sizing, tiling and band grouping of raster requests; tiles also partition pixel tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a request may hold, what it should, and the allowance for overhead.
HARD_BYTES, TARGET_BYTES, OVERHEAD, MOST_TILES = 50_331_648, 24 * 1024 * 1024, 1.30, 256
METRES_PER_DEGREE = 111_320.0


def dims(bbox: tuple[float, float, float, float], scale_m: float) -> tuple[int, int]:
    """Pixels across and down, at the equatorial degree step."""
    step = scale_m / METRES_PER_DEGREE
    return math.ceil((bbox[2] - bbox[0]) / step), math.ceil((bbox[3] - bbox[1]) / step)


def estimate_bytes(nx: int, ny: int, bands: int, width: int = 4) -> float:
    return nx * ny * bands * width * OVERHEAD


def tiles_per_side(bbox, scale_m: float, bands: int) -> int | None:
    """The fewest n with n x n tiles of at most TARGET_BYTES each; None beyond MOST_TILES."""
    n = 1
    while n * n <= MOST_TILES:
        x0, y0, x1, y1 = bbox
        if estimate_bytes(*dims((x0, y0, x0 + (x1 - x0) / n, y0 + (y1 - y0) / n), scale_m), bands) <= TARGET_BYTES:
            return n
        n += 1
    return None


def band_chunks(bbox, scale_m: float, bands: int) -> int:
    """How many bands fit one request of the whole box; 1 at least."""
    return max(1, int(TARGET_BYTES // estimate_bytes(*dims(bbox, scale_m), 1)))


def tiles(spark: SparkSession, bbox, scale_m: float, bands: int) -> DataFrame:
    """tile, x0, y0, x1, y1, nx, ny, bytes; the tiles cover the box without overlap."""
    n = tiles_per_side(bbox, scale_m, bands)
    if n is None:
        raise ValueError("the request needs too many tiles: use a coarser scale or fewer bands")
    x0, y0, x1, y1 = bbox
    rows = []
    for k in range(n * n):
        i, j = divmod(k, n)
        box = (x0 + (x1 - x0) * j / n, y0 + (y1 - y0) * i / n, x0 + (x1 - x0) * (j + 1) / n, y0 + (y1 - y0) * (i + 1) / n)
        nx, ny = dims(box, scale_m)
        rows.append((k, *box, nx, ny, float(estimate_bytes(nx, ny, bands))))
    return spark.createDataFrame(rows, "tile int, x0 double, y0 double, x1 double, y1 double, nx int, ny int, bytes double")


def download_manifest(spark: SparkSession, requests: DataFrame, have: DataFrame, least_bytes: int = 1) -> DataFrame:
    """Each request (name, tile, bytes) with its status: cached (in ``have``: name, tile, size; large enough), failed (there, but smaller), too_large (over the hard limit) or pending."""
    met = requests.join(have.select("name", "tile", F.col("size").alias("size")), ["name", "tile"], "left")
    status = F.when(F.col("size") >= least_bytes, "cached").when(F.col("size").isNotNull(), "failed").when(F.col("bytes") > HARD_BYTES, "too_large").otherwise("pending")
    return met.withColumn("status", status)
