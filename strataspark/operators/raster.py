"""Rasters as pixel tables keyed by (row, col); row 0 is north, col 0 west."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import METRES_PER_DEGREE, Lcc
from ..functions.numeric import finite, col


@dataclass(frozen=True)
class Grid:
    nx: int
    ny: int
    xres: float
    yres: float
    xmin: float
    ymax: float

    def x(self, c: Column) -> Column:
        return (c + 0.5) * self.xres + self.xmin

    def y(self, r: Column) -> Column:
        return F.lit(self.ymax) - (r + 0.5) * self.yres

    def place(self, x: Column | str, y: Column | str) -> tuple[Column, Column]:
        """Fractional (row, col) of a point; cell centres are whole numbers."""
        return (F.lit(self.ymax) - col(y)) / self.yres - 0.5, (col(x) - self.xmin) / self.xres - 0.5

    def pixels(self, spark: SparkSession, partitions: int | None = None) -> DataFrame:
        cells = spark.range(0, self.nx * self.ny, 1, partitions) if partitions else spark.range(self.nx * self.ny)
        r, c = F.floor(F.col("id") / self.nx).cast("int"), F.pmod("id", F.lit(self.nx)).cast("int")
        return cells.select(r.alias("row"), c.alias("col")).withColumns({"x": self.x(F.col("col")), "y": self.y(F.col("row"))})


def make_grid(bbox: tuple[float, float, float, float], cell_m: float) -> Grid:
    """Degree grid of about ``cell_m`` metres over (xmin, ymin, xmax, ymax), whole cells, from the north-west."""
    x0, y0, x1, y1 = bbox
    yres = cell_m / METRES_PER_DEGREE
    xres = cell_m / (METRES_PER_DEGREE * math.cos(math.radians((y0 + y1) / 2)))
    return Grid(math.ceil((x1 - x0) / xres), math.ceil((y1 - y0) / yres), xres, yres, x0, y1)


def target_grid(ring_xy: list[tuple[float, float]], cell_m: float, pad: int = 1) -> Grid:
    """Projected grid whose edges are whole multiples of the cell, around a ring, with a margin of cells."""
    xs, ys = [p[0] for p in ring_xy], [p[1] for p in ring_xy]
    x0, x1 = (math.floor(min(xs) / cell_m) - pad) * cell_m, (math.ceil(max(xs) / cell_m) + pad) * cell_m
    y0, y1 = (math.floor(min(ys) / cell_m) - pad) * cell_m, (math.ceil(max(ys) / cell_m) + pad) * cell_m
    return Grid(round((x1 - x0) / cell_m), round((y1 - y0) / cell_m), cell_m, cell_m, x0, y1)


def sample(points: DataFrame, raster: DataFrame, grid: Grid, x: str, y: str, value: str, out: str = "z", method: str = "bilinear", key: str = "id") -> DataFrame:
    """Adds the raster's value at each point: nearest cell, or bilinear with the nearest one where a neighbour is missing; NULL outside the extent.

    A point becomes four keyed rows at most, joined on (row, col) and summed
    back by its key, so neither side is replicated whole.
    """
    r, c = grid.place(x, y)
    inside = (r >= -0.5) & (r <= grid.ny - 0.5) & (c >= -0.5) & (c <= grid.nx - 0.5)
    clamp_r = lambda v: F.greatest(F.lit(0), F.least(F.lit(grid.ny - 1), v)).cast("int")
    clamp_c = lambda v: F.greatest(F.lit(0), F.least(F.lit(grid.nx - 1), v)).cast("int")
    cells = raster.select("row", "col", F.col(value).cast("double").alias("_z"))
    cells = cells.withColumn("_z", F.when(~F.isnan("_z"), F.col("_z")))
    near = points.select(key, F.when(inside, r).alias("_r"), F.when(inside, c).alias("_c")).filter("_r is not null")
    # halves round up, south and east
    spots = near.withColumns({"row": clamp_r(F.floor(F.col("_r") + 0.5)), "col": clamp_c(F.floor(F.col("_c") + 0.5))})
    nearest = spots.join(cells, ["row", "col"]).select(key, F.col("_z").alias("_near"))
    if method == "nearest":
        return points.join(nearest.withColumnRenamed("_near", out), key, "left")
    fr, fc = F.col("_r") - F.floor("_r"), F.col("_c") - F.floor("_c")
    corners = F.array(*[F.struct(clamp_r(F.floor("_r") + i).alias("row"), clamp_c(F.floor("_c") + j).alias("col"), ((fr if i else 1 - fr) * (fc if j else 1 - fc)).alias("w")) for i in (0, 1) for j in (0, 1)])
    four = near.select(key, F.explode(corners).alias("k")).select(key, "k.*").join(cells, ["row", "col"])
    bil = four.groupBy(key).agg(F.when(F.count("_z") == 4, F.sum(F.col("_z") * F.col("w"))).alias("_bil"))
    both = points.join(bil, key, "left").join(nearest, key, "left")
    return both.withColumn(out, F.coalesce("_bil", "_near")).drop("_bil", "_near")


def warp(raster: DataFrame, source: Grid, target: Grid, projection: Lcc, value: str, method: str = "bilinear") -> DataFrame:
    """Projected pixel table: each target centre goes back to degrees and is sampled there."""
    px = target.pixels(raster.sparkSession)
    lon, lat = projection.inverse("x", "y")
    px = px.withColumns({"lon": lon, "lat": lat, "id": F.col("row").cast("long") * target.nx + F.col("col")})
    return sample(px, raster, source, "lon", "lat", value, value, method).drop("id")


def focal_mean(raster: DataFrame, value: str, radius_cells: int, out: str = "focal") -> DataFrame:
    """Mean in a disc: each row's cells feed running sums along the row, then one join per row offset.

    Prefix sums along rows make a disc of radius R cost 2R + 1 rows a pixel, not R squared.
    """
    w = Window.partitionBy("row").orderBy("col")
    half = {dr: math.isqrt(radius_cells**2 - dr**2) for dr in range(-radius_cells, radius_cells + 1)}
    # one pair of running columns for each different width
    wide = raster.select("row", "col", value, *[f(value).over(w.rangeBetween(-h, h)).alias(f"_{k}{h}") for h in sorted(set(half.values())) for k, f in (("s", F.sum), ("n", F.count))])
    parts = [F.struct((F.col("row") + dr).alias("r"), F.col(f"_s{h}").alias("s"), F.col(f"_n{h}").alias("n")) for dr, h in half.items()]
    strips = wide.select("col", F.explode(F.array(*parts)).alias("p")).select("p.*", "col")
    sums = strips.groupBy(F.col("r").alias("row"), "col").agg(F.try_divide(F.sum("s"), F.sum("n")).alias(out))
    return raster.join(sums, ["row", "col"], "left")


def tpi(raster: DataFrame, value: str, radius_cells: int, out: str = "tpi") -> DataFrame:
    return focal_mean(raster, value, radius_cells, "_focal").withColumn(out, F.col(value) - F.col("_focal")).drop("_focal")


def slope(raster: DataFrame, value: str, cell_m: float, out: str = "slope_deg") -> DataFrame:
    """Horn's slope from the eight neighbours; NULL at the rim or next to a missing cell."""
    ew, ns = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    z = F.col(value)
    a = raster.withColumns({"_w": F.lag(z).over(ew), "_e": F.lead(z).over(ew)})
    for c in ("_w", "_e", value):
        a = a.withColumns({f"_n{c}": F.lag(c).over(ns), f"_s{c}": F.lead(c).over(ns)})
    gx = (F.col("_n_e") + 2 * F.col("_e") + F.col("_s_e")) - (F.col("_n_w") + 2 * F.col("_w") + F.col("_s_w"))
    gy = (F.col("_s_w") + 2 * F.col(f"_s{value}") + F.col("_s_e")) - (F.col("_n_w") + 2 * F.col(f"_n{value}") + F.col("_n_e"))
    s = F.degrees(F.atan(F.sqrt(gx * gx + gy * gy) / (8 * cell_m)))
    return a.withColumn(out, s).select(*raster.columns, out)


def remap(raster: DataFrame, key: str, table: DataFrame, value: str, default=None) -> DataFrame:
    """Class -> value from a lookup (its NULL values count as unmapped); the rest is NULL or the default."""
    t = table.filter(col(value).isNotNull()).select(key, value).dropDuplicates([key])
    out = raster.join(t, key, "left")
    return out.withColumn(value, F.coalesce(value, F.lit(default))) if default is not None else out


def mosaic(layers: list[DataFrame], value: str) -> DataFrame:
    """The last non-null value of each cell wins."""
    all_ = None
    for i, d in enumerate(layers):
        x = d.filter(col(value).isNotNull()).select("row", "col", F.struct(F.lit(i).alias("p"), F.col(value).alias("v")).alias("s"))
        all_ = x if all_ is None else all_.unionByName(x)
    return all_.groupBy("row", "col").agg(F.max("s")["v"].alias(value))


def stack(base: DataFrame, *others: DataFrame) -> DataFrame:
    """Bands side by side; cells of the base are kept."""
    for o in others:
        base = base.join(o.select("row", "col", *[c for c in o.columns if c not in base.columns]), ["row", "col"], "left")
    return base


def composite_median(images: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    return images.groupBy(*keys).agg(*[F.median(b).alias(b) for b in bands])


def probe(raster: DataFrame, value: str) -> DataFrame:
    q = F.percentile(value, F.array(*[F.lit(p) for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)]))
    return raster.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi"), q.alias("q"))


def distance_to_mask(raster: DataFrame, mask: str, cell_m: float, most_cells: int = 1 << 20) -> DataFrame:
    """Distance to the nearest masked cell, exact, in two passes of windows: along columns, then along rows over lower envelopes.

    The second pass takes, for each pixel, the least of g(col')^2 + (col - col')^2
    over its row; a row is one ordered window's array.
    """
    w = Window.partitionBy("col").orderBy("row")
    up = F.col("row") - F.last(F.when(F.col(mask), F.col("row")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(F.when(F.col(mask), F.col("row")), True).over(w.rowsBetween(0, Window.unboundedFollowing)) - F.col("row")
    g = raster.withColumn("_g", F.least(up, down))
    line = g.groupBy("row").agg(F.collect_list(F.when(F.col("_g").isNotNull(), F.struct("col", "_g"))).alias("_line"))
    best = F.array_min(F.transform("_line", lambda k: k["_g"] * k["_g"] + (k["col"] - F.col("col")) * (k["col"] - F.col("col"))))
    return g.join(line, "row").withColumn("distance_m", F.sqrt(best) * cell_m).drop("_g", "_line")


def sentinel_to_null(df: DataFrame, columns: list[str], sentinel: float = -9999.0) -> DataFrame:
    """Samples of masked pixels, marked by a sentinel so that their points stay, become NULL; so do values that aren't finite."""
    return df.withColumns({c: F.when(F.abs(F.col(c) - sentinel) >= 1e-6, finite(c)) for c in columns})


def verify_raster(px: DataFrame, epsg: int, value: str = "z") -> DataFrame:
    """One row on what landed: rows, columns, layers, code, mean and whether every pixel is missing."""
    out = px.agg((F.max("row") + 1).alias("ny"), (F.max("col") + 1).alias("nx"), F.avg(finite(value)).alias("mean"))
    return out.select(F.coalesce("ny", F.lit(0)).alias("ny"), F.coalesce("nx", F.lit(0)).alias("nx"), F.lit(1).alias("layers"), F.lit(f"EPSG:{epsg}").alias("code"), "mean", F.col("mean").isNull().alias("all_missing"))
