"""Neighbours, distance bands, pairs, rectangles, rings and hexagons.

Points that are parameters (a few, checked) become literals in one expression.
Where both sides are tables, a grid of cells at least as wide as the search
radius turns the distance join into a hash join on cells, with the exact
distance tested afterwards.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, bearing_of, haversine_km, to_local
from ..functions.numeric import col

#: Points that may be inlined into an expression.
MOST_LITERALS = 100
_KM_PER_DEGREE = math.pi / 180 * EARTH_KM


def nearest_of(points: list[tuple], lon: Column | str, lat: Column | str) -> Column:
    """struct(d, i) of the nearest of a few points (i, lon, lat); ties: the smallest i."""
    if len(points) > MOST_LITERALS:
        raise ValueError("use nearest_join for a table of points")
    all_ = [F.struct(haversine_km(lon, lat, x, y).alias("d"), F.lit(i).alias("i")) for i, x, y in points]
    return F.least(*all_) if len(all_) > 1 else all_[0]


def _cells(df: DataFrame, lon: str, lat: str, step: float, columns: int, spread: bool) -> DataFrame:
    """Cell columns, round the globe; with ``spread`` each row goes to its cell and the eight around it."""
    x, y = F.floor((F.col(lon) + 180) * (columns / 360)), F.floor(F.col(lat) / step)
    n = F.lit(columns)
    if not spread:
        return df.withColumns({"_cx": F.pmod(x, n), "_cy": y})
    around = F.array_distinct(F.array(*[F.struct(F.pmod(x + i, n).alias("_cx"), (y + j).alias("_cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    return df.withColumn("_cell", F.explode(around)).select("*", "_cell.*").drop("_cell")


def distance_join(left: DataFrame, right: DataFrame, radius_km: float, lon="lon", lat="lat", rlon="rlon", rlat="rlat", max_lat: float | None = None) -> DataFrame:
    """Pairs within ``radius_km``, with ``d``, at any place on the globe, the 180th meridian and the poles included.

    Cells are a radius high, and wide enough at the largest latitude of the left
    side (``max_lat``; one small aggregate unless given).
    """
    step = radius_km / _KM_PER_DEGREE * 1.0001
    if max_lat is None:
        max_lat = left.agg(F.max(F.abs(F.col(lat)))).first()[0] or 0.0
    # half the widest meridian angle that a circle of this radius spans at that latitude
    reach = math.radians(min(step, 180.0))
    sine = math.sin(reach) / max(math.cos(math.radians(max_lat)), 1e-12) if reach < math.pi / 2 else 2.0
    width = math.degrees(math.asin(sine)) * 1.0001 if sine < 1 and max_lat + step < 90 else 360.0
    columns = max(1, math.floor(360 / width))
    a, b = _cells(left, lon, lat, step, columns, False), _cells(right, rlon, rlat, step, columns, True)
    return a.join(b, ["_cx", "_cy"]).withColumn("d", haversine_km(lon, lat, rlon, rlat)).filter(F.col("d") <= radius_km).drop("_cx", "_cy")


def places(df: DataFrame, *found: Column, lon="lon", lat="lat") -> DataFrame:
    """One row a place, with aggregates of its rows. Rows of one place have all distances in common, so joins of places serve tables with any number of rows a place."""
    return df.groupBy(lon, lat).agg(*found) if found else df.select(lon, lat).distinct()


def of_places(rows: DataFrame, found: DataFrame, lon="lon", lat="lat") -> DataFrame:
    """Rows with what was found for their place (lon, lat of ``found``); rows without are dropped."""
    at = found.withColumnsRenamed({"lon": "_plon", "lat": "_plat"})
    return rows.join(at, F.col(lon).eqNullSafe(F.col("_plon")) & F.col(lat).eqNullSafe(F.col("_plat"))).drop("_plon", "_plat")


def nearest_join(left: DataFrame, right: DataFrame, key: str, rid: str, start_km: float = 1.0, lon="lon", lat="lat", rlon="rlon", rlat="rlat", max_lat: float | None = None, growth: float = 4.0, others: bool = False) -> DataFrame:
    """Adds the nearest right row (rid, d) to each left key; ties, which are distances equal to nine decimals: the smallest rid. With ``others`` a row is not its own neighbour.

    Places meet, not rows: of a right place only its smallest rid counts (with
    ``others``, rows meet).  Rings grow until every place has a neighbour within
    the ring's radius; each round joins on cells, its result is kept on disk,
    and only what is left goes on.
    """
    at_ = [F.col(lon).alias("lon"), F.col(lat).alias("lat")]
    keys = [key] if others else ["lon", "lat"]
    todo, done, radius = left.select(*([key] if others else []), *at_), None, start_km
    rights = right.select(F.col(rid).alias("_rid"), F.col(rlon).alias("rlon"), F.col(rlat).alias("rlat"))
    if not others:
        todo, rights = places(todo), places(rights, F.min("_rid").alias("_rid"), lon="rlon", lat="rlat")
    half = math.pi * EARTH_KM
    while True:
        last = radius * 8 >= half
        near = _extent_pairs(todo, rights) if last else distance_join(todo, rights, radius, max_lat=max_lat)
        if others:
            near = near.filter(F.col(key) != F.col("_rid"))
        best = near.groupBy(*keys).agg(F.min(F.struct(F.round("d", 9).alias("d"), "_rid")).alias("m"), F.min("d").alias("d")).select(*keys, F.col("m._rid").alias(rid), "d").persist(StorageLevel.DISK_ONLY)
        done = best if done is None else done.unionByName(best)
        if not last:
            todo = todo.join(best.select(*keys), keys, "left_anti")
        if last or todo.isEmpty():
            return left.join(done, key) if others else of_places(left, done, lon, lat)
        radius *= growth


def _extent_pairs(at: DataFrame, rights: DataFrame, blocks: int = 64) -> DataFrame:
    """The last rows, far from everything, against all of the right side, which is dealt over ``blocks`` tasks."""
    spread = at.withColumn("_z", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return spread.join(rights.withColumn("_z", F.pmod(F.xxhash64("_rid"), F.lit(blocks)).cast("int")), "_z").withColumn("d", haversine_km("lon", "lat", "rlon", "rlat"))


def median_neighbour_km(df: DataFrame, key: str, lon="lon", lat="lat", alone: float = 5.0) -> float:
    """Median distance of rows to their nearest other row; ``alone`` under two rows."""
    points = df.select(key, F.col(lon).alias("lon"), F.col(lat).alias("lat"))
    near = nearest_join(points, points.select(F.col(key).alias("_o"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat")), key, "_o", others=True)
    found = near.agg(F.percentile("d", F.lit(0.5))).first()[0]
    return alone if found is None else found


def buffered_bbox(df: DataFrame, bbox: tuple[float, float, float, float], km: float, lon="lon", lat="lat") -> DataFrame:
    """One row xmin, ymin, xmax, ymax: the box grown to hold every point with ``km`` around it (degrees of 111.32 km)."""
    x, y = km / 111.32 / F.cos(F.radians(F.avg(lat))), km / 111.32
    return df.agg(F.least(F.lit(bbox[0]), F.min(lon) - x).alias("xmin"), F.least(F.lit(bbox[1]), F.min(lat) - y).alias("ymin"), F.greatest(F.lit(bbox[2]), F.max(lon) + x).alias("xmax"), F.greatest(F.lit(bbox[3]), F.max(lat) + y).alias("ymax"))


def bounding_box(df: DataFrame, x: str, y: str, group: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(group or [])).agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))


def buffered_ring(hull_: list[tuple[float, float]], distance: float, arc: int = 8) -> list[tuple[float, float]]:
    """A convex counter-clockwise ring grown by ``distance``: edges move out, corners become arcs of ``arc`` steps. Closed."""
    out, n = [], len(hull_)
    for k in range(n):
        (xa, ya), (x, y), (xb, yb) = hull_[k - 1], hull_[k], hull_[(k + 1) % n]
        start = math.atan2(y - ya, x - xa) - math.pi / 2 if n > 1 else 0.0
        turn = (math.atan2(yb - y, xb - x) - math.pi / 2 - start) % (2 * math.pi) if n > 1 else 2 * math.pi
        out += [(x + distance * math.cos(start + turn * j / arc), y + distance * math.sin(start + turn * j / arc)) for j in range(arc + 1)]
    return [*out, out[0]]


def hex_grid(spark: SparkSession, bbox: tuple[float, float, float, float], size: float) -> DataFrame:
    """(q, r, x, y, ring) of all pointy-top hexagons, ``size`` between centres, whose centre lies in the box."""
    xmin, ymin, xmax, ymax = bbox
    row, radius = size * math.sqrt(3) / 2, size / math.sqrt(3)
    r0, r1 = math.ceil(ymin / row), math.floor(ymax / row)
    rows = spark.range(r0, r1 + 1).select(F.col("id").alias("r")) if r1 >= r0 else spark.range(0).select(F.col("id").alias("r"))
    q0, q1 = F.ceil(F.lit(xmin / size) - F.col("r") / 2), F.floor(F.lit(xmax / size) - F.col("r") / 2)
    cells = rows.withColumns({"q0": q0, "q1": q1}).filter("q1 >= q0").select("r", F.explode(F.sequence("q0", "q1")).alias("q"))
    cells = cells.select("q", "r", ((F.col("q") + F.col("r") / 2) * size).alias("x"), (F.col("r") * row).alias("y"))
    corner = [(radius * math.cos(math.radians(60 * k + 30)), radius * math.sin(math.radians(60 * k + 30))) for k in (0, 1, 2, 3, 4, 5, 0)]
    return cells.withColumn("ring", F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in corner]))


def compare_projections(df: DataFrame, x1: str, y1: str, x2: str, y2: str) -> DataFrame:
    """Adds offset_m, the distance between two projections of a point."""
    return df.withColumn("offset_m", F.hypot(F.col(x1) - F.col(x2), F.col(y1) - F.col(y2)))


def pair_cloud(df: DataFrame, key: str, lon="lon", lat="lat", value: str | None = None, blocks: int = 16) -> DataFrame:
    """All unordered pairs (a < b) at any distance, with d and, for a value, the semivariance.

    The cloud is quadratic by definition, for frames of cores; rows are dealt
    into blocks and every two blocks meet once, so no task holds the table.
    """
    cols = [F.col(key).alias("k"), F.col(lon).alias("lon"), F.col(lat).alias("lat"), (F.col(value) if value else F.lit(None)).cast("double").alias("v")]
    rows = df.select(*cols).withColumn("i", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    left = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.select(F.col("k").alias("rk"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"), F.col("v").alias("rv"), F.col("i").alias("j"))
    out = left.join(right, "j").filter("k < rk").withColumn("d", haversine_km("lon", "lat", "rlon", "rlat")).withColumn("gamma", F.pow(F.col("v") - F.col("rv"), F.lit(2)) / 2)
    return out.select(F.col("k").alias("a"), F.col("rk").alias("b"), "d", *(["gamma"] if value else []))


def pairs_within(df: DataFrame, key: str, radius_km: float, lon="lon", lat="lat", value: str | None = None) -> DataFrame:
    """Unordered pairs (a < b) within a radius, with d and, for a value, the semivariance."""
    keep = [F.col(key).alias("a"), F.col(lon).alias("lon"), F.col(lat).alias("lat"), *([F.col(value).alias("va")] if value else [])]
    other = [F.col(key).alias("b"), F.col(lon).alias("rlon"), F.col(lat).alias("rlat"), *([F.col(value).alias("vb")] if value else [])]
    out = distance_join(df.select(*keep), df.select(*other), radius_km).filter("a < b")
    if value:
        out = out.withColumn("gamma", F.pow(F.col("va") - F.col("vb"), F.lit(2)) / 2)
    return out.select("a", "b", "d", *(["gamma"] if value else []))


def principal_axis(df: DataFrame, lon="lon", lat="lat") -> DataFrame:
    """One row: centre, bearing (0 to 180) and the share of variance along it."""
    c = F.broadcast(df.agg(F.avg(lon).alias("lon0"), F.avg(lat).alias("lat0")))
    m = df.join(c).withColumns({"x": (F.col(lon) - F.col("lon0")) * 111_320.0 * F.cos(F.radians("lat0")), "y": (F.col(lat) - F.col("lat0")) * 111_320.0})
    s = m.agg(F.first("lon0").alias("lon0"), F.first("lat0").alias("lat0"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("cxy"))
    root = F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, F.lit(2)) + F.pow("cxy", F.lit(2)))
    return s.select("lon0", "lat0", bearing_of("vx", "vy", "cxy").alias("bearing"), F.try_divide((F.col("vx") + F.col("vy")) / 2 + root, F.col("vx") + F.col("vy")).alias("share"))


def along_across(lon: Column | str, lat: Column | str, lon0: float, lat0: float, bearing: float) -> tuple[Column, Column]:
    """Kilometres along and across a bearing, from an origin."""
    x, y = to_local(lon, lat, lon0, lat0)
    b = math.radians(bearing)
    return (x * math.sin(b) + y * math.cos(b)) / 1000, (x * math.cos(b) - y * math.sin(b)) / 1000


def oriented_rectangle(df: DataFrame, lon: str, lat: str, lon0: float, lat0: float, bearing: float, along_km: float = 0.0, across_km: float = 0.0) -> DataFrame:
    """One row: extents along and across with buffers, length, width and area in km, and the closed ring of five corners."""
    a, c = along_across(lon, lat, lon0, lat0, bearing)
    r = df.agg((F.min(a) - along_km).alias("a0"), (F.max(a) + along_km).alias("a1"), (F.min(c) - across_km).alias("c0"), (F.max(c) + across_km).alias("c1"))
    r = r.withColumns({"length_km": F.col("a1") - F.col("a0"), "width_km": F.col("c1") - F.col("c0")}).withColumn("area_km2", F.col("length_km") * F.col("width_km"))
    b = math.radians(bearing)
    kx, ky = 111_320.0 * math.cos(math.radians(lat0)), 111_320.0

    def corner(along: str, across: str) -> Column:
        x = (F.col(along) * math.sin(b) + F.col(across) * math.cos(b)) * 1000
        y = (F.col(along) * math.cos(b) - F.col(across) * math.sin(b)) * 1000
        return F.struct((x / kx + lon0).alias("lon"), (y / ky + lat0).alias("lat"))

    return r.withColumn("ring", F.array(*[corner(*k) for k in (("a0", "c0"), ("a1", "c0"), ("a1", "c1"), ("a0", "c1"), ("a0", "c0"))]))


def in_rectangle(lon, lat, lon0: float, lat0: float, bearing: float, a0: float, a1: float, c0: float, c1: float) -> Column:
    a, c = along_across(lon, lat, lon0, lat0, bearing)
    return a.between(a0, a1) & c.between(c0, c1)


def in_ring(x: Column | str, y: Column | str, ring: list[tuple[float, float]]) -> Column:
    """Ray casting, half-open in y; a closing vertex may be given or not. Odd crossings are inside."""
    if ring[0] == ring[-1]:
        ring = ring[:-1]
    x, y = col(x), col(y)
    n = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
        if y1 == y2:
            continue
        cross = (F.lit(y1) > y) != (F.lit(y2) > y)
        at = F.lit(x1) + (y - y1) * ((x2 - x1) / (y2 - y1))
        n = n + (cross & (x < at)).cast("int")
    return F.pmod(n, F.lit(2)) == 1


def densify(ring: list[tuple[float, float]], n: int) -> list[tuple[float, float]]:
    """n - 1 points an edge and the closing one."""
    if ring[0] != ring[-1]:
        ring = [*ring, ring[0]]
    out = [(x1 + (x2 - x1) * k / (n - 1), y1 + (y2 - y1) * k / (n - 1)) for (x1, y1), (x2, y2) in zip(ring, ring[1:]) for k in range(n - 1)]
    return [*out, out[0]]


def coverage(df: DataFrame, distance: str, radii: list[float], cell_km2: float) -> DataFrame:
    """Per radius: percentage and area within it. One pass; the radii are columns, then unpivoted."""
    one = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(distance) <= r).alias(str(i)) for i, r in enumerate(radii)])
    long = one.unpivot("n", [str(i) for i in range(len(radii))], "i", "within")
    return long.select(F.element_at(F.array(*[F.lit(float(r)) for r in radii]), F.col("i").cast("int") + 1).alias("radius_km"), (100 * F.try_divide("within", "n")).alias("pct"), (F.col("within") * cell_km2).alias("area_km2"))


def hex_bin(x: Column | str, y: Column | str, size: float) -> tuple[Column, Column]:
    """Axial coordinates (q, r) of pointy-top hexagons whose centres are ``size`` apart."""
    radius = size / math.sqrt(3)
    q = (col(x) * (math.sqrt(3) / 3) - col(y) / 3) / radius
    r = col(y) * (2 / 3) / radius
    rq, rr, rs = F.round(q), F.round(r), F.round(-q - r)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
    return (F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq).cast("long"), F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr).cast("long"))


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Hull of a small collected set (monotone chain), counter-clockwise, open."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    lower, upper = half(pts), half(pts[::-1])
    return lower[:-1] + upper[:-1]


def hull(df: DataFrame, x: str, y: str, group: list[str] | None = None) -> DataFrame:
    """Convex hull per group: partial hulls where rows are read, then one hull of the few that are left."""
    keys = group or []
    schema = ", ".join([*[f"`{k}` {dict(df.dtypes)[k]}" for k in keys], "x double, y double"])

    def partial(frames):
        import pandas as pd

        for f in frames:
            for k, g in f.groupby(keys, dropna=False) if keys else [((), f)]:
                h = convex_hull(list(zip(g["x"], g["y"])))
                yield pd.DataFrame({**dict(zip(keys, k if isinstance(k, tuple) else (k,))), "x": [p[0] for p in h], "y": [p[1] for p in h]})

    some = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna(subset=["x", "y"]).mapInPandas(partial, schema)

    def final(f):
        import pandas as pd

        h = convex_hull(list(zip(f["x"], f["y"])))
        return pd.DataFrame({**{k: f[k].iloc[0] for k in keys}, "x": [p[0] for p in h], "y": [p[1] for p in h]})

    return some.groupBy(*keys).applyInPandas(final, schema)
