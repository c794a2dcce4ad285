"""Hard gates: a run that fails one stops with a named error and a remedy."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import col, near_rel

log = logging.getLogger(__name__)


class GateError(RuntimeError):
    """A gate's verdict, with what to do about it."""

    def __init__(self, title: str, *details: str, remedy: str = ""):
        super().__init__("\n".join([title, *details, *([f"Remedy: {remedy}"] if remedy else [])]))


def gate_columns(df: DataFrame, expected: list[str]) -> DataFrame:
    """Missing columns are fatal, further ones a warning. Metadata only."""
    if missing := [c for c in expected if c not in df.columns]:
        raise GateError("columns are missing", ", ".join(missing), remedy="check the header against the schema")
    if extra := [c for c in df.columns if c not in expected]:
        log.warning("unexpected columns: %s", ", ".join(extra))
    return df


def geolocation(lon: Column | str, lat: Column | str, bbox: tuple[float, float, float, float], allow_fix: bool = True) -> tuple[Column, Column]:
    """(longitude, flags): as it is where it lies in the box (xmin, ymin, xmax, ymax), flipped where only the sign is wrong."""
    lon, lat = col(lon), col(lat)
    x0, y0, x1, y1 = bbox
    inside = lambda x: x.between(x0, x1) & lat.between(y0, y1)
    missing = lon.isNull() | lat.isNull() | F.isnan(lon) | F.isnan(lat)
    good, flipped = ~missing & inside(lon), ~missing & ~inside(lon) & inside(-lon)
    fixed = F.when(flipped, -lon).otherwise(lon) if allow_fix else lon
    flags = F.array_compact(F.array(F.when(missing, F.lit("COORD_MISSING")), F.when(flipped, F.lit("LON_SIGN_REPAIRED" if allow_fix else "COORD_OUT_OF_REGION")), F.when(~missing & ~good & ~flipped, F.lit("COORD_OUT_OF_REGION"))))
    return fixed, flags


def gate_geolocation(df: DataFrame, lon: str, lat: str, bbox, allow_fix: bool = True) -> DataFrame:
    """Adds longitude_fixed and geo_flags; stops if signs are wrong and may not be fixed."""
    fixed, flags = geolocation(lon, lat, bbox, allow_fix)
    if not allow_fix:
        n = df.filter(col(lon).between(-bbox[2], -bbox[0]) & col(lat).between(bbox[1], bbox[3])).count()
        if n:
            raise GateError("longitudes have the wrong sign", f"{n} rows", remedy="allow the repair or correct the input")
    return df.withColumns({"longitude_fixed": fixed, "geo_flags": flags})


def gate_western(df: DataFrame, lon: str) -> DataFrame:
    if not df.filter(col(lon) > 0).isEmpty():
        raise GateError("a longitude is positive", remedy="run the geolocation gate first")
    return df


def reconcile(df: DataFrame, supplied: str, recomputed: str, tol: float) -> DataFrame:
    """Adds reconciles (NULL with NULL counts as equal) and abs_diff."""
    both_null = col(supplied).isNull() & col(recomputed).isNull()
    ok = both_null | F.coalesce(near_rel(recomputed, supplied, tol), F.lit(False))
    return df.withColumns({"reconciles": ok, "abs_diff": F.abs(col(supplied) - col(recomputed))})


def gate_reconcile(df: DataFrame, supplied: str, recomputed: str, tol: float, most: float = 0.5) -> DataFrame:
    """Stops if half of the rows or more don't reconcile."""
    out = reconcile(df, supplied, recomputed, tol)
    r = out.agg(F.count("*").alias("n"), F.count_if(~F.col("reconciles")).alias("bad")).first()
    if r["bad"] and r["bad"] >= most * r["n"]:
        raise GateError("the supplied values don't reconcile", f"{r['bad']} of {r['n']} rows", remedy="check the units of the supplied column")
    return out


def gate_consistent(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Stops if a group has several values of a column that should be one."""
    bad = df.groupBy(group).agg(*[(F.min(c) != F.max(c)).alias(c) for c in columns]).filter(" or ".join(f"`{c}`" for c in columns))
    if rows := bad.limit(5).collect():
        raise GateError("groups disagree with themselves", ", ".join(str(r[0]) for r in rows))
    return df


def gate_same_support(df: DataFrame, layer: str, support: str, layers: list[str]) -> DataFrame:
    """Layers of different depth support can't be combined."""
    kinds = [r[0] for r in df.filter(col(layer).isin(layers)).select(support).distinct().limit(10).collect()]
    if len(kinds) > 1:
        raise GateError("layers differ in depth support", ", ".join(map(str, kinds)))
    return df


def gate_nested(df: DataFrame, shallow: str, deep: str) -> DataFrame:
    if not df.filter(col(deep) < col(shallow)).isEmpty():
        raise GateError("a deeper interval holds less than a shallower one")
    return df


def name_factor(value: Column | str, known: dict[str, float], tol: float) -> Column:
    """Name of the nearest known factor within ``tol``, else "unrecognised"; ties by name."""
    gaps = F.array(*[F.struct(F.abs(col(value) - v).alias("gap"), F.lit(k).alias("name")) for k, v in sorted(known.items())])
    best = F.array_min(gaps)
    return F.when(best["gap"] <= tol, best["name"]).otherwise(F.lit("unrecognised"))
