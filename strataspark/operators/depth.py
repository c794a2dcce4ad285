"""Layered samples: depth bounds, integration over windows, support and contact.

A core's segments are ordered by explicit keys.  A stock over a window that
the core doesn't reach is a lower bound: it is flagged, never rescaled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import col

SLACK = 1e-8


def depth_bounds(df: DataFrame, core: str, order: list[str], thickness: str) -> DataFrame:
    """Adds seg_index, bottom and top by a running sum; one shuffle on the core."""
    w = Window.partitionBy(core).orderBy(*order)
    bottom = F.sum(thickness).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"seg_index": F.row_number().over(w), "bottom": bottom}).withColumn("top", F.col("bottom") - F.col(thickness))


def depth_semantics(df: DataFrame, core: str, order: list[str], depth: str) -> DataFrame:
    """One row: cores with several segments, decreases, ties and the verdict whether the column holds thicknesses."""
    step = F.col(depth) - F.lag(depth).over(Window.partitionBy(core).orderBy(*order))
    per = df.select(core, step.alias("step")).groupBy(core).agg(F.count("*").alias("n"), F.count_if(F.col("step") < 0).alias("down"), F.count_if(F.col("step") == 0).alias("same"))
    total = per.agg(F.count_if(F.col("n") > 1).alias("n_multi"), F.sum("down").alias("n_decrease"), F.sum("same").alias("n_tie"))
    return total.withColumn("verdict", F.when(F.col("n_decrease") + F.col("n_tie") > 0, "thickness").otherwise("ambiguous"))


def overlap(top: Column | str, bottom: Column | str, lo, hi) -> Column:
    return F.greatest(F.lit(0.0), F.least(col(bottom), hi) - F.greatest(col(top), lo))


def integrate(df: DataFrame, keys: list[str], density: str, lo, hi, extrapolate: bool = False) -> DataFrame:
    """Per core (and further keys): stock, covered and requested depth, coverage, lower-bound flag.

    ``lo`` and ``hi`` are columns or numbers, the same for all rows of a key.
    Every core stays, also one without any overlap.  With ``extrapolate`` the
    deepest segment's density fills the gap; its share of the stock is told.
    """
    lo, hi = (F.lit(float(x)) if isinstance(x, (int, float)) else col(x) for x in (lo, hi))
    cut = overlap("top", "bottom", lo, hi)
    parts = df.select(*keys, (hi - lo).alias("requested"), cut.alias("cut"), col(density).alias("d"), F.col("bottom").alias("b"))
    # within the window an unknown density makes the stock unknown
    total = F.when(F.count_if((F.col("cut") > 0) & F.col("d").isNull()) == 0, F.coalesce(F.sum(F.when(F.col("cut") > 0, F.col("cut") * F.col("d"))), F.lit(0.0)))
    out = parts.groupBy(*keys).agg(F.max("requested").alias("requested"), F.sum("cut").alias("covered"), F.count_if(F.col("cut") > 0).alias("n_used"), total.alias("stock"), F.max(F.struct("b", "d"))["d"].alias("deepest_density"))
    out = out.withColumns({"coverage": F.try_divide("covered", "requested"), "is_lower_bound": F.col("covered") < F.col("requested") - SLACK})
    if extrapolate:
        gap = F.greatest(F.lit(0.0), F.col("requested") - F.col("covered"))
        out = out.withColumn("gap", gap).withColumn("stock_extrap", F.col("stock") + F.when(F.col("gap") > SLACK, F.col("gap") * F.col("deepest_density")).otherwise(0.0))
        out = out.withColumn("extrap_share", F.try_divide(F.col("stock_extrap") - F.col("stock"), "stock_extrap"))
    return out if extrapolate else out.drop("deepest_density")


def cube(df: DataFrame, keys: list[str], scenarios: DataFrame, windows: DataFrame, density: Column, extrapolate: bool = False) -> DataFrame:
    """Stocks for every scenario and window.

    Both are parameter tables of a few rows (checked): they are carried as an
    array literal and exploded, so there is no cartesian product to plan.
    """
    pairs = [(s, w) for s in scenarios.limit(101).collect() for w in windows.limit(101).collect()]
    if len(pairs) > 1000:
        raise ValueError("scenarios and windows are parameters, not data")
    names = [*scenarios.columns, *windows.columns]
    cells = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, [*s, *w])]) for s, w in pairs])
    wide = df.withColumn("_cell", F.explode(cells)).select("*", "_cell.*").drop("_cell").withColumn("_density", density)
    return integrate(wide, [*keys, *names], "_density", "lo", "hi", extrapolate)


def common_support(df: DataFrame, core: str) -> DataFrame:
    """One row: the depth that every core reaches and the core that limits it (ties: the smallest id)."""
    return df.groupBy(core).agg(F.max("bottom").alias("total")).agg(F.min(F.struct("total", core)).alias("m")).select(F.col("m.total").alias("common_depth"), F.col(f"m.{core}").alias("limiting_core"))


def depth_support(df: DataFrame, core: str, reference: float) -> DataFrame:
    return df.groupBy(core).agg(F.max("bottom").alias("length")).withColumn("reaches", F.col("length") >= reference - SLACK)


def peat_contact(df: DataFrame, core: str, om: str, threshold: float) -> DataFrame:
    """Per core: depth of the first segment below the threshold after the first one at or above it.

    One sorted pass: the first organic depth is a running window, no self-join.
    """
    w = Window.partitionBy(core)
    first = F.min(F.when(F.col(om) >= threshold, F.col("top"))).over(w)
    rows = df.withColumn("_first", first)
    out = rows.groupBy(core).agg(F.max("_first").alias("first_peat"), F.min(F.when((F.col(om) < threshold) & (F.col("top") > F.col("_first")), F.col("top"))).alias("contact"), F.max("bottom").alias("length"))
    outcome = F.when(F.col("first_peat").isNull(), "no_peat").when(F.col("contact").isNotNull(), "contact_observed").otherwise("still_peat")
    depth = F.when(F.col("first_peat").isNull(), 0.0).otherwise(F.coalesce("contact", "length"))
    return out.select(core, outcome.alias("outcome"), depth.alias("peat_depth"), (outcome == "still_peat").alias("is_lower_bound"))


def core_rollup(df: DataFrame, core: str, firsts: list[str], bd: str, om: str, flags: str | None = None) -> DataFrame:
    """One row per core: values of its first segment, counts, length and ranges."""
    first = [F.min(F.struct("seg_index", c))[c].alias(c) for c in firsts]
    flagged = [F.count_if(F.size(flags) > 0).alias("n_flagged")] if flags else []
    return df.groupBy(core).agg(*first, F.count("*").alias("n_segments"), F.max("bottom").alias("length"), F.min(bd).alias("bd_min"), F.max(bd).alias("bd_max"), F.min(om).alias("om_min"), F.max(om).alias("om_max"), *flagged)


def untruncated_stock(df: DataFrame, core: str, density: str, thickness: str, reach: float = 29.9) -> DataFrame:
    """The simple per-core total that isn't cut at a depth, with its own lower-bound rule."""
    return df.groupBy(core).agg(F.sum(F.col(density) * F.col(thickness) * 10).alias("stock_kgm2"), F.sum(thickness).alias("depth"), F.count("*").alias("n")).withColumn("is_lower_bound", F.col("depth") < reach)


def last_two_direction(df: DataFrame, core: str, order: list[str], value: str) -> DataFrame:
    """Whether a value rises or falls between a core's last two segments."""
    w = Window.partitionBy(core).orderBy(*[F.desc(c) for c in order])
    last = df.select(core, F.row_number().over(w).alias("r"), value).filter("r <= 2").groupBy(core).agg(F.max(F.when(F.col("r") == 1, F.col(value))).alias("last"), F.max(F.when(F.col("r") == 2, F.col(value))).alias("before"))
    return last.withColumn("direction", F.when(F.col("before").isNull(), "single").when(F.col("last") > F.col("before"), "rising").when(F.col("last") < F.col("before"), "falling").otherwise("level"))


def naive_audit(prior: DataFrame, stocks: DataFrame, cores: DataFrame, core: str, naive: str, stock: str, covered: str, lon: str) -> DataFrame:
    """An earlier table's naive sums beside properly integrated stocks: both longitudes, both totals, their ratio (NULL over 0) and the core's length. Every prior row stays."""
    own = stocks.select(core, F.col(stock).alias("proper_stock"), F.col(covered).alias("core_length"))
    place = cores.groupBy(core).agg(F.first(lon).alias("our_lon"))
    out = prior.select(core, F.col(lon).alias("prior_lon"), F.col(naive).alias("naive_sum")).join(own, core, "left").join(place, core, "left")
    return out.withColumn("ratio", F.try_divide("proper_stock", "naive_sum"))
