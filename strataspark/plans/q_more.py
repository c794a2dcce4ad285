"""Imagery, audits, sweeps and report queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import imagery
from ..functions.numeric import linear_combination
from ..operators import bayes, ml, spatial, stats
from .q_space import _CORES, _GRID_SQL, _few, _grid, _part, _PART, hav
from .registry import POINTS, points, query, read, rounded


@query("cloud_mask", "SELECT l_returnflag, count(CASE WHEN l_linenumber NOT IN (1, 3) THEN 1 END) AS n_clear, round(avg(CASE WHEN l_linenumber NOT IN (1, 3) THEN l_extendedprice / 10000e0 END), 6) AS mean FROM lineitem GROUP BY 1")
def cloud_mask(spark, sf):
    li = read(spark, sf, "lineitem").select("l_returnflag", imagery.cloud_mask("l_extendedprice", "l_linenumber").alias("z"))
    return rounded(li.groupBy("l_returnflag").agg(F.count("z").alias("n_clear"), F.avg("z").alias("mean")), 6, "mean")


@query("tasseled_cap", "SELECT l_orderkey, l_linenumber, l_partkey, round(0.15e0 * l_quantity - 0.3e0 * l_tax + 0.02e0 * l_discount, 9) AS wetness FROM lineitem")
def tasseled_cap(spark, sf):
    w = linear_combination({"l_quantity": 0.15, "l_tax": -0.3, "l_discount": 0.02})
    return rounded(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", w.alias("wetness")), 9, "wetness")


@query("zscore_audit", """WITH g AS (SELECT avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS s FROM part) SELECT p_brand, round((avg(p_retailprice) - max(m)) / max(s), 6) AS z, abs((avg(p_retailprice) - max(m)) / max(s)) <= 0.1e0 AS consistent FROM part, g GROUP BY 1""")
def zscore_audit(spark, sf):
    p = read(spark, sf, "part").select("p_brand", "p_retailprice")
    pooled = F.broadcast(p.agg(F.avg("p_retailprice").alias("m"), F.stddev_samp("p_retailprice").alias("s")))
    z = imagery.zscore("mean", "m", "s")
    return rounded(p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("mean")).join(pooled).select("p_brand", z.alias("z"), imagery.consistent(z, 0.1).alias("consistent")), 6, "z")


@query("covariate_coverage", "WITH u AS (SELECT CASE WHEN l_linenumber > 3 THEN l_tax END AS tax, CASE WHEN l_linenumber > 5 THEN l_discount END AS discount, l_quantity AS quantity FROM lineitem) SELECT 'tax' AS covariate, count(tax) AS n FROM u UNION ALL SELECT 'discount', count(discount) FROM u UNION ALL SELECT 'quantity', count(quantity) FROM u")
def covariate_coverage(spark, sf):
    li = read(spark, sf, "lineitem")
    one = li.agg(F.count(F.when(F.col("l_linenumber") > 3, F.col("l_tax"))).alias("tax"), F.count(F.when(F.col("l_linenumber") > 5, F.col("l_discount"))).alias("discount"), F.count("l_quantity").alias("quantity"))
    return one.unpivot([], one.columns, "covariate", "n")


@query("report_scalars", POINTS + """SELECT round(avg(2 * abs(lon)), 6) AS mean_displacement, min(v) AS v_min, max(v) AS v_max, arg_min(id, (abs(v - 1000), id)) AS nearest_to_default, (max(v) FILTER (stratum < 10)) < (min(v) FILTER (stratum >= 10)) AS separated FROM sup""")
def report_scalars(spark, sf):
    p = points(spark, sf)
    low, high = F.max(F.when(F.col("stratum") < 10, F.col("v"))), F.min(F.when(F.col("stratum") >= 10, F.col("v")))
    return rounded(p.agg(F.avg(2 * F.abs("lon")).alias("mean_displacement"), F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.min(F.struct(F.abs(F.col("v") - 1000), "id"))["id"].alias("nearest_to_default"), (low < high).alias("separated")), 6, "mean_displacement")


@query("alternate_labels", POINTS + "SELECT id, CAST(row_number() OVER (PARTITION BY stratum ORDER BY id) % 2 AS INTEGER) AS side FROM sup")
def alternate_labels(spark, sf):
    return points(spark, sf).select("id", (F.row_number().over(Window.partitionBy("stratum").orderBy("id")) % 2).alias("side"))


_D = f"d AS (SELECT g.row, g.col, min({hav('g', 's')}) AS d FROM grid g, {_CORES} s GROUP BY 1, 2)"


@query("masked_surface", POINTS + f", {_GRID_SQL}, {_D} SELECT row, col, CASE WHEN d <= 15 THEN round(exp(-0.5e0 * pow(d / 10e0, 2)), 6) END AS w FROM d")
def masked_surface(spark, sf):
    cores = [(i, c["lon"], c["lat"]) for i, c in enumerate(_few(spark, sf))]
    g = _grid(spark).withColumn("d", spatial.nearest_of(cores, "lon", "lat")["d"])
    return rounded(g.select("row", "col", F.when(F.col("d") <= 15, bayes.kernel("d", 10.0)).alias("w")), 6, "w")


@query("length_scale_sweep", POINTS + f""", {_GRID_SQL}, w AS (SELECT g.row, g.col, l, sum(exp(-0.5e0 * pow({hav('g', 's')} / l, 2)) / ((50e0 + s.id) * (50e0 + s.id))) AS tau FROM grid g, {_CORES} s, (VALUES (5e0), (10e0), (25e0)) v(l) GROUP BY 1, 2, 3)
SELECT l AS length, round(avg(tau / (1 / 90000e0 + tau)), 6) AS mean_info, round(max(tau / (1 / 90000e0 + tau)), 6) AS max_info FROM w GROUP BY 1""")  # fmt: skip
def length_scale_sweep(spark, sf):
    g, cores, out = _grid(spark), _few(spark, sf), None
    for length in (5.0, 10.0, 25.0):
        tau, _ = bayes.sums_literal(cores, "lon", "lat", length)
        info = bayes.posterior(F.lit(0.0), F.lit(300.0), tau, F.lit(0.0))["info_frac"]
        x = g.select(info.alias("i")).agg(F.lit(length).alias("length"), F.avg("i").alias("mean_info"), F.max("i").alias("max_info"))
        out = x if out is None else out.unionByName(x)
    return rounded(out, 6, "mean_info", "max_info")


@query("implied_fraction", f"WITH {_PART} SELECT round(avg(z * 0.1e0) / avg(z), 6) AS implied, least(1 - 1e-9, 30e0 / 230e0) AS uniform FROM r")
def implied_fraction(spark, sf):
    p = _part(spark, sf)
    return rounded(p.agg((F.avg(F.col("z") * 0.1) / F.avg("z")).alias("implied"), F.first(bayes.uniform_fraction(F.lit(30.0), F.lit(230.0))).alias("uniform")), 6, "implied")


@query("area_changed", f"WITH {_PART}, x AS (SELECT z, z * (1 + (class % 5) / 10000e0) AS z2 FROM r) SELECT count(*) FILTER (abs(z2 - z) > 0.1) AS n_changed, round(count(*) FILTER (abs(z2 - z) > 0.1) * 0.01e0, 4) AS km2 FROM x")
def area_changed(spark, sf):
    p = _part(spark, sf).withColumn("z2", F.col("z") * (1 + F.pmod("class", F.lit(5)) / 10000.0))
    n = F.count_if(F.abs(F.col("z2") - F.col("z")) > 0.1)
    return rounded(p.agg(n.alias("n_changed"), (n * 0.01).alias("km2")), 4, "km2")


@query("class_labels", "SELECT p_partkey, CASE p_size WHEN 1 THEN 'water' WHEN 2 THEN 'peat' ELSE 'class ' || p_size END AS label FROM part")
def class_labels(spark, sf):
    return read(spark, sf, "part").select("p_partkey", imagery.class_label("p_size", {1: "water", 2: "peat"}).alias("label"))


@query("metric_table", "SELECT 'n' AS metric, CAST(count(*) AS DOUBLE) AS value FROM part UNION ALL SELECT 'max_price', max(p_retailprice) FROM part")
def metric_table(spark, sf):
    return stats.metric_table(read(spark, sf, "part").agg(F.count("*").alias("n"), F.max("p_retailprice").alias("max_price")), ["n", "max_price"])


@query("band_median_by_class", f"WITH {_PART} SELECT class, round(median(z), 4) AS z, count(*) AS n FROM r GROUP BY 1")
def band_median_by_class(spark, sf):
    return rounded(_part(spark, sf).groupBy("class").agg(F.median("z").alias("z"), F.count("*").alias("n")), 4, "z")


@query("forest_quantiles")
def forest_quantiles(spark, sf):
    """Half-width between the trees' 10 and 90 % quantiles."""
    s = read(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("a"), F.pmod("s_suppkey", F.lit(13)).cast("double").alias("b"), "s_acctbal")
    return ml.forest_quantiles(ml.forest(s, ["a", "b"], "s_acctbal", trees=20, depth=5), s).select("s_suppkey", "pred", "half_width")
