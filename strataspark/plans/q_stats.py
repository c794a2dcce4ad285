"""Statistics, cross-validation and ML queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cv, ml, stats
from ..operators.raster import composite_median, remap
from ..streaming.updates import sessions, tumbling
from .registry import POINTS, hav, points, query, read, rounded

#: Trees of the forests that are refitted for every draw (the operators' default is 500).
IMPORTANCE_TREES = 50


def _t_sql(df: str) -> str:
    """The 0.975 quantile of t for over 200 degrees of freedom: the expansion about the normal quantile, as numbers."""
    z = 1.959963984540054
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    return "(" + " + ".join([repr(z), *(f"{c!r} / pow({df}, {k})" for k, c in enumerate(terms, 1))]) + ")"


@query("stratum_stats", f"""WITH g AS (SELECT o_orderpriority AS stratum, count(*) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS sd FROM orders GROUP BY 1)
SELECT stratum, n, round(mean, 3) AS mean, round(sd, 3) AS sd, round(sd / sqrt(n), 4) AS se, round(100 * sd / mean, 4) AS cv_pct, round(mean - {_t_sql('(n - 1e0)')} * sd / sqrt(n), 2) AS t_lo, round(mean + {_t_sql('(n - 1e0)')} * sd / sqrt(n), 2) AS t_hi, n >= 8 AS trustworthy FROM g""")  # fmt: skip
def stratum_stats(spark, sf):
    out = stats.t_ci(stats.group_stats(read(spark, sf, "orders").withColumnRenamed("o_orderpriority", "stratum"), ["stratum"], "o_totalprice"))
    return rounded(rounded(rounded(out, 3, "mean", "sd"), 4, "se", "cv_pct"), 2, "t_lo", "t_hi")


_W = {"1-URGENT": 3.0, "2-HIGH": 2.0, "3-MEDIUM": 1.0, "4-NOT SPECIFIED": 1.0, "5-LOW": 4.0}


@query("stratified_area_weighted", f"""WITH g AS (SELECT o_orderpriority AS k, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) / sqrt(count(*)) AS se FROM orders GROUP BY 1), w AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}e0)" for k, v in _W.items())}) v(k, w))
SELECT round(sum(w * mean) / sum(w), 3) AS mean, round(sqrt(sum(w * w * se * se)) / sum(w), 4) AS se, count(*) FILTER (se IS NULL) AS n_strata_without_se FROM g JOIN w USING (k)""")  # fmt: skip
def stratified_area_weighted(spark, sf):
    g = stats.group_stats(read(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice")
    return rounded(rounded(stats.stratified(g, _W, "o_orderpriority"), 3, "mean"), 4, "se").select("mean", "se", "n_strata_without_se")


@query("excluded_list", "WITH c AS (SELECT s_nationkey, s_suppkey FROM supplier WHERE s_acctbal < 0) SELECT s_nationkey, count(*) AS n_excluded, string_agg(CAST(s_suppkey AS VARCHAR), ';' ORDER BY s_suppkey) AS ids FROM c GROUP BY 1")
def excluded_list(spark, sf):
    return stats.excluded(read(spark, sf, "supplier").withColumn("low", F.col("s_acctbal") < 0), ["s_nationkey"], "s_suppkey", "low")


@query("bootstrap_ci", """WITH x AS (SELECT s_nationkey AS k, s_acctbal AS v, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS i FROM supplier),
z AS (SELECT k, count(*) AS n, avg(v) AS mean FROM x GROUP BY 1), d AS (SELECT k, n, r, unnest(range(1, n + 1)) AS j FROM z, range(1, 10001) t(r) WHERE n > 1),
m AS (SELECT d.k, d.r, avg(v) AS m FROM d JOIN x ON x.k = d.k AND x.i = CAST('0x' || substr(md5(d.k || ':' || d.r || ':' || d.j || ':1'), 1, 15) AS BIGINT) % d.n GROUP BY 1, 2),
b AS (SELECT k, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM m GROUP BY 1)
SELECT k AS s_nationkey, n, round(mean, 4) AS mean, round(lo, 4) AS boot_lo, round(hi, 4) AS boot_hi, n >= 8 AS trustworthy FROM z LEFT JOIN b USING (k)""")  # fmt: skip
def bootstrap_ci(spark, sf):
    return rounded(stats.bootstrap_ci(read(spark, sf, "supplier"), ["s_nationkey"], "s_acctbal", ["s_suppkey"]), 4, "mean", "boot_lo", "boot_hi")


@query("quantiles_type7", """WITH q AS (SELECT o_orderpriority, quantile_cont(o_totalprice, [0.05, 0.25, 0.5, 0.75, 0.95]) AS q FROM orders GROUP BY 1)
SELECT o_orderpriority, unnest([0.05e0, 0.25e0, 0.5e0, 0.75e0, 0.95e0]) AS prob, round(unnest(q), 4) AS value FROM q""")  # fmt: skip
def quantiles_type7(spark, sf):
    return rounded(stats.quantiles(read(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice", [0.05, 0.25, 0.5, 0.75, 0.95]), 4, "value")


@query("ecdf_percentile", "SELECT s_suppkey, round((SELECT 100e0 * avg(CASE WHEN c_acctbal <= s_acctbal THEN 1e0 ELSE 0e0 END) FROM customer), 6) AS pct FROM supplier")
def ecdf_percentile(spark, sf):
    return rounded(stats.ecdf(read(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", read(spark, sf, "customer"), "c_acctbal"), 6, "pct").select("s_suppkey", "pct")


@query("ranksum_u", """WITH x AS (SELECT o_orderpriority = '1-URGENT' AS a, CAST(floor(o_totalprice / 100) AS DOUBLE) AS v FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')),
r AS (SELECT a, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2e0 AS rk, count(*) OVER () AS n FROM x), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM x GROUP BY v)),
s AS (SELECT CAST(count(*) FILTER (a) AS DOUBLE) AS n1, CAST(count(*) FILTER (NOT a) AS DOUBLE) AS n2, sum(rk) FILTER (a) AS r1 FROM r), u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 + n2 AS n FROM s, t)
SELECT CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, u, round((u - n1 * n2 / 2 - sign(u - n1 * n2 / 2) * 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))), 6) AS z, round(u / (n1 * n2), 6) AS cles FROM u""")  # fmt: skip
def ranksum_u(spark, sf):
    o = read(spark, sf, "orders").select("o_orderpriority", F.floor(F.col("o_totalprice") / 100).cast("double").alias("v"))
    return rounded(stats.rank_sum(o, "o_orderpriority", "v", "1-URGENT", "5-LOW"), 6, "z", "cles").drop("p")


@query("metrics_block", """WITH x AS (SELECT l_returnflag AS g, l_extendedprice AS o, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity * 1000 END AS p FROM lineitem), y AS (SELECT *, p - o AS e FROM x)
SELECT g AS l_returnflag, count(e) AS n, count(o) AS n_obs, count(e) AS n_predicted, round(sqrt(avg(e * e)), 3) AS rmse, round(avg(abs(e)), 3) AS mae, round(avg(e), 3) AS bias, round(1 - sum(e * e) / (var_pop(o) FILTER (e IS NOT NULL) * count(e)), 6) AS r2_cv, round(1 - sqrt(avg(e * e)) / stddev_pop(o) FILTER (e IS NOT NULL), 6) AS skill_null, round(count(e) / CAST(count(o) AS DOUBLE), 6) AS coverage FROM y GROUP BY 1""")  # fmt: skip
def metrics_block(spark, sf):
    li = read(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", F.when(F.col("l_linenumber") != 3, F.col("l_quantity") * 1000).alias("p"))
    return rounded(rounded(stats.metrics(li, ["l_returnflag"], "l_extendedprice", "p"), 3, "rmse", "mae", "bias"), 6, "r2_cv", "skill_null", "coverage")


@query("benchmark_layers", """WITH u AS (UNPIVOT (SELECT l_extendedprice / 1000 AS t, l_quantity AS quantity, l_tax * 100 AS tax FROM lineitem) ON quantity, tax INTO NAME layer VALUE x)
SELECT layer, count(*) AS n, round(avg(x), 4) AS layer_mean, round(avg(t), 4) AS truth_mean, round(avg(x - t), 4) AS bias, round(sqrt(avg((x - t) * (x - t))), 4) AS rmse, round(corr(x, t), 6) AS r FROM u GROUP BY 1""")  # fmt: skip
def benchmark_layers(spark, sf):
    li = read(spark, sf, "lineitem").select((F.col("l_extendedprice") / 1000).alias("t"), F.col("l_quantity").alias("quantity"), (F.col("l_tax") * 100).alias("tax"))
    return rounded(rounded(stats.benchmark(li, ["quantity", "tax"], "t"), 4, "layer_mean", "truth_mean", "bias", "rmse"), 6, "r")


@query("zonal_stats", "SELECT p_brand, round(avg(p_retailprice), 4) AS mean, round(stddev_pop(p_retailprice), 4) AS sd, count(*) AS n, round(count(*) * 0.0625e0, 4) AS area_km2, round(100e0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM part GROUP BY 1")
def zonal_stats(spark, sf):
    return rounded(stats.zonal(read(spark, sf, "part"), "p_brand", "p_retailprice", 250.0), 4, "mean", "sd", "area_km2", "pct")


@query("evenness", """WITH c AS (SELECT event_type, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p FROM c)
SELECT count(*) AS k, round(-sum(p * ln(p)) / ln(count(*)), 6) AS evenness, round(min(p), 6) AS min_share, round(max(p), 6) AS max_share FROM p""")  # fmt: skip
def evenness(spark, sf):
    return rounded(stats.evenness(read(spark, sf, "events"), "event_type"), 6, "evenness", "min_share", "max_share")


@query("crosstab_dominance", """WITH c AS (SELECT user_id % 20 AS g, event_type, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2), p AS (SELECT g, n / sum(n) OVER (PARTITION BY g) AS p FROM c)
SELECT g, CAST(count(*) FILTER (p > 0.19e0) AS INTEGER) AS n_above, round(max(p), 6) AS dominant_share FROM p GROUP BY 1""")  # fmt: skip
def crosstab_dominance(spark, sf):
    return rounded(stats.crosstab(read(spark, sf, "events").withColumn("g", F.pmod("user_id", F.lit(20))), "g", "event_type", 0.19), 6, "dominant_share")


@query("histogram", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def histogram(spark, sf):
    return read(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


@query("remap_classes", """WITH m AS (SELECT p_brand, avg(p_retailprice) AS v FROM part GROUP BY 1 HAVING count(*) > 75)
SELECT p_partkey, round(v, 4) AS v, CASE WHEN v IS NULL THEN 'class ' || p_brand ELSE 'mapped' END AS label FROM part LEFT JOIN m USING (p_brand)""")  # fmt: skip
def remap_classes(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    table = p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("v"), F.count("*").alias("n")).withColumn("v", F.when(F.col("n") > 75, F.col("v")))
    out = remap(p.select("p_partkey", "p_brand"), "p_brand", table, "v")
    return rounded(out, 4, "v").select("p_partkey", "v", F.when(F.col("v").isNull(), F.concat(F.lit("class "), "p_brand")).otherwise("mapped").alias("label"))


@query("season_composite", "SELECT CAST(l_partkey % 100 AS BIGINT) AS cell, round(median(l_extendedprice), 4) AS z FROM lineitem WHERE dayofyear(l_shipdate) BETWEEN 182 AND 244 AND year(l_shipdate) BETWEEN 1994 AND 1996 AND l_discount < 0.08 GROUP BY 1")
def season_composite(spark, sf):
    li = read(spark, sf, "lineitem").filter(F.dayofyear("l_shipdate").between(182, 244) & F.year("l_shipdate").between(1994, 1996) & (F.col("l_discount") < 0.08))
    return rounded(composite_median(li.select(F.pmod("l_partkey", F.lit(100)).alias("cell"), F.col("l_extendedprice").alias("z")), ["cell"], ["z"]), 4, "z")


@query("sigma_floor", POINTS + """, g AS (SELECT stratum, var_samp(v) AS s2, count(*) AS n FROM sup GROUP BY 1), f AS (SELECT sqrt(sum((n - 1) * s2) / sum(n - 1)) AS floor FROM g WHERE n > 1)
SELECT id, round(greatest(coalesce(sqrt(s2), floor), floor), 4) AS sigma FROM sup JOIN g USING (stratum), f""")  # fmt: skip
def sigma_floor(spark, sf):
    return rounded(stats.sigma_floor(points(spark, sf), "stratum", "v"), 4, "sigma").select("id", "sigma")


@query("inverse_variance_mean", "WITH x AS (SELECT l_returnflag, l_extendedprice AS v, CASE WHEN l_tax > 0 THEN 1 / (l_tax * l_tax) END AS w FROM lineitem) SELECT l_returnflag, round(sum(v * w) / sum(w), 3) AS mean, round(1 / sqrt(sum(w)), 8) AS sigma, count(w) AS n FROM x GROUP BY 1")
def inverse_variance_mean(spark, sf):
    return rounded(rounded(stats.inverse_variance(read(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_tax"), 3, "mean"), 8, "sigma")


# ---------------------------------------------------------------- cross-validation

_CV = """WITH d AS (SELECT o_custkey % 50 AS g, o_totalprice / 1000e0 AS y, CAST(o_orderkey % 97 AS DOUBLE) + o_totalprice / 5000e0 AS x, o_orderpriority AS stratum, CAST(o_orderkey % 31 AS DOUBLE) AS x2 FROM orders)"""


def _cv_frame(spark, sf):
    o = read(spark, sf, "orders")
    k = lambda n: F.pmod("o_orderkey", F.lit(n)).cast("double")
    return o.select(F.pmod("o_custkey", F.lit(50)).alias("g"), (F.col("o_totalprice") / 1000).alias("y"), (k(97) + F.col("o_totalprice") / 5000).alias("x"), F.col("o_orderpriority").alias("stratum"), k(31).alias("x2"))


_SCORE = "SELECT count(*) AS n, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(p - y), 6) AS bias, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) AS r2_cv FROM f"


def _scores(df):
    return rounded(stats.metrics(df, [], "y", "pred"), 6, "rmse", "bias", "r2_cv").select("n", "rmse", "bias", "r2_cv")


@query("cv_logo_null", _CV + ", s AS (SELECT g, sum(y) AS sy, count(*) AS n FROM d GROUP BY 1), t AS (SELECT sum(sy) AS ty, sum(n) AS tn FROM s), f AS (SELECT y, (ty - sy) / (tn - n) AS p FROM d JOIN s USING (g), t) " + _SCORE)
def cv_logo_null(spark, sf):
    return _scores(cv.leave_group_out(_cv_frame(spark, sf), [], "g", "y"))


def _ols_sql(group):
    return _CV + f""", s AS (SELECT {group} AS k, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM d GROUP BY 1), t AS (SELECT sum(n) AS tn, sum(sx) AS tx, sum(sy) AS ty, sum(sxx) AS txx, sum(sxy) AS txy FROM s),
c AS (SELECT k, tn - n AS n, tx - sx AS sx, ty - sy AS sy, txx - sxx AS sxx, txy - sxy AS sxy FROM s, t), b AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b FROM c), f AS (SELECT y, (sy - b * sx) / n + b * x AS p FROM d JOIN b ON d.{group} = b.k) """ + _SCORE  # fmt: skip


@query("cv_logo_ols", _ols_sql("g"))
def cv_logo_ols(spark, sf):
    return _scores(cv.leave_group_out(_cv_frame(spark, sf), [], "g", "y", "x"))


@query("cv_loso_ols", _ols_sql("stratum"))
def cv_loso_ols(spark, sf):
    return _scores(cv.leave_group_out(_cv_frame(spark, sf), [], "stratum", "y", "x"))


@query("screen_covariates", _CV + """, u AS (UNPIVOT (SELECT g, y, x, x2 FROM d) ON x, x2 INTO NAME covariate VALUE v), s AS (SELECT covariate, g, count(*) AS n, sum(v) AS sx, sum(y) AS sy, sum(v * v) AS sxx, sum(v * y) AS sxy FROM u GROUP BY 1, 2),
t AS (SELECT covariate, sum(n) AS tn, sum(sx) AS tx, sum(sy) AS ty, sum(sxx) AS txx, sum(sxy) AS txy FROM s GROUP BY 1), c AS (SELECT covariate, g, tn - n AS n, tx - sx AS sx, ty - sy AS sy, txx - sxx AS sxx, txy - sxy AS sxy FROM s JOIN t USING (covariate)),
b AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b FROM c), e AS (SELECT covariate, y, (sy - b * sx) / n + b * v AS p FROM u JOIN b USING (covariate, g)),
m AS (SELECT covariate, sqrt(avg((p - y) * (p - y))) AS rmse FROM e GROUP BY 1) SELECT covariate, round(rmse, 6) AS rmse, CAST(row_number() OVER (ORDER BY rmse, covariate) AS INTEGER) AS rank, CAST(count(*) OVER () AS INTEGER) AS n_candidates FROM m""")  # fmt: skip
def screen_covariates(spark, sf):
    return rounded(cv.screen(_cv_frame(spark, sf), ["x", "x2"], "g", "y"), 6, "rmse").select("covariate", "rmse", "rank", "n_candidates")


# least squares on x, on the prior too, the mean, and the prior alone, each without the row's group
_FOLDS = ", ".join(f"""s_{g} AS (SELECT {g} AS k, count(*) AS n, sum(x) AS sx, sum(p0) AS sp, sum(y) AS sy, sum(x * x) AS sxx, sum(x * p0) AS sxp, sum(p0 * p0) AS spp, sum(x * y) AS sxy, sum(p0 * y) AS spy FROM d GROUP BY 1),
c_{g} AS (SELECT s.k, t.n - s.n AS n, t.sx - s.sx AS sx, t.sp - s.sp AS sp, t.sy - s.sy AS sy, t.sxx - s.sxx AS sxx, t.sxp - s.sxp AS sxp, t.spp - s.spp AS spp, t.sxy - s.sxy AS sxy, t.spy - s.spy AS spy FROM s_{g} s, (SELECT sum(n) AS n, sum(sx) AS sx, sum(sp) AS sp, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxp) AS sxp, sum(spp) AS spp, sum(sxy) AS sxy, sum(spy) AS spy FROM s_{g}) t),
v_{g} AS (SELECT *, sxx - sx * sx / n AS vx, spp - sp * sp / n AS vp, sxp - sx * sp / n AS vxp, sxy - sx * sy / n AS vxy, spy - sp * sy / n AS vpy FROM c_{g}),
f_{g} AS (SELECT d.id, d.y, sy / n AS pn, sy / n + vxy / vx * (x - sx / n) AS pa, p0 AS pp, sy / n + (vxy * vp - vpy * vxp) / (vx * vp - vxp * vxp) * (x - sx / n) + (vpy * vx - vxy * vxp) / (vx * vp - vxp * vxp) * (p0 - sp / n) AS pb FROM d JOIN v_{g} ON k = d.{g}),
w_{g} AS (SELECT a.id, sum(exp(-0.5e0 * pow({hav("a", "b")} / 5e0, 2))) AS w, sum(exp(-0.5e0 * pow({hav("a", "b")} / 5e0, 2)) * (b.y - b.p0)) AS wr FROM d a JOIN d b ON a.{g} <> b.{g} AND {hav("a", "b")} <= 20 GROUP BY 1),
l_{g} AS (SELECT y, unnest(['N', 'A', 'P', 'B', 'C']) AS model, unnest([pn, pa, pp, pb, pp + coalesce(wr / (1 + w), 0)]) AS p FROM f_{g} LEFT JOIN w_{g} USING (id)),
m_{g} AS (SELECT model, count(*) AS n, sqrt(avg((p - y) * (p - y))) AS rmse, 1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)) AS r2 FROM l_{g} GROUP BY 1)""" for g in ("core", "stratum"))
_CANDIDATES = POINTS + f""", d AS (SELECT id, lon, lat, id % 20 AS core, id % 3 AS stratum, v / 1000 AS y, v / 2000 + (id % 7) / 3e0 AS x, v / 1500 + (id % 5) / 2e0 AS p0 FROM sup), {_FOLDS},
r AS (SELECT model, a.n, a.rmse, a.r2 AS loco_r2, b.r2 AS loso_r2, max(CASE WHEN model = 'P' THEN a.rmse END) OVER () AS map_rmse FROM m_core a JOIN m_stratum b USING (model)) """


def _scored(spark, sf):
    p, k = points(spark, sf), lambda n: F.pmod("id", F.lit(n))
    d = p.select("id", "lon", "lat", k(20).alias("core"), k(3).alias("stratum"), (F.col("v") / 1000).alias("y"), (F.col("v") / 2000 + k(7) / 3).alias("x"), (F.col("v") / 1500 + k(5) / 2).alias("p0"))
    return cv.candidate_scores(d, "id", "core", "stratum", "y", ["x"], cv.prior_anchor(d, ["p0"]), 5.0, 20.0)


@query("candidate_scores", _CANDIDATES + "SELECT model, n, round(rmse, 6) AS rmse, round(loco_r2, 6) AS loco_r2, round(loso_r2, 6) AS loso_r2, round(map_rmse, 6) AS map_rmse FROM r")
def candidate_scores(spark, sf):
    return rounded(_scored(spark, sf), 6, "rmse", "loco_r2", "loso_r2", "map_rmse").drop("loso_coverage")


@query("model_selection", _CANDIDATES + """, q AS (SELECT model FROM r WHERE model IN ('A', 'B', 'C') AND loco_r2 > 0 AND loso_r2 > 0 AND rmse < map_rmse ORDER BY loso_r2 DESC, model LIMIT 1) SELECT coalesce((SELECT model FROM q), 'C') AS model, EXISTS (SELECT 1 FROM q) AS qualified""")
def model_selection(spark, sf):
    return cv.select_model(_scored(spark, sf))


@query("stratum_transfer", _ols_sql("stratum").replace(_SCORE, "").replace("f AS (SELECT y, ", "f AS (SELECT d.stratum, y, ") + " SELECT stratum, count(*) AS n, round(avg(p - y), 6) AS bias, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse FROM f GROUP BY 1")
def stratum_transfer(spark, sf):
    out = stats.metrics(cv.leave_group_out(_cv_frame(spark, sf), [], "stratum", "y", "x"), ["stratum"], "y", "pred")
    return rounded(out, 6, "bias", "rmse").select("stratum", "n", "bias", "rmse")


# ---------------------------------------------------------------- embeddings and models


@query("embedding_nn", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS other, list_distance(a.v, b.v) AS d FROM e a, e b WHERE a.vec_id <> b.vec_id)
SELECT vec_id, arg_min(other, (d, other)) AS nearest, round(min(d), 6) AS distance FROM p GROUP BY 1""")  # fmt: skip
def embedding_nn(spark, sf):
    return rounded(ml.embedding_nearest(read(spark, sf, "embeddings"), "vec_id", "embedding"), 6, "distance")


@query("kmeans_shares")
def kmeans_shares(spark, sf):
    out = ml.kmeans(read(spark, sf, "embeddings"), "embedding", 6, "vec_id")
    return stats.zonal(out.withColumn("one", F.lit(1.0)), "cluster", "one", 10.0).select("cluster", "n", "pct")


@query("forest_predict")
def forest_predict(spark, sf):
    li = read(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("a"), F.pmod("s_suppkey", F.lit(13)).cast("double").alias("b"), F.lit(1.0).alias("flat"), "s_acctbal")
    return ml.forest_predict(ml.forest(li, ["a", "b", "flat"], "s_acctbal", trees=20, depth=5), li).select("s_suppkey", "pred")


@query("rf_importance")
def rf_importance(spark, sf):
    s = read(spark, sf, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("balance"), F.count("*").cast("double").alias("n"))
    frame = s.select(F.pmod("s_nationkey", F.lit(5)).alias("g"), "balance", "n", (F.col("balance") * 3).alias("y"))
    return ml.importance(frame, ["balance", "n"], "y", "g", trees=IMPORTANCE_TREES)


@query("forest_validation")
def forest_validation(spark, sf):
    s = read(spark, sf, "supplier").groupBy("s_nationkey").agg(F.avg("s_acctbal").alias("balance"), F.count("*").cast("double").alias("n"))
    return ml.forest_validation(s.withColumn("y", F.col("balance") * 3), ["balance", "n"], "y", "s_nationkey", trees=IMPORTANCE_TREES)


@query("ols_insample", """WITH d AS (SELECT v AS y, lon AS a, lat AS b FROM sup), m AS (SELECT avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(y) AS vy, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cab, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby, count(*) AS n FROM d),
s AS (SELECT *, (cay * vb - cby * cab) / (va * vb - cab * cab) AS ba, (cby * va - cay * cab) / (va * vb - cab * cab) AS bb FROM m) SELECT n, round(ba, 4) AS slope_a, round(bb, 4) AS slope_b, round((ba * cay + bb * cby) / vy, 6) AS r2, 'flat' AS dropped FROM s""".join([POINTS + ", ", ""]).replace("WITH d AS", "d AS"))  # fmt: skip
def ols_insample(spark, sf):
    d = points(spark, sf).select(F.col("v").alias("y"), F.col("lon").alias("a"), F.col("lat").alias("b"), F.lit(2.0).alias("flat"))
    m = cv.ols(d, ["a", "b", "flat"], "y")
    return spark.createDataFrame([(m["n"], round(m["slopes"]["a"], 4), round(m["slopes"]["b"], 4), round(m["r2"], 6), ";".join(m["dropped"]))], "n long, slope_a double, slope_b double, r2 double, dropped string")


# ---------------------------------------------------------------- extensions on the event table


@query("ext_tumbling", "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_tumbling(spark, sf):
    return rounded(tumbling(read(spark, sf, "events"), "ts", "1 hour", ["event_type"], "value"), 4, "total")


@query("ext_session", """WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 minutes THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")  # fmt: skip
def ext_session(spark, sf):
    return rounded(sessions(read(spark, sf, "events"), "ts", "30 minutes", "user_id", "value"), 4, "total")
