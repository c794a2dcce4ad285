"""Means with honest uncertainty, strata, resampling, quantiles, ranks, zones and scores."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import col, cut_bin, finite, mean_se, safe_div, t_quantile

TRUSTED_N = 8
#: Degrees of freedom of the table; beyond, the expansion is within 1e-8 (tested).
TABLE_DF = 200
#: Rows that a bootstrap broadcasts to its draws, and draws a task.
MOST_BROADCAST, TASK_DRAWS = 2_000_000, 4_000_000


def group_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sd, se, cv_pct by group; finite values only."""
    return df.groupBy(*keys).agg(*[c.alias(k) for k, c in mean_se(value).items()])


def t_table(spark: SparkSession, conf: float = 0.95, most: int = 200) -> DataFrame:
    """df -> two-sided t quantile; beyond ``most`` degrees of freedom the last row serves."""
    p = (1 + conf) / 2
    return spark.createDataFrame([(d, float(t_quantile(p, d))) for d in range(1, most + 1)], "df int, t double")


def t_beyond(df: Column, conf: float = 0.95) -> Column:
    """Two-sided t quantile for many degrees of freedom: four terms of the expansion in 1/df about the normal one."""
    z = NormalDist().inv_cdf((1 + conf) / 2)
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    v = df.cast("double")
    return sum((F.lit(c) / F.pow(v, F.lit(k)) for k, c in enumerate(terms, 1)), F.lit(z))


def t_ci(stats: DataFrame, conf: float = 0.95, most: int | None = None) -> DataFrame:
    """Adds t_lo, t_hi and trustworthy (n >= 8) to rows with n, mean, se. With ``most`` the degrees of freedom end there."""
    rows = most or TABLE_DF
    table = F.broadcast(t_table(stats.sparkSession, conf, rows))
    df = F.col("n") - 1
    out = stats.withColumn("df", F.least(df, F.lit(rows)).cast("int")).join(table, "df", "left").drop("df")
    if most is None:
        out = out.withColumn("t", F.when(df > rows, t_beyond(df, conf)).otherwise(F.col("t")))
    return out.withColumns({"t_lo": F.col("mean") - F.col("t") * F.col("se"), "t_hi": F.col("mean") + F.col("t") * F.col("se"), "trustworthy": F.col("n") >= TRUSTED_N}).drop("t")


def bootstrap_ci(df: DataFrame, keys: list[str], value: str, order: list[str], replicates: int = 10_000, conf: float = 0.95, seed: int = 1) -> DataFrame:
    """n, mean and percentile bootstrap interval of the mean by group; NULL bounds under two values.

    Draw k of replicate r takes the row (MD5 of "keys:r:k:seed", its first 15
    hex digits) mod n of its group, in ``order``: a generator that any engine
    repeats.  Rows are numbered within groups; replicates are dealt over tasks
    by their number of draws, exploded there and joined to the numbered rows on
    (group, number).  The rows are broadcast up to ``MOST_BROADCAST``, beyond it
    both sides are shuffled; the draws are never the side that is built.
    """
    x = df.select(*keys, *[c for c in order if c not in keys], finite(value).alias("_v")).filter("_v is not null")
    numbered = x.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).select(*keys, "_i", "_v")
    sizes = numbered.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))
    total = x.count()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(total * replicates / TASK_DRAWS))
    dealt = sizes.filter("n > 1").select(*keys, "n", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("_rep")).repartition(tasks, *keys, "_rep")
    draws = dealt.select(*keys, "n", "_rep", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("_k"))
    name = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.col("_rep").cast("string"), F.col("_k").cast("string"), F.lit(str(seed)))
    drawn = draws.withColumn("_i", (F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long") % F.col("n")).cast("int"))
    rows = F.broadcast(numbered) if total <= MOST_BROADCAST else numbered.hint("merge")
    means = drawn.join(rows, [*keys, "_i"]).groupBy(*keys, "_rep").agg(F.avg("_v").alias("_m"))
    a = (1 - conf) / 2
    bounds = means.groupBy(*keys).agg(F.percentile("_m", F.lit(a)).alias("boot_lo"), F.percentile("_m", F.lit(1 - a)).alias("boot_hi"))
    return sizes.join(bounds, keys, "left").withColumn("trustworthy", F.col("n") >= TRUSTED_N)


def _balanced(steps: DataFrame, n: int = 1024) -> DataFrame:
    """Adds ``b``, an ordered bucket of distinct values ``v`` with about as many in each: edges are quantiles, at most ``n``."""
    from pyspark.ml.feature import Bucketizer

    edges = steps.agg(F.percentile_approx("v", [k / n for k in range(1, n)], 10 * n)).first()[0] or []
    splits = [-float("inf"), *sorted(set(edges)), float("inf")]
    return Bucketizer(splits=splits, inputCol="v", outputCol="b").transform(steps) if len(splits) > 2 else steps.withColumn("b", F.lit(0.0))


def stratified(stats: DataFrame, weights: dict, key: str) -> DataFrame:
    """Area-weighted overall mean, se and normal interval from rows (key, mean, se). NULL if a stratum has no weight; strata without se are left out of the variance and counted."""
    pairs = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
    w = F.element_at(F.create_map(*pairs), col(key)) if pairs else F.lit(None).cast("double")
    x = stats.withColumn("_w", w)
    total = F.sum("_w")
    known = F.count("_w") == F.count("*")
    mean = F.when(known, safe_div(F.sum(F.col("_w") * F.col("mean")), total))
    se = F.when(known, F.sqrt(safe_div(F.sum(F.pow("_w", F.lit(2)) * F.pow("se", F.lit(2))), total * total)))
    return x.agg(mean.alias("mean"), se.alias("se"), F.count_if(F.col("se").isNull()).alias("n_strata_without_se")).withColumns({"lo": F.col("mean") - 1.96 * F.col("se"), "hi": F.col("mean") + 1.96 * F.col("se")})


def quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Long table (keys, prob, value) of exact quantiles, linear between order statistics."""
    q = df.groupBy(*keys).agg(F.percentile(finite(value), F.array(*[F.lit(p) for p in probs])).alias("q"))
    return q.select(*keys, F.posexplode("q").alias("_i", "value")).select(*keys, F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1).alias("prob"), "value")


def ecdf(values: DataFrame, value: str, reference: DataFrame, ref: str) -> DataFrame:
    """Adds pct, the percentage of the reference at or below each value.

    Both sides are merged and ranked once per distinct value: a running count
    over range-partitioned value groups, not a comparison of all pairs.
    """
    both = values.select(finite(value).alias("v"), F.lit(0).alias("n")).groupBy("v").agg(F.sum("n").alias("n")).unionByName(reference.select(finite(ref).alias("v"), F.lit(1).alias("n")).groupBy("v").agg(F.sum("n").alias("n")))
    steps = both.filter("v is not null").groupBy("v").agg(F.sum("n").alias("n"))
    # counts by balanced bucket first, so the running sum inside a bucket is a bounded window
    b = _balanced(steps).join(F.broadcast(steps.agg(F.sum("n").alias("total"))))
    before = b.groupBy("b").agg(F.sum("n").alias("m")).withColumn("before", F.sum("m").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.sum("n").over(Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    done = b.withColumn("within", within).join(F.broadcast(before), "b").select("v", (100 * F.try_divide(F.coalesce("before", F.lit(0)) + F.col("within"), F.col("total"))).alias("pct"))
    return values.withColumn("_v", finite(value)).join(done.withColumnRenamed("v", "_v"), "_v", "left").drop("_v")


def rank_sum(df: DataFrame, group: str, value: str, first, second) -> DataFrame:
    """Wilcoxon rank sum of two groups: n1, n2, U of the first, z with tie and continuity correction, its two-sided normal p, P(X>Y) + P(=)/2.

    Ties share one row with their counts, so the ranking runs over distinct values.
    """
    x = df.filter(col(group).isin(first, second)).select((col(group) == first).alias("a"), finite(value).alias("v")).filter("v is not null")
    steps = x.groupBy("v").agg(F.count_if("a").alias("n1"), F.count_if(~F.col("a")).alias("n2")).withColumn("t", F.col("n1") + F.col("n2"))
    b = _balanced(steps)
    before = b.groupBy("b").agg(F.sum("t").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum("t").over(Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = b.withColumn("within", within).join(F.broadcast(before), "b").withColumn("rank", F.col("before") + F.col("within") - F.col("t") + (F.col("t") + 1) / 2)
    s = ranked.agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"), F.sum(F.col("rank") * F.col("n1")).alias("r1"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    gap = u - n1 * n2 / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - safe_div(F.col("ties"), n * (n - 1))))
    z = safe_div(gap - F.signum(gap) * 0.5, sigma)
    return s.select("n1", "n2", u.alias("u"), z.alias("z"), (2 * normal_tail(F.abs(z))).alias("p"), safe_div(u, n1 * n2).alias("cles"))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0: a positive-term series below 3, a continued fraction of fixed depth beyond."""
    density = F.exp(-z * z / 2) / (2 * 3.141592653589793) ** 0.5
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(z.alias("t"), z.alias("s")), lambda a, k: F.struct((a["t"] * z * z / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * z * z / (2 * k + 1)).alias("s")))
    fraction = F.aggregate(F.reverse(F.sequence(F.lit(1), F.lit(60))), z, lambda a, k: z + k / a)
    return F.when(z.isNull(), F.lit(None).cast("double")).when(z < 3, 0.5 - density * terms["s"]).otherwise(density / fraction)


def metrics(df: DataFrame, keys: list[str], observed: str, predicted: str) -> DataFrame:
    """rmse, mae, bias, r2_cv, skill_null, n, n_obs, n_predicted (finite pairs), coverage; sums over the same finite pairs. r2_cv is NULL under two pairs or without spread; skill_null compares with the pairs' mean."""
    o, p = finite(observed), finite(predicted)
    both = o.isNotNull() & p.isNotNull()
    x = df.select(*keys, o.alias("o"), p.alias("p"), F.when(both, p - o).alias("e"), F.when(both, o).alias("ob"))
    n = F.count("e")
    sse = F.sum(F.col("e") * F.col("e"))
    sst = F.var_pop("ob") * n
    return x.groupBy(*keys).agg(n.alias("n"), F.count("o").alias("n_obs"), n.alias("n_predicted"), F.sqrt(safe_div(sse, n)).alias("rmse"), F.avg(F.abs("e")).alias("mae"), F.avg("e").alias("bias"), F.when((n >= 2) & (sst > 0), 1 - safe_div(sse, sst)).alias("r2_cv"), F.when(sst > 0, 1 - F.sqrt(safe_div(sse, sst))).alias("skill_null"), safe_div(n, F.count("o")).alias("coverage"))


def skill(rmse: Column | str, reference: Column | str) -> Column:
    return 1 - safe_div(rmse, reference)


def zonal(df: DataFrame, zone: str, value: str, cell_m: float) -> DataFrame:
    """mean, population sd, n, area and share by class; classes without a value are counted in the shares."""
    g = df.groupBy(zone).agg(F.avg(finite(value)).alias("mean"), F.stddev_pop(finite(value)).alias("sd"), F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return g.withColumns({"area_km2": F.col("n") * (cell_m / 1000) ** 2, "pct": 100 * F.col("n") / total})


def evenness(df: DataFrame, category: str) -> DataFrame:
    """k, Shannon evenness, smallest and largest share."""
    n = df.groupBy(category).agg(F.count("*").alias("n")).filter("n > 0")
    s = n.agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("nln"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    h = F.log("total") - F.col("nln") / F.col("total")
    return s.select("k", safe_div(h, F.log("k")).alias("evenness"), (F.col("lo") / F.col("total")).alias("min_share"), (F.col("hi") / F.col("total")).alias("max_share"))


def crosstab(df: DataFrame, row: str, column: str, least: float = 0.05) -> DataFrame:
    """Per row class: how many column classes hold over ``least`` of it, and the largest share."""
    n = df.groupBy(row, column).agg(F.count("*").alias("n"))
    share = n.groupBy(row).agg(F.sum("n").alias("total"), F.max("n").alias("most"), F.collect_list("n").alias("all"))
    return share.select(row, F.size(F.filter("all", lambda x: x / F.col("total") > least)).alias("n_above"), (F.col("most") / F.col("total")).alias("dominant_share"))


def inverse_variance(df: DataFrame, keys: list[str], value: str, sigma: str) -> DataFrame:
    w = F.when(col(sigma) > 0, safe_div(F.lit(1.0), col(sigma) * col(sigma)))
    w = F.when(col(value).isNotNull(), w)
    return df.groupBy(*keys).agg(safe_div(F.sum(w * col(value)), F.sum(w)).alias("mean"), safe_div(F.lit(1.0), F.sqrt(F.sum(w))).alias("sigma"), F.count(w).alias("n"))


def origin_regression(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """y = b x through the origin by group: slope, implied divisor, ratio range, largest residual, n."""
    rows = df.select(group, finite(x).alias("x"), finite(y).alias("y")).filter("x > 0 and y is not null")
    fit = rows.groupBy(group).agg(safe_div(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x"))).alias("b"), F.min(F.col("y") / F.col("x")).alias("min_ratio"), F.max(F.col("y") / F.col("x")).alias("max_ratio"), F.count("*").alias("n"))
    worst = rows.join(fit.select(group, "b"), group).groupBy(group).agg(F.max(F.abs(F.col("y") - F.col("b") * F.col("x"))).alias("max_resid"))
    return fit.join(worst, group).withColumn("divisor", safe_div(F.lit(1.0), F.col("b")))


def sigma_floor(df: DataFrame, stratum: str, value: str, floor: float | None = None) -> DataFrame:
    """Adds sigma: the stratum's sd, at least the pooled one (or ``floor``); the floor where a stratum has one row."""
    by = df.groupBy(stratum).agg(F.stddev_samp(finite(value)).alias("_s"))
    pooled = F.lit(floor) if floor is not None else None
    if pooled is None:
        means = df.groupBy(stratum).agg(F.var_samp(finite(value)).alias("v"), F.count(finite(value)).alias("n"))
        one = means.filter("n > 1").agg(F.sqrt(safe_div(F.sum((F.col("n") - 1) * F.col("v")), F.sum(F.col("n") - 1))).alias("_floor"))
        return df.join(by, stratum, "left").join(F.broadcast(one)).withColumn("sigma", F.greatest("_s", "_floor")).drop("_s", "_floor")
    return df.join(by, stratum, "left").withColumn("sigma", F.greatest(F.col("_s"), pooled)).drop("_s")


def benchmark(df: DataFrame, layers: list[str], truth: str) -> DataFrame:
    """Each layer against the truth: n, means, bias, rmse, Pearson r over complete pairs. One pass over an unpivoted table."""
    long = df.select(F.col(truth).cast("double").alias("_t"), *[F.col(c).cast("double").alias(c) for c in layers]).unpivot("_t", layers, "layer", "x")
    ok = F.col("x").isNotNull() & F.col("_t").isNotNull()
    e = F.when(ok, F.col("x") - F.col("_t"))
    return long.groupBy("layer").agg(F.count(e).alias("n"), F.avg("x").alias("layer_mean"), F.avg("_t").alias("truth_mean"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"), F.corr("x", "_t").alias("r"))


def variogram(pairs: DataFrame, distance: str, gamma: str, bins: int = 5, informative: int = 30) -> DataFrame:
    """Equal-width lag bins of a pair cloud; empty bins appear."""
    edges = F.broadcast(pairs.agg(F.min(distance).alias("_lo"), F.max(distance).alias("_hi")))
    b = pairs.join(edges).withColumn("bin", cut_bin(distance, "_lo", "_hi", bins)).groupBy("bin").agg(F.count("*").alias("n_pairs"), F.avg(distance).alias("mean_distance"), F.avg(gamma).alias("semivariance"))
    spine = pairs.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return spine.join(b, "bin", "left").withColumn("n_pairs", F.coalesce("n_pairs", F.lit(0))).withColumn("informative", F.col("n_pairs") >= informative)


def excluded(df: DataFrame, keys: list[str], core: str, flag: str) -> DataFrame:
    """Per key: how many cores are excluded and a sorted list of them."""
    x = df.filter(flag).groupBy(*keys).agg(F.count("*").alias("n_excluded"), F.array_sort(F.collect_list(core)).alias("ids"))
    return x.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ";"))


def metric_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row of measures -> (metric, value)."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "metric", "value")
