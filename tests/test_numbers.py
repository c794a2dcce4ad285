"""Closed-form expectations of the column functions and operators."""

import math
import time

import pytest
from pyspark.sql import functions as F

from strataspark.functions import numeric as N
from strataspark.functions import units as U
from strataspark.functions.geo import Lcc, haversine_km
from strataspark.operators import bayes, cv, depth, flags, gates, ml, raster, spatial, stats
from strataspark.operators.gates import GateError
from strataspark.operators.raster import Grid
from strataspark.plans import tiles
from strataspark.plans.stages import Stage, run


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_numeric(spark):
    lit = F.lit
    assert one(spark, N.trailing_int(lit("PM-03-A-2"))) == 2 and one(spark, N.trailing_int(lit("PM-02-A-10"))) == 10 and one(spark, N.trailing_int(lit("PM-01-A"))) is None
    assert one(spark, N.finite(lit(float("nan")))) is None and one(spark, N.finite(lit(float("inf")))) is None and one(spark, N.finite(lit(2))) == 2.0
    assert one(spark, N.safe_div(lit(1.0), lit(0.0))) is None
    assert one(spark, N.near_rel(lit(1.01), lit(1.0), 0.02)) and not one(spark, N.near_rel(lit(1.03), lit(1.0), 0.02)) and one(spark, N.near_rel(lit(1e-9), lit(0.0), 1e-8))
    assert one(spark, N.truthy(lit("Yes"))) and not one(spark, N.truthy(lit(None).cast("string")))
    assert [one(spark, N.cut_bin(lit(float(v)), lit(0.0), lit(10.0), 5)) for v in (0, 2, 2.1, 10)] == [1, 1, 2, 5]
    assert one(spark, U.carbon_density(lit(0.0929), lit(22.7))) == pytest.approx(0.0210883)
    rows = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert rows.agg(N.strict_sum("x").alias("s")).first()["s"] is None


def test_t_quantile():
    assert N.t_quantile(0.975, 4) == pytest.approx(2.7764451052, abs=1e-8)
    assert N.t_quantile(0.975, 2) == pytest.approx(4.3026527297, abs=1e-8)
    assert N.normal_two_sided_p(1.959963985) == pytest.approx(0.05)


def test_t_interval_of_large_groups(spark):
    df = spark.createDataFrame([(n, 0.0, 1.0) for n in (5, 201, 202, 301, 1001, 30001)], "n long, mean double, se double")
    got = {r["n"]: r for r in stats.t_ci(df).collect()}
    assert all(r["t_hi"] == pytest.approx(N.t_quantile(0.975, n - 1), abs=1e-8) and r["t_lo"] == -r["t_hi"] for n, r in got.items()) and len(got) == 6


def segs(spark, rows):
    return depth.depth_bounds(spark.createDataFrame(rows, "core string, i int, thickness double, d double"), "core", ["i"], "thickness")


def test_depth(spark):
    b = segs(spark, [("a", 3, 7.85, 1.0), ("a", 1, 8.625, 1.0), ("a", 2, 8.75, 1.0)]).orderBy("i").collect()
    assert [r["bottom"] for r in b] == pytest.approx([8.625, 17.375, 25.225])
    s = segs(spark, [("a", 1, 10.0, 0.05), ("b", 1, 10.0, 0.1), ("b", 2, 15.0, 0.2), ("c", 1, 14.5, 0.1)])
    at = lambda lo, hi, **k: {r["core"]: r for r in depth.integrate(s, ["core"], "d", lo, hi, **k).collect()}
    assert at(0, 10)["a"]["stock"] == pytest.approx(0.5)
    assert at(0, 20)["b"]["stock"] == pytest.approx(3.0)
    c = at(0, 30)["c"]
    assert c["stock"] == pytest.approx(1.45) and c["is_lower_bound"]
    assert at(20, 30)["a"]["stock"] == 0 and at(20, 30)["a"]["n_used"] == 0
    e = depth.integrate(segs(spark, [("a", 1, 10.0, 0.1)]), ["core"], "d", 0, 30, extrapolate=True).first()
    assert e["gap"] == pytest.approx(20) and e["stock_extrap"] * 10 == pytest.approx(30) and e["extrap_share"] == pytest.approx(2 / 3)
    unknown = segs(spark, [("a", 1, 10.0, None)])
    assert depth.integrate(unknown, ["core"], "d", 0, 30).first()["stock"] is None


@pytest.mark.parametrize("values, expected", [((15.2, 5.5), (1, 0, "thickness")), ((10, 10, 10), (0, 2, "thickness")), ((10, 20), (0, 0, "ambiguous"))])
def test_semantics(spark, values, expected):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "core string, i int, depth double")
    r = depth.depth_semantics(df, "core", ["i"], "depth").first()
    assert (r["n_decrease"], r["n_tie"], r["verdict"]) == expected


def test_peat_contact(spark):
    rows = [("x", 1, 15.2, 80.0), ("x", 2, 5.0, 10.0), ("y", 1, 14.5, 80.0), ("z", 1, 10.0, 5.0)]
    s = segs(spark, rows).withColumnRenamed("d", "om")
    got = {r["core"]: (r["outcome"], r["peat_depth"], r["is_lower_bound"]) for r in depth.peat_contact(s, "core", "om", 30.0).collect()}
    assert got == {"x": ("contact_observed", 15.2, False), "y": ("still_peat", 14.5, True), "z": ("no_peat", 0.0, False)}


def test_flags_and_gates(spark):
    df = spark.createDataFrame([(87.68, 56.0), (-120.0, 49.0), (None, 56.0)], "lon double, lat double")
    out = gates.gate_geolocation(df, "lon", "lat", (-90, 50, -80, 60)).collect()
    assert out[0]["longitude_fixed"] == -87.68 and [r["geo_flags"] for r in out] == [["LON_SIGN_REPAIRED"], ["COORD_OUT_OF_REGION"], ["COORD_MISSING"]]
    with pytest.raises(GateError):
        gates.gate_geolocation(df, "lon", "lat", (-90, 50, -80, 60), allow_fix=False)
    three = lambda bad: spark.createDataFrame([(1.0, 2.0 if i < bad else 1.0) for i in range(3)], "a double, b double")
    assert gates.gate_reconcile(three(1), "a", "b", 0.01).filter("not reconciles").count() == 1
    with pytest.raises(GateError):
        gates.gate_reconcile(three(3), "a", "b", 0.01)
    with pytest.raises(GateError):
        gates.gate_columns(df, ["lon", "nope"])
    with pytest.raises(GateError):
        gates.gate_western(df, "lon")
    dup = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0), ("c", 2.0), ("d", None), ("e", None)], "core string, om double")
    assert {r["core"] for r in flags.across_groups(dup, "core", ["om"]).filter("dup").collect()} == {"a", "b"}
    assert one(spark, flags.to_text(F.array(F.lit("b"), F.lit("a")))) == "a;b"


def test_origin_factors(spark):
    df = spark.createDataFrame([("FS", x, x * 0.58) for x in (10.0, 20.0)] + [("PM", x, x * 0.5) for x in (5.0, 9.0)], "g string, x double, y double")
    got = {r["g"]: r["b"] for r in stats.origin_regression(df, "g", "x", "y").collect()}
    assert got == pytest.approx({"FS": 0.58, "PM": 0.5})


def test_scores(spark):
    def r2(o, p):
        df = spark.createDataFrame(list(zip(o, p)), "o double, p double")
        return stats.metrics(df, [], "o", "p").first()

    assert r2([1.0, 2.0, 3.0], [1.0, 2.0, 3.0])["r2_cv"] == 1
    assert r2([1.0, 2.0, 3.0], [2.0, 2.0, 2.0])["r2_cv"] == pytest.approx(0)
    assert r2([1.0, 2.0, 3.0], [3.0, 2.0, 1.0])["r2_cv"] < 0
    assert r2([1.0, 2.0], [1.0, None])["r2_cv"] is None
    part = r2([1.0, 2.0, 9.0, None], [1.0, 2.0, None, 4.0])
    assert part["n"] == 2 and part["r2_cv"] == 1 and part["coverage"] == pytest.approx(2 / 3)


def test_distance(spark):
    lit = F.lit
    assert one(spark, haversine_km(lit(0.0), lit(0.0), lit(0.0), lit(1.0))) == pytest.approx(111.195, abs=0.01)
    assert one(spark, haversine_km(lit(87.68), lit(56.1), lit(-87.68), lit(56.1))) > 5000
    x, y = Lcc().forward(lit(-87.6282), lit(55.965999))
    assert (one(spark, x), one(spark, y)) == pytest.approx((449599.9948, 792274.1280), abs=0.01)
    lon, lat = Lcc().inverse(x, y)
    assert (one(spark, lon), one(spark, lat)) == pytest.approx((-87.6282, 55.965999), abs=1e-9)
    assert one(spark, Lcc().forward(lit(0.0), lit(90.0))[0]) is None


def test_posterior(spark):
    p = bayes.posterior(F.lit(10.0), F.lit(1.0), F.lit(1.0), F.lit(20.0))
    assert one(spark, p["post_mean"]) == 15 and one(spark, p["post_sd"]) == pytest.approx(1 / math.sqrt(2)) and one(spark, p["info_frac"]) == 0.5
    none = F.lit(None).cast("double")
    assert one(spark, bayes.posterior(none, F.lit(1.0), F.lit(0.0), F.lit(0.0))["post_mean"]) is None
    assert one(spark, bayes.posterior(F.lit(0.0), F.lit(1.0), F.lit(4.0), F.lit(0.0))["post_sd"]) == pytest.approx(1 / math.sqrt(5))
    assert one(spark, bayes.kernel(F.lit(0.0), 2.0)) == 1 and one(spark, bayes.kernel(F.lit(2.0), 2.0)) == pytest.approx(math.exp(-0.5)) and one(spark, bayes.kernel(F.lit(3.0), 2.0, 2.5)) == 0
    with pytest.raises(ValueError):
        bayes.kernel(F.lit(1.0), 0)
    a, b = bayes.split_column(F.lit(100.0), 0.13)
    assert (one(spark, a), one(spark, b)) == pytest.approx((13, 87))
    assert one(spark, bayes.recombine(F.lit(1.0), F.lit(3.0), F.lit(2.0), F.lit(4.0))[1]) == 5
    assert one(spark, bayes.uniform_fraction(F.lit(9.0), F.lit(3.0))) < 1


def test_leave_out_is_a_refit(spark):
    rows = [(g, float(x), 2.0 * x + (g % 2) + 0.1 * x * x) for g in range(4) for x in range(3)]
    df = spark.createDataFrame(rows, "g int, x double, y double")
    got = {(r["g"], r["x"]): r["pred"] for r in cv.leave_group_out(df, [], "g", "y", "x").collect()}
    import numpy as np

    for g, x, _ in rows:
        train = [(a, b) for h, a, b in rows if h != g]
        slope, cut = np.polyfit([a for a, _ in train], [b for _, b in train], 1)
        assert got[g, x] == pytest.approx(slope * x + cut)
    flat = df.withColumn("x", F.lit(5.0))
    mean = cv.leave_group_out(flat, [], "g", "y", "x").filter("g = 0").first()["pred"]
    assert mean == pytest.approx(np.mean([y for g, _, y in rows if g != 0]))


def test_buffer_excludes(spark):
    pts = [(i, i, -88.0 + 0.0001 * (i % 3) + (0.5 if i > 2 else 0.0), 56.0, float(i)) for i in range(6)]
    df = spark.createDataFrame(pts, "id int, g int, lon double, lat double, y double")
    other = df.select(F.col("id").alias("rid"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))

    def train(km):
        near = spatial.distance_join(df.select(F.col("g").alias("fold"), "lon", "lat"), other, km).select("fold", F.col("rid").alias("id"))
        return cv.buffered(df, "g", "y", None, near)

    assert {r["n_train"] for r in train(1.0).collect()} == {3}
    assert all(r["pred"] is None for r in train(500.0).collect())
    assert {r["n_train"] for r in cv.buffered(df, "g", "y", None, spark.createDataFrame([], "fold int, id int")).collect()} == {5}


def test_rings_and_grids(spark):
    assert len(spatial.densify([(0, 0), (1, 0), (1, 1), (0, 1)], 10)) == 37
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    assert one(spark, spatial.in_ring(F.lit(0.5), F.lit(0.5), square)) and not one(spark, spatial.in_ring(F.lit(1.5), F.lit(0.5), square))
    g = raster.make_grid((-88.05, 55.88, -87.45, 56.22), 100.0)
    assert (g.ny, g.nx) == (379, 374) or g.nx * g.ny == pytest.approx(141_746, rel=0.01)
    axis = spark.createDataFrame([(0.01 * i, 56.0 + 0.01 * i * math.cos(math.radians(56.05))) for i in range(11)], "lon double, lat double")
    assert spatial.principal_axis(axis).first()["bearing"] == pytest.approx(45, abs=0.5)
    hull = spatial.convex_hull([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5)])
    assert sorted(hull) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_warp_keeps_linear_surfaces(spark):
    g = Grid(40, 40, 0.01, 0.01, -88.0, 56.4)
    r = g.pixels(spark).withColumn("z", 10 * F.col("x") + 3 * F.col("y"))
    pts = spark.createDataFrame([(i, -87.9 + 0.0213 * i, 56.1 + 0.0171 * i) for i in range(10)], "id int, lon double, lat double")
    out = raster.sample(pts, r, g, "lon", "lat", "z").collect()
    assert all(abs(x["z"] - (10 * x["lon"] + 3 * x["lat"])) < 1e-6 for x in out)
    outside = raster.sample(spark.createDataFrame([(1, 0.0, 0.0)], "id int, lon double, lat double"), r, g, "lon", "lat", "z").first()
    assert outside["z"] is None
    classes = r.withColumn("z", F.when(F.col("col") % 2 == 0, 180.0).otherwise(188.0))
    assert {x["z"] for x in raster.sample(pts, classes, g, "lon", "lat", "z", method="nearest").collect()} <= {180.0, 188.0}


def test_tiles(spark):
    box = (-88.72, 55.3, -87.485, 56.078)
    nx, ny = tiles.dims(box, 30.0)
    assert abs(nx - 4583) <= 5 and abs(ny - 2887) <= 5
    t = tiles.tiles(spark, box, 30.0, 2).collect()
    assert all(r["bytes"] <= tiles.TARGET_BYTES for r in t)
    assert sum((r["x1"] - r["x0"]) * (r["y1"] - r["y0"]) for r in t) == pytest.approx((box[2] - box[0]) * (box[3] - box[1]))


def test_selection_and_verdict(spark):
    rows = [("A", -0.5, 0.4, 1.2, 2.5), ("C", 0.3, -0.2, 2.0, 2.5), ("P", None, None, 2.5, 2.5)]
    r = cv.select_model(spark.createDataFrame(rows, "model string, loco_r2 double, loso_r2 double, rmse double, map_rmse double")).first()
    assert (r["model"], r["qualified"]) == ("C", False)


def test_importance_p_values(spark):
    rows = [(i % 4, float(i), float(i % 3), float(i) * 2) for i in range(12)]
    df = spark.createDataFrame(rows, "g int, a double, b double, y double")
    r = {x["covariate"]: x for x in ml.importance(df, ["a", "b"], "y", "g", shuffles=2, nulls=4, trees=5).collect()}
    assert all(x["p"] >= 1 / 5 for x in r.values())
    none = ml.importance(df, ["a", "b"], "y", "g", shuffles=1, nulls=0, trees=3).collect()
    assert all(x["p"] is None and not x["beats_chance"] for x in none)


def test_forest_degenerates_to_the_mean(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 4.0)], "x double, y double")
    assert ml.forest(df, ["x"], "y") == 3.0


def test_stages(spark):
    def broken(_):
        raise RuntimeError("no network")

    out = run([Stage("b", lambda f: f["a"].filter("id > 1"), ("a",)), Stage("a", lambda f: spark.range(4)), Stage("remote", broken, optional=True), Stage("after", lambda f: f["remote"], ("remote",), optional=True)])
    assert out.frames["b"].count() == 2 and set(out.failed) == {"remote", "after"}
    with pytest.raises(RuntimeError):
        run([Stage("remote", broken)])


def test_empty_bins_appear(spark):
    pairs = spark.createDataFrame([(0.0, 1.0), (10.0, 3.0)], "d double, gamma double")
    out = stats.variogram(pairs, "d", "gamma").orderBy("bin").collect()
    assert [r["n_pairs"] for r in out] == [1, 0, 0, 0, 1] and not any(r["informative"] for r in out)


def test_buffer_that_leaves_one_place(spark):
    """What is left of a large table after subtraction has no spread in x: the mean, not the sums' rounding errors."""
    import numpy as np

    rng = np.random.default_rng(5)
    xs, ys = -88 + rng.integers(0, 1000, 20_000) / 1000, np.round(rng.uniform(-999, 9999, 20_000), 2)
    xs[:60] = -87.303
    df = spark.createDataFrame([(i, int(i >= 60), float(x), float(v)) for i, (x, v) in enumerate(zip(xs, ys))], "id int, g int, x double, y double")
    out = cv.buffered(df, "g", "y", "x", spark.createDataFrame([], "fold int, id int")).filter("g = 1")
    assert out.agg(F.max(F.abs(F.col("pred") - float(ys[:60].mean())))).first()[0] < 1e-6
    assert out.select("n_train").distinct().collect()[0][0] == 60
    kept = cv.buffered(df.filter("id < 10000"), "g", "y", "x", spark.createDataFrame([], "fold int, id int")).filter("id = 7").first()["pred"]
    slope, cut = np.polyfit(xs[60:10_000], ys[60:10_000], 1)
    assert kept == pytest.approx(slope * xs[7] + cut, rel=1e-9)


def test_screen_ranks_one_set_of_scores(spark, monkeypatch):
    """Scores that come out a little higher each time they are computed still have ranks 1 to n."""
    later = F.udf(lambda: time.time() % 1e4 * 1e-9, "double").asNondeterministic()
    plain = cv.metrics
    monkeypatch.setattr(cv, "metrics", lambda *a: plain(*a).withColumn("rmse", F.col("rmse") + later()))
    df = spark.createDataFrame([(i % 4, float(i), float((i * 7) % 5), float(i * i), 1.0) for i in range(20)], "g int, a double, b double, y double, c double")
    got = cv.screen(df, ["a", "b", "c"], "g", "y").orderBy("rank").collect()
    assert [(r["rank"], r["n_candidates"]) for r in got] == [(1, 3), (2, 3), (3, 3)]
    assert [r["rmse"] for r in got] == sorted(r["rmse"] for r in got)
