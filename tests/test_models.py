"""Resampling, forests on frames, least squares, candidates, and joins round the globe."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.functions.geo import haversine_km
from strataspark.operators import cv, flags, ml, raster, spatial, stats
from strataspark.operators.gates import GateError
from strataspark.plans import catalogue
from strataspark.plans.tiles import download_manifest


def test_bootstrap_is_near_t(spark):
    rng = np.random.default_rng(3)
    rows = [(g, i, float(v)) for g, n in (("a", 60), ("b", 12), ("c", 1)) for i, v in enumerate(rng.normal(10, 3, n))]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    got = {r["g"]: r for r in stats.bootstrap_ci(df, ["g"], "v", ["i"], 2000).collect()}
    t = {r["g"]: r for r in stats.t_ci(stats.group_stats(df, ["g"], "v")).collect()}
    assert got["c"]["boot_lo"] is None and got["c"]["mean"] is not None
    for g in "ab":
        width = t[g]["t_hi"] - t[g]["t_lo"]
        assert 0.75 * width < got[g]["boot_hi"] - got[g]["boot_lo"] < 1.1 * width
        assert got[g]["boot_lo"] < got[g]["mean"] < got[g]["boot_hi"]


def test_normal_tail(spark):
    z = [0.0, 0.5, 1.96, 2.99, 3.0, 5.0, 8.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in z], "z double").select(stats.normal_tail(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(v / math.sqrt(2)) / 2 for v in z], rel=1e-9)


def test_metrics_counts_pairs(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, None), (None, 3.0), (4.0, 4.0)], "o double, p double")
    r = stats.metrics(df, [], "o", "p").first()
    assert (r["n"], r["n_obs"], r["n_predicted"]) == (2, 3, 2)
    assert r["skill_null"] == pytest.approx(1 - math.sqrt(0.125) / 1.5)


def test_ranks_do_not_mind_an_outlier(spark):
    rng = random.Random(1)
    v = [rng.random() for _ in range(300)] + [1e12]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    got = {r["v"]: r["pct"] for r in stats.ecdf(df, "v", df, "v").collect()}
    assert all(got[x] == pytest.approx(100 * sum(y <= x for y in v) / len(v)) for x in v)


def test_forest_on_a_frame(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3))
    y = 3 * x[:, 0] + 0.1 * rng.normal(size=80)
    f = ml.frame_forest(x, y, trees=40)
    assert np.corrcoef(ml.frame_predict(f, x), y)[0, 1] > 0.95
    assert ml.grown(np.array([[1.0], [2.0], [3.0], [4.0]]), np.array([0.0, 0, 1, 1]), 1, 1, 1, rng) == (0, 2.5, 0.0, 1.0)
    assert ml.frame_predict([(0, 2.5, 0.0, 1.0)], np.array([[np.nan], [3.0]])).tolist() == [0.0, 1.0]  # missing goes left
    df = spark.createDataFrame([(*map(float, r), float(v), i % 8) for i, (r, v) in enumerate(zip(x, y))], "a double, b double, c double, y double, g int")
    got = {r["covariate"]: r for r in ml.importance(df, ["a", "b", "c"], "y", "g", shuffles=3, nulls=20, trees=6).collect()}
    assert got["a"]["rank"] == 1 and got["a"]["p_value"] == pytest.approx(1 / 21) and got["a"]["beats_chance"]
    assert got["a"]["importance_pct"] == pytest.approx(100 * got["a"]["importance"] / got["a"]["base_rmse"]) and not got["b"]["beats_chance"]
    none = ml.importance(df, ["a"], "y", "g", shuffles=10, nulls=20, trees=6, budget_s=0.0).first()
    assert none["p_value"] is None and none["n_null"] == 0 and not none["beats_chance"]
    v = {r["metric"]: r["value"] for r in ml.forest_validation(df, ["a", "b", "c"], "y", "g", trees=20).collect()}
    assert v["beats_null"] == 1.0 and v["n_cores"] == 80 and 0.5 < v["loco_r2"] <= 1


def test_ols_on_several_covariates(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 2)) + [1000, 5]
    y = 2 + x @ [0.5, -1] + rng.normal(size=40)
    g = np.arange(40) % 5
    df = spark.createDataFrame([(*map(float, r), 7.0, float(v), int(k)) for r, v, k in zip(x, y, g)], "a double, b double, flat double, y double, g int")
    m = cv.ols(df, ["a", "b", "flat"], "y")
    design = np.column_stack([np.ones(40), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    assert m["dropped"] == ["flat"] and [m["slopes"]["a"], m["slopes"]["b"]] == pytest.approx(beta[1:]) and m["intercept"] == pytest.approx(beta[0], abs=1e-4)
    assert m["r2"] == pytest.approx(1 - ((y - design @ beta) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert {round(r["pred"], 6) for r in cv.predict_ols(m, df).collect()} == {round(v, 6) for v in design @ beta}
    got = {(r["y"]): r["pred"] for r in cv.leave_group_out_many(df, "g", "y", ["a", "b", "flat"]).collect()}
    for k in range(5):
        b = np.linalg.lstsq(design[g != k], y[g != k], rcond=None)[0]
        assert [got[v] for v in y[g == k]] == pytest.approx(design[g == k] @ b)


def test_selection_rule(spark):
    schema = "model string, loco_r2 double, loso_r2 double, rmse double, map_rmse double"
    pick = lambda *rows: tuple(cv.select_model(spark.createDataFrame(rows, schema)).first())
    assert pick(("N", 0.9, 0.9, 1.0, 2.0), ("A", 0.5, 0.4, 1.0, 2.0), ("C", 0.5, 0.3, 1.0, 2.0), ("P", 0.9, 0.95, 1.0, 2.0)) == ("A", True)
    assert pick(("A", 0.5, None, 1.0, 2.0), ("C", 0.5, -0.3, 1.0, 2.0)) == ("C", False)
    assert pick(("A", 0.5, 0.4, 3.0, 2.0), ("P", 0.1, 0.1, 2.0, 2.0)) == ("P", False)


def test_partial_stratum_scores_are_blanked(spark):
    df = spark.createDataFrame([(i, i % 4, 0 if i < 7 else 1, float(i), float(i % 3)) for i in range(8)], "id int, core int, s int, y double, x double").withColumns({"lon": F.lit(0.0), "lat": F.lit(0.0)})
    got = {r["model"]: r for r in cv.candidate_scores(df, "id", "core", "s", "y", ["x"], None, 1.0, 5.0).collect()}
    assert set(got) == {"N", "A"} and got["N"]["loso_r2"] is None and got["N"]["loso_coverage"] < 1 and got["N"]["map_rmse"] is None


def test_distances_round_the_globe(spark):
    rng = random.Random(4)
    pts = [(i, rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for i in range(150)] + [(200, 179.99, 10.0), (201, -179.99, 10.0), (202, 10.0, 89.99), (203, -170.0, 89.98)]
    df = spark.createDataFrame(pts, "id int, lon double, lat double")
    right = df.select(F.col("id").alias("rid"), F.col("lon").alias("rlon"), F.col("lat").alias("rlat"))
    every = df.crossJoin(right).withColumn("d", haversine_km("lon", "lat", "rlon", "rlat"))
    for radius in (5.0, 400.0, 6000.0, 15000.0):
        got = {(r["id"], r["rid"]) for r in spatial.distance_join(df, right, radius).collect()}
        assert got == {(r["id"], r["rid"]) for r in every.filter(F.col("d") <= radius).collect()}
    best = {r["id"]: r["m"]["rid"] for r in every.filter("id != rid").groupBy("id").agg(F.min(F.struct("d", "rid")).alias("m")).collect()}
    assert {r["id"]: r["rid"] for r in spatial.nearest_join(df, right, "id", "rid", others=True).collect()} == best
    assert spatial.median_neighbour_km(df.limit(1), "id") == 5.0
    cloud = spatial.pair_cloud(df, "id", blocks=5)
    assert cloud.count() == len(pts) * (len(pts) - 1) // 2 and cloud.distinct().count() == cloud.count()


def test_rings_and_boxes(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    ring = spatial.buffered_ring(square, 1.0, 64)
    area = sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:])) / 2
    assert ring[0] == ring[-1] and area == pytest.approx(4 + 8 + math.pi, rel=1e-3)
    one = spark.createDataFrame([(1.0, 2.0), (3.0, -1.0)], "x double, y double")
    assert tuple(spatial.bounding_box(one, "x", "y").first()) == (1.0, -1.0, 3.0, 2.0)
    cells = spatial.hex_grid(spark, (0.0, 0.0, 10.0, 10.0), 1.0).collect()
    assert all(len(r["ring"]) == 7 for r in cells) and len(cells) == pytest.approx(100 / (math.sqrt(3) / 2), rel=0.2)


def test_absent_indices(spark):
    df = spark.createDataFrame([("A-1", "a"), ("A-2", "a"), ("B", "b")], "sample string, core string")
    got = {r["sample"]: (r["seg_index"], r["index_absent"]) for r in flags.index_absent(df, "sample", "core").collect()}
    assert got == {"A-1": (1, False), "A-2": (2, False), "B": (1, True)}
    with pytest.raises(GateError):
        flags.index_absent(df.union(spark.createDataFrame([("Bx", "b")], df.schema)), "sample", "core")


def test_samples_and_downloads(spark):
    px = spark.createDataFrame([(1, -9999.0), (2, 3.0), (3, float("nan"))], "i int, z double")
    assert [r["z"] for r in raster.sentinel_to_null(px, ["z"]).orderBy("i").collect()] == [None, 3.0, None]
    r = raster.verify_raster(spark.createDataFrame([(0, 0, None), (4, 2, None)], "row int, col int, z double"), 4326).first()
    assert (r["ny"], r["nx"], r["code"], r["all_missing"]) == (5, 3, "EPSG:4326", True)
    ask = spark.createDataFrame([("a", 0, 10.0), ("a", 1, 10.0), ("a", 2, 1e9), ("a", 3, 10.0)], "name string, tile int, bytes double")
    have = spark.createDataFrame([("a", 0, 500), ("a", 1, 0)], "name string, tile int, size long")
    assert [r["status"] for r in download_manifest(spark, ask, have).orderBy("tile").collect()] == ["cached", "failed", "too_large", "pending"]


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_bootstrap_never_builds_its_draws(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(stats, "MOST_BROADCAST", most, raising=False)
    monkeypatch.setattr(stats, "TASK_DRAWS", 1000, raising=False)
    rows = [(g, i, float((7 * i + g) % 11)) for g in (0, 1) for i in range(300)] + [(2, 0, 4.0)]
    spark.createDataFrame(rows, "g int, i int, v double").write.parquet(f"{tmp_path}/x.parquet")
    out = stats.bootstrap_ci(spark.read.parquet(f"{tmp_path}/x.parquet"), ["g"], "v", ["i"], 100)
    got = {r["g"]: (r["n"], r["boot_lo"], r["boot_hi"]) for r in out.collect()}
    assert got[2] == (1, None, None)
    for g in (0, 1):
        v = [x for k, _, x in rows if k == g]
        means = [sum(v[int(hashlib.md5(f"{g}:{r}:{k}:1".encode()).hexdigest()[:15], 16) % 300] for k in range(1, 301)) / 300 for r in range(1, 101)]
        assert got[g] == (300, pytest.approx(np.percentile(means, 2.5)), pytest.approx(np.percentile(means, 97.5)))
    joins = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "_i#" in line]
    assert joins and not any("BuildLeft" in line for line in joins), joins
    assert any(("BroadcastHashJoin" if most else "SortMergeJoin") in line for line in joins), joins


@pytest.mark.parametrize("name", ["haversine_ring_counts", "nearest_neighbour", "posterior_pair_table"])
def test_places_meet_not_rows(spark, tmp_path, monkeypatch, name):
    """Eleven and seven rows at each place: the queries' distance joins see each place once, every row has its result."""
    keys = lambda n: [k + 1000 * i for k in (1, 5, 60, 300) for i in range(n)]
    sup, cus = [(k, k % 3, k / 7) for k in keys(11)], [(k, 0, 0.0) for k in keys(7)]
    spark.createDataFrame(sup, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame(cus, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    met, plain = [], spatial.distance_join

    def join(left, right, *a, **k):
        met.append((left.count(), right.count()))
        return plain(left, right, *a, **k)

    monkeypatch.setattr(spatial, "distance_join", join)
    got = {r["id"]: r for r in catalogue.queries()[name](spark, str(tmp_path)).collect()}
    assert met == [(4, 4)]
    assert set(got) == {k for k, *_ in cus}
    duck = duckdb.connect()
    for t in ("supplier", "customer"):
        duck.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    rel = duck.sql(catalogue.oracle_sql()[name])
    assert {r[0]: r for r in rel.fetchall()} == {k: tuple(r[c] for c in rel.columns) for k, r in got.items()}


def test_nearest_ties_go_to_the_smallest_id(spark):
    """Distances that differ by less than the ninth decimal are equal."""
    left = spark.createDataFrame([(1, 10.0, 50.0), (2, 10.0, 50.0)], "id int, lon double, lat double")
    right = spark.createDataFrame([(5, 10.0, 50.1), (9, 10.0, 50.1 - 1e-13), (7, 10.0, 50.1), (3, 11.0, 50.0)], "rid int, rlon double, rlat double")
    assert {(r["id"], r["rid"]) for r in spatial.nearest_join(left, right, "id", "rid").collect()} == {(1, 5), (2, 5)}
