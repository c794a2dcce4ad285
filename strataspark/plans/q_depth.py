"""Depth, flag, gate and join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import units
from ..functions.numeric import norm_diff, trailing_int
from ..operators import depth, flags, gates, stats
from ..sources.geojson import point_feature
from .registry import ORDER, POINTS, SEG, points, query, read, rounded, segments

_OVER = "greatest(0e0, least(bottom, {hi}e0) - greatest(top, {lo}e0))"


@query("depth_bounds", SEG + "SELECT core_id, CAST(seg_index AS INTEGER) AS seg_index, top, bottom FROM s")
def depth_bounds(spark, sf):
    return segments(spark, sf).select("core_id", F.col("seg_index").cast("int").alias("seg_index"), "top", "bottom")


@query("depth_semantics", """WITH d AS (SELECT l_orderkey, l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS step FROM lineitem),
p AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (step < 0) AS down, count(*) FILTER (step = 0) AS same FROM d GROUP BY 1)
SELECT CAST(count(*) FILTER (n > 1) AS BIGINT) AS n_multi, CAST(sum(down) AS BIGINT) AS n_decrease, CAST(sum(same) AS BIGINT) AS n_tie, CASE WHEN sum(down) + sum(same) > 0 THEN 'thickness' ELSE 'ambiguous' END AS verdict FROM p""")  # fmt: skip
def depth_semantics(spark, sf):
    return depth.depth_semantics(read(spark, sf, "lineitem").select("l_orderkey", "l_quantity", *ORDER), "l_orderkey", ORDER, "l_quantity")


def _integrate_sql(lo, hi):
    o = _OVER.format(lo=lo, hi=hi)
    return SEG + f"SELECT core_id, round(sum({o} * density), 4) AS stock, round(sum({o}), 4) AS covered, count(*) FILTER ({o} > 0) AS n_used, sum({o}) < {hi - lo}e0 - 1e-8 AS is_lower_bound FROM s GROUP BY core_id"


def _integrate(spark, sf, lo, hi):
    out = depth.integrate(segments(spark, sf), ["core_id"], "density", lo, hi)
    return rounded(out, 4, "stock", "covered").select("core_id", "stock", "covered", "n_used", "is_lower_bound")


@query("integrate_0_30", _integrate_sql(0, 30))
def integrate_0_30(spark, sf):
    return _integrate(spark, sf, 0, 30)


@query("integrate_offset_window", _integrate_sql(5, 15))
def integrate_offset_window(spark, sf):
    return _integrate(spark, sf, 5, 15)


_O100 = _OVER.format(lo=0, hi=100)


@query("extrapolate_window", SEG + f"""SELECT core_id, round(gap, 4) AS gap, round(stock, 4) AS stock, round(stock + gap * d, 4) AS stock_extrap FROM
(SELECT core_id, greatest(0e0, 100e0 - sum({_O100})) AS gap, sum({_O100} * density) AS stock, arg_max(density, (bottom, density)) AS d FROM s GROUP BY core_id)""")  # fmt: skip
def extrapolate_window(spark, sf):
    out = depth.integrate(segments(spark, sf), ["core_id"], "density", 0, 100, extrapolate=True)
    return rounded(out, 4, "gap", "stock", "stock_extrap").select("core_id", "gap", "stock", "stock_extrap")


@query("common_support", SEG + "SELECT min(total) AS common_depth, arg_min(core_id, (total, core_id)) AS limiting_core FROM (SELECT core_id, max(bottom) AS total FROM s GROUP BY 1)")
def common_support(spark, sf):
    return depth.common_support(segments(spark, sf), "core_id")


@query("depth_support", SEG + "SELECT core_id, max(bottom) AS length, max(bottom) >= 30e0 - 1e-8 AS reaches FROM s GROUP BY 1")
def depth_support(spark, sf):
    return depth.depth_support(segments(spark, sf), "core_id", 30.0)


_CUBE = SEG + f"""SELECT core_id, scenario, win AS "window", round(sum(cut * density * CASE WHEN scenario = 'harmonised' AND stratum = 'R' THEN f ELSE 1e0 END), 4) AS stock, sum(cut) < hi - lo - 1e-8 AS is_lower_bound FROM
(SELECT s.*, scenario, f, win, lo, hi, greatest(0e0, least(bottom, hi) - greatest(top, lo)) AS cut FROM s, (VALUES ('as_supplied', 1e0), ('harmonised', 0.51e0 / 0.58e0)) a(scenario, f), (VALUES ('reference', 0e0, 30e0), ('common', 0e0, 14.5e0)) w(win, lo, hi)) GROUP BY core_id, scenario, win, lo, hi"""


def cube(spark, sf):
    scenarios = spark.createDataFrame([("as_supplied", 1.0), ("harmonised", 0.51 / 0.58)], "scenario string, factor double")
    windows = spark.createDataFrame([("reference", 0.0, 30.0), ("common", 0.0, 14.5)], "window string, lo double, hi double")
    factor = F.when((F.col("scenario") == "harmonised") & (F.col("stratum") == "R"), F.col("factor")).otherwise(1.0)
    return depth.cube(segments(spark, sf), ["core_id"], scenarios, windows, F.col("density") * factor)


@query("scenario_window_cube", _CUBE)
def scenario_window_cube(spark, sf):
    return rounded(cube(spark, sf), 4, "stock").select("core_id", "scenario", "window", "stock", "is_lower_bound")


@query("flagship_strata", "WITH cube AS (" + _CUBE.replace("round(sum(", "(sum(").replace(", 4) AS stock", ") AS stock") + """),
st AS (SELECT o_orderpriority AS stratum, scenario, "window", stock FROM cube JOIN orders ON core_id = o_orderkey WHERE NOT is_lower_bound)
SELECT stratum, scenario, "window", count(*) AS n, round(avg(stock), 4) AS mean, round(stddev_samp(stock) / sqrt(count(*)), 4) AS se FROM st GROUP BY ALL""")  # fmt: skip
def flagship_strata(spark, sf):
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("core_id"), F.col("o_orderpriority").alias("stratum"))
    usable = cube(spark, sf).filter("not is_lower_bound").join(orders, "core_id")
    return rounded(stats.group_stats(usable, ["stratum", "scenario", "window"], "stock"), 4, "mean", "se").select("stratum", "scenario", "window", "n", "mean", "se")


@query("peat_contact", SEG + """, f AS (SELECT *, min(top) FILTER (om >= 30e0) OVER (PARTITION BY core_id) AS first_peat FROM s),
g AS (SELECT core_id, max(first_peat) AS fp, min(top) FILTER (om < 30e0 AND top > first_peat) AS contact, max(bottom) AS len FROM f GROUP BY 1)
SELECT core_id, CASE WHEN fp IS NULL THEN 'no_peat' WHEN contact IS NOT NULL THEN 'contact_observed' ELSE 'still_peat' END AS outcome, CASE WHEN fp IS NULL THEN 0e0 ELSE coalesce(contact, len) END AS peat_depth, fp IS NOT NULL AND contact IS NULL AS is_lower_bound FROM g""")  # fmt: skip
def peat_contact(spark, sf):
    return depth.peat_contact(segments(spark, sf), "core_id", "om", 30.0)


@query("core_rollup", SEG + "SELECT core_id, min(stratum) FILTER (seg_index = 1) AS stratum, count(*) AS n_segments, max(bottom) AS length, min(density) AS bd_min, max(density) AS bd_max, round(min(om), 7) AS om_min, round(max(om), 7) AS om_max FROM s GROUP BY 1")
def core_rollup(spark, sf):
    return rounded(depth.core_rollup(segments(spark, sf), "core_id", ["stratum"], "density", "om"), 7, "om_min", "om_max")


@query("untruncated_stock", "SELECT l_orderkey AS core_id, round(sum(l_discount * l_quantity * 10), 4) AS stock_kgm2, sum(l_quantity) AS depth, count(*) AS n, sum(l_quantity) < 29.9e0 AS is_lower_bound FROM lineitem GROUP BY 1")
def untruncated_stock(spark, sf):
    li = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("core_id"), "l_discount", "l_quantity")
    return rounded(depth.untruncated_stock(li, "core_id", "l_discount", "l_quantity"), 4, "stock_kgm2")


@query("last_two_direction", SEG + """, r AS (SELECT core_id, density, row_number() OVER (PARTITION BY core_id ORDER BY seg_index DESC) AS k FROM s),
p AS (SELECT core_id, max(density) FILTER (k = 1) AS last, max(density) FILTER (k = 2) AS before FROM r GROUP BY 1)
SELECT core_id, CASE WHEN before IS NULL THEN 'single' WHEN last > before THEN 'rising' WHEN last < before THEN 'falling' ELSE 'level' END AS direction FROM p""")  # fmt: skip
def last_two_direction(spark, sf):
    return depth.last_two_direction(segments(spark, sf), "core_id", ["seg_index"], "density").select("core_id", "direction")


@query("origin_regression", SEG + """, f AS (SELECT stratum, sum(om * soc) / sum(om * om) AS b FROM s WHERE om > 0 GROUP BY 1)
SELECT s.stratum, round(max(b), 6) AS b, round(1 / max(b), 6) AS divisor, round(min(soc / om), 6) AS min_ratio, round(max(soc / om), 6) AS max_ratio, round(max(abs(soc - b * om)), 6) AS max_resid, count(*) AS n FROM s JOIN f USING (stratum) WHERE om > 0 GROUP BY 1""")  # fmt: skip
def origin_regression(spark, sf):
    return rounded(stats.origin_regression(segments(spark, sf), "stratum", "om", "soc"), 6, "b", "divisor", "min_ratio", "max_ratio", "max_resid")


_REC = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS supplied, l_extendedprice * (1e0 + (l_partkey % 7) / 1000e0) AS recomputed FROM lineitem"


@query("reconcile_top5", f"WITH r AS ({_REC}) SELECT l_orderkey, l_linenumber, l_partkey, round(abs(supplied - recomputed), 3) AS abs_diff FROM r ORDER BY abs(supplied - recomputed) DESC, l_orderkey, l_linenumber, l_partkey LIMIT 5")
def reconcile_top5(spark, sf):
    return rounded(_reconciled(spark, sf).orderBy(F.desc("abs_diff"), "l_orderkey", "l_linenumber", "l_partkey").limit(5), 3, "abs_diff").select("l_orderkey", "l_linenumber", "l_partkey", "abs_diff")


def _reconciled(spark, sf):
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("supplied"))
    return gates.reconcile(li.withColumn("recomputed", F.col("supplied") * (1 + F.pmod("l_partkey", F.lit(7)) / 1000.0)), "supplied", "recomputed", 0.0045)


@query("reconcile_counts", f"WITH r AS ({_REC}) SELECT count(*) AS n, count(*) FILTER (NOT abs(recomputed - supplied) / abs(supplied) < 0.0045e0) AS bad FROM r")
def reconcile_counts(spark, sf):
    return _reconciled(spark, sf).agg(F.count("*").alias("n"), F.count_if(~F.col("reconciles")).alias("bad"))


_FLAG = """WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, list_filter([CASE WHEN l_tax > 0.07e0 THEN 'BD_ABOVE_MAX' END, CASE WHEN l_tax < 0.01e0 THEN 'BD_BELOW_MIN' END,
CASE WHEN l_extendedprice / 1000e0 > 100e0 OR l_extendedprice < 0 THEN 'OM_OUT_OF_RANGE' END, CASE WHEN l_quantity <= 0 THEN 'THICKNESS_NONPOSITIVE' END, CASE WHEN l_quantity > 45e0 THEN 'THICKNESS_ABOVE_MAX' END], lambda x: x IS NOT NULL) AS tags FROM lineitem) """


def _flagged(spark, sf):
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_tax", "l_quantity", (F.col("l_extendedprice") / 1000).alias("om"), (F.col("l_extendedprice") / 2000).alias("soc"))
    return li.withColumn("tags", flags.flag_array(flags.value_rules("l_tax", "om", "soc", "l_quantity", bd_max=0.07, bd_min=0.01, thickness_max=45.0)))


@query("value_flags", _FLAG + "SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_sort(tags), ';') AS qc_flags, CAST(len(tags) AS INTEGER) AS n_flags FROM f")
def value_flags(spark, sf):
    return _flagged(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", flags.to_text(flags.merge("tags")).alias("qc_flags"), F.size("tags").alias("n_flags"))


@query("flag_tally", _FLAG + ", d AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b, _ in flags.DICTIONARY) + ") v(flag, tier)), c AS (SELECT unnest(tags) AS flag FROM f) SELECT flag, tier, count(c.flag) AS n_rows FROM d LEFT JOIN c USING (flag) GROUP BY flag, tier")
def flag_tally(spark, sf):
    t = flags.tally(_flagged(spark, sf), "tags")
    return flags.dictionary(spark).select("flag", "tier").join(t, "flag", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


@query("cross_group_duplicates", """WITH g AS (SELECT l_quantity, l_discount, l_tax, l_partkey, min(l_orderkey) <> max(l_orderkey) AS dup FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN g USING (l_quantity, l_discount, l_tax, l_partkey) WHERE dup""")  # fmt: skip
def cross_group_duplicates(spark, sf):
    li = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax")
    return flags.across_groups(li, "l_orderkey", ["l_quantity", "l_discount", "l_tax", "l_partkey"]).filter("dup").select("l_orderkey", "l_linenumber", "l_partkey")


@query("single_segment_groups", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1")
def single_segment_groups(spark, sf):
    return flags.single_row_groups(read(spark, sf, "lineitem").select("l_orderkey"), "l_orderkey").filter("single").select("l_orderkey")


@query("trailing_int", "SELECT c_custkey, TRY_CAST(nullif(regexp_extract(c_name, '[0-9]+$', 0), '') AS INTEGER) AS n, TRY_CAST(nullif(regexp_extract(c_mktsegment, '[0-9]+$', 0), '') AS INTEGER) AS none FROM customer")
def trailing(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", trailing_int("c_name").alias("n"), trailing_int("c_mktsegment").alias("none"))


_GEO = POINTS + """, p AS (SELECT id, lat, CASE id % 5 WHEN 0 THEN -lon WHEN 1 THEN NULL WHEN 2 THEN 10e0 ELSE lon END AS lon FROM sup)
SELECT id, CASE WHEN lon IS NOT NULL AND NOT lon BETWEEN -90 AND -80 AND -lon BETWEEN -90 AND -80 THEN -lon ELSE lon END AS longitude,
CASE WHEN lon IS NULL THEN 'COORD_MISSING' WHEN lon BETWEEN -90 AND -80 THEN '' WHEN -lon BETWEEN -90 AND -80 THEN 'LON_SIGN_REPAIRED' ELSE 'COORD_OUT_OF_REGION' END AS flags FROM p"""


@query("geolocation_gate", _GEO)
def geolocation_gate(spark, sf):
    k = F.pmod("id", F.lit(5))
    p = points(spark, sf).withColumn("lon", F.when(k == 0, -F.col("lon")).when(k == 2, 10.0).when(k != 1, F.col("lon")))
    out = gates.gate_geolocation(p, "lon", "lat", (-90, 50, -80, 60))
    return out.select("id", F.col("longitude_fixed").alias("longitude"), flags.to_text("geo_flags").alias("flags"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark, sf):
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("geojson_points", POINTS + """SELECT id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || lon || ',' || lat || ']},"properties":{"id":' || id || ',"note":' || CASE WHEN id % 2 = 0 THEN 'null' ELSE '"a\\"b"' END || '}}' AS feature FROM sup""")
def geojson_points(spark, sf):
    p = points(spark, sf).withColumn("note", F.when(F.pmod("id", F.lit(2)) != 0, F.lit('a"b')))
    return p.select("id", point_feature("lon", "lat", ["id", "note"]).alias("feature"))


@query("left_first_match", """WITH f AS (SELECT o_custkey, min(o_orderkey) AS first_order FROM orders GROUP BY 1) SELECT c_custkey, first_order FROM customer LEFT JOIN f ON c_custkey = o_custkey""")
def left_first_match(spark, sf):
    first = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first_order"))
    return read(spark, sf, "customer").select("c_custkey").join(first, "c_custkey", "left")


@query("anti_missing", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_missing(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey").join(read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("semi_present", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi_present(spark, sf):
    big = read(spark, sf, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf, "customer").select("c_custkey").join(big, "c_custkey", "left_semi")


@query("inner_merge", "SELECT o_orderpriority, l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2")
def inner_merge(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return rounded(read(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity").join(o, "l_orderkey").groupBy("o_orderpriority", "l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty")), 2, "qty")


@query("pivot_suffixes", SEG + """SELECT core_id, sum(density * thickness) FILTER (stratum = 'A') AS stock_a, sum(density * thickness) FILTER (stratum = 'N') AS stock_n FROM s GROUP BY 1""".replace("sum(density * thickness)", "count(*)"))
def pivot_suffixes(spark, sf):
    s = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("core_id"), "l_returnflag")
    return s.groupBy("core_id").agg(F.count_if(F.col("l_returnflag") == "A").alias("stock_a"), F.count_if(F.col("l_returnflag") == "N").alias("stock_n"))


@query("set_ops", """SELECT 'union' AS op, count(*) AS n FROM (SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer)
UNION ALL SELECT 'union_all', count(*) FROM (SELECT s_nationkey FROM supplier UNION ALL SELECT c_nationkey FROM customer)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT s_nationkey FROM supplier INTERSECT SELECT c_nationkey FROM customer)
UNION ALL SELECT 'except', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)""")  # fmt: skip
def set_ops(spark, sf):
    s, c, n = (read(spark, sf, t).select(F.col(k).alias("k")) for t, k in (("supplier", "s_nationkey"), ("customer", "c_nationkey"), ("nation", "n_nationkey")))
    parts = {"union": s.union(c).distinct(), "union_all": s.unionByName(c), "intersect": s.intersect(c), "except": n.subtract(s)}
    out = None
    for k, d in parts.items():
        x = d.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n")
        out = x if out is None else out.unionByName(x)
    return out


@query("norm_diff", "SELECT l_orderkey, l_linenumber, l_partkey, round((l_tax - l_discount) / nullif(l_tax + l_discount, 0), 6) AS nd FROM lineitem")
def norm_difference(spark, sf):
    return rounded(read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", norm_diff("l_tax", "l_discount").alias("nd")), 6, "nd")


@query("unit_conversions", "SELECT l_orderkey, l_linenumber, l_partkey, round(l_tax * l_discount / 100 * 10, 8) AS kgm2, round(l_extendedprice * 1.22e0 * 0.5e0 * 0.1e0, 7) AS carbon, round((l_quantity / 10) * (l_tax / 100) * 15 / 100, 8) AS layer FROM lineitem")
def unit_conversions(spark, sf):
    li = read(spark, sf, "lineitem")
    return rounded(rounded(li.select("l_orderkey", "l_linenumber", "l_partkey", units.gcm2_to_kgm2(units.carbon_density("l_tax", "l_discount")).alias("kgm2"), units.biomass_to_carbon("l_extendedprice").alias("carbon"), units.layer_stock("l_quantity", "l_tax", 15.0).alias("layer")), 8, "kgm2", "layer"), 7, "carbon")


@query("resolve_units", """WITH m AS (SELECT median(l_extendedprice) AS med FROM lineitem) SELECT reading, med * f BETWEEN 1 AND 100 AS plausible FROM m, (VALUES ('as is', 1e0), ('per thousand', 0.001e0), ('per ten', 0.1e0)) v(reading, f)""")
def resolve_units(spark, sf):
    med = read(spark, sf, "lineitem").agg(F.median("l_extendedprice").alias("med"))
    readings = F.array(*[F.struct(F.lit(n).alias("reading"), F.lit(f).alias("f")) for n, f in (("as is", 1.0), ("per thousand", 0.001), ("per ten", 0.1))])
    return med.select("med", F.explode(readings).alias("r")).select("r.reading", (F.col("med") * F.col("r.f")).between(1, 100).alias("plausible"))


@query("name_factor", SEG + """, f AS (SELECT stratum, sum(om * soc) / sum(om * om) AS b FROM s GROUP BY 1), c AS (SELECT stratum, name, abs(b - v) AS gap FROM f, (VALUES ('a', 0.5e0), ('b', 0.58e0), ('c', 0.95e0)) k(name, v))
SELECT stratum, CASE WHEN min(gap) <= 0.02 THEN arg_min(name, (gap, name)) ELSE 'unrecognised' END AS name FROM c GROUP BY 1""")  # fmt: skip
def name_factor(spark, sf):
    fit = stats.origin_regression(segments(spark, sf), "stratum", "om", "soc")
    return fit.select("stratum", gates.name_factor("b", {"a": 0.5, "b": 0.58, "c": 0.95}, 0.02).alias("name"))


@query("naive_audit", SEG + """, prior AS (SELECT core_id, sum(density) AS naive, CAST(-core_id % 90 AS DOUBLE) AS lon FROM s GROUP BY 1), own AS (SELECT core_id, sum(density * thickness) AS stock, sum(thickness) AS covered FROM s GROUP BY 1)
SELECT core_id, lon AS prior_lon, lon / 2 AS our_lon, round(naive, 6) AS naive_sum, round(stock, 6) AS proper_stock, covered AS core_length, round(CASE WHEN naive <> 0 THEN stock / naive END, 6) AS ratio FROM prior JOIN own USING (core_id)""")  # fmt: skip
def naive_audit(spark, sf):
    s = segments(spark, sf)
    lon = F.expr("cast(-core_id % 90 as double)")
    prior = s.groupBy("core_id").agg(F.sum("density").alias("naive")).withColumn("lon", lon)
    own = depth.integrate(s, ["core_id"], "density", 0.0, 1e6)
    out = depth.naive_audit(prior, own, prior.select("core_id", (F.col("lon") / 2).alias("lon")), "core_id", "naive", "stock", "covered", "lon")
    return rounded(out, 6, "naive_sum", "proper_stock", "ratio")


@query("index_absent", "SELECT 'P' || p_partkey || CASE WHEN p_partkey % 10 = 0 THEN 'x' ELSE '' END AS sample, CASE WHEN p_partkey % 10 = 0 THEN 1 ELSE CAST(p_partkey AS INTEGER) END AS seg_index, p_partkey % 10 = 0 AS index_absent FROM part")
def index_absent(spark, sf):
    key = F.col("p_partkey")
    p = read(spark, sf, "part").select(F.concat(F.lit("P"), key, F.when(key % 10 == 0, "x").otherwise("")).alias("sample"), F.when(key % 10 == 0, -key - 1).otherwise(key % 10).alias("core"))
    return flags.index_absent(p, "sample", "core").select("sample", "seg_index", "index_absent")
