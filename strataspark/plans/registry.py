"""Queries by name: a function of (spark, sf_dir), and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


#: Orders as cores, line items as segments in a fixed order.
SEG = """WITH seg AS (SELECT l_orderkey AS core_id, l_returnflag AS stratum, l_quantity AS thickness, l_discount AS density,
 l_extendedprice / 1000e0 AS om, l_extendedprice * (1e0 - l_discount) / 1000e0 AS soc,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seg_index,
 sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bottom FROM lineitem),
s AS (SELECT *, bottom - thickness AS top FROM seg) """

#: Suppliers and customers as points.
POINTS = """WITH sup AS (SELECT s_suppkey AS id, -88e0 + ((s_suppkey * 7919) % 1000) / 1000e0 AS lon, 55.5e0 + ((s_suppkey * 104729) % 1000) / 1000e0 AS lat, s_acctbal AS v, s_nationkey AS stratum FROM supplier),
cus AS (SELECT c_custkey AS id, -88e0 + ((c_custkey * 7919) % 1000) / 1000e0 AS lon, 55.5e0 + ((c_custkey * 104729) % 1000) / 1000e0 AS lat, c_acctbal AS v, c_nationkey AS stratum FROM customer) """


def hav(a: str, b: str) -> str:
    """SQL of the great-circle distance of two aliases."""
    return f"2e0*6371.0088e0*asin(least(1e0, sqrt(pow(sin(({b}.lat-{a}.lat)*pi()/360e0),2)+cos({a}.lat*pi()/180e0)*cos({b}.lat*pi()/180e0)*pow(sin(({b}.lon-{a}.lon)*pi()/360e0),2))))"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.depth import depth_bounds

    li = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity", "l_discount", *ORDER)
    s = depth_bounds(li, "l_orderkey", ORDER, "l_quantity")
    return s.select(F.col("l_orderkey").alias("core_id"), F.col("l_returnflag").alias("stratum"), F.col("l_quantity").alias("thickness"), F.col("l_discount").alias("density"), (F.col("l_extendedprice") / 1000).alias("om"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000).alias("soc"), "seg_index", "bottom", "top")


def points(spark: SparkSession, sf_dir: str, table: str = "supplier") -> DataFrame:
    p = table[0]
    key = f"{p}_{'supp' if p == 's' else 'cust'}key"
    df = read(spark, sf_dir, table)
    lon = F.lit(-88.0) + F.pmod(F.col(key) * 7919, F.lit(1000)) / 1000.0
    lat = F.lit(55.5) + F.pmod(F.col(key) * 104729, F.lit(1000)) / 1000.0
    return df.select(F.col(key).alias("id"), lon.alias("lon"), lat.alias("lat"), F.col(f"{p}_acctbal").alias("v"), F.col(f"{p}_nationkey").alias("stratum"))
