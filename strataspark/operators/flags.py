"""Data-quality flags: rows are annotated, never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import col

#: The flags, their tier and meaning.
DICTIONARY = [
    ("LON_SIGN_REPAIRED", "repair", "longitude had the wrong sign and was flipped"),
    ("COORD_MISSING", "flag", "latitude or longitude missing"),
    ("COORD_OUT_OF_REGION", "flag", "outside the region even after a sign flip"),
    ("BD_ABOVE_MAX", "flag", "bulk density above the plausible maximum"),
    ("BD_BELOW_MIN", "flag", "bulk density below the plausible minimum"),
    ("OM_OUT_OF_RANGE", "flag", "organic matter outside 0 to 100 percent"),
    ("SOC_OUT_OF_RANGE", "flag", "organic carbon outside 0 to 100 percent"),
    ("SOC_EXCEEDS_OM", "flag", "more organic carbon than organic matter"),
    ("THICKNESS_NONPOSITIVE", "flag", "thickness missing or not above 0"),
    ("THICKNESS_ABOVE_MAX", "flag", "thickness above the plausible maximum"),
    ("DUPLICATE_ACROSS_CORES", "flag", "same organic matter and carbon in several cores"),
    ("SINGLE_SEGMENT_CORE", "flag", "core of one segment"),
    ("SEGMENT_INDEX_ABSENT", "flag", "sample id without a trailing number"),
    ("OCD_NOT_RECONCILED", "flag", "supplied density differs from the recomputed one"),
]


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DICTIONARY, "flag string, tier string, meaning string")


def flag_array(rules: list[tuple[str, Column]]) -> Column:
    """The tags whose predicate is true; a NULL predicate counts as false."""
    return F.array_compact(F.array(*[F.when(F.coalesce(p, F.lit(False)), F.lit(tag)) for tag, p in rules]))


def value_rules(bd="bulk_density", om="om_pct", soc="soc_pct", thickness="thickness_cm", bd_max=2.0, bd_min=0.01, thickness_max=50.0) -> list[tuple[str, Column]]:
    bd, om, soc, thickness = (col(c) for c in (bd, om, soc, thickness))
    return [
        ("BD_ABOVE_MAX", bd > bd_max),
        ("BD_BELOW_MIN", bd < bd_min),
        ("OM_OUT_OF_RANGE", (om < 0) | (om > 100)),
        ("SOC_OUT_OF_RANGE", (soc < 0) | (soc > 100)),
        ("SOC_EXCEEDS_OM", soc > om),
        ("THICKNESS_NONPOSITIVE", thickness.isNull() | (thickness <= 0)),
        ("THICKNESS_ABOVE_MAX", thickness > thickness_max),
    ]


def merge(*arrays: Column | str) -> Column:
    return F.array_distinct(F.concat(*[col(a) for a in arrays]))


def to_text(flags: Column | str, sep: str = ";") -> Column:
    return F.array_join(F.array_sort(col(flags)), sep)


def across_groups(df: DataFrame, group: str, values: list[str], name: str = "dup") -> DataFrame:
    """True where the same values stand in two groups at least; NULL values never do. One grouped aggregate, joined back."""
    seen = df.dropna(subset=values).groupBy(*values).agg((F.min(group) != F.max(group)).alias(name))
    return df.join(seen, values, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def single_row_groups(df: DataFrame, group: str, name: str = "single") -> DataFrame:
    return df.withColumn(name, F.count("*").over(Window.partitionBy(group)) == 1)


def tally(df: DataFrame, flags: str) -> DataFrame:
    """flag, n_rows, most frequent first."""
    return df.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), "flag")


def index_absent(df: DataFrame, sample: str, group: str, index: str = "seg_index", flag: str = "index_absent") -> DataFrame:
    """Adds the sample id's trailing number and whether it is absent; an absent one is 1 in a group of one row, and fatal in any other."""
    from ..functions.numeric import trailing_int
    from .gates import GateError

    out = df.withColumn(index, trailing_int(sample)).withColumn(flag, F.col(index).isNull())
    bad = out.groupBy(group).agg(F.count("*").alias("n"), F.max(F.when(F.col(flag), F.col(sample))).alias("sample")).filter("n > 1 and sample is not null").orderBy(group).first()
    if bad is not None:
        raise GateError("the order of segments is unknown", f"sample {bad['sample']} has no trailing number, and its core {bad[group]} has {bad['n']} segments", remedy="take the order from the field records")
    return out.withColumn(index, F.coalesce(F.col(index), F.lit(1)))
