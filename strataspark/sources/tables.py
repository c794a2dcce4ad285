"""CSV with verbatim headers, upstream artefacts, manifests, Markdown and versioned snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import null_tokens
from ..operators.gates import GateError, gate_columns

#: The field table's headers as delivered -> (name, type).
FIELD_COLUMNS = {
    "year": ("year", "int"),
    "Core Id": ("core_id", "string"),
    "Sample Id": ("sample_id", "string"),
    "Latitude": ("latitude", "double"),
    "Longitude": ("longitude_supplied", "double"),
    "Depth": ("thickness_cm", "double"),
    "Bulk Density": ("bulk_density_gcm3", "double"),
    "OM": ("om_pct", "double"),
    "SOC": ("soc_pct", "double"),
    "Organic Carbon Density (g/cm^2)": ("ocd_supplied", "double"),
}


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_csv_verbatim(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text under their own headers; "", NA and NaN are NULL; a missing file is fatal."""
    if not _exists(spark, path):
        raise GateError(f"no such file: {path}", remedy="place the table there or correct the path")
    df = spark.read.option("header", True).option("quote", '"').csv(path)
    return df.select(*[null_tokens(F.col(f"`{c}`")).alias(c) for c in df.columns])


def typed(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """Renamed, trimmed and cast; what can't be cast is NULL."""
    gate_columns(df, list(columns))
    return df.select(*[(F.trim(F.col(f"`{c}`")) if t == "string" else F.col(f"`{c}`").try_cast(t)).alias(n) for c, (n, t) in columns.items()])


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    return typed(read_csv_verbatim(spark, path), FIELD_COLUMNS)


def campaign(core_id: Column | str, rules: dict[str, str]) -> Column:
    """Stratum from the id's prefix; an unknown prefix stops the query."""
    c = F.col(core_id) if isinstance(core_id, str) else core_id
    out = F.raise_error(F.concat(F.lit("no campaign for core "), F.coalesce(c, F.lit("NULL")))).cast("string")
    for prefix, name in rules.items():
        out = F.when(c.startswith(prefix), F.lit(name)).otherwise(out)
    return out


def require(spark: SparkSession, path: str, produced_by: str) -> DataFrame:
    """An upstream product as Parquet, or an error that names its producer."""
    if not _exists(spark, path):
        raise GateError(f"{path} is missing", remedy=f"run {produced_by} first")
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, files: int = 1) -> None:
    """Export with empty fields for NULL; ``files`` 1 is meant for small result tables."""
    df.coalesce(files).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def manifest(spark: SparkSession, rows: list[dict]) -> DataFrame:
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame([tuple(None if r.get(k) is None else str(r[k]) for k in names) for r in rows], T.StructType([T.StructField(k, T.StringType()) for k in names]))


def markdown(df: DataFrame, digits: int = 3, rows: int = 60) -> str:
    """A GitHub table of at most ``rows`` rows of a report table."""
    show = lambda v: "" if v is None else f"{round(v, digits):g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in df.limit(rows).collect())])


def report(title: str, sections: dict[str, DataFrame | None]) -> str:
    """Markdown of the sections whose table exists."""
    return "\n\n".join([f"# {title}", *(f"## {k}\n\n{markdown(v)}" for k, v in sections.items() if v is not None)]) + "\n"


def versions(spark: SparkSession, root: str) -> list[int]:
    if not _exists(spark, root):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    names = [s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))


def snapshot(df: DataFrame, root: str) -> int:
    """Write the next version beside the earlier ones and return its number."""
    n = max(versions(df.sparkSession, root), default=0) + 1
    df.write.mode("error").parquet(f"{root}/version={n}")
    return n


def latest(spark: SparkSession, root: str) -> DataFrame:
    found = versions(spark, root)
    if not found:
        raise GateError(f"no version under {root}", remedy="write a snapshot first")
    return spark.read.parquet(f"{root}/version={found[-1]}")


#: Public carbon and land layers (name, asset, units, metres).
CATALOGUE = [
    ("forest carbon", "sothe2022 forest carbon", "kg/m2", 250), ("forest carbon uncertainty", "sothe2022 forest carbon sd", "kg/m2", 250),
    ("soil carbon 0-100", "sothe2022 soil carbon", "kg/m2", 250), ("soil carbon 0-30", "sothe2022 soil carbon 30", "kg/m2", 250),
    ("soil carbon uncertainty", "sothe2022 soil carbon sd", "kg/m2", 250), ("peat carbon", "li2025 peat carbon", "kg/m2", 250),
    ("peat carbon uncertainty", "li2025 peat carbon sd", "kg/m2", 250), ("soil organic carbon content", "soilgrids soc", "dg/kg", 250),
    ("bulk density", "soilgrids bdod", "cg/cm3", 250), ("biomass", "gedi l4a agbd", "Mg/ha", 25), ("relative height 98", "gedi rh98", "m", 25),
    ("canopy height", "sothe canopy height", "m", 250), ("canopy height 1 m", "meta canopy height", "m", 1), ("forest attributes", "scanfi", "t/ha", 30),
    ("wetland class", "gwl fcs30", "class", 30), ("land cover", "esa worldcover", "class", 10), ("embedding", "satellite embedding", "unitless", 10),
]


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "name string, layer string, units string, resolution_m int")
