"""Masks and filters of image tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col, safe_div

#: Scene classes that are cloud, shadow, snow or defective; and the reflectance scale.
CLOUDY, REFLECTANCE = (1, 3, 8, 9, 10, 11), 10_000


def cloud_mask(band: Column | str, scene_class: Column | str, bad: tuple[int, ...] = CLOUDY) -> Column:
    """Reflectance, NULL where the scene class is bad."""
    return F.when(~col(scene_class).isin(*bad), col(band) / REFLECTANCE)


def quality_mask(quality: Column | str, degrade: Column | str) -> Column:
    return (col(quality) == 1) & (col(degrade) == 0)


def in_season(time: Column | str, first_day: int = 182, last_day: int = 244, first_year: int = 2023, last_year: int = 2025) -> Column:
    return F.dayofyear(col(time)).between(first_day, last_day) & F.year(col(time)).between(first_year, last_year)


def has_polarisation(list_: Column | str, wanted: str) -> Column:
    return F.array_contains(col(list_), wanted)


def unmasked(condition: Column) -> Column:
    """1 or 0; a NULL condition is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def zscore(value: Column | str, mean: Column | str, sd: Column | str) -> Column:
    return safe_div(col(value) - col(mean), col(sd))


def consistent(z: Column | str, most: float = 1.5) -> Column:
    return F.abs(col(z)) <= most


def class_label(code: Column | str, labels: dict[int, str]) -> Column:
    pairs = [x for k, v in labels.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(code)), F.concat(F.lit("class "), col(code).cast("string")))
