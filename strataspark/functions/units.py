"""Densities, stocks and unit conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col

#: Mg/ha of biomass to Mg/ha of carbon is x (1 + below-ground ratio) x carbon fraction; then to kg/m2.
ROOT_RATIO, CARBON_FRACTION, MG_HA_TO_KG_M2 = 0.22, 0.5, 0.1


def carbon_density(bulk_density: Column | str, soc_pct: Column | str) -> Column:
    """g/cm3 of carbon from bulk density in g/cm3 and carbon in percent."""
    return col(bulk_density) * col(soc_pct) / 100


def gcm2_to_kgm2(c: Column | str) -> Column:
    return col(c) * 10


def kgm2_to_tha(c: Column | str) -> Column:
    return col(c) * 10


def tha_to_kgm2(c: Column | str) -> Column:
    return col(c) / 10


def kgm2_to_mgha(c: Column | str) -> Column:
    return col(c) * 10


def mgha_to_kgm2(c: Column | str) -> Column:
    return col(c) * MG_HA_TO_KG_M2


def biomass_to_carbon(agb: Column | str) -> Column:
    return col(agb) * (1 + ROOT_RATIO) * CARBON_FRACTION * MG_HA_TO_KG_M2


def layer_stock(soc: Column | str, bdod: Column | str, thickness_cm: Column | float) -> Column:
    """kg/m2 of one soil layer: soc in dg/kg, bulk density in cg/cm3."""
    return (col(soc) / 10) * (col(bdod) / 100) * thickness_cm / 100


def scaled_soc(soc: Column | str, campaign: Column | str, factors: dict[str, float], standard: float, peat: str) -> Column:
    """Carbon of the peat campaign rescaled to a standard carbon share of organic matter; other rows unchanged."""
    factor = F.when(col(campaign) == peat, F.lit(standard / factors[peat]))
    return col(soc) * F.coalesce(factor, F.lit(1.0))
