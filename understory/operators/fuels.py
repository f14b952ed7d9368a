"""Dead-fuel counts to fuel mass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from understory import fixed_values as fv
from understory.functions import zero_sum

COUNTS = {"count_1h": "count_1hr", "count_10h": "count_10h", "count_100h": "count_100h", "count_1000h": "count_1000h"}
LONG_CLASSES = ("mass_fine",)  # of the long form
MASS_COUNT = {"1hr": "count_1h", "10hr": "count_10h", "100hr": "count_100h"}


def sum_transects(fuels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts per plot over its transects; a missing count adds nothing."""
    return fuels.groupBy(*keys).agg(*[zero_sum(F.col(raw)).alias(out) for out, raw in COUNTS.items()])


def class_mass(count: Column, fuel_class: str) -> Column:
    """Tons per acre of one fuel class from its planar-transect count."""
    diameter_sq, gravity, length_m = fv.FUEL_CLASSES[fuel_class]
    numerator = fv.FUEL_K * count * diameter_sq * gravity * fv.FUEL_ANGLE * fv.FUEL_SLOPE_CORRECTION
    return numerator / (length_m * fv.FUEL_TRANSECTS * fv.FEET_PER_M_FUEL)


def fuel_mass(summed: DataFrame) -> DataFrame:
    """Mass by class and of all fine fuels. The 1000-hour class has no mass."""
    masses = {f"mass_{c}": class_mass(F.col(count), c) for c, count in MASS_COUNT.items()}
    fine = F.col("mass_1hr") + F.col("mass_10hr") + F.col("mass_100hr")
    return summed.withColumns(masses).withColumn("mass_fine", fine)


def long_form(mass: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per plot and fuel class; only the fine total is carried on."""
    return mass.unpivot(list(ids), list(LONG_CLASSES), "fuel_class", "mass_tons_ac")
