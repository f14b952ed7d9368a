"""Scalar rules as built-in column expressions, all inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from understory import fixed_values as fv


def recode(column: Column, mapping: Mapping[str, str]) -> Column:
    """Replace listed values, leave every other value (and null) alone."""
    result = column
    for old, new in mapping.items():
        result = F.when(column == old, F.lit(new)).otherwise(result)
    return result


def closed_levels(column: Column, levels: Sequence[str]) -> Column:
    """Keep values of a closed domain; anything else becomes null."""
    return F.when(column.isin(*levels), column)


def level_order(column: Column, levels: Sequence[str]) -> Column:
    """Position of a value in its domain, from 0; null (and strangers) come last."""
    position = F.array_position(F.lit(list(levels)), column)
    return F.coalesce(F.when(position > 0, position - 1), F.lit(len(levels))).cast("int")


def is_one_of(column: Column, values: Sequence[str]) -> Column:
    """Membership test that is false, never null, for a null value."""
    return F.coalesce(column.isin(*values), F.lit(False))


def if_else(condition: Column, yes: Column, no: Column) -> Column:
    """Two-way choice whose result is null where the test is null."""
    return F.when(condition, yes).when(~condition, no)


def project_code(plot_id: Column) -> Column:
    """Second part of an ``A_B_C`` identifier, empty when there is none."""
    return F.split_part(plot_id, F.lit("_"), F.lit(2))


def elev_class(elev_m: Column, split: Column) -> Column:
    """Low or high against ``split``; exactly at the split is neither."""
    low, high = fv.ELEV_CLASSES
    return F.when(elev_m < split, low).when(elev_m > split, high)


def species_group(code: Column, codes_by_group: Mapping[str, Sequence[str]]) -> Column:
    """Group of a species code; unlisted and null codes are ``unknown``."""
    result = F.lit("unknown")
    for group, codes in codes_by_group.items():
        result = F.when(code.isin(*codes), group).otherwise(result)
    return result


def size_class(dbh_in: Column) -> Column:
    """Ten-inch bins, closed on the right; null outside 0 to 70 in."""
    bounds = zip(fv.SIZE_CLASS_UPPER_IN, fv.SIZE_CLASSES)
    result = F.when(dbh_in < 0, F.lit(None).cast("string"))
    for upper, label in bounds:
        result = result.when(dbh_in <= upper, label)
    return result


def basal_area_sqm(dbh_cm: Column) -> Column:
    """Stem cross-section in square metres."""
    radius_m = dbh_cm / 200
    return F.pi() * radius_m * radius_m


def basal_area_sqft(dbh_cm: Column) -> Column:
    return basal_area_sqm(dbh_cm) * fv.SQFT_PER_SQM


def per_acre(value: Column) -> Column:
    """Plot total to per-acre value."""
    return value / F.lit(fv.PLOT_AREA_AC)
