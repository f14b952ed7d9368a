"""Column expressions: scalar rules and null-aware aggregates."""

from understory.functions.aggregates import count_true, mean, strict_sum, zero_sum
from understory.functions.columns import (
    basal_area_sqft,
    basal_area_sqm,
    closed_levels,
    elev_class,
    if_else,
    is_one_of,
    level_order,
    per_acre,
    project_code,
    recode,
    size_class,
    species_group,
)

__all__ = [
    "basal_area_sqft", "basal_area_sqm", "closed_levels", "count_true", "elev_class", "if_else",
    "is_one_of", "level_order", "mean", "per_acre", "project_code", "recode", "size_class",
    "species_group", "strict_sum", "zero_sum",
]
