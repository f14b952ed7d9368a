"""Tree records to plot, plot x species and plot x species x size metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from understory import fixed_values as fv
from understory.functions import basal_area_sqft, count_true, per_acre, size_class, species_group, zero_sum
from understory.profiles import Profile

SPECIES = {"species_group": fv.SPECIES_GROUPS}
SPECIES_SIZE = {"species_group": fv.SPECIES_GROUPS, "size_class": fv.SIZE_CLASSES}

# Sums from which every metric of a group follows, and which add up over groups.
SUMS = (
    "n_live_gt10cm", "n_live_gt10in", "n_dead_gt10in", "n_dead_gt10cm",
    "ba_live_ft", "ba_dead_ft", "dbh2_live",
)

CELL_MEASURES = (
    "n_live_gt10cm", "n_live_gt10in", "n_dead_gt10in", "ba_live_ft", "qmd_live_in",
    "ba_live_sqfac", "tpa_live_gt10cm", "tpa_live_gt10in", "tpa_snags_gt10in",
)


def measure_trees(trees: DataFrame, profile: Profile) -> DataFrame:
    """Trees at or above the minimum size, with group, units and size class."""
    return describe_trees(trees.where(F.col("dbh_cm") >= fv.MIN_DBH_CM), profile)


def describe_trees(trees: DataFrame, profile: Profile) -> DataFrame:
    """Trees of any size, with group, units and size class."""
    dbh_in = F.col("dbh_cm") / fv.CM_PER_INCH
    return (
        trees.withColumn("species_code", F.upper("species_code"))
        .withColumn("species_group", species_group(F.col("species_code"), profile.species_codes))
        .withColumn("dbh_in", dbh_in)
        .withColumn("ba_ft", basal_area_sqft(F.col("dbh_cm")))
        .withColumn("size_class", size_class(F.col("dbh_in")))
    )


def sum_trees(measured: DataFrame, by: Sequence[str | Column], profile: Profile) -> DataFrame:
    """Additive sums by group, combined on the map side before the shuffle."""
    return measured.groupBy(*by).agg(*_sums(profile))


def _sums(profile: Profile) -> list[Column]:
    live, dead = F.col("status") == "L", F.col("status") == "D"
    large = F.col("dbh_cm") > profile.gt10in_cm
    return [
        count_true(live).alias("n_live_gt10cm"),
        count_true(large & live).alias("n_live_gt10in"),
        count_true(large & dead).alias("n_dead_gt10in"),
        count_true(dead).alias("n_dead_gt10cm"),
        zero_sum(F.when(live, F.col("ba_ft"))).alias("ba_live_ft"),
        zero_sum(F.when(dead, F.col("ba_ft"))).alias("ba_dead_ft"),
        zero_sum(F.when(live, F.col("dbh_in") * F.col("dbh_in"))).alias("dbh2_live"),
    ]


def take_census(trees: DataFrame, profile: Profile) -> DataFrame:
    """Sums of the measured trees and counts of all trees, from one pass over them.

    A row stands for the trees of a plot, a species code and a size class that are measured, or are
    not (``measured``): :func:`roll_up` of the measured ones gives what :func:`sum_trees` gives.
    ``n_trees`` counts rows of any size, also without a diameter, ``n_oversize`` those too large for the last class.
    Counts are part of the table, so a task that runs twice counts once.
    """
    measured = F.coalesce(F.col("dbh_cm") >= fv.MIN_DBH_CM, F.lit(False))
    described = describe_trees(trees, profile).withColumn("measured", measured)
    described = described.withColumn("size_class", F.when(F.col("measured"), F.col("size_class")))
    return described.groupBy(*profile.keys, "species_code", *SPECIES_SIZE, "measured").agg(
        *_sums(profile),
        F.count(F.lit(1)).alias("n_trees"),
        count_true(F.col("dbh_in") > fv.SIZE_CLASS_UPPER_IN[-1]).alias("n_oversize"),
    )


def roll_up(sums: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Coarser sums from finer ones, without another look at the trees."""
    return sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS])


def qmd() -> Column:
    """Quadratic mean diameter of live stems, null when there are none."""
    return F.sqrt(F.try_divide(F.col("dbh2_live"), F.col("n_live_gt10cm")))


def plot_metrics(sums: DataFrame, profile: Profile) -> DataFrame:
    """Metrics of a whole plot."""
    metrics = {
        "qmd_live_in": qmd(),
        "ba_live_sqfac": per_acre(F.col("ba_live_ft")),
        "ba_dead_sqfac": per_acre(F.col("ba_dead_ft")),
        "tpa_live_gt10cm": per_acre(F.col("n_live_gt10cm")),
        "tpa_live_gt10in": per_acre(F.col("n_live_gt10in")),
        "tpa_dead_gt10cm": per_acre(F.col(profile.dead_gt10cm_source)),
        "tpa_dead_gt10in": per_acre(F.col("n_dead_gt10in")),
    }
    unused = ["dbh2_live"] if profile.dead_gt10cm_source == "n_dead_gt10cm" else ["dbh2_live", "n_dead_gt10cm"]
    return sums.withColumns(metrics).drop(*unused)


def cell_metrics(sums: DataFrame, by: Sequence[str]) -> DataFrame:
    """Metrics of a species or species x size cell of a plot."""
    return sums.withColumns(
        {
            "qmd_live_in": qmd(),
            "ba_live_sqfac": per_acre(F.col("ba_live_ft")),
            "tpa_live_gt10cm": per_acre(F.col("n_live_gt10cm")),
            "tpa_live_gt10in": per_acre(F.col("n_live_gt10in")),
            "tpa_snags_gt10in": per_acre(F.col("n_dead_gt10in")),
        }
    ).select(*by, *CELL_MEASURES)


def shared_scan_rollup(measured: DataFrame, profile: Profile) -> DataFrame:
    """All three levels from one pass over the trees, told apart by ``level``.

    Trees are summed once at the finest grain; the coarser levels add up those
    sums. Grouping sets would instead triple every tree row before the first
    aggregate.
    """
    return rollup_levels(sum_trees(measured, [*profile.keys, *SPECIES_SIZE], profile), profile)


def rollup_levels(finest: DataFrame, profile: Profile) -> DataFrame:
    """The finest sums and the two coarser levels that follow from them, told apart by ``level``."""
    keys = list(profile.keys)
    species = roll_up(finest, [*keys, *SPECIES])
    plot = roll_up(species, keys)
    levels = {"plot": plot, "species": species, "species_size": finest}
    columns = [*keys, *SPECIES_SIZE, *SUMS]
    parts = []
    for level, frame in levels.items():
        absent = [c for c in SPECIES_SIZE if c not in frame.columns]
        parts.append(
            frame.withColumns({c: F.lit(None).cast("string") for c in absent} | {"level": F.lit(level)})
            .select("level", *columns)
        )
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first
