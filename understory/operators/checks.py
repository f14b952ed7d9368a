"""Data-quality reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from understory.fixed_values import CM_PER_INCH, SIZE_CLASS_UPPER_IN
from understory.functions import strict_sum
from understory.operators.duplicates import flag_later
from understory.operators.joins import null_safe_join


def ids_missing_from(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys of ``left`` that ``right`` does not have."""
    mine, theirs = left.select(*keys).distinct(), right.select(*keys).distinct()
    return null_safe_join(mine, theirs, keys, "left_anti")


def repeated_keys(frame: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def oversize_trees(trees: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trees per plot that are too large for the last size class."""
    too_large = F.col("dbh_cm") / CM_PER_INCH > SIZE_CLASS_UPPER_IN[-1]
    return trees.where(too_large).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def species_frequency(trees: DataFrame) -> DataFrame:
    """Rows per upper-case species code; rows without a code are not counted."""
    code = F.upper("species_code").alias("species_code")
    return trees.select(code).where(F.col("species_code").isNotNull()).groupBy("species_code").agg(
        F.count(F.lit(1)).alias("n")
    )


def census_report(census: DataFrame, plots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The checks of a run from what it stored: (check, *keys, species_code, n), without a scan of the trees.

    ``census`` comes from ``trees.take_census``, ``plots`` has a row for each plot record. ``n`` counts
    trees, or plot records where a check is about plots. One grouping of the census by plot serves three checks.
    """
    trees = census.groupBy(*keys).agg(F.sum("n_trees").alias("n_trees"), F.sum("n_oversize").alias("n_oversize"))
    records = plots.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_records"))
    both = trees.select(F.struct(*keys).alias("_key"), "n_trees", "n_oversize").join(
        records.select(F.struct(*keys).alias("_key"), "n_records"), "_key", "full")
    found = {
        "oversize_trees": (F.col("n_oversize") > 0, F.col("n_oversize")),
        "trees_without_plots": (F.col("n_records").isNull(), F.col("n_trees")),
        "plots_without_trees": (F.col("n_trees").isNull(), F.col("n_records")),
        "duplicate_plots": (F.col("n_records") > 1, F.col("n_records")),
    }
    labelled = F.array(*[F.when(hit, F.struct(F.lit(name).alias("check"), n.alias("n"))) for name, (hit, n) in found.items()])
    by_plot = both.select("_key.*", F.inline(F.array_compact(labelled))).withColumn("species_code", F.lit(None).cast("string"))
    codes = census.where(F.col("species_code").isNotNull()).groupBy("species_code").agg(F.sum("n_trees").alias("n"))
    by_code = codes.withColumns({"check": F.lit("species_freq")} | {k: F.lit(None).cast(census.schema[k].dataType) for k in keys})
    columns = ["check", *keys, "species_code", "n"]
    return by_plot.select(*columns).unionByName(by_code.select(*columns))


def survey_fingerprint(trees: DataFrame, plot_id: str) -> DataFrame:
    """Basal area (dm2) by species of each survey of one plot, largest first (``row_rank``).

    The first and second entry of the earlier year are told apart by whether a
    tree number was seen before in the file. A missing diameter makes the sum
    of its group null.
    """
    flagged = flag_later(trees.where(F.col("plot_id") == plot_id))
    label = (
        F.when(F.col("year") == "2025", "2025").when(F.col("is_later"), "2024b").otherwise("2024a")
    )
    radius_dm = F.col("dbh_cm") / 20
    by_species = (
        flagged.withColumn("plot_year", label)
        .groupBy("plot_year", "species_code")
        .agg(strict_sum(F.pi() * radius_dm * radius_dm).alias("ba"))
    )
    order = [F.desc_nulls_last("ba"), F.asc_nulls_last("species_code")]
    ranked = by_species.withColumn("row_rank", F.row_number().over(Window.partitionBy("plot_year").orderBy(*order)))
    return ranked.orderBy(F.asc_nulls_last("plot_year"), *order)
