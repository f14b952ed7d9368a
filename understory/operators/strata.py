"""Means of plot metrics over strata, with absent cells counted as zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.functions import mean, zero_sum
from understory.operators.densify import Domains, unnest_cells

STRATUM_MEASURES = (
    "n_live_gt10cm", "n_live_gt10in", "n_dead_gt10in", "ba_live_ft", "qmd_live_in",
    "tpa_live_gt10cm", "tpa_live_gt10in", "tpa_snags_gt10in",
)

# Code of the entry that counts a plot, next to the codes of its cells.
PLOT_CODE = -1


def means_of_dense(dense: DataFrame, by: Sequence[str], measures: Sequence[str] = STRATUM_MEASURES) -> DataFrame:
    """Plain means over an already zero-filled table."""
    return dense.groupBy(*by).agg(*[mean(F.col(m)).alias(m) for m in measures])


def stratum_means(
    nested: DataFrame,
    strata: Sequence[str],
    domains: Domains,
    measures: Sequence[str] = STRATUM_MEASURES,
) -> DataFrame:
    """Means over the zero-filled cells of each stratum, without filling them.

    ``nested`` holds one row per plot with its observed cells (``nest_cells``)
    and its attributes. Zero cells add nothing to a sum, so a mean is the sum
    over observed cells divided by the plots of the stratum; only sums by
    stratum and cell, a few dozen rows per stratum, are shuffled. A null-level
    cell exists only where observed and is divided by its own count.
    """
    listed = ", ".join(f"coalesce(e.value.{m}, 0e0) as {m}" for m in measures)
    nothing = ", ".join(f"0e0 as {m}" for m in measures)
    entries = nested.selectExpr(
        *strata,
        f"inline(concat(array(struct({PLOT_CODE} as code, {nothing})),"
        f" transform(map_entries(cells), e -> struct(e.key as code, {listed}))))",
    )
    sums = entries.groupBy(*strata, "code").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(m).alias(m) for m in measures]
    )
    cell = F.struct("code", F.struct("n", *measures))
    by_stratum = sums.groupBy(*strata).agg(
        F.max(F.when(F.col("code") == PLOT_CODE, F.col("n"))).alias("n_plots"),
        F.map_from_entries(F.collect_list(F.when(F.col("code") != PLOT_CODE, cell))).alias("cells"),
    ).where("n_plots is not null")  # without strata, no plots still make one group
    dense = unnest_cells(by_stratum, domains, ["n", *measures])
    in_domain = " and ".join(f"{name} is not null" for name in domains)
    plots = f"(case when {in_domain} then n_plots else n end)"
    return dense.selectExpr(*domains, *strata, *[f"{m} / {plots} as {m}" for m in measures])


def totals(means: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Bar totals with a whole-number label, halves rounded to even."""
    summed = means.groupBy(*by).agg(zero_sum(F.col(value)).alias(name))
    return summed.withColumn("label", F.bround(F.col(name), 0))

