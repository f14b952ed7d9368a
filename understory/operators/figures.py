"""Datasets behind the figures. Drawing them is left to the reader."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from understory import fixed_values as fv
from understory.functions import level_order
from understory.operators.dimension import PAIRED_FLAG
from understory.operators.quantiles import exact_quantiles

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
VIOLIN_MEASURES = ("ba_live_ft", "tpa_live_gt10cm", "ba_dead_ft", "tpa_dead_gt10cm")


def stacked_bars(means: DataFrame, x: str, facets: Sequence[str], value: str) -> DataFrame:
    """Lower and upper end of each species segment; the first level is on top.

    A bar has one segment per species group, so its window holds five rows.
    """
    window = (
        Window.partitionBy(*facets, x)
        .orderBy(level_order(F.col("species_group"), fv.SPECIES_GROUPS).desc())
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    upper = F.sum(value).over(window)
    return means.select(*facets, x, "species_group", F.col(value), upper.alias("ymax")).withColumn(
        "ymin", F.col("ymax") - F.col(value)
    )


def reversed_panels(frame: DataFrame, panel: str, *then: str) -> DataFrame:
    """Rows in panel order, last panel first; ``panel_rank`` numbers the panels of each ``then``."""
    ranked = frame.withColumn("panel_rank", F.dense_rank().over(Window.partitionBy(*then).orderBy(F.desc_nulls_last(panel))))
    return ranked.orderBy(F.desc_nulls_last(panel), *[F.asc_nulls_last(c) for c in then])


def in_level_order(frame: DataFrame, domains: Mapping[str, Sequence[str]], *then: str) -> DataFrame:
    """Rows sorted for reading: by level, not by name, nulls last, then by other columns."""
    by_level = [level_order(F.col(name), levels) for name, levels in domains.items()]
    return frame.orderBy(*by_level, *[F.asc_nulls_last(c) for c in then])


def ranked_by_level(frame: DataFrame, by: Sequence[str], name: str, levels: Sequence[str]) -> DataFrame:
    """``row_rank`` of each row within its group, by level, nulls last."""
    order = Window.partitionBy(*by).orderBy(level_order(F.col(name), levels))
    return frame.withColumn("row_rank", F.row_number().over(order))


def measures_long(plots: DataFrame, ids: Sequence[str], measures: Sequence[str] = VIOLIN_MEASURES) -> DataFrame:
    """Plot metrics in long form, so one job serves all panels of a figure."""
    as_double = plots.select(*ids, *[F.col(m).cast("double").alias(m) for m in measures])
    return as_double.unpivot(list(ids), list(measures), "measure", "value")


def box_hinges(frame: DataFrame, by: Sequence[str], value: str, closed: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Quartiles of each box. Whiskers are drawn to the hinges, so add nothing."""
    return exact_quantiles(frame, by, value, QUARTILES, closed)


def known_elevation(frame: DataFrame) -> DataFrame:
    """Rows an axis limited to the two elevation classes shows."""
    return frame.where(F.col("elev_class").isNotNull())


def paired_lines(trees_plt: DataFrame) -> DataFrame:
    """Live basal area of paired plots in both years, labelled at the later end."""
    label = F.when(F.col("year") == "2025", F.col("plot_id"))
    return trees_plt.where(F.col(PAIRED_FLAG)).select(
        "trt_project", "plot_id", "year", "ba_live_ft", label.alias("label")
    )


def habitat_points(plots: DataFrame) -> DataFrame:
    """Plots with a complete habitat class and a numbered size.

    Open-cover text labels need no filter of their own: they are not levels of
    the cover domain, so they are null already. A size stored as a number is
    read as its whole-number text.
    """
    size = F.regexp_replace(F.col("cwhr_size").cast("string"), r"\.0$", "")
    return (
        plots.withColumn("cwhr_size", size)
        .dropna(subset=["cwhr_size", "cwhr_cover", "cwhr_type"])
        .where(F.col("cwhr_size").isin(*fv.CWHR_SIZES))
    )


def habitat_counts(plots: DataFrame, facet: str) -> DataFrame:
    """Points per position of the habitat scatter."""
    return habitat_points(plots).groupBy(facet, "cwhr_size", "cwhr_cover", "cwhr_type").agg(
        F.count(F.lit(1)).alias("n")
    )
