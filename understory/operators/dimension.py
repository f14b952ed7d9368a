"""The plot dimension: attributes joined to every plot-level table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from understory import fixed_values as fv
from understory.functions import closed_levels, elev_class, is_one_of, project_code, recode
from understory.operators.joins import PACKED, null_safe_join, pack
from understory.operators.quantiles import exact_quantiles
from understory.profiles import Profile

PAIRED_FLAG = "y2024_untrt_y2025_trt"
ELEVATION = ("elev_m", "elev_class")
PLAIN_ATTRIBUTES = (*ELEVATION, "trt_ctl")
PAIRED_ATTRIBUTES = ("treated_simp", "trt_project", PAIRED_FLAG)


def drop_unsurveyed(plots: DataFrame, year: str = "2025") -> DataFrame:
    """Plots of ``year`` without coordinates were never visited."""
    unvisited = F.coalesce(F.col("year") == year, F.lit(False)) & F.col("Easting").isNull()
    return plots.where(~unvisited)


def median_elevation(plots: DataFrame) -> DataFrame:
    """Exact median elevation, one row."""
    return exact_quantiles(plots, [], "elev_m", {"elev_median": 0.5}).select("elev_median")


def classify_plots(plots: DataFrame, profile: Profile) -> DataFrame:
    """Recode habitat classes, split by elevation, derive project and treatment."""
    split: Column = (
        F.lit(profile.elev_split) if profile.elev_split is not None else median_elevation(plots).scalar()
    )
    cover = closed_levels(recode(F.col("cwhr_cover"), fv.CWHR_COVER_CODES), fv.CWHR_COVERS)
    derived = {
        "cwhr_type": recode(F.col("cwhr_type"), fv.CWHR_TYPE_CODES),
        "cwhr_cover": cover,
        "elev_class": elev_class(F.col("elev_m"), split),
    }
    if profile.paired:
        derived["treated_simp"] = is_one_of(F.col("treated"), fv.TREATED_VALUES)
        derived["trt_project"] = project_code(F.col("plot_id"))
    return plots.withColumns(derived)


def paired_plot_ids(plots: DataFrame) -> DataFrame:
    """Plots seen untreated in 2024 and treated in 2025, one row each.

    One aggregate over the plot replaces the two identifier sets and their
    intersection.
    """
    treated_2025 = (F.col("year") == "2025") & F.col("treated_simp")
    untreated_2024 = (F.col("year") == "2024") & ~F.col("treated_simp")
    return (
        plots.groupBy("plot_id")
        .agg(F.bool_or(treated_2025).alias("_after"), F.bool_or(untreated_2024).alias("_before"))
        .where(F.col("_after") & F.col("_before"))
        .select("plot_id")
    )


def attributes(profile: Profile) -> list[str]:
    """Names of the attributes of :func:`plot_dimension`."""
    return [*PLAIN_ATTRIBUTES, *(PAIRED_ATTRIBUTES if profile.paired else ())]


def guard_keys(dimension: DataFrame, keys: Sequence[str], collisions: str) -> DataFrame:
    """The dimension with each key once, unless keys that repeat are to multiply rows.

    The records of a key are counted in one aggregate by the packed key, which combines before
    the shuffle and leaves the dimension dealt out as the join on it needs. A repeated key stops
    the job where ``collisions`` is ``"fail"``, and is left out where it is ``"set aside"``.
    """
    if collisions == "multiply":
        return dimension
    if collisions not in ("fail", "set aside"):
        raise ValueError(f"unknown treatment of plot collisions: {collisions}")
    attributes = F.struct(F.lit(True).alias("_there"), *[c for c in dimension.columns if c not in keys])
    counted = dimension.groupBy(pack(keys)).agg(F.count(F.lit(1)).alias("_n"), F.any_value(attributes).alias("_a"))
    if collisions == "set aside":
        counted = counted.where("_n = 1")
    else:
        message = F.concat(F.col("_n").cast("string"), F.lit(" plot records of "), F.to_json(PACKED))
        counted = counted.withColumn("_a", F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.col("_a")))
    return counted.select(f"{PACKED}.*", "_a.*").drop("_there")


def colliding_records(plots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Plot records whose key has several."""
    counted = plots.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return null_safe_join(plots, counted.drop("_n"), keys, "left_semi")


def plot_dimension(plots: DataFrame, profile: Profile, columns: Sequence[str] | None = None) -> DataFrame:
    """Plot attributes by key. ``plots`` has been through :func:`classify_plots`.

    ``columns`` limits it to some of :func:`attributes`; the paired flag costs a join
    only where it is asked for. Without any, a row per plot record is left.
    """
    wanted = [c for c in attributes(profile) if columns is None or c in columns]
    source = {"trt_ctl": F.col("Sample").alias("trt_ctl")}
    dimension = plots.select(*profile.keys, *[source.get(c, c) for c in wanted if c != PAIRED_FLAG])
    if PAIRED_FLAG not in wanted:
        return dimension
    flagged = paired_plot_ids(plots).withColumn("_paired", F.lit(True))
    joined = null_safe_join(dimension, flagged, ["plot_id"])
    return joined.withColumn(PAIRED_FLAG, F.col("_paired").isNotNull()).drop("_paired")
