"""Kernel densities behind violin plots.

The Gaussian density is taken on a fixed grid of points after linear binning,
the usual published shortcut: each value is shared between its two neighbouring
grid points, and only the binned weights are convolved with the kernel. Rows
are reduced to at most ``POINTS`` weights per group before the shuffle; the
convolution works on those.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from understory.operators.joins import join_group_statistics
from understory.operators.quantiles import group_statistics

POINTS = 512


def bandwidth() -> Column:
    """Rule-of-thumb bandwidth from count, spread and quartile range."""
    spread = F.least(F.col("sd"), (F.col("q3") - F.col("q1")) / 1.34)
    level = F.abs(F.col("min"))
    usable = (
        F.when(spread > 0, spread).when(F.col("sd") > 0, F.col("sd")).when(level > 0, level).otherwise(F.lit(1.0))
    )
    return F.lit(0.9) * usable * F.pow(F.col("n").cast("double"), F.lit(-0.2))


def violin_density(
    frame: DataFrame,
    x: str,
    panel: Sequence[str],
    value: str,
    closed: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Density of ``value`` over its range for each violin at ``x`` in a ``panel``.

    ``panel`` names at least one column, such as the measure shown in it. Groups of fewer than two rows have no violin. ``violinwidth`` is relative to
    the tallest violin of the panel, as in equal-area violins.
    """
    by = [*panel, x]
    stats = group_statistics(frame, by, value, {"q1": 0.25, "q3": 0.75}, closed).where("n >= 2")
    stats = stats.withColumn("bw", bandwidth())
    stats = stats.withColumn("low", F.col("min") - 4 * F.col("bw")).withColumn(
        "step", (F.col("max") + 4 * F.col("bw") - F.col("low")) / (POINTS - 1)
    )
    grid = stats.select(*by, "n", "min", "max", "bw", "low", "step")
    rows = frame.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    placed = join_group_statistics(rows, grid, by, "_v", closed, F.col("n")).withColumn(
        "_at", (F.col("_v") - F.col("low")) / F.col("step")
    )
    left = F.floor("_at").cast("int")
    share = F.col("_at") - left
    shares = F.array(
        F.struct(left.alias("bin"), ((1 - share) * F.col("_n")).alias("w")),
        F.struct((left + 1).alias("bin"), (share * F.col("_n")).alias("w")),
    )
    carried = ["n", "min", "max", "bw", "low", "step"]
    bins = placed.select(*by, *carried, F.inline(shares)).groupBy(*by, "bin").agg(
        F.sum("w").alias("w"), *[F.max(c).alias(c) for c in carried]
    )
    nested = bins.groupBy(*by).agg(
        F.collect_list(F.struct("bin", "w")).alias("bins"), *[F.max(c).alias(c) for c in carried]
    )

    # The kernel depends on the distance of two grid points only: one vector serves all of them.
    z = F.lit(1.0) * F.col("step") / F.col("bw")
    height = 1 / (F.col("n") * F.col("bw") * sqrt(2 * pi))
    kernel = F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda d: F.exp(z * z * d * d * -0.5) * height)

    def smoothed(group: Column) -> Column:
        def at(j: Column) -> Column:
            return F.aggregate(group["bins"], F.lit(0.0), lambda total, b: total + b.w * F.get(group["kernel"], F.abs(j - b.bin)))

        return F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)), at)

    # bound once for all points by a transform over an array of one
    group = F.array(F.struct("bins", kernel.alias("kernel")))
    smooth = nested.withColumn("_k", F.get(F.transform(group, smoothed), F.lit(0))).drop("bins")

    # Read the density off at evenly spaced points of the data range.
    spacing = (F.col("max") - F.col("min")) / (POINTS - 1)
    points = F.transform(
        F.sequence(F.lit(0), F.lit(POINTS - 1)),
        lambda i: F.struct(i.alias("point"), (F.col("min") + i * spacing).alias("y")),
    )
    at = (F.col("y") - F.col("low")) / F.col("step")
    below = F.least(F.floor(at).cast("int"), F.lit(POINTS - 2))
    base = F.get("_k", below)
    density = base + (F.get("_k", below + 1) - base) * (at - below)
    curves = smooth.select(*by, "n", "low", "step", "_k", F.inline(points)).select(
        *by, "n", "point", "y", density.alias("density")
    )
    # A panel holds POINTS rows for each of its few violins.
    tallest = F.max("density").over(Window.partitionBy(*panel))
    return curves.withColumn("violinwidth", F.col("density") / tallest)
