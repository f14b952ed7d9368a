"""Field corrections: identifier recodes and single-value fixes, driven by data."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from understory.functions import if_else
from understory.profiles import RecodePlots, SetValue


def recode_plot_ids(frame: DataFrame, recodes: Iterable[RecodePlots]) -> DataFrame:
    """Apply identifier recodes to the rows of their survey year.

    The recodes are a short list from the profile, so they are joined as a
    broadcast table. A chain of ``when`` would be copied into every filter on
    the identifier, and the generated code would outgrow what the JVM compiles.
    """
    rows = [(fix.year, old, new) for fix in recodes for old, new in fix.mapping.items()]
    if not rows:
        return frame
    if len({row[:2] for row in rows}) < len(rows):
        raise ValueError("a plot is recoded twice in one year")
    table = frame.sparkSession.createDataFrame(rows, "year string, plot_id string, _new_id string")
    joined = frame.join(F.broadcast(table), ["year", "plot_id"], "left")
    return joined.withColumn("plot_id", F.coalesce("_new_id", "plot_id")).select(*frame.columns)


def matches(fix: SetValue) -> Column:
    """All match columns equal, with three-valued logic."""
    return reduce(lambda a, b: a & b, [F.col(name) == F.lit(value) for name, value in fix.match.items()])


def set_values(trees: DataFrame, fixes: Iterable[SetValue]) -> DataFrame:
    """Apply value fixes one after the other; each sees the result of the last."""
    for fix in fixes:
        old, new, test = F.col(fix.column), F.lit(fix.value), matches(fix)
        if fix.null_test == "null":
            chosen = if_else(test, new, old)
        else:
            chosen = F.when(test, new).otherwise(old)
        trees = trees.withColumn(fix.column, chosen)
    return trees


def changed_rows(trees: DataFrame, fixes: Iterable[SetValue], columns: list[str]) -> DataFrame:
    """Rows the value fixes change, as they are afterwards."""
    fixes = list(fixes)
    touched = sorted({fix.column for fix in fixes})
    before = trees.withColumns({f"_old_{c}": F.col(c) for c in touched})
    after = set_values(before, fixes)
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in touched], F.lit(False))
    return after.where(differs).select(*columns)
