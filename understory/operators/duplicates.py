"""Repeated tree records, in file order.

A record is a *later occurrence* when an earlier row of the source has the same
key. One aggregate counts the rows of each key and finds its first position, a
number, so copies collapse before the shuffle without a sort. Only keys with
several rows are joined back, and a key that holds a large share of the rows is
spread in proportion to it, so it never meets in one task, as it would in a
window over the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from understory.operators.joins import join_by_frequency
from understory.profiles import RecodePlots
from understory.sources.tables import POSITION

TREE_KEY = ("year", "plot_id", "tree_num")


def _with_firsts(trees: DataFrame, keys: Sequence[str], position: str, how: str) -> DataFrame:
    """Rows with ``_first``, the first position of their key where it has several rows."""
    counted = trees.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(position).alias("_first"))
    return join_by_frequency(trees, counted.where("_n > 1"), keys, F.col("_n"), F.col(position), how).drop("_n")


def flag_later(
    trees: DataFrame,
    keys: Sequence[str] = TREE_KEY,
    position: str = POSITION,
    flag: str = "is_later",
) -> DataFrame:
    """Add a boolean column, true on second and later occurrences of a key."""
    later = F.coalesce(F.col(position) > F.col("_first"), F.lit(False))
    return _with_firsts(trees, keys, position, "left").withColumn(flag, later).drop("_first")


def later_rows(trees: DataFrame, keys: Sequence[str] = TREE_KEY, position: str = POSITION) -> DataFrame:
    """Only the second and later occurrences; null keys equal each other."""
    return _with_firsts(trees, keys, position, "inner").where(F.col(position) > F.col("_first")).drop("_first")


def in_surveys(surveys: Iterable[tuple[str, str]]) -> Column:
    """True on rows of the listed (year, plot) surveys, false on all others."""
    hits = [(F.col("year") == year) & (F.col("plot_id") == plot) for year, plot in surveys]
    return F.coalesce(reduce(lambda a, b: a | b, hits, F.lit(False)), F.lit(False))


def source_surveys(
    surveys: Iterable[tuple[str, str]], recodes: Iterable[RecodePlots]
) -> list[tuple[str, str]]:
    """The listed surveys by the identifiers they have before recoding."""
    new_ids = {(fix.year, old): new for fix in recodes for old, new in fix.mapping.items()}
    before = []
    for year, plot in surveys:
        before += [key for key, new in new_ids.items() if (key[0], new) == (year, plot)]
        if (year, plot) not in new_ids:
            before.append((year, plot))
    return before


def keep_later_surveys(
    trees: DataFrame,
    surveys: Iterable[tuple[str, str]],
    correct: Callable[[DataFrame], DataFrame] = lambda frame: frame,
    recodes: Iterable[RecodePlots] = (),
    keys: Sequence[str] = TREE_KEY,
    position: str = POSITION,
    only: Column | None = None,
    others: DataFrame | None = None,
) -> DataFrame:
    """In the listed surveys, drop the first occurrence of every tree.

    These plots were entered twice and only the second entry is right. A tree
    entered once is dropped, of a tree entered three times two rows stay. Year
    and plot are part of the key, so surveys do not affect each other and one
    pass serves any number of them; a survey listed twice is treated twice.

    ``correct`` is applied before trees are compared, and ``recodes`` are the
    identifier changes it makes. Listed surveys are split off on the source
    columns, so the split is a plain filter the scan can prune files by; only
    their rows are shuffled. ``only`` is a condition on source columns for rows of
    the other surveys, for callers that drop rows afterwards anyway; it must not be
    applied before trees of the listed ones are compared. ``others`` is the table as it
    is read without positions, from which rows of the other surveys are then taken;
    the result has no positions either.
    """
    surveys = list(surveys)
    repeated = [s for i, s in enumerate(surveys) if s in surveys[:i]]
    listed = source_surveys(dict.fromkeys(surveys), list(recodes))
    rest = trees if others is None else others
    rest = rest.where(~in_surveys(listed)) if listed else rest
    rest = correct(rest if only is None else rest.where(only))
    if not listed:
        return rest
    kept = later_rows(correct(trees.where(in_surveys(listed))), keys, position)
    result = rest.unionByName(kept.select(*rest.columns))
    if repeated and others is not None:
        raise ValueError("a survey that is listed twice needs positions throughout")
    return keep_later_surveys(result, repeated, keys=keys, position=position) if repeated else result
