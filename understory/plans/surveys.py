"""A growing inventory: sums of each survey year are stored, and a further year is added to them.

Tree metrics follow from sums that add up over any grouping, so a year's trees are read once, when
it is added. What depends on several years (pairs, classes, zero-filled levels, figures) is computed from the stored
sums when it is asked for. Adding a year again replaces it; other years are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from understory.operators import trees
from understory.operators.trees import SPECIES_SIZE
from understory.plans.inventory import Inventory
from understory.profiles import Profile
from understory.sources.versions import TableSet

TREE_SUMS, FUEL_SUMS, PLOTS = "tree_sums", "fuel_sums", "plots"


def add_survey(store: TableSet, survey: Inventory, year: str) -> int:
    """Store the sums of ``survey``, an inventory of the records of one year, and return the version with it.

    All years of a set have to be summed under profiles that agree in their rules; corrections may differ.
    A record of another year stops the job, and the set stays as it was.
    """
    if store.by not in survey.keys:
        raise ValueError(f"a profile without {store.by} among its keys has one survey only")
    by = [*survey.keys, *SPECIES_SIZE]
    return store.write(
        {TREE_SUMS: survey.tree_sums(by), FUEL_SUMS: survey.fuels_agg, PLOTS: survey.located_plots}, part=year)


class StoredInventory(Inventory):
    """Summaries of all stored years. Tables of single trees (checks, duplicates) are not to be had from sums."""

    def __init__(self, store: TableSet, profile: Profile, version: int | None = None):
        number = version if version is not None else max(store.versions(), default=None)
        self._sums = store.read(TREE_SUMS, number)
        self._fuel_sums = store.read(FUEL_SUMS, number)
        located = store.read(PLOTS, number)
        super().__init__(located, self._sums, self._fuel_sums, located, profile)

    @cached_property
    def surveyed_plots(self) -> DataFrame:
        return self._raw["plots"]

    @cached_property
    def located_plots(self) -> DataFrame:
        return self._raw["plots"]

    @cached_property
    def fuels_agg(self) -> DataFrame:
        return self._fuel_sums

    @cached_property
    def positioned_trees(self) -> DataFrame:
        raise ValueError("only sums of trees are stored")

    def _corrected_trees(self, measured: bool = False, only: Column | None = None) -> DataFrame:
        raise ValueError("only sums of trees are stored")

    def tree_sums(self, by: Sequence[str | Column], year: str | None = None) -> DataFrame:
        """Stored sums, added up; a filter on the year leaves other years' files unread."""
        sums = self._sums if year is None else self._sums.where(F.col("year") == year)
        return trees.roll_up(sums, by)
