"""Forest-plot inventory analytics as Spark DataFrame jobs."""

from understory.plans.inventory import Inventory
from understory.profiles import ONE_YEAR, TWO_YEAR, Corrections, Profile, RecodePlots, SetValue

__all__ = ["Inventory", "ONE_YEAR", "TWO_YEAR", "Corrections", "Profile", "RecodePlots", "SetValue"]
