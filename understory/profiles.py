"""Run profiles: which keys, thresholds, code lists and corrections apply.

One pipeline serves both summaries of the inventory. ``TWO_YEAR`` compares two
survey years and applies the field corrections; ``ONE_YEAR`` summarises a
single survey and differs only in the switches listed here.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from understory import fixed_values as fv


@dataclass(frozen=True)
class RecodePlots:
    """Replace plot identifiers in one survey year, in every table."""

    year: str
    mapping: Mapping[str, str]


@dataclass(frozen=True)
class SetValue:
    """Set ``column`` to ``value`` on tree rows where every ``match`` column is equal.

    ``null_test`` says what an undecided (null) comparison does: ``"keep"``
    leaves the value alone, ``"null"`` makes it null.
    """

    match: Mapping[str, Any]
    column: str
    value: Any
    null_test: str = "keep"


@dataclass(frozen=True)
class Corrections:
    """Field corrections, as data. Applied in the order of the fields."""

    recodes: tuple[RecodePlots, ...] = ()
    tree_values: tuple[SetValue, ...] = ()
    keep_later: tuple[tuple[str, str], ...] = ()


SURVEY_CORRECTIONS = Corrections(
    recodes=(RecodePlots("2024", fv.PLOT_ID_FIXES_2024),),
    tree_values=(
        SetValue(fv.DBH_FIX["match"], "dbh_cm", fv.DBH_FIX["dbh_cm"]),
        SetValue(fv.TREE_NUM_FIX["match"], "tree_num", fv.TREE_NUM_FIX["tree_num"], null_test="null"),
    ),
    keep_later=fv.RESURVEYED_PLOTS,
)


@dataclass(frozen=True)
class Profile:
    """Switches that separate the two summaries.

    ``elev_split`` of ``None`` splits at the median elevation of the plots.
    ``mean_year`` restricts the single-year stratum means; ``None`` averages
    everything. ``plot_collisions`` says what happens to rows that meet several plot records
    of one key: ``"multiply"`` joins them to each, as a plain join does, ``"fail"`` stops
    the job, ``"set aside"`` joins them to none and leaves those records to a table of their own.
    """

    keys: tuple[str, ...] = ("year", "plot_id")
    pine_codes: tuple[str, ...] = fv.PINE_CODES
    gt10in_cm: float = fv.TEN_INCHES_CM
    elev_split: float | None = fv.ELEV_SPLIT_M
    dead_gt10cm_source: str = "n_dead_gt10cm"
    mean_year: str | None = "2024"
    paired: bool = True
    plot_collisions: str = "multiply"
    corrections: Corrections = field(default_factory=Corrections)

    @property
    def species_codes(self) -> dict[str, tuple[str, ...]]:
        return {
            "shade_tolerant": fv.SHADE_TOLERANT_CODES,
            "pine": self.pine_codes,
            "hardwood": fv.HARDWOOD_CODES,
            "tanoak": fv.TANOAK_CODES,
        }


TWO_YEAR = Profile(corrections=SURVEY_CORRECTIONS)

# In the one-year summary the "10 in" columns are cut at 10 cm and the dead
# density over 10 cm comes from them; both are kept so results agree.
ONE_YEAR = Profile(
    keys=("plot_id",),
    pine_codes=fv.PINE_CODES_ONE_YEAR,
    gt10in_cm=10.0,
    elev_split=None,
    dead_gt10cm_source="n_dead_gt10in",
    mean_year=None,
    paired=False,
)
