"""The whole pipeline, from survey tables to figure datasets.

Every table is a lazy DataFrame plan. Reading one costs nothing; running it scans
only the tables and columns it needs. Boxes and violins take several passes, so
they write the plot-level table they are made of to the shared folder first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from understory import fixed_values as fv
from understory.functions import zero_sum
from understory.operators import checks, corrections, dimension, duplicates, figures, fuels, strata, trees
from understory.operators.densify import nest_cells, unnest_cells
from understory.operators.density import violin_density
from understory.operators.dimension import PAIRED_FLAG
from understory.operators.joins import PACKED, null_safe_join, pack
from understory.operators.spatial import attach_elevation, drop_geometry, grid_cell, require_coordinates
from understory.operators.trees import CELL_MEASURES, SPECIES, SPECIES_SIZE
from understory.profiles import Profile
from understory.sources.shared import cut_lineage
from understory.sources.tables import POSITION, add_file_position

# Closed domains of the elevation figures; a null class is a group as well.
ELEV_MEASURES = {"measure": figures.VIOLIN_MEASURES, "elev_class": fv.ELEV_CLASSES}
ELEV_FUELS = {"fuel_class": fuels.LONG_CLASSES, "elev_class": fv.ELEV_CLASSES}


class Inventory:
    """Summaries of one inventory under one profile.

    ``plots``, ``trees`` and ``fuels`` are the united survey tables; where trees have
    to be compared, ``trees`` carries its position or was just read from Parquet. ``dem`` is
    the elevation raster as a table and ``cell`` computes its keys.
    """

    def __init__(
        self,
        plots: DataFrame,
        trees: DataFrame,
        fuels: DataFrame,
        dem: DataFrame,
        profile: Profile,
        cell: dict[str, Column] | None = None,
    ):
        self.profile = profile
        self.keys = list(profile.keys)
        self._raw = {"plots": plots, "trees": trees, "fuels": fuels}
        self._dem = dem
        self._cell = cell or grid_cell(0.0, 0.0, 30.0)
        self._stored = False  # whether shared tables have been written by materialize()
        self._census: DataFrame | None = None  # counts of all trees, where materialize() stored them

    def _recoded(self, name: str) -> DataFrame:
        return corrections.recode_plot_ids(self._raw[name], self.profile.corrections.recodes)

    # --- cleaned tables ------------------------------------------------------

    @cached_property
    def surveyed_plots(self) -> DataFrame:
        """Plots that were visited."""
        plots = self._recoded("plots")
        return dimension.drop_unsurveyed(plots) if self.profile.paired else plots

    @cached_property
    def located_plots(self) -> DataFrame:
        """Surveyed plots with elevation."""
        return drop_geometry(attach_elevation(require_coordinates(self.surveyed_plots), self._dem, self._cell))

    @cached_property
    def plots(self) -> DataFrame:
        return dimension.classify_plots(self.located_plots, self.profile)

    @cached_property
    def plots_off_raster(self) -> DataFrame:
        """Classified plots for tables that have no use for elevation; it is null here."""
        flat = drop_geometry(self.surveyed_plots).withColumn("elev_m", F.lit(None).cast("double"))
        return dimension.classify_plots(flat, self.profile)

    @cached_property
    def dimension(self) -> DataFrame:
        return dimension.plot_dimension(self.plots, self.profile)

    @cached_property
    def plots_set_aside(self) -> DataFrame:
        """Surveyed plot records that share their key with others; a profile may keep them out of all joins."""
        return dimension.colliding_records(drop_geometry(self.surveyed_plots), self.keys)

    @cached_property
    def trees(self) -> DataFrame:
        """Trees after corrections, without the first entry of resurveyed plots."""
        return self._corrected_trees()

    @cached_property
    def positioned_trees(self) -> DataFrame:
        """Raw trees with their position in the file, which only comparisons of trees need."""
        raw = self._raw["trees"]
        return raw if POSITION in raw.columns else add_file_position(raw)

    def _corrected_trees(self, measured: bool = False, only: Column | None = None) -> DataFrame:
        """``measured``: rows are not told apart any more, so most are read without a position."""
        rules = self.profile.corrections
        once = len(set(rules.keep_later)) == len(rules.keep_later)
        bare = self._raw["trees"].drop(POSITION) if measured and once else None

        def correct(frame: DataFrame) -> DataFrame:
            recoded = corrections.recode_plot_ids(frame, rules.recodes)
            return corrections.set_values(recoded, rules.tree_values)

        compared = self.positioned_trees if rules.keep_later else self._raw["trees"]
        return duplicates.keep_later_surveys(compared, rules.keep_later, correct, rules.recodes, only=only, others=bare)

    @cached_property
    def measured_trees(self) -> DataFrame:
        """Trees of the minimum size. Unless a correction can lift a tree over it, the scan drops the others."""
        fixes = [fix.match.get("dbh_cm") for fix in self.profile.corrections.tree_values if fix.column == "dbh_cm"]
        settled = all(old is not None and old >= fv.MIN_DBH_CM for old in fixes)
        large = F.col("dbh_cm") >= fv.MIN_DBH_CM
        return trees.measure_trees(self._corrected_trees(True, large if settled else None), self.profile)

    @cached_property
    def fuels(self) -> DataFrame:
        return self._recoded("fuels")

    # --- plot-level tables ---------------------------------------------------

    def tree_sums(self, by: Sequence[str | Column], year: str | None = None) -> DataFrame:
        """Additive sums of the trees, of one year if it is given; all tree tables are made of them."""
        measured = self.measured_trees if year is None else self.measured_trees.where(F.col("year") == year)
        return trees.sum_trees(measured, by, self.profile)

    def with_plots(self, frame: DataFrame, columns: list[str] | None = None, year: str | None = None) -> DataFrame:
        """Attach the plot dimension; rows without a plot keep null attributes.

        ``columns`` are the attributes that are used: without an elevation the raster
        is not joined, without the paired flag the plots are not paired. ``year``
        is the only one ``frame`` holds, if it holds only one.
        """
        attributes = dimension.attributes(self.profile) if columns is None else columns
        if self._stored or set(dimension.ELEVATION) & set(attributes):
            plots = self.dimension if self._stored or columns is None else dimension.plot_dimension(
                self.plots, self.profile, columns)
        else:
            plots = dimension.plot_dimension(self.plots_off_raster, self.profile, columns)
        if year is not None:
            plots = plots.where(F.col("year") == year)
        plots = dimension.guard_keys(plots.select(*self.keys, *attributes), self.keys, self.profile.plot_collisions)
        return null_safe_join(frame, plots.select(*self.keys, *attributes), self.keys)

    @cached_property
    def trees_plt(self) -> DataFrame:
        sums = self.tree_sums([pack(self.keys)])
        return self.with_plots(trees.plot_metrics(sums.select(f"{PACKED}.*", "*"), self.profile))

    def _nested(self, domains: dict, columns: list[str] | None = None, year: str | None = None) -> DataFrame:
        """Observed cells per plot, one row each, with the plot's attributes (those in ``columns``).

        Attributes are joined before cells are unrolled: one row per plot meets
        the dimension instead of one per cell. Filling touches measures only, so
        the order does not matter to the result.
        """
        by = [*self.keys, *domains]
        cells = trees.cell_metrics(self.tree_sums(by, year), by)
        return self.with_plots(nest_cells(cells, self.keys, domains, CELL_MEASURES), columns, year)

    @cached_property
    def _species_nested(self) -> DataFrame:
        return self._nested(SPECIES)

    @cached_property
    def _size_nested(self) -> DataFrame:
        return self._nested(SPECIES_SIZE)

    @cached_property
    def trees_plt_sp(self) -> DataFrame:
        return unnest_cells(self._species_nested, SPECIES, CELL_MEASURES)

    @cached_property
    def trees_plt_sp_size(self) -> DataFrame:
        return unnest_cells(self._size_nested, SPECIES_SIZE, CELL_MEASURES)

    @cached_property
    def rollup_shared_scan(self) -> DataFrame:
        return trees.rollup_levels(self.tree_sums([*self.keys, *SPECIES_SIZE]), self.profile)

    @cached_property
    def fuels_agg(self) -> DataFrame:
        return fuels.sum_transects(self.fuels, self.keys)

    @cached_property
    def fuels_mass(self) -> DataFrame:
        return self.with_plots(fuels.fuel_mass(self.fuels_agg))

    # --- stratum means -------------------------------------------------------

    def _one_year_means(self, domains: dict, by: list[str]) -> DataFrame:
        """Means of the profile's year over strata of plot attributes."""
        year = self.profile.mean_year
        if self._stored:
            nested = self._species_nested if domains is SPECIES else self._size_nested
            nested = nested if year is None else nested.where(F.col("year") == year)
        else:
            nested = self._nested(domains, by, year)
        return strata.stratum_means(nested, by, domains)

    @cached_property
    def trees_sp_elev(self) -> DataFrame:
        return self._one_year_means(SPECIES, ["elev_class"])

    @cached_property
    def trees_sp_trtctl(self) -> DataFrame:
        return self._one_year_means(SPECIES, ["trt_ctl"])

    @cached_property
    def trees_sp_trtuntrt(self) -> DataFrame:
        """Paired plots by flag: rows whose survey has no plot record are left out."""
        nested = self._species_nested if self._stored else self._nested(SPECIES, ["trt_project", PAIRED_FLAG])
        paired = nested.where(F.col(PAIRED_FLAG))
        return strata.stratum_means(paired, ["year", "trt_project"], SPECIES)

    @cached_property
    def trees_sp_size(self) -> DataFrame:
        return self._one_year_means(SPECIES_SIZE, [])

    @cached_property
    def trees_sp_size_elev(self) -> DataFrame:
        return self._one_year_means(SPECIES_SIZE, ["elev_class"])

    @cached_property
    def trees_sp_size_trtctl(self) -> DataFrame:
        return self._one_year_means(SPECIES_SIZE, ["trt_ctl"])

    @cached_property
    def trees_sp_size_paired(self) -> DataFrame:
        """Paired plots by identifier: rows whose survey has no plot record stay."""
        ids = dimension.paired_plot_ids(self.plots_off_raster)
        nested = self._size_nested if self._stored else self._nested(SPECIES_SIZE, ["treated_simp", "trt_project"])
        paired = null_safe_join(nested, ids, ["plot_id"], "left_semi")
        return strata.stratum_means(paired, ["treated_simp", "year", "trt_project"], SPECIES_SIZE)

    # --- figure datasets -----------------------------------------------------

    @cached_property
    def bar_totals_size(self) -> DataFrame:
        return strata.totals(
            self.trees_sp_size_paired, ["trt_project", "year", "size_class"], "tpa_live_gt10cm", "total_tpa"
        )

    @cached_property
    def bar_totals_tpa(self) -> DataFrame:
        return strata.totals(self.trees_sp_trtuntrt, ["year", "trt_project"], "tpa_live_gt10cm", "total_tpa")

    @cached_property
    def bar_totals_ba(self) -> DataFrame:
        return strata.totals(self.trees_sp_trtuntrt, ["year", "trt_project"], "ba_live_ft", "total_ba")

    def stack(self, table: str, x: str, facets: list[str], value: str) -> DataFrame:
        """Stacked bars of one of the stratum-mean tables."""
        return figures.stacked_bars(getattr(self, table), x, facets, value)

    @cached_property
    def stack_paired_size(self) -> DataFrame:
        """Bars by size class; treated and untreated rows of a year share a bar."""
        means = self.trees_sp_size_paired.groupBy("trt_project", "year", "size_class", "species_group").agg(
            zero_sum(F.col("tpa_live_gt10cm")).alias("tpa_live_gt10cm")
        )
        return figures.stacked_bars(means, "size_class", ["trt_project", "year"], "tpa_live_gt10cm")

    @cached_property
    def _figure_plots(self) -> DataFrame:
        """Plot metrics behind boxes and violins, stored: those pass over them two or three times."""
        return self.trees_plt if self._stored else cut_lineage(self.trees_plt)

    @cached_property
    def _figure_fuels(self) -> DataFrame:
        """Fuel masses behind boxes and violins, stored."""
        return self.fuels_mass if self._stored else cut_lineage(self.fuels_mass)

    def _elev_measures(self) -> DataFrame:
        return figures.measures_long(figures.known_elevation(self._figure_plots), ["elev_class"])

    def _paired_plots(self) -> DataFrame:
        return self._figure_plots.where(F.col(PAIRED_FLAG))

    def fuels_long(self, x: str, mass: DataFrame | None = None) -> DataFrame:
        ids = [*self.keys, *[c for c in ("elev_class", "trt_ctl") if c not in self.keys]]
        return fuels.long_form(self.fuels_mass if mass is None else mass, ids if x in ids else [*ids, x])

    def _paired_fuels(self, mass: DataFrame) -> DataFrame:
        paired = mass.where(F.col(PAIRED_FLAG))
        return fuels.long_form(paired, ["year", "plot_id", "elev_class", "trt_ctl", "trt_project"])

    @cached_property
    def fuels_long_paired(self) -> DataFrame:
        return self._paired_fuels(self.fuels_mass)

    @cached_property
    def box_elev(self) -> DataFrame:
        return figures.box_hinges(self._elev_measures(), ["measure", "elev_class"], "value", ELEV_MEASURES)

    @cached_property
    def density_elev(self) -> DataFrame:
        return violin_density(self._elev_measures(), "elev_class", ["measure"], "value", ELEV_MEASURES)

    @cached_property
    def box_trtctl(self) -> DataFrame:
        rows = figures.measures_long(self._figure_plots, ["trt_ctl"])
        return figures.box_hinges(rows, ["measure", "trt_ctl"], "value")

    @cached_property
    def density_trtctl(self) -> DataFrame:
        rows = figures.measures_long(self._figure_plots, ["trt_ctl"])
        return violin_density(rows, "trt_ctl", ["measure"], "value")

    @cached_property
    def box_paired(self) -> DataFrame:
        rows = figures.measures_long(self._paired_plots(), ["year", "trt_project"])
        return figures.box_hinges(rows, ["measure", "trt_project", "year"], "value")

    @cached_property
    def density_paired(self) -> DataFrame:
        rows = figures.measures_long(self._paired_plots(), ["year", "trt_project"])
        return violin_density(rows, "year", ["measure", "trt_project"], "value")

    @cached_property
    def box_fuels_elev(self) -> DataFrame:
        """The fuel axis is not limited to the two classes, so the null one stays."""
        return figures.box_hinges(
            self.fuels_long("elev_class", self._figure_fuels), ["fuel_class", "elev_class"], "mass_tons_ac", ELEV_FUELS
        )

    @cached_property
    def density_fuels_elev(self) -> DataFrame:
        return violin_density(
            self.fuels_long("elev_class", self._figure_fuels), "elev_class", ["fuel_class"], "mass_tons_ac", ELEV_FUELS
        )

    @cached_property
    def box_fuels_trtctl(self) -> DataFrame:
        return figures.box_hinges(self.fuels_long("trt_ctl", self._figure_fuels), ["fuel_class", "trt_ctl"], "mass_tons_ac")

    @cached_property
    def density_fuels_trtctl(self) -> DataFrame:
        return violin_density(self.fuels_long("trt_ctl", self._figure_fuels), "trt_ctl", ["fuel_class"], "mass_tons_ac")

    @cached_property
    def box_fuels_paired(self) -> DataFrame:
        return figures.box_hinges(
            self._paired_fuels(self._figure_fuels), ["fuel_class", "trt_project", "year"], "mass_tons_ac"
        )

    @cached_property
    def density_fuels_paired(self) -> DataFrame:
        return violin_density(self._paired_fuels(self._figure_fuels), "year", ["fuel_class", "trt_project"], "mass_tons_ac")

    @cached_property
    def paired_ba_lines(self) -> DataFrame:
        return figures.paired_lines(self.trees_plt)

    def habitat_counts(self, facet: str) -> DataFrame:
        plots = self.plots.withColumnRenamed("Sample", "trt_ctl")
        return figures.habitat_counts(plots, facet)

    # --- running all of it ---------------------------------------------------

    @cached_property
    def run_checks(self) -> DataFrame:
        """What :func:`checks.census_report` finds in this run. Checks that compare single trees are not in it."""
        if self._census is None:
            raise ValueError("run materialize(with_checks=True) first")
        return checks.census_report(self._census, self.dimension, self.keys)

    def materialize(
        self, store: Callable[[DataFrame], DataFrame] = cut_lineage, with_checks: bool = False
    ) -> Inventory:
        """Store what several tables share, so the trees are scanned once.

        Call it before asking for many tables of one run. ``store`` writes a
        frame to shared storage and returns the stored copy. ``with_checks`` keeps counts
        of all trees beside the sums, and :attr:`run_checks` is then read from them.
        """
        self.dimension = store(self.dimension)
        self._stored = True
        by = [*self.keys, *SPECIES_SIZE]
        if with_checks:
            self._census = store(trees.take_census(self._corrected_trees(True), self.profile))
            sums = store(trees.roll_up(self._census.where("measured"), by))
        else:
            sums = store(self.tree_sums(by))
        cells = {
            "_size_nested": (SPECIES_SIZE, sums),
            "_species_nested": (SPECIES, trees.roll_up(sums, [*self.keys, *SPECIES])),
        }
        for name, (domains, rows) in cells.items():
            metrics = trees.cell_metrics(rows, [*self.keys, *domains])
            setattr(self, name, store(self.with_plots(nest_cells(metrics, self.keys, domains, CELL_MEASURES))))
        self.trees_plt = store(
            self.with_plots(trees.plot_metrics(trees.roll_up(sums, self.keys), self.profile))
        )
        self.fuels_mass = store(self.fuels_mass)
        return self
