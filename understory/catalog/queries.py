"""Registered queries over the test tables.

Each query is a plan of the library, cut to declared columns. Doubles are
rounded to six places so that sums in a different order compare equal.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from understory import fixed_values as fv
from understory.catalog import inputs
from understory.operators import checks, corrections, dimension, duplicates, figures, spatial, strata
from understory.plans.inventory import Inventory
from understory.plans.surveys import StoredInventory, add_survey
from understory.profiles import Profile, RecodePlots
from understory.sources import schemas
from understory.sources.shared import shared_folder
from understory.sources.tables import add_file_position, bind_surveys
from understory.sources.versions import TableSet

Query = Callable[[SparkSession, str], DataFrame]

PLOT_NUMBERS = ["ba_live_ft", "ba_dead_ft", "qmd_live_in", "ba_live_sqfac", "ba_dead_sqfac",
                "tpa_live_gt10cm", "tpa_live_gt10in", "tpa_dead_gt10cm", "tpa_dead_gt10in", "elev_m"]
CELL_NUMBERS = ["ba_live_ft", "qmd_live_in", "ba_live_sqfac", "tpa_live_gt10cm", "tpa_live_gt10in",
                "tpa_snags_gt10in", "elev_m"]
COUNTS = ["n_live_gt10cm", "n_live_gt10in", "n_dead_gt10in"]
DIM_TWO = ["elev_class", "trt_ctl", "treated_simp", "trt_project", "y2024_untrt_y2025_trt"]
DIM_ONE = ["elev_class", "trt_ctl"]
MEANS = list(strata.STRATUM_MEASURES)
SP, SIZE = "species_group", "size_class"
BOX = ["q1", "median", "q3"]
CURVE = ["y", "density", "violinwidth"]
ENDS = ["ymin", "ymax"]
FUEL_NUMBERS = ["count_1h", "count_10h", "count_100h", "count_1000h",
                "mass_1hr", "mass_10hr", "mass_100hr", "mass_fine", "elev_m"]
TILE = ["tile_x", "tile_y", "pixel_x", "pixel_y"]

# query: (columns as they are, columns rounded to six places)
SHAPES: dict[str, tuple[list[str], list[str]]] = {
    # ingest and corrections
    "plots_union_recode": (["year", "plot_id", "treated", "cavities_large", "cavities_small", "Observer_other"], []),
    "trees_union_recode": (["year", "plot_id", "n"], []),
    "fuels_union_recode": (["year", "plot_id", "n"], []),
    "tree_corrections": (["year", "plot_id", "tree_num", "dbh_cm"], []),
    "dedupe_keep_later": (["year", "plot_id", "n_rows"], []),
    "ingest_csv_keep_later": (["year", "plot_id", "n_rows"], []),
    # checks
    "plots_set_aside": (["year", "plot_id", "Sample", "treated", "cwhr_type"], []),
    "fuels_set_aside": (["year", "plot_id", "trt_ctl", "trt_project"], ["mass_1hr", "mass_fine"]),
    "dup_report": (["year", "plot_id", "tree_num", "species_code", "status", "dbh_cm"], []),
    "survey_fingerprint": (["plot_year", "species_code", "row_rank"], ["ba"]),
    "plots_without_trees": (["year", "plot_id"], []),
    "trees_without_plots": (["year", "plot_id"], []),
    "duplicate_plots": (["year", "plot_id", "n"], []),
    "duplicate_trees": (["year", "plot_id", "tree_num", "n"], []),
    "oversize_trees": (["year", "plot_id", "n"], []),
    "species_freq": (["species_code", "n"], []),
    "run_checks": (["check", "year", "plot_id", "species_code", "n"], []),
    "run_checks_b": (["check", "plot_id", "species_code", "n"], []),
    # dimension
    "tree_metrics": (["year", "plot_id", "tree_num", "species_code", "status", SP, SIZE], ["dbh_in", "ba_ft"]),
    "plots_elev": (["year", "plot_id"], ["elev_m"]),
    "plots_elev_stored": (["year", "plot_id"], ["elev_m"]),
    "plots_tile_keys": (["year", "plot_id", *TILE], ["lon", "lat"]),
    "plots_elev_tiles": (["year", "plot_id", *TILE], ["elev_m"]),
    "elev_median": ([], ["elev_median"]),
    "plot_dimension": (["year", "plot_id", *DIM_TWO], ["elev_m"]),
    "plot_dimension_b": (["plot_id", *DIM_ONE], ["elev_m"]),
    "paired_plots": (["plot_id"], []),
    # plot-level tables
    "trees_plt": (["year", "plot_id", *COUNTS, "n_dead_gt10cm", *DIM_TWO], PLOT_NUMBERS),
    "ingest_trees_plt": (["year", "plot_id", *COUNTS, "n_dead_gt10cm", *DIM_TWO], PLOT_NUMBERS),
    "trees_plt_sp": (["year", "plot_id", SP, *COUNTS, *DIM_TWO], CELL_NUMBERS),
    "trees_plt_sp_size": (["year", "plot_id", SP, SIZE, *COUNTS, *DIM_TWO], CELL_NUMBERS),
    "trees_plt_b": (["plot_id", *COUNTS, *DIM_ONE], PLOT_NUMBERS),
    "trees_plt_sp_b": (["plot_id", SP, *COUNTS, *DIM_ONE], CELL_NUMBERS),
    "trees_plt_sp_size_b": (["plot_id", SP, SIZE, *COUNTS, *DIM_ONE], CELL_NUMBERS),
    "rollup_shared_scan": (
        ["level", "year", "plot_id", SP, SIZE, *COUNTS, "n_dead_gt10cm"], ["ba_live_ft", "ba_dead_ft", "dbh2_live"]
    ),
    # years added to stored sums
    "yearly_trees_plt": (["year", "plot_id", *COUNTS, "n_dead_gt10cm", *DIM_TWO], PLOT_NUMBERS),
    "yearly_rollup": (
        ["level", "year", "plot_id", SP, SIZE, *COUNTS, "n_dead_gt10cm"], ["ba_live_ft", "ba_dead_ft", "dbh2_live"]
    ),
    "yearly_trees_sp_size": ([SP, SIZE], MEANS),
    "yearly_trees_sp_size_paired": ([SP, SIZE, "treated_simp", "year", "trt_project"], MEANS),
    "yearly_fuels_mass": (["year", "plot_id", *DIM_TWO], FUEL_NUMBERS),
    # stratum means
    "trees_sp_elev": ([SP, "elev_class"], MEANS),
    "trees_sp_trtctl": ([SP, "trt_ctl"], MEANS),
    "trees_sp_trtuntrt": ([SP, "year", "trt_project"], MEANS),
    "trees_sp_size": ([SP, SIZE], MEANS),
    "trees_sp_size_ranked": ([SP, SIZE, "row_rank"], ["tpa_live_gt10cm"]),
    "trees_sp_size_elev": ([SP, SIZE, "elev_class"], MEANS),
    "trees_sp_size_trtctl": ([SP, SIZE, "trt_ctl"], MEANS),
    "trees_sp_size_y2024untrt_y2025trt": ([SP, SIZE, "treated_simp", "year", "trt_project"], MEANS),
    "trees_sp_elev_b": ([SP, "elev_class"], MEANS),
    "trees_sp_trtctl_b": ([SP, "trt_ctl"], MEANS),
    "trees_sp_size_b": ([SP, SIZE], MEANS),
    "trees_sp_size_elev_b": ([SP, SIZE, "elev_class"], MEANS),
    "trees_sp_size_trtctl_b": ([SP, SIZE, "trt_ctl"], MEANS),
    # fuels
    "fuels_agg": (["year", "plot_id"], FUEL_NUMBERS[:4]),
    "fuels_mass": (["year", "plot_id", *DIM_TWO], FUEL_NUMBERS),
    "fuels_mass_b": (["plot_id", *DIM_ONE], FUEL_NUMBERS),
    "fuels_long": (["year", "plot_id", "elev_class", "trt_ctl", "fuel_class"], ["mass_tons_ac"]),
    "fuels_long_paired": (
        ["year", "plot_id", "elev_class", "trt_ctl", "trt_project", "fuel_class"], ["mass_tons_ac"]
    ),
    "fuels_long_b": (["plot_id", "elev_class", "trt_ctl", "fuel_class"], ["mass_tons_ac"]),
    # bars
    "bar_totals_size": (["trt_project", "year", SIZE, "label"], ["total_tpa"]),
    "bar_totals_tpa": (["year", "trt_project", "label", "panel_rank"], ["total_tpa"]),
    "bar_totals_ba": (["year", "trt_project", "label", "panel_rank"], ["total_ba"]),
    "stack_size": ([SIZE, SP], ENDS),
    "stack_size_elev": (["elev_class", SIZE, SP], ENDS),
    "stack_size_trtctl": (["trt_ctl", SIZE, SP], ENDS),
    "stack_elev_tpa": (["elev_class", SP], ENDS),
    "stack_elev_ba": (["elev_class", SP], ENDS),
    "stack_trtctl_tpa": (["trt_ctl", SP], ENDS),
    "stack_trtctl_ba": (["trt_ctl", SP], ENDS),
    "stack_paired_size": (["trt_project", "year", SIZE, SP], ENDS),
    "stack_paired_tpa": (["trt_project", "year", SP, "panel_rank"], ENDS),
    "stack_paired_ba": (["trt_project", "year", SP, "panel_rank"], ENDS),
    "stack_size_b": ([SIZE, SP], ENDS),
    "stack_size_elev_b": (["elev_class", SIZE, SP], ENDS),
    "stack_size_trtctl_b": (["trt_ctl", SIZE, SP], ENDS),
    "stack_elev_tpa_b": (["elev_class", SP], ENDS),
    "stack_elev_ba_b": (["elev_class", SP], ENDS),
    "stack_trtctl_tpa_b": (["trt_ctl", SP], ENDS),
    "stack_trtctl_ba_b": (["trt_ctl", SP], ENDS),
    # boxes and violins
    "box_elev": (["measure", "elev_class"], BOX),
    "box_paired": (["measure", "trt_project", "year"], BOX),
    "box_fuels": (["fuel_class", "elev_class"], BOX),
    "box_fuels_paired": (["fuel_class", "trt_project", "year"], BOX),
    "box_elev_b": (["measure", "elev_class"], BOX),
    "box_trtctl_b": (["measure", "trt_ctl"], BOX),
    "box_fuels_b": (["fuel_class", "elev_class"], BOX),
    "box_fuels_trtctl_b": (["fuel_class", "trt_ctl"], BOX),
    "density_elev": (["measure", "elev_class", "n", "point"], CURVE),
    "density_paired": (["measure", "trt_project", "year", "n", "point"], CURVE),
    "density_fuels": (["fuel_class", "elev_class", "n", "point"], CURVE),
    "density_fuels_paired": (["fuel_class", "trt_project", "year", "n", "point"], CURVE),
    "density_elev_b": (["measure", "elev_class", "n", "point"], CURVE),
    "density_trtctl_b": (["measure", "trt_ctl", "n", "point"], CURVE),
    "density_fuels_b": (["fuel_class", "elev_class", "n", "point"], CURVE),
    "density_fuels_trtctl_b": (["fuel_class", "trt_ctl", "n", "point"], CURVE),
    # other figures
    "paired_ba_lines": (["trt_project", "plot_id", "year", "label"], ["ba_live_ft"]),
    "cwhr_counts_elev": (["elev_class", "cwhr_size", "cwhr_cover", "cwhr_type", "n"], []),
    "cwhr_counts_elev_b": (["elev_class", "cwhr_size", "cwhr_cover", "cwhr_type", "n"], []),
    "cwhr_counts_trtctl_b": (["trt_ctl", "cwhr_size", "cwhr_cover", "cwhr_type", "n"], []),
}


def shaped(name: str, frame: DataFrame) -> DataFrame:
    plain, rounded = SHAPES[name]
    return frame.select(*plain, *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in rounded])


# --- queries that are more than one property of an inventory ------------------

def _count_by_plot(frame: DataFrame, name: str = "n") -> DataFrame:
    return frame.groupBy("year", "plot_id").agg(F.count(F.lit(1)).alias(name))


def _split_surveys(frame: DataFrame) -> list[tuple[str, DataFrame]]:
    """The table as two one-year tables without a year column, as surveys arrive."""
    return [(y, frame.where(F.col("year") == y).drop("year")) for y in ("2024", "2025")]


def _united(frame: DataFrame, schema, recodes: tuple[RecodePlots, ...]) -> DataFrame:
    tagged = [part.withColumn("year", F.lit(year)) for year, part in _split_surveys(frame)]
    return corrections.recode_plot_ids(bind_surveys(tagged, schema), recodes)


def plots_union_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first year lacks a column, the second has others under its own names, as the surveys arrive."""
    (_, first), (_, second) = _split_surveys(inputs.plots(spark, sf_dir))
    first = first.drop("treated").withColumn("year", F.lit("2024"))
    second = second.withColumnsRenamed({new: old for old, new in fv.PLOT_COLUMNS_2025.items()})
    second = second.withColumn("year", F.lit("2025")).withColumnsRenamed(fv.PLOT_COLUMNS_2025)
    united = bind_surveys([first, dimension.drop_unsurveyed(second)], schemas.PLOTS)
    return corrections.recode_plot_ids(united, inputs.CORRECTIONS.recodes)


def trees_union_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count_by_plot(_united(inputs.trees(spark, sf_dir), schemas.TREES, inputs.CORRECTIONS.recodes))


def fuels_union_recode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _count_by_plot(_united(inputs.fuels(spark, sf_dir), schemas.FUELS, inputs.CORRECTIONS.recodes))


def tree_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = corrections.recode_plot_ids(inputs.trees(spark, sf_dir), inputs.CORRECTIONS.recodes)
    return corrections.changed_rows(
        trees, inputs.CORRECTIONS.tree_values, ["year", "plot_id", "tree_num", "dbh_cm"]
    )


def survey_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the plot are taken by the identifiers they have in the source, so the scan reads only those."""
    rules = inputs.CORRECTIONS
    surveys = [(year, inputs.FINGERPRINT_PLOT) for year in ("2024", "2025")]
    rows = add_file_position(inputs.trees(spark, sf_dir)).where(duplicates.in_surveys(duplicates.source_surveys(surveys, rules.recodes)))
    fixed = corrections.set_values(corrections.recode_plot_ids(rows, rules.recodes), rules.tree_values)
    return checks.survey_fingerprint(fixed, inputs.FINGERPRINT_PLOT)


def plots_tile_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    visited = inputs.plots(spark, sf_dir).where(F.col("Easting").isNotNull())
    return spatial.tile_keys(visited, fv.UTM_ZONE, fv.DEM_ZOOM)


def plots_elev_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation from a raster keyed by tile and pixel."""
    keyed = plots_tile_keys(spark, sf_dir)
    return spatial.attach_elevation(keyed, inputs.tile_raster(spark), spatial.cell_columns(TILE), keep_keys=True)


def plots_elev_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation from a raster stored for this join: its cells stay where they are, and those around the plots are read."""
    plots = spatial.require_coordinates(inputs.two_year(spark, sf_dir).surveyed_plots)
    cell = spatial.grid_cell(*inputs.DEM_ORIGIN, inputs.DEM_RESOLUTION_M)
    near = spatial.cells_around(inputs.stored_dem(spark), plots, cell, list(cell))
    return spatial.attach_elevation(plots, near, cell)


def run_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks of a run that stored its tables, two plots of a year under one identifier among them."""
    inv = inputs.two_year(spark, sf_dir, Profile(corrections=inputs.COLLIDING))
    return inv.materialize(with_checks=True).run_checks


def duplicate_plots(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv = inputs.two_year(spark, sf_dir, Profile(corrections=inputs.COLLIDING))
    return checks.repeated_keys(inv.located_plots, inv.keys)


def ingest_trees_plt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.two_year(spark, sf_dir, records=inputs.ingested_trees(spark, sf_dir)).trees_plt


def ingest_csv_keep_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees through text files, where file order decides which entry of a tree is the later one."""
    inv = inputs.two_year(spark, sf_dir, records=inputs.exported_trees(spark, sf_dir))
    return _count_by_plot(inv.trees, "n_rows")


SETTING_ASIDE = Profile(corrections=inputs.COLLIDING, plot_collisions="set aside")


def plots_set_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.two_year(spark, sf_dir, SETTING_ASIDE).plots_set_aside


def fuels_set_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fuel masses when two plots of a year come under one identifier: no row twice, no attribute guessed."""
    return inputs.two_year(spark, sf_dir, SETTING_ASIDE).fuels_mass


def _yearly(spark: SparkSession, sf_dir: str) -> StoredInventory:
    """The first year is stored as it arrives, the second is added, then the first is replaced with its corrections."""
    store = TableSet(spark, f"{shared_folder(spark)}/surveys-{uuid.uuid4().hex}")
    add_survey(store, inputs.survey(spark, sf_dir, "2024", Profile()), "2024")
    for year in ("2025", "2024"):
        add_survey(store, inputs.survey(spark, sf_dir, year), year)
    return StoredInventory(store, inputs.TWO_YEAR_INPUTS)


# --- queries that are one table of an inventory --------------------------------


TWO_YEAR: dict[str, Callable[[Inventory], DataFrame]] = {
    "dedupe_keep_later": lambda inv: _count_by_plot(inv.trees, "n_rows"),
    "dup_report": lambda inv: duplicates.later_rows(inv.trees),
    "plots_without_trees": lambda inv: checks.ids_missing_from(inv.located_plots, inv.trees, inv.keys),
    "trees_without_plots": lambda inv: checks.ids_missing_from(inv.trees, inv.located_plots, inv.keys),
    "duplicate_trees": lambda inv: checks.repeated_keys(inv.trees, list(duplicates.TREE_KEY)),
    "oversize_trees": lambda inv: checks.oversize_trees(inv.trees, inv.keys),
    "species_freq": lambda inv: checks.species_frequency(inv.trees),
    "tree_metrics": lambda inv: inv.measured_trees,
    "plots_elev": lambda inv: inv.located_plots,
    "elev_median": lambda inv: dimension.median_elevation(inv.located_plots),
    "plot_dimension": lambda inv: inv.dimension,
    "paired_plots": lambda inv: dimension.paired_plot_ids(inv.plots),
    "trees_plt": lambda inv: inv.trees_plt,
    "trees_plt_sp": lambda inv: inv.trees_plt_sp,
    "trees_plt_sp_size": lambda inv: inv.trees_plt_sp_size,
    "rollup_shared_scan": lambda inv: inv.rollup_shared_scan,
    "trees_sp_elev": lambda inv: inv.trees_sp_elev,
    "trees_sp_trtctl": lambda inv: inv.trees_sp_trtctl,
    "trees_sp_trtuntrt": lambda inv: inv.trees_sp_trtuntrt,
    "trees_sp_size": lambda inv: inv.trees_sp_size,
    "trees_sp_size_ranked": lambda inv: figures.ranked_by_level(inv.trees_sp_size, [SP], SIZE, fv.SIZE_CLASSES),
    "trees_sp_size_elev": lambda inv: inv.trees_sp_size_elev,
    "trees_sp_size_trtctl": lambda inv: inv.trees_sp_size_trtctl,
    "trees_sp_size_y2024untrt_y2025trt": lambda inv: inv.trees_sp_size_paired,
    "fuels_agg": lambda inv: inv.fuels_agg,
    "fuels_mass": lambda inv: inv.fuels_mass,
    "fuels_long": lambda inv: inv.fuels_long("elev_class"),
    "fuels_long_paired": lambda inv: inv.fuels_long_paired,
    "bar_totals_size": lambda inv: inv.bar_totals_size,
    "bar_totals_tpa": lambda inv: figures.reversed_panels(inv.bar_totals_tpa, "trt_project", "year"),
    "bar_totals_ba": lambda inv: figures.reversed_panels(inv.bar_totals_ba, "trt_project", "year"),
    "stack_size": lambda inv: inv.stack("trees_sp_size", SIZE, [], "tpa_live_gt10cm"),
    "stack_size_elev": lambda inv: inv.stack("trees_sp_size_elev", SIZE, ["elev_class"], "tpa_live_gt10cm"),
    "stack_size_trtctl": lambda inv: inv.stack("trees_sp_size_trtctl", SIZE, ["trt_ctl"], "tpa_live_gt10cm"),
    "stack_elev_tpa": lambda inv: inv.stack("trees_sp_elev", "elev_class", [], "tpa_live_gt10cm"),
    "stack_elev_ba": lambda inv: inv.stack("trees_sp_elev", "elev_class", [], "ba_live_ft"),
    "stack_trtctl_tpa": lambda inv: inv.stack("trees_sp_trtctl", "trt_ctl", [], "tpa_live_gt10cm"),
    "stack_trtctl_ba": lambda inv: inv.stack("trees_sp_trtctl", "trt_ctl", [], "ba_live_ft"),
    "stack_paired_size": lambda inv: inv.stack_paired_size,
    "stack_paired_tpa": lambda inv: figures.reversed_panels(
        inv.stack("trees_sp_trtuntrt", "year", ["trt_project"], "tpa_live_gt10cm"), "trt_project", "year"
    ),
    "stack_paired_ba": lambda inv: figures.reversed_panels(
        inv.stack("trees_sp_trtuntrt", "year", ["trt_project"], "ba_live_ft"), "trt_project", "year"
    ),
    "box_elev": lambda inv: inv.box_elev,
    "box_paired": lambda inv: inv.box_paired,
    "box_fuels": lambda inv: inv.box_fuels_elev,
    "box_fuels_paired": lambda inv: inv.box_fuels_paired,
    "density_elev": lambda inv: inv.density_elev,
    "density_paired": lambda inv: inv.density_paired,
    "density_fuels": lambda inv: inv.density_fuels_elev,
    "density_fuels_paired": lambda inv: inv.density_fuels_paired,
    "paired_ba_lines": lambda inv: inv.paired_ba_lines,
    "cwhr_counts_elev": lambda inv: inv.habitat_counts("elev_class"),
}

YEARLY: dict[str, Callable[[Inventory], DataFrame]] = {
    "yearly_trees_plt": TWO_YEAR["trees_plt"],
    "yearly_rollup": TWO_YEAR["rollup_shared_scan"],
    "yearly_trees_sp_size": TWO_YEAR["trees_sp_size"],
    "yearly_trees_sp_size_paired": TWO_YEAR["trees_sp_size_y2024untrt_y2025trt"],
    "yearly_fuels_mass": TWO_YEAR["fuels_mass"],
}

ONE_YEAR: dict[str, Callable[[Inventory], DataFrame]] = {
    "run_checks_b": lambda inv: inv.materialize(with_checks=True).run_checks,
    "plot_dimension_b": lambda inv: inv.dimension,
    "trees_plt_b": lambda inv: inv.trees_plt,
    "trees_plt_sp_b": lambda inv: inv.trees_plt_sp,
    "trees_plt_sp_size_b": lambda inv: inv.trees_plt_sp_size,
    "trees_sp_elev_b": lambda inv: inv.trees_sp_elev,
    "trees_sp_trtctl_b": lambda inv: inv.trees_sp_trtctl,
    "trees_sp_size_b": lambda inv: inv.trees_sp_size,
    "trees_sp_size_elev_b": lambda inv: inv.trees_sp_size_elev,
    "trees_sp_size_trtctl_b": lambda inv: inv.trees_sp_size_trtctl,
    "fuels_mass_b": lambda inv: inv.fuels_mass,
    "fuels_long_b": lambda inv: inv.fuels_long("elev_class"),
    "stack_size_b": TWO_YEAR["stack_size"],
    "stack_size_elev_b": TWO_YEAR["stack_size_elev"],
    "stack_size_trtctl_b": TWO_YEAR["stack_size_trtctl"],
    "stack_elev_tpa_b": TWO_YEAR["stack_elev_tpa"],
    "stack_elev_ba_b": TWO_YEAR["stack_elev_ba"],
    "stack_trtctl_tpa_b": TWO_YEAR["stack_trtctl_tpa"],
    "stack_trtctl_ba_b": TWO_YEAR["stack_trtctl_ba"],
    "box_elev_b": lambda inv: inv.box_elev,
    "box_trtctl_b": lambda inv: inv.box_trtctl,
    "box_fuels_b": lambda inv: inv.box_fuels_elev,
    "box_fuels_trtctl_b": lambda inv: inv.box_fuels_trtctl,
    "density_elev_b": lambda inv: inv.density_elev,
    "density_trtctl_b": lambda inv: inv.density_trtctl,
    "density_fuels_b": lambda inv: inv.density_fuels_elev,
    "density_fuels_trtctl_b": lambda inv: inv.density_fuels_trtctl,
    "cwhr_counts_elev_b": lambda inv: inv.habitat_counts("elev_class"),
    "cwhr_counts_trtctl_b": lambda inv: inv.habitat_counts("trt_ctl"),
}

DIRECT: dict[str, Query] = {
    "plots_union_recode": plots_union_recode,
    "trees_union_recode": trees_union_recode,
    "fuels_union_recode": fuels_union_recode,
    "tree_corrections": tree_corrections,
    "survey_fingerprint": survey_fingerprint,
    "plots_tile_keys": plots_tile_keys,
    "plots_elev_tiles": plots_elev_tiles,
    "plots_elev_stored": plots_elev_stored,
    "duplicate_plots": duplicate_plots,
    "run_checks": run_checks,
    "ingest_trees_plt": ingest_trees_plt,
    "ingest_csv_keep_later": ingest_csv_keep_later,
    "plots_set_aside": plots_set_aside,
    "fuels_set_aside": fuels_set_aside,
}


def _run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    if name in DIRECT:
        frame = DIRECT[name](spark, sf_dir)
    elif name in YEARLY:
        frame = YEARLY[name](_yearly(spark, sf_dir))
    elif name in ONE_YEAR:
        frame = ONE_YEAR[name](inputs.one_year(spark, sf_dir))
    else:
        frame = TWO_YEAR[name](inputs.two_year(spark, sf_dir))
    return shaped(name, frame)


def all_queries() -> dict[str, Query]:
    return {name: partial(_run, name) for name in SHAPES}
