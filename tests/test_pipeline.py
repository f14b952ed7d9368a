"""Whole pipeline on the small test tables: invariants, plans, SQL agreement."""

import os
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from check_oracle import compare, connect
from tests.conftest import rows
from understory import Inventory
from understory.catalog import inputs, queries
from understory.catalog.oracle import all_oracles
from understory.operators import checks
from understory.operators.spatial import grid_cell
from understory.profiles import ONE_YEAR, TWO_YEAR, Profile
from understory.sources import schemas
from understory.sources.tables import read_table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")

# One query of each kind. ALL_QUERIES=1 runs every query, as tools/check_oracle.py does.
SAMPLE = [
    "plots_union_recode", "trees_union_recode", "dedupe_keep_later", "dup_report", "survey_fingerprint",
    "trees_without_plots", "plots_tile_keys", "plot_dimension", "plot_dimension_b", "trees_plt", "trees_plt_sp_size",
    "trees_sp_size", "trees_sp_size_elev", "trees_sp_trtuntrt", "trees_sp_size_y2024untrt_y2025trt",
    "trees_sp_size_b", "rollup_shared_scan", "fuels_mass", "bar_totals_size", "stack_paired_size", "box_elev",
    "box_paired", "box_fuels", "density_elev_b", "density_paired", "cwhr_counts_trtctl_b",
    "plots_without_trees", "duplicate_plots", "tree_corrections", "species_freq", "plots_elev", "plots_elev_tiles",
    "ingest_trees_plt", "trees_sp_size_ranked", "bar_totals_tpa", "stack_paired_tpa", "stack_size_elev", "stack_elev_ba_b",
    "box_fuels_paired", "density_fuels", "density_fuels_trtctl_b", "fuels_long", "fuels_long_paired",
    "run_checks", "run_checks_b", "plots_elev_stored",
]
# These were empty at some scale; they have to show something.
NEVER_EMPTY = ["plots_without_trees", "trees_without_plots", "duplicate_plots", "tree_corrections", "box_fuels"]


@pytest.fixture(scope="module")
def inv(spark):
    return inputs.two_year(spark, SF)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", queries.SHAPES if os.environ.get("ALL_QUERIES") else SAMPLE)
def test_query_equals_its_sql(spark, con, name):
    same, note = compare(spark, con, name, SF)
    assert same, note
    assert name not in NEVER_EMPTY or not note.startswith("0 rows")


def test_entry_module(spark):
    assert set(queries.SHAPES) <= set(__spark_entry__.queries()) and set(queries.SHAPES) <= set(__spark_entry__.oracle_sql())
    frame = __spark_entry__.entry(spark)
    assert frame.columns[:2] == ["species_group", "size_class"] and frame.count() >= 35


def test_every_query_is_registered_once():
    groups = [set(queries.DIRECT), set(queries.TWO_YEAR), set(queries.YEARLY), set(queries.ONE_YEAR)]
    assert set.union(*groups) == set(queries.SHAPES)
    assert sum(map(len, groups)) == len(queries.SHAPES)


def test_filled_tables_have_all_cells(inv):
    surveys = inv.measured_trees.select("year", "plot_id").distinct().count()
    null_cells = inv.measured_trees.where("size_class is null").select("year", "plot_id", "species_group").distinct()
    fan_out = checks.repeated_keys(inv.dimension, inv.keys).count()
    assert fan_out == 0
    assert inv.trees_plt_sp.count() == 5 * surveys
    assert inv.trees_plt_sp_size.count() == 35 * surveys + null_cells.count()


def test_levels_add_up(inv):
    by = ["year", "plot_id"]
    total = F.sum("n_live_gt10cm").alias("n")
    plot = rows(inv.trees_plt.groupBy(*by).agg(total))
    assert rows(inv.trees_plt_sp.groupBy(*by).agg(total)) == plot
    assert rows(inv.trees_plt_sp_size.groupBy(*by).agg(total)) == plot


def test_bars_reach_their_labels(inv):
    top = {(r[0], r[1], r[2]): r[3] for r in inv.stack_paired_size.groupBy("trt_project", "year", "size_class").agg(F.max("ymax")).collect()}
    labels = inv.bar_totals_size.collect()
    assert len(top) == len(labels) > 0
    for r in labels:
        assert top[r.trt_project, r.year, r.size_class] == pytest.approx(r.total_tpa)


def test_one_year_profile_equals_two_year_with_all_switches(spark):
    """On one survey the two summaries differ by their switches only."""
    args = [inputs.plots(spark, SF, False), inputs.trees(spark, SF, False), inputs.fuels(spark, SF, False)]
    dem, cell = inputs.dem(spark), grid_cell(*inputs.DEM_ORIGIN, inputs.DEM_RESOLUTION_M)
    one = Inventory(*args, dem, ONE_YEAR, cell)
    switched = replace(
        Profile(), pine_codes=ONE_YEAR.pine_codes, gt10in_cm=10.0, elev_split=None,
        dead_gt10cm_source="n_dead_gt10in", mean_year=None,
    )
    tagged = [f.withColumn("year", F.lit("2024")) for f in args]
    tagged[0] = tagged[0].withColumn("treated", F.lit(None).cast("string"))
    two = Inventory(*tagged, dem, switched, cell)
    for table in ("trees_plt", "trees_plt_sp", "trees_sp_size_elev", "trees_sp_trtctl", "fuels_mass"):
        mine, theirs = getattr(one, table), getattr(two, table)
        columns = [F.round(c, 9).alias(c) if t == "double" else c for c, t in mine.dtypes]
        assert rows(mine.select(*columns)) == rows(theirs.select(*columns)), table


def test_materialized_run_equals_lazy_run(spark, inv):
    stored = inputs.two_year(spark, SF).materialize()
    for table in ("trees_plt", "trees_plt_sp_size", "trees_sp_size", "trees_sp_elev", "fuels_mass"):
        columns = [F.round(c, 9).alias(c) if t == "double" else c for c, t in getattr(inv, table).dtypes]
        assert rows(getattr(stored, table).select(*columns)) == rows(getattr(inv, table).select(*columns)), table
    plan = stored.trees_sp_size._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "l_suppkey" not in plan


def test_checks_ride_on_a_stored_run(spark, inv):
    """Counts equal the single checks, tables those of a run without them, and the trees are not scanned again."""
    stored = inputs.two_year(spark, SF).materialize(with_checks=True)
    for table in ("trees_plt", "trees_plt_sp", "trees_sp_size"):
        columns = [F.round(c, 9).alias(c) if t == "double" else c for c, t in getattr(inv, table).dtypes]
        assert rows(getattr(stored, table).select(*columns)) == rows(getattr(inv, table).select(*columns)), table
    found = stored.run_checks
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "l_suppkey" not in plan
    alone = {
        "oversize_trees": (checks.oversize_trees(inv.trees, inv.keys), ["year", "plot_id", "n"]),
        "trees_without_plots": (checks.ids_missing_from(inv.trees, inv.located_plots, inv.keys), ["year", "plot_id"]),
        "plots_without_trees": (checks.ids_missing_from(inv.located_plots, inv.trees, inv.keys), ["year", "plot_id"]),
        "duplicate_plots": (checks.repeated_keys(inv.located_plots, inv.keys), ["year", "plot_id", "n"]),
        "species_freq": (checks.species_frequency(inv.trees), ["species_code", "n"]),
    }
    for name, (frame, columns) in alone.items():
        assert rows(found.where(F.col("check") == name), *columns) == rows(frame, *columns), name
    with pytest.raises(ValueError, match="with_checks"):
        inv.run_checks


def final_plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


HEAVY = ["trees_plt", "trees_plt_sp_size", "trees_sp_size", "dup_report", "box_elev", "box_paired", "density_paired",
         "trees_sp_size_y2024untrt_y2025trt", "elev_median", "plot_dimension_b"]


@pytest.mark.parametrize("name", HEAVY)
def test_plans_hold_at_scale(spark, name):
    """No nested-loop or cross join, no Python worker, no window over everything."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = final_plan(queries.all_queries()[name](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "FlatMapGroups"):
        assert operator not in plan, operator
    for window in re.findall(r"windowspecdefinition\(([^)]*)", plan):
        assert not window.startswith("v ASC") and "ASC" not in window.split(",")[0], window


def test_tree_scan_reads_only_needed_columns(spark, inv):
    plan = final_plan(inv.trees_plt)
    schemas = set(re.findall(r"ReadSchema: struct<(l_[^>]*)>", plan))
    assert schemas and all("l_orderkey" not in s and "l_tax" not in s and "l_quantity" not in s for s in schemas)


def test_boxes_and_violins_read_a_stored_table(spark, inv):
    """Their passes are over plot metrics written once, not over the trees."""
    for frame in (inv.box_elev, inv.density_elev, inputs.one_year(spark, SF).density_elev):
        plan = final_plan(frame)
        assert "l_suppkey" not in plan and "s_suppkey" not in plan and plan.count("FileScan") + plan.count("Scan parquet") < 10


def test_tables_join_only_what_they_use(spark, inv):
    """No raster where no elevation is used, one year of plots where one is averaged, no paired flag unless asked."""
    plan = inv.trees_sp_size._jdf.queryExecution().optimizedPlan().toString()
    assert "cell_x" not in plan and "_paired" not in plan
    assert "2025" not in "".join(line for line in plan.splitlines() if "s_suppkey" in line and "suffix" in line and "Generate" in line)
    assert "cell_x" not in inv.trees_sp_trtctl._jdf.queryExecution().optimizedPlan().toString()
    assert "cell_x" in inv.trees_sp_elev._jdf.queryExecution().optimizedPlan().toString()


def test_duplicates_hash_and_main_scan_has_no_position(spark, inv):
    for name in ("dup_report", "dedupe_keep_later", "survey_fingerprint"):
        assert "SortAggregate" not in final_plan(queries.all_queries()[name](spark, SF)), name
    scans = re.findall(r"FileScan parquet \[([^\]]*l_suppkey[^\]]*)\]", final_plan(inv.trees_plt))
    assert len(scans) >= 2 and any("_metadata" not in s and "row_index" not in s for s in scans)


def test_minimum_diameter_reaches_the_scan(spark, tmp_path, plots_of, dem):
    rows = [("A_P_1", float(i), "PSME", "L", 5.0 + i) for i in range(20)]
    frame = spark.createDataFrame(rows, "plot_id string, tree_num double, species_code string, status string, dbh_cm double")
    frame.write.parquet(f"{tmp_path}/trees")
    trees = read_table(spark, f"{tmp_path}/trees", schemas.TREES, year="2024", with_position=True)
    fuels = spark.createDataFrame([], schemas.FUELS)
    inv = Inventory(plots_of([("2024", "A_P_1", "s", None, 5.0, 5.0)]), trees, fuels, dem, TWO_YEAR)
    assert "GreaterThanOrEqual(dbh_cm,10.0)" in final_plan(inv.trees_plt)
    assert inv.measured_trees.count() == 15


def test_oracles_read_given_tables():
    for name, sql in all_oracles().items():
        assert re.search(r"from (lineitem|supplier|events)\b", sql), name
