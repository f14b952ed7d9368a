"""Versioned table sets, and survey years added to stored sums."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import rows
from understory.operators.spatial import grid_cell
from understory.plans.inventory import Inventory
from understory.plans.surveys import StoredInventory, add_survey
from understory.profiles import Corrections, Profile, SetValue
from understory.sources.versions import TableSet

PROFILE = Profile()
FUELS = "year string, plot_id string, count_1hr double, count_10h double, count_100h double, count_1000h double"
TREES = [
    ("2024", "A", 1.0, "PSME", "L", 30.0), ("2024", "A", 2.0, "ABCO", "D", 41.3), ("2024", "B", 1.0, "PIPO", "L", 181.0),
    ("2025", "A", 1.0, "PSME", "L", 31.0), ("2025", "C", 1.0, None, "L", 12.5), ("2025", "C", 2.0, "PSME", None, 5.0),
]
PLOTS = [
    ("2024", "A", "Treatment", None, 10.0, 10.0), ("2024", "B", "Control", None, 40.0, 10.0),
    ("2025", "A", "Treatment", "y", 10.0, 10.0), ("2025", "B", "Control", "n", 999.0, 10.0),
]
FUEL_ROWS = [("2024", "A", 1.0, 2.0, 3.0, 4.0), ("2024", "A", None, 1.0, 1.0, 1.0), ("2025", "A", 5.0, 6.0, 7.0, 8.0)]


@pytest.fixture
def survey(spark, trees_of, plots_of, dem):
    def build(*years, trees=TREES, profile=PROFILE):
        keep = F.col("year").isin(*years)
        return Inventory(plots_of(PLOTS).where(keep), trees_of(trees).where(keep),
                         spark.createDataFrame(FUEL_ROWS, FUELS).where(keep), dem, profile, grid_cell(0.0, 0.0, 30.0))

    return build


TABLES = ("trees_plt", "trees_plt_sp", "trees_plt_sp_size", "trees_sp_elev", "trees_sp_trtuntrt", "trees_sp_size_paired",
          "rollup_shared_scan", "fuels_mass", "bar_totals_tpa", "paired_ba_lines", "dimension")


def test_years_one_by_one_equal_all_years_at_once(spark, survey, tmp_path):
    store = TableSet(spark, str(tmp_path / "set"))
    assert store.versions() == [] and store.manifest() == []
    assert add_survey(store, survey("2024"), "2024") == 1
    first = {r.table: r.path for r in store.manifest()}
    assert add_survey(store, survey("2025"), "2025") == 2
    assert {r.table: r.path for r in store.manifest() if r.part == "2024"} == first  # referred to, not written again
    both, stored = survey("2024", "2025"), StoredInventory(store, PROFILE)
    for name in TABLES:
        expected = getattr(both, name)
        assert rows(getattr(stored, name), *expected.columns) == rows(expected), name
    assert rows(StoredInventory(store, PROFILE, version=1).trees_plt) == rows(survey("2024").trees_plt)
    assert rows(stored.materialize().trees_sp_size) == rows(both.trees_sp_size)


def test_a_year_is_replaced_and_dropped(spark, survey, tmp_path):
    store = TableSet(spark, str(tmp_path / "set"))
    for year in ("2024", "2025"):
        add_survey(store, survey(year), year)
    fixed = Profile(corrections=Corrections(tree_values=(SetValue({"plot_id": "B", "dbh_cm": 181.0}, "dbh_cm", 18.1),)))
    add_survey(store, survey("2024", profile=fixed), "2024")
    assert rows(StoredInventory(store, PROFILE).trees_plt) == rows(survey("2024", "2025", profile=fixed).trees_plt)
    store.drop_part("2024")
    assert rows(StoredInventory(store, PROFILE).trees_plt) == rows(survey("2025").trees_plt)
    assert store.versions() == [1, 2, 3, 4] and store.read("plots", 2).count() == 4
    with pytest.raises(ValueError, match="no part"):
        store.drop_part("2024")
    with pytest.raises(ValueError, match="no version"):
        store.read("plots", 9)


def test_a_stopped_write_leaves_the_old_set(spark, tmp_path):
    store = TableSet(spark, str(tmp_path / "set"))
    store.write({"a": spark.range(3).toDF("x"), "b": spark.range(2).toDF("x")})
    broken = spark.range(5).select(F.when(F.col("id") > 3, F.raise_error(F.lit("stop"))).otherwise(F.col("id")).alias("x"))
    with pytest.raises(PySparkException, match="stop"):
        store.write({"a": spark.range(9).toDF("x"), "b": broken})
    assert store.versions() == [1] and store.read("a").count() == 3 and store.read("b").count() == 2
    (tmp_path / "set" / "versions" / "000000002" / "_temporary").mkdir(parents=True)  # stopped while the manifest was written
    assert store.versions() == [1] and store.read("a").count() == 3
    assert store.write({"a": spark.range(7).toDF("x")}) == 3
    assert store.read("a").count() == 7 and store.read("b").count() == 2 and store.read("a", 1).count() == 3


def test_rows_of_another_year_stop_the_write(spark, survey, tmp_path):
    store = TableSet(spark, str(tmp_path / "set"))
    with pytest.raises(PySparkException, match="another part"):
        add_survey(store, survey("2024", "2025"), "2024")
    assert store.versions() == []


def test_a_year_filter_leaves_other_years_unread(spark, survey, tmp_path):
    store = TableSet(spark, str(tmp_path / "set"))
    for year in ("2024", "2025"):
        add_survey(store, survey(year), year)
    sums = StoredInventory(store, PROFILE).tree_sums(["plot_id"], "2024")
    plan = sums._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1 and "Union" not in plan


def test_empty_years_whole_tables_and_missing_trees(spark, survey, tmp_path):
    store = TableSet(spark, str(tmp_path / "set"))
    add_survey(store, survey("2024"), "2024")
    add_survey(store, survey("2023"), "2023")
    stored = StoredInventory(store, PROFILE)
    assert rows(stored.trees_plt) == rows(survey("2024").trees_plt)
    for ask in (lambda: stored.trees, lambda: stored.measured_trees, lambda: stored.positioned_trees):
        with pytest.raises(ValueError, match="only sums"):
            ask()
    with pytest.raises(ValueError, match="whole or in parts"):
        store.write({"plots": spark.range(1)})
    with pytest.raises(ValueError, match="one survey"):
        add_survey(store, survey("2024", profile=Profile(keys=("plot_id",))), "2024")
