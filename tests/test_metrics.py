import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from understory import fixed_values as fv
from understory.operators import checks, fuels, strata, trees
from understory.operators.densify import densify, nest_cells
from understory.operators.trees import CELL_MEASURES, SPECIES, SPECIES_SIZE
from understory.profiles import ONE_YEAR, Profile

TWO = Profile()
KEYS = ["year", "plot_id"]


def plot_table(frame, profile=TWO):
    measured = trees.measure_trees(frame, profile)
    return trees.plot_metrics(trees.sum_trees(measured, list(profile.keys), profile), profile)


def cells(frame, domains, profile=TWO):
    by = [*profile.keys, *domains]
    return trees.cell_metrics(trees.sum_trees(trees.measure_trees(frame, profile), by, profile), by)


def test_minimum_size(trees_of):
    frame = trees_of([("2024", "A", float(i), "PSME", "L", d) for i, d in enumerate([9.9, None, 10.0])])
    assert rows(trees.measure_trees(frame, TWO), "dbh_cm", "size_class") == [(10.0, "04-10")]


def test_quadratic_mean_diameter(trees_of):
    frame = trees_of([("2024", "A", 1.0, "PSME", "L", 25.4), ("2024", "A", 2.0, "PSME", "L", 50.8)])
    assert plot_table(frame).first().qmd_live_in == pytest.approx(15.811388, abs=1e-6)


def test_plot_metrics_by_hand(trees_of):
    frame = trees_of([
        ("2024", "A", 1.0, "psme", "L", 25.4), ("2024", "A", 2.0, "PSME", "L", 25.5), ("2024", "A", 3.0, "LIDE", "D", 30.0),
        ("2024", "A", 4.0, "LIDE", None, 30.0), ("2024", "A", 5.0, "LIDE", "D", 12.0),
    ])
    r = plot_table(frame).first()
    area = lambda d: math.pi * (d / 200) ** 2 * 10.7639
    assert (r.n_live_gt10cm, r.n_live_gt10in, r.n_dead_gt10in, r.n_dead_gt10cm) == (2, 1, 1, 2)
    assert r.ba_live_ft == pytest.approx(area(25.4) + area(25.5))
    assert r.ba_dead_ft == pytest.approx(area(30) + area(12))
    assert r.tpa_dead_gt10cm == pytest.approx(2 / fv.PLOT_AREA_AC)
    one = plot_table(frame, ONE_YEAR).first()
    assert (one.n_live_gt10in, one.n_dead_gt10in) == (2, 2)
    assert "n_dead_gt10cm" not in one.asDict()


def test_ten_centimetre_cut_of_the_one_year_profile(trees_of):
    frame = trees_of([("2024", "A", 1.0, "PSME", "L", 10.0), ("2024", "A", 2.0, "PSME", "D", 10.1)])
    r = plot_table(frame, ONE_YEAR).first()
    assert (r.n_live_gt10cm, r.n_live_gt10in, r.n_dead_gt10in) == (1, 0, 1)
    assert r.tpa_dead_gt10cm == r.tpa_dead_gt10in


def test_only_dead_trees(trees_of):
    frame = trees_of([("2024", "A", 1.0, "PSME", "D", 30.0)])
    r = plot_table(frame).first()
    assert (r.n_live_gt10cm, r.ba_live_ft, r.qmd_live_in) == (0, 0.0, None)
    dense = densify(cells(frame, SPECIES), KEYS, SPECIES, CELL_MEASURES)
    assert {x.qmd_live_in for x in dense.collect()} == {0.0}


def test_dense_tables_cover_all_levels(trees_of):
    frame = trees_of([
        ("2024", "A", 1.0, "PSME", "L", 30.0), ("2024", "B", 1.0, "LIDE", "L", 5.0), ("2025", "A", 1.0, "LIDE", "L", 200.0),
    ])
    species = densify(cells(frame, SPECIES), KEYS, SPECIES, CELL_MEASURES)
    assert rows(species.groupBy(*KEYS).count()) == [("2024", "A", 5), ("2025", "A", 5)]
    size = densify(cells(frame, SPECIES_SIZE), KEYS, SPECIES_SIZE, CELL_MEASURES)
    assert rows(size.groupBy(*KEYS).count()) == [("2024", "A", 35), ("2025", "A", 36)]
    null_class = size.where("size_class is null")
    assert rows(null_class, *KEYS, "species_group", "n_live_gt10cm") == [("2025", "A", "tanoak", 1)]
    assert dict(size.dtypes)["n_live_gt10cm"] == "bigint"
    assert size.where("n_live_gt10cm is null or qmd_live_in is null").count() == 0
    pairs = {(r.species_group, r.size_class) for r in size.where("year = '2024'").collect()}
    assert pairs == {(s, z) for s in fv.SPECIES_GROUPS for z in fv.SIZE_CLASSES}


def random_trees(n=3000, plots=30, seed=3):
    rng = random.Random(seed)
    codes = ["ABCO", "pipo", "PIJE", "LIDE", "QUKE", None, "ZZZZ"]
    data = []
    for i in range(n):
        plot = 0 if rng.random() < 0.34 else rng.randrange(plots)
        data.append((
            rng.choice(["2024", "2025"]), f"A_P{plot % 3}_{plot}", float(i), rng.choice(codes),
            rng.choice(["L", "L", "D", None]), rng.choice([None, round(rng.uniform(5, 190), 1)]),
        ))
    return data


@pytest.mark.parametrize("domains", [SPECIES, SPECIES_SIZE], ids=["species", "size"])
@pytest.mark.parametrize("stratum", [[], ["year"], ["year", "g"]], ids=["all", "year", "two"])
def test_stratum_means_equal_means_over_filled_rows(trees_of, domains, stratum):
    observed = cells(trees_of(random_trees()), domains)
    group = F.when(F.crc32("plot_id") % 3 > 0, (F.crc32("plot_id") % 3).cast("string")).alias("g")
    nested = nest_cells(observed, KEYS, domains, CELL_MEASURES).select("*", group)
    dense = densify(observed, KEYS, domains, CELL_MEASURES).select("*", group)
    by = [*domains, *stratum]
    fast = {tuple(r)[: len(by)]: tuple(r)[len(by):] for r in strata.stratum_means(nested, stratum, domains).collect()}
    plain = {tuple(r)[: len(by)]: tuple(r)[len(by):] for r in strata.means_of_dense(dense, by).collect()}
    assert fast.keys() == plain.keys()
    for key, want in plain.items():
        assert fast[key] == pytest.approx(want, rel=1e-9), key


def test_no_plots_no_means(trees_of):
    nested = nest_cells(cells(trees_of(random_trees(50)), SPECIES), KEYS, SPECIES, CELL_MEASURES).where("year = '1999'")
    assert strata.stratum_means(nested, [], SPECIES).count() == 0


def test_sums_add_up_over_levels(trees_of):
    frame = trees.measure_trees(trees_of(random_trees()), TWO)
    direct = trees.sum_trees(frame, KEYS, TWO)
    rolled = trees.roll_up(trees.sum_trees(frame, [*KEYS, *SPECIES_SIZE], TWO), KEYS)
    want = {(r.year, r.plot_id): r for r in direct.collect()}
    for r in rolled.collect():
        assert tuple(r)[2:] == pytest.approx(tuple(want[r.year, r.plot_id])[2:], rel=1e-9)
    levels = rows(trees.shared_scan_rollup(frame, TWO).groupBy("level").agg(F.sum("n_live_gt10cm")))
    assert len(levels) == 3 and len({total for _, total in levels}) == 1


FUELS = "year string, plot_id string, count_1hr double, count_10h double, count_100h double, count_1000h double"


def test_fuel_mass(spark):
    frame = spark.createDataFrame([
        ("2024", "A", 7.0, 3.0, None, 1.0), ("2024", "A", 5.0, None, 2.0, None), ("2024", "B", None, None, None, None),
    ], FUELS)
    got = {r.plot_id: r for r in fuels.fuel_mass(fuels.sum_transects(frame, KEYS)).collect()}
    a = got["A"]
    assert (a.count_1h, a.count_10h, a.count_100h, a.count_1000h) == (12, 3, 2, 1)
    assert (a.mass_1hr, a.mass_10hr, a.mass_100hr, a.mass_fine) == pytest.approx(
        (0.128081, 0.317479, 1.713744, 2.159303), abs=1e-6
    )
    assert (got["B"].count_1h, got["B"].mass_fine) == (0, 0)


def test_fuel_long_form(spark):
    frame = spark.createDataFrame([("2024", "A", 1.0, 0.0, 0.0, 0.0)], FUELS)
    long = fuels.long_form(fuels.fuel_mass(fuels.sum_transects(frame, KEYS)), KEYS)
    assert long.columns == ["year", "plot_id", "fuel_class", "mass_tons_ac"]
    assert long.first().fuel_class == "mass_fine"
    assert long.count() == 1


def test_labels_round_half_to_even(spark):
    frame = spark.createDataFrame([("a", 2.5), ("b", 1.5), ("b", 2.0), ("c", None)], "k string, v double")
    got = rows(strata.totals(frame, ["k"], "v", "total"))
    assert got == [("a", 2.5, 2.0), ("b", 3.5, 4.0), ("c", 0.0, 0.0)]


def test_census_has_the_sums_and_counts_all_trees(spark, trees_of):
    """Small, unmeasured, oversize and unnamed trees; null keys; a table without rows."""
    frame = trees_of([
        ("2024", "A", 1.0, "psme", "L", 25.4), ("2024", "A", 2.0, "PSME", "D", 40.0), ("2024", "A", 3.0, "PSME", "L", 4.0),
        ("2024", "A", 4.0, None, "L", None), ("2024", "A", 5.0, "ABCO", "L", 178.0), ("2024", "B", 1.0, "LIDE", None, 2.0),
        ("2025", None, 1.0, "XX", "L", 12.0), ("2025", None, None, "XX", "D", 12.0),
    ])
    by = [*KEYS, *SPECIES_SIZE]
    for some in (frame, frame.where("false")):
        census = trees.take_census(some, TWO)
        sums = trees.sum_trees(trees.measure_trees(some, TWO), by, TWO)
        assert rows(trees.roll_up(census.where("measured"), by), *sums.columns) == rows(sums)
    census = trees.take_census(frame, TWO)
    assert rows(census.groupBy(*KEYS).agg(F.sum("n_trees"), F.sum("n_oversize"))) == [
        ("2024", "A", 5, 1), ("2024", "B", 1, 0), ("2025", None, 2, 0)]
    plots = spark.createDataFrame([("2024", "A"), ("2024", "A"), ("2024", "C"), (None, None)], "year string, plot_id string")
    assert rows(checks.census_report(census, plots, KEYS)) == sorted([
        ("oversize_trees", "2024", "A", None, 1), ("duplicate_plots", "2024", "A", None, 2),
        ("trees_without_plots", "2024", "B", None, 1), ("trees_without_plots", "2025", None, None, 2),
        ("plots_without_trees", "2024", "C", None, 1), ("plots_without_trees", None, None, None, 1),
        ("species_freq", None, None, "PSME", 3), ("species_freq", None, None, "ABCO", 1),
        ("species_freq", None, None, "LIDE", 1), ("species_freq", None, None, "XX", 2),
    ], key=repr)
