import math
from dataclasses import replace

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.conftest import rows
from understory import Inventory
from understory.operators import dimension, spatial
from understory.profiles import ONE_YEAR, Profile

TREES = [("2024", "A_P_1", 1.0, "PSME", "L", 30.0)]


def inventory(spark, plots, trees, dem, profile=Profile()):
    fuels = spark.createDataFrame(
        [("2024", "A_P_1", 1.0, 1.0, 1.0, 1.0)],
        "year string, plot_id string, count_1hr double, count_10h double, count_100h double, count_1000h double",
    )
    return Inventory(plots, trees, fuels, dem, profile, spatial.grid_cell(0.0, 0.0, 30.0))


def test_dimension_and_paired_flag(spark, plots_of, trees_of, dem):
    plots = plots_of([
        ("2024", "A_P_1", "Treatment", None, 5.0, 5.0), ("2025", "A_P_1", "Treatment", "y", 5.0, 5.0),
        ("2024", "A_Q_2", "Control", None, 35.0, 5.0), ("2025", "A_Q_2", "Control", "n", 35.0, 5.0),
        ("2024", "A_Q_3", "Control", "y", 65.0, 5.0), ("2025", "A_Q_3", "Control", "inferred", 65.0, 5.0),
        ("2025", "A_Q_4", "Control", "y", None, None), ("2024", "x", "Control", None, 900.0, 5.0),
    ])
    got = rows(inventory(spark, plots, trees_of(TREES), dem).dimension)
    assert got == [
        ("2024", "A_P_1", 1200.0, "Low elev", "Treatment", False, "P", True),
        ("2024", "A_Q_2", 1305.0, None, "Control", False, "Q", False),
        ("2024", "A_Q_3", 1400.0, "High elev", "Control", True, "Q", False),
        ("2024", "x", None, None, "Control", False, "", False),
        ("2025", "A_P_1", 1200.0, "Low elev", "Treatment", True, "P", True),
        ("2025", "A_Q_2", 1305.0, None, "Control", False, "Q", False),
        ("2025", "A_Q_3", 1400.0, "High elev", "Control", True, "Q", False),
    ]


def test_median_split(spark, plots_of, trees_of, dem):
    plots = plots_of([("x", f"p{i}", "s", None, 5.0 + 30 * i, 5.0) for i in range(3)]).drop("year", "treated")
    trees = trees_of(TREES).drop("year")
    got = rows(inventory(spark, plots, trees, dem, ONE_YEAR).dimension, "plot_id", "elev_class")
    assert got == [("p0", "Low elev"), ("p1", None), ("p2", "High elev")]


def test_median_averages_the_middle_pair(spark):
    frame = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 10.0, None)], "elev_m double")
    assert dimension.median_elevation(frame).first()[0] == 2.5
    assert dimension.median_elevation(frame.where("elev_m > 99")).first()[0] is None


def test_plot_without_coordinates_fails(spark, plots_of, trees_of, dem):
    plots = plots_of([("2024", "A_P_1", "Treatment", None, None, 5.0)])
    with pytest.raises(PySparkException, match="plot without coordinates: A_P_1"):
        inventory(spark, plots, trees_of(TREES), dem).located_plots.collect()


def test_null_keys_match_each_other(spark, plots_of, trees_of, dem):
    plots = plots_of([("2024", None, "Treatment", None, 5.0, 5.0)])
    trees = trees_of([("2024", None, 1.0, "PSME", "L", 30.0)])
    got = rows(inventory(spark, plots, trees, dem).trees_plt, "plot_id", "trt_ctl", "n_live_gt10cm")
    assert got == [(None, "Treatment", 1)]


def test_repeated_plot_record_fans_out(spark, plots_of, trees_of, dem):
    plots = plots_of([("2024", "A_P_1", "Treatment", None, 5.0, 5.0)] * 2)
    assert inventory(spark, plots, trees_of(TREES), dem).trees_plt.count() == 2


def test_flag_and_identifier_set_differ_on_unmatched_surveys(spark, plots_of, trees_of, dem):
    """A survey without a plot record is paired by identifier, not by flag."""
    plots = plots_of([
        ("2024", "A_P_1", "s", None, 5.0, 5.0), ("2025", "A_P_1", "s", "y", 5.0, 5.0),
    ])
    trees = trees_of([(y, "A_P_1", 1.0, "PSME", "L", 30.0) for y in ("2024", "2025", "2026")])
    inv = inventory(spark, plots, trees, dem)
    by_flag = rows(inv.trees_sp_trtuntrt.select("year").distinct())
    by_id = rows(inv.trees_sp_size_paired.select("year", "trt_project").distinct())
    assert by_flag == [("2024",), ("2025",)]
    assert by_id == [("2024", "P"), ("2025", "P"), ("2026", None)]


def inverse_utm_usgs(easting, northing, zone):
    """Independent textbook inverse (series in the footpoint latitude)."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep2 = e2 / (1 - e2)
    mu = northing / k0 / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    p1 = (mu + (3 * e1 / 2 - 27 * e1**3 / 32) * math.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * math.sin(4 * mu)
          + 151 * e1**3 / 96 * math.sin(6 * mu) + 1097 * e1**4 / 512 * math.sin(8 * mu))
    c, t = ep2 * math.cos(p1) ** 2, math.tan(p1) ** 2
    n = a / math.sqrt(1 - e2 * math.sin(p1) ** 2)
    r = a * (1 - e2) / (1 - e2 * math.sin(p1) ** 2) ** 1.5
    d = (easting - 500000) / (n * k0)
    lat = p1 - n * math.tan(p1) / r * (
        d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c**2 - 9 * ep2) * d**4 / 24
        + (61 + 90 * t + 298 * c + 45 * t**2 - 252 * ep2 - 3 * c**2) * d**6 / 720)
    lon = (d - (1 + 2 * t + c) * d**3 / 6
           + (5 - 2 * c + 28 * t - 3 * c**2 + 8 * ep2 + 24 * t**2) * d**5 / 120) / math.cos(p1)
    return zone * 6 - 183 + math.degrees(lon), math.degrees(lat)


def test_reprojection_and_tiles(spark):
    points = [(500000.0, 4427757.21), (640000.0, 4370000.0), (642900.0, 4372900.0), (300000.0, 5500000.0), (760000.0, 3600000.0)]
    frame = spark.createDataFrame(points, "Easting double, Northing double")
    for r in spatial.tile_keys(frame, 10, 12).collect():
        lon, lat = inverse_utm_usgs(r.Easting, r.Northing, 10)
        assert (r.lon, r.lat) == pytest.approx((lon, lat), abs=2e-8)
        x = (lon + 180) / 360 * 4096
        y = (1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * 4096
        assert (r.tile_x, r.tile_y) == (math.floor(x), math.floor(y))
        assert (r.pixel_x, r.pixel_y) == (math.floor(x % 1 * 256), math.floor(y % 1 * 256))
    central = spark.createDataFrame([(500000.0, 0.9996 * 4429529.03035)], "Easting double, Northing double")
    got = spatial.tile_keys(central, 10, 12).first()
    assert (got.lon, got.lat) == pytest.approx((-123.0, 40.0), abs=1e-8)


def test_elevation_from_a_tile_keyed_raster(spark):
    frame = spark.createDataFrame([("p", 640000.0, 4370000.0)], "plot_id string, Easting double, Northing double")
    keyed = spatial.tile_keys(frame, 10, 12)
    names = ["tile_x", "tile_y", "pixel_x", "pixel_y"]
    raster = keyed.select(*names, F.lit(777.0).alias("elev_m"))
    located = spatial.attach_elevation(keyed, raster, spatial.cell_columns(names))
    assert located.first().elev_m == 777.0


def test_profiles_differ_only_in_their_switches():
    two = replace(
        Profile(), keys=ONE_YEAR.keys, pine_codes=ONE_YEAR.pine_codes, gt10in_cm=ONE_YEAR.gt10in_cm, elev_split=None,
        dead_gt10cm_source=ONE_YEAR.dead_gt10cm_source, mean_year=None, paired=False,
    )
    assert two == ONE_YEAR


def test_colliding_plot_keys(spark, plots_of):
    """Rows are multiplied, refused or left without attributes, by profile; others are not touched."""
    from understory.operators import dimension as dim

    plots = plots_of([("2024", "A", "Control", None, 1.0, 1.0), ("2024", "A", "Treatment", None, 2.0, 1.0),
                      ("2024", "B", "Control", None, 1.0, 1.0), ("2025", None, "Control", "y", 1.0, 1.0)])
    one = plots.select("year", "plot_id", F.col("Sample").alias("trt_ctl"))
    keys = ["year", "plot_id"]
    assert dim.guard_keys(one, keys, "multiply").count() == 4
    kept = rows(dim.guard_keys(one, keys, "set aside"), "year", "plot_id", "trt_ctl")
    assert kept == [("2024", "B", "Control"), ("2025", None, "Control")]
    assert rows(dim.colliding_records(plots, keys), "plot_id", "Sample") == [("A", "Control"), ("A", "Treatment")]
    with pytest.raises(Exception, match="2 plot records of"):
        dim.guard_keys(one, keys, "fail").collect()
    assert dim.guard_keys(one.where("plot_id is null or plot_id = 'B'"), keys, "fail").count() == 2
    bare = dim.guard_keys(one.select(*keys), keys, "set aside")
    assert rows(bare, *keys) == [("2024", "B"), ("2025", None)]
    with pytest.raises(ValueError, match="unknown treatment"):
        dim.guard_keys(one, keys, "other")


RASTER_KEYS = ["cell_x", "cell_y"]


@pytest.fixture(scope="module")
def wide_raster(spark, tmp_path_factory):
    """400 x 100 cells, stored in four buckets."""
    cells = spark.range(40_000).selectExpr("id div 100 as cell_x", "id % 100 as cell_y", "cast(id as double) as elev_m", "1 as more")
    path = f"{tmp_path_factory.mktemp('raster')}/cells"
    return cells, path, spatial.store_raster(cells, "wide_raster", path, RASTER_KEYS, 4)


def test_a_stored_raster_is_not_moved(spark, wide_raster):
    cells, path, stored = wide_raster
    cell = spatial.grid_cell(0.0, 0.0, 1.0)
    points = [(7.0, 3.0), (9.5, 3.0), (9.5, 3.0), (8.0, 200.0), (None, 3.0)]
    plots = spark.createDataFrame([(str(i), *p) for i, p in enumerate(points)], "plot_id string, Easting double, Northing double")
    expected = rows(spatial.attach_elevation(plots, cells, cell), "plot_id", "elev_m")
    again = spatial.open_raster(spark, cells.schema, "wide_raster_again", path, RASTER_KEYS, 4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for raster in (stored, again):
            joined = spatial.attach_elevation(plots, spatial.cells_around(raster, plots, cell, ["cell_x"]), cell)
            assert rows(joined, "plot_id", "elev_m") == expected
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan
            assert plan.count("hashpartitioning(cell_x") == 1, plan
        nowhere = plots.where("false")
        assert spatial.cells_around(stored, nowhere, cell, RASTER_KEYS).count() == 0
        assert spatial.attach_elevation(nowhere, spatial.cells_around(stored, nowhere, cell, RASTER_KEYS), cell).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_cells_around_keep_all_that_plots_can_meet(spark, wide_raster):
    cells, _, stored = wide_raster
    plots = spark.createDataFrame([(12.0, 40.0), (15.0, 44.0)], "Easting double, Northing double")
    near = spatial.cells_around(stored, plots, spatial.grid_cell(0.0, 0.0, 1.0), RASTER_KEYS)
    assert rows(near, *RASTER_KEYS) == sorted([(x, y) for x in range(12, 16) for y in range(40, 45)], key=repr)
    assert near.columns == [*RASTER_KEYS, "elev_m"]
