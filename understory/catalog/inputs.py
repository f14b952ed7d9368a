"""Inventory-shaped inputs derived from the general test tables.

The column expressions are plain SQL that Spark and the checking engine read
alike, so both sides start from the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from understory.operators.spatial import grid_cell, store_raster
from understory.plans.inventory import Inventory
from understory.profiles import ONE_YEAR, Corrections, Profile, RecodePlots, SetValue
from understory.sources import schemas
from understory.sources.shared import shared_folder
from understory.sources.tables import add_file_position, bind_surveys, read_table

TREE_YEAR = "case when year(l_shipdate) % 2 = 0 then '2024' else '2025' end"
# Lines that field corrections are for, at any scale: a diameter, a number, and a
# number whose test is undecided for want of a diameter.
FIX_DIAMETER = "l_suppkey = 1 and l_linenumber = 5"
FIX_NUMBER = "l_suppkey = 2 and l_linenumber = 4"
FIX_UNDECIDED = "l_suppkey = 2 and l_linenumber = 3"
TREES = {
    "plot_id": "concat('TR_P', cast(l_suppkey % 4 as string), '_', cast(l_suppkey as string))",
    "tree_num": f"case when {FIX_NUMBER} or {FIX_UNDECIDED} then 15e0 else cast(l_partkey as double) end",
    "species_code": (
        f"case when {FIX_DIAMETER} then 'PSME' when l_linenumber = 2 and l_partkey % 16 = 5 then cast(null as string)"
        " else case l_partkey % 16 when 0 then 'ABCO' when 1 then 'abma' when 2 then 'CADE' when 3 then 'PSME'"
        " when 4 then 'TABR' when 5 then 'PILA' when 6 then 'PINUS' when 7 then 'pipo' when 8 then 'PIJE'"
        " when 9 then 'ACMA' when 10 then 'ARME' when 11 then 'CONU' when 12 then 'QUCH' when 13 then 'QUKE'"
        " when 14 then 'LIDE' else 'XXXX' end end"
    ),
    "status": (
        "case when l_linenumber = 7 and l_returnflag = 'A' then cast(null as string)"
        " when l_returnflag = 'R' then 'D' else 'L' end"
    ),
    "dbh_cm": (
        f"case when {FIX_DIAMETER} then 171e0 when {FIX_NUMBER} then 545e-1"
        f" when {FIX_UNDECIDED} or (l_linenumber = 6 and l_returnflag = 'A') then cast(null as double)"
        " else round(l_extendedprice / 590, 1) end"
    ),
}
PLOTS = {
    "plot_id": "concat('TR_P', cast(s_suppkey % 4 as string), '_', cast(s_suppkey as string))",
    "Sample": "case when s_suppkey % 2 = 0 then 'Treatment' else 'Control' end",
    "cwhr_type": (
        "case s_suppkey % 5 when 0 then 'Douglas fir' when 1 then 'Douglas Fir' when 2 then 'Ponderosa Pine'"
        " when 3 then 'Sierran mixed conifer' else 'MHC' end"
    ),
    "cwhr_size": "cast(s_suppkey % 9 as string)",
    "cwhr_cover": (
        "case s_suppkey % 6 when 0 then 'S' when 1 then 'P' when 2 then 'M' when 3 then 'D' when 4 then '60+'"
        " else '25-40 percent open' end"
    ),
    "Northing": "4370000e0 + (s_suppkey * 211) % 3000",
}
OFF_RASTER = "s_suppkey % 10 = 4"
EASTING = f"case when {OFF_RASTER} then 65e4 else 64e4 + (s_suppkey * 137) % 3000 end"
# Plots of the first year that were laid out and have no trees.
BARE = "s_suppkey % 10 = 7"
BARE_SUFFIX = "_BARE"
# Columns that the second year's table calls by other names.
OTHER_COLUMNS = {
    "cavities_large": "cast(s_suppkey % 3 as string)", "cavities_small": "cast(s_suppkey % 5 as string)",
    "Observer_other": "case when s_suppkey % 2 = 0 then concat('obs', cast(s_suppkey as string)) end",
}
EASTING_BY_YEAR = f"case when year = '2025' and s_suppkey % 7 = 0 then cast(null as double) else {EASTING} end"
TREATED = (
    "case when year = '2024' then cast(null as string) else case s_suppkey % 5 when 0 then 'y'"
    " when 1 then 'inferred' when 2 then 'n' else cast(null as string) end end"
)
VISITS = [f"struct('{year}' as year, '{suffix}' as suffix)" for year, suffix in (
    ("2024", ""), ("2025", ""), ("2024", BARE_SUFFIX))]
VISITED = "not (year = '2025' and s_suppkey % 11 = 0)"
FUEL_YEAR = "case when event_id % 2 = 0 then '2024' else '2025' end"
FUELS = {
    "plot_id": "concat('TR_P', cast(user_id % 4 as string), '_', cast(user_id as string))",
    "count_1hr": "case when event_id % 13 = 0 then cast(null as double) else floor(value) end",
    "count_10h": "cast(event_id % 17 as double)",
    "count_100h": "cast(event_id % 5 as double)",
    "count_1000h": "cast(event_id % 3 as double)",
}
DEM_SIDE = 101
DEM_ORIGIN = (640000.0, 4370000.0)
DEM_RESOLUTION_M = 30.0
ELEVATION = "1000e0 + 5 * ((cell_x * 7 + cell_y * 13) % 120)"

# Corrections for these inputs; plot of the fingerprint.
CORRECTIONS = Corrections(
    recodes=(RecodePlots("2024", {"TR_P2_2": "TR_Q2_2"}),),
    tree_values=(
        SetValue({"year": "2025", "plot_id": "TR_P1_1", "species_code": "PSME", "dbh_cm": 171.0}, "dbh_cm", 17.1),
        SetValue(
            {"year": "2025", "plot_id": "TR_P2_2", "tree_num": 15.0, "dbh_cm": 54.5}, "tree_num", 9000.0,
            null_test="null",
        ),
    ),
    keep_later=(("2024", "TR_P3_3"), ("2025", "TR_P0_4")),
)
FINGERPRINT_PLOT = "TR_P3_3"
# A recode that gives two plots of a year one identifier.
COLLIDING = Corrections(recodes=(RecodePlots("2024", {"TR_P2_2": "TR_P3_3"}),))

TWO_YEAR_INPUTS = Profile(corrections=CORRECTIONS)
ONE_YEAR_INPUTS = ONE_YEAR


def _named(expressions: dict[str, str]) -> list[str]:
    return [f"{sql} as {name}" for name, sql in expressions.items()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trees(spark: SparkSession, sf_dir: str, years: bool = True) -> DataFrame:
    """Tree records as they are read."""
    lines = table(spark, sf_dir, "lineitem")
    year = [f"{TREE_YEAR} as year"] if years else []
    return lines.selectExpr(*year, *_named(TREES))


def plots(spark: SparkSession, sf_dir: str, years: bool = True) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier")
    if not years:
        return suppliers.selectExpr(*_named(PLOTS), f"{EASTING} as Easting")
    visits = suppliers.selectExpr("*", f"inline(array({', '.join(VISITS)}))").where(f"{VISITED} and (suffix = '' or {BARE})")
    named = PLOTS | {"plot_id": f"concat({PLOTS['plot_id']}, suffix)"} | OTHER_COLUMNS
    return visits.selectExpr("year", *_named(named), f"{TREATED} as treated", f"{EASTING_BY_YEAR} as Easting")


def fuels(spark: SparkSession, sf_dir: str, years: bool = True) -> DataFrame:
    year = [f"{FUEL_YEAR} as year"] if years else []
    return table(spark, sf_dir, "events").selectExpr(*year, *_named(FUELS))


def dem(spark: SparkSession) -> DataFrame:
    """A raster that covers the plots, by rule."""
    cells = spark.range(DEM_SIDE * DEM_SIDE).selectExpr(
        f"id div {DEM_SIDE} as cell_x", f"id % {DEM_SIDE} as cell_y"
    )
    return cells.selectExpr("cell_x", "cell_y", f"{ELEVATION} as elev_m")


RASTER_BUCKETS = 16


def stored_dem(spark: SparkSession) -> DataFrame:
    """The raster as a table laid out for joins by cell."""
    name = f"raster_{uuid.uuid4().hex}"
    return store_raster(dem(spark), name, f"{shared_folder(spark)}/{name}", ["cell_x", "cell_y"], RASTER_BUCKETS)


EXPORT_ROWS = 20_000  # of one text file
LINES = T.StructType([
    T.StructField("l_partkey", T.LongType()), T.StructField("l_suppkey", T.LongType()),
    T.StructField("l_linenumber", T.IntegerType()), T.StructField("l_extendedprice", T.DoubleType()),
    T.StructField("l_returnflag", T.StringType()), T.StructField("l_shipdate", T.TimestampNTZType()),
])


def ingested_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both years' trees through the reader: declared columns, position, year literal, union by name."""
    parts = []
    for year in ("2024", "2025"):
        lines = read_table(spark, f"{sf_dir}/lineitem.parquet", LINES, year=year, with_position=True)
        parts.append(lines.where(f"{TREE_YEAR} = year").selectExpr("year", *_named(TREES), "src_row"))
    return bind_surveys(parts, schemas.TREES)


def exported_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trees as text files in file order, read back with rows numbered by the reader."""
    path = f"{shared_folder(spark)}/trees-{uuid.uuid4().hex}"
    rows = add_file_position(trees(spark, sf_dir))
    ordered = rows.repartitionByRange("src_row").sortWithinPartitions("src_row").drop("src_row")
    ordered.write.option("maxRecordsPerFile", EXPORT_ROWS).csv(path, header=True)
    return read_table(spark, path, schemas.TREES, fmt="csv", with_position=True, number_rows=True, header=True)


# A raster keyed by web-map tile and pixel, by rule, around the plots on the grid.
PIXEL_ORIGIN = (189200, 397300)
PIXEL_SIDE = 400
TILE_ELEVATION = "1000e0 + 5 * ((gx * 7 + gy * 13) % 120)"


def tile_raster(spark: SparkSession) -> DataFrame:
    x0, y0 = PIXEL_ORIGIN
    pixels = spark.range(PIXEL_SIDE * PIXEL_SIDE).selectExpr(
        f"{x0} + id div {PIXEL_SIDE} as gx", f"{y0} + id % {PIXEL_SIDE} as gy")
    return pixels.selectExpr("gx div 256 as tile_x", "gy div 256 as tile_y", "gx % 256 as pixel_x", "gy % 256 as pixel_y",
                             f"{TILE_ELEVATION} as elev_m")


def two_year(
    spark: SparkSession, sf_dir: str, profile: Profile = TWO_YEAR_INPUTS, records: DataFrame | None = None,
) -> Inventory:
    return _inventory(spark, sf_dir, profile, True, records)


def survey(spark: SparkSession, sf_dir: str, year: str, profile: Profile = TWO_YEAR_INPUTS) -> Inventory:
    """The records of one of the two years, as they arrive when it is over."""
    parts = [table_of(spark, sf_dir).where(f"year = '{year}'") for table_of in (plots, trees, fuels)]
    return Inventory(*parts, dem(spark), profile, grid_cell(*DEM_ORIGIN, DEM_RESOLUTION_M))


def one_year(spark: SparkSession, sf_dir: str) -> Inventory:
    return _inventory(spark, sf_dir, ONE_YEAR_INPUTS, years=False)


def _inventory(
    spark: SparkSession, sf_dir: str, profile: Profile, years: bool, records: DataFrame | None = None
) -> Inventory:
    return Inventory(
        plots(spark, sf_dir, years),
        records if records is not None else trees(spark, sf_dir, years),
        fuels(spark, sf_dir, years),
        dem(spark),
        profile,
        grid_cell(*DEM_ORIGIN, DEM_RESOLUTION_M),
    )
