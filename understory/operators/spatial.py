"""Elevation of plot centres from a raster stored as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# WGS84 ellipsoid and UTM grid, fixed by their definitions.
SEMI_MAJOR_M = 6378137.0
FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_FALSE_EASTING_M = 500000.0
TILE_PIXELS = 256


def require_coordinates(plots: DataFrame, easting: str = "Easting", northing: str = "Northing") -> DataFrame:
    """Fail the job on a plot without a position, instead of losing it in a join."""
    missing = F.col(easting).isNull() | F.col(northing).isNull()
    message = F.concat(F.lit("plot without coordinates: "), F.coalesce(F.col("plot_id"), F.lit("null")))
    return plots.withColumn(easting, F.when(missing, F.raise_error(message)).otherwise(F.col(easting)))


def grid_cell(
    origin_x: float, origin_y: float, resolution_m: float, easting: str = "Easting", northing: str = "Northing"
) -> dict[str, Column]:
    """Cell indices of a point in a projected raster."""
    return {
        "cell_x": F.floor((F.col(easting) - origin_x) / resolution_m).cast("long"),
        "cell_y": F.floor((F.col(northing) - origin_y) / resolution_m).cast("long"),
    }


def attach_elevation(
    plots: DataFrame, dem: DataFrame, cell: dict[str, Column], keep_keys: bool = False
) -> DataFrame:
    """Left equi join of points to raster cells; points off the raster get null.

    The raster can be far larger than the plots, so neither side is hinted.
    """
    keys = list(cell)
    located = plots.withColumns(cell)
    joined = located.join(dem.select(*keys, "elev_m"), keys, "left")
    return joined if keep_keys else joined.drop(*keys)


def store_raster(dem: DataFrame, table: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Write a raster once so that no later join moves it: dealt into ``buckets`` by ``keys``, sorted within.

    ``path`` is a folder that all executors share, ``table`` the name in the session's catalog. A join on
    ``keys`` then deals out the points alone. Choose ``buckets`` for some 200 MB of raster in each.
    """
    dealt = dem.select(*keys, "elev_m").repartition(buckets, *keys)
    writer = dealt.write.mode("errorifexists").format("parquet").option("path", path)
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return dem.sparkSession.table(table)


def open_raster(
    spark: SparkSession, schema: T.StructType, table: str, path: str, keys: Sequence[str], buckets: int
) -> DataFrame:
    """A raster that :func:`store_raster` wrote in an earlier session, with the layout it was given there."""
    wanted = [schema[name] for name in (*keys, "elev_m")]
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in wanted)
    by = ", ".join(keys)
    layout = f"clustered by ({by}) sorted by ({by}) into {buckets} buckets"
    spark.sql(f"create table {table} ({columns}) using parquet {layout} location '{path}'")
    return spark.table(table)


def cells_around(dem: DataFrame, plots: DataFrame, cell: dict[str, Column], ranged: Sequence[str]) -> DataFrame:
    """The part of a raster between the least and largest of the plots' cells, in the ``ranged`` keys.

    The bounds are found when the job runs and reach the raster's scan, where row groups outside
    them are passed over. No cell that a plot can meet is left out; without any plot, none is left.
    """
    bounds = plots.select(*[cell[k].alias(k) for k in ranged]).agg(
        *[f(k).alias(f"{name}_{k}") for k in ranged for name, f in (("least", F.min), ("largest", F.max))])
    for key in ranged:
        dem = dem.where(F.col(key).between(bounds.select(f"least_{key}").scalar(), bounds.select(f"largest_{key}").scalar()))
    return dem


def drop_geometry(plots: DataFrame, easting: str = "Easting", northing: str = "Northing") -> DataFrame:
    return plots.drop(easting, northing)


def utm_to_lonlat(easting: Column, northing: Column, zone: int) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a northern-hemisphere UTM point.

    Inverse transverse Mercator by its series in the third flattening, to the
    third order: errors stay far below a millimetre inside a zone.
    """
    n = FLATTENING / (2 - FLATTENING)
    rectifying = SEMI_MAJOR_M / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi = northing / (UTM_SCALE * rectifying)
    eta = (easting - UTM_FALSE_EASTING_M) / (UTM_SCALE * rectifying)
    xi_p, eta_p = xi, eta
    for j, b in enumerate(beta, start=1):
        xi_p = xi_p - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta_p = eta_p - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi_p) / F.cosh(eta_p))
    latitude = chi
    for j, d in enumerate(delta, start=1):
        latitude = latitude + d * F.sin(2 * j * chi)
    longitude = F.lit(float(zone * 6 - 183)) + F.degrees(F.atan2(F.sinh(eta_p), F.cos(xi_p)))
    return longitude, F.degrees(latitude)


def tile_pixel(longitude: Column, latitude: Column, zoom: int) -> dict[str, Column]:
    """Web-Mercator tile and pixel indices of a point, for a tile-keyed raster."""
    side = float(2**zoom)
    x = (longitude + 180) / 360 * side
    y = (1 - F.asinh(F.tan(F.radians(latitude))) / F.pi()) / 2 * side
    return {
        "tile_x": F.floor(x).cast("long"),
        "tile_y": F.floor(y).cast("long"),
        "pixel_x": F.floor((x - F.floor(x)) * TILE_PIXELS).cast("long"),
        "pixel_y": F.floor((y - F.floor(y)) * TILE_PIXELS).cast("long"),
    }


def tile_keys(
    plots: DataFrame, zone: int, zoom: int, easting: str = "Easting", northing: str = "Northing"
) -> DataFrame:
    """Plots with position in degrees and their tile and pixel keys."""
    longitude, latitude = utm_to_lonlat(F.col(easting), F.col(northing), zone)
    degrees = plots.withColumns({"lon": longitude, "lat": latitude})
    return degrees.withColumns(tile_pixel(F.col("lon"), F.col("lat"), zoom))


def cell_columns(keys: Sequence[str]) -> dict[str, Column]:
    """Key columns that are already present, for :func:`attach_elevation`."""
    return {k: F.col(k) for k in keys}
