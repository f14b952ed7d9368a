"""Declared schemas of the survey tables. Nothing is inferred from data."""

from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


TEXT, NUMBER, WHOLE = T.StringType(), T.DoubleType(), T.LongType()

PLOTS = _struct(
    year=TEXT, plot_id=TEXT, Sample=TEXT, treated=TEXT, Easting=NUMBER, Northing=NUMBER,
    cwhr_type=TEXT, cwhr_size=TEXT, cwhr_cover=TEXT,
    cavities_large=TEXT, cavities_small=TEXT, Observer_other=TEXT,
)
TREES = _struct(
    year=TEXT, plot_id=TEXT, tree_num=NUMBER, species_code=TEXT, status=TEXT, dbh_cm=NUMBER,
)
FUELS = _struct(
    year=TEXT, plot_id=TEXT, count_1hr=NUMBER, count_10h=NUMBER, count_100h=NUMBER, count_1000h=NUMBER,
)
DEM = _struct(cell_x=WHOLE, cell_y=WHOLE, elev_m=NUMBER)
