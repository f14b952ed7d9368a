import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

TREE_COLUMNS = (
    "year string, plot_id string, tree_num double, species_code string, status string, dbh_cm double,"
    " src_row long"
)
PLOT_COLUMNS = (
    "year string, plot_id string, Sample string, treated string, Easting double, Northing double,"
    " cwhr_type string, cwhr_size string, cwhr_cover string"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def trees_of(spark):
    """Tree table from (year, plot, tree_num, species, status, dbh) rows, in list order."""

    def build(rows):
        return spark.createDataFrame([(*row, i) for i, row in enumerate(rows)], TREE_COLUMNS)

    return build


@pytest.fixture
def plots_of(spark):
    """Plot table from (year, plot, Sample, treated, Easting, Northing) rows."""

    def build(rows):
        return spark.createDataFrame([(*row, "Douglas fir", "3", "60+") for row in rows], PLOT_COLUMNS)

    return build


@pytest.fixture
def dem(spark):
    """Cells of 30 m: elevation 1200, 1305 and 1400 in the first three columns."""
    return spark.createDataFrame(
        [(0, 0, 1200.0), (1, 0, 1305.0), (2, 0, 1400.0)], "cell_x long, cell_y long, elev_m double"
    )


def rows(frame, *columns):
    picked = frame.select(*columns) if columns else frame
    return sorted((tuple(r) for r in picked.collect()), key=repr)
