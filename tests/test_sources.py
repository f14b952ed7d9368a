import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import rows
from understory.sources import schemas
from understory.sources import shared, tables
from understory.sources.shared import cut_lineage
from understory.sources.tables import bind_surveys, check_types, read_table, write_tables


@pytest.fixture
def tree_files(spark, tmp_path):
    frame = spark.createDataFrame(
        [(f"P{i % 3}", float(i), "PSME", "L", 20.0 + i) for i in range(40)],
        "plot_id string, tree_num double, species_code string, status string, dbh_cm double",
    )
    path = str(tmp_path / "trees")
    frame.repartitionByRange(4, "tree_num").sortWithinPartitions("tree_num").write.parquet(path)
    return path


def test_positions_follow_file_order_over_several_files(spark, tree_files):
    trees = read_table(spark, tree_files, schemas.TREES, year="2024", with_position=True)
    ordered = trees.orderBy("src_row").select("tree_num").collect()
    assert [r[0] for r in ordered] == [float(i) for i in range(40)]
    assert trees.select("src_row").distinct().count() == 40


def test_positions_take_no_job(spark, tree_files):
    """Files are numbered from the list the scan was planned with."""
    spark.sparkContext.setJobGroup("positions", "no job expected")
    try:
        trees = read_table(spark, tree_files, schemas.TREES, year="2024", with_position=True)
        trees.schema, trees._jdf.queryExecution().optimizedPlan()
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("positions")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_ten_thousand_files_are_numbered_without_a_hint(spark, monkeypatch):
    frame = spark.range(1)
    names = [f"file:///t/part-{i:05d}" for i in reversed(range(10_000))]
    monkeypatch.setattr(type(frame), "inputFiles", lambda self: names)
    numbers = tables.file_ordinals(frame)
    assert numbers.count() == 10_000 and numbers.where("_file = 'file:/t/part-00123'").first()._file_no == 123
    plan = frame.selectExpr("'x' as _file").join(numbers, "_file", "left")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()


def test_file_names_that_need_escapes(spark, tmp_path):
    path = str(tmp_path / "a b%20c")
    for i, name in enumerate(("one two", "z+ü")):
        spark.range(i * 10, i * 10 + 3).coalesce(1).write.parquet(f"{path}/survey={name}")
    placed = tables.add_file_position(spark.read.parquet(path))
    assert placed.where("src_row is null").count() == 0 and placed.select("src_row").distinct().count() == 6


CSV_SCHEMA = T.StructType([T.StructField("tree_num", T.DoubleType()), T.StructField("species_code", T.StringType())])


@pytest.mark.parametrize("block", ["128m", "97b"])
def test_rows_of_text_files_are_numbered_in_file_order(spark, tmp_path, block):
    """Many blocks to a file, several blocks to a task, header lines in the first block of each file."""
    expected = []
    for name in ("b.csv", "a.csv", "c.csv"):
        rows_ = [(f"{ord(name[0])}{i}", "x" * (i * 7 % 40)) for i in range(60 if name != "c.csv" else 0)]
        (tmp_path / name).write_text("tree_num,species_code\n" + "".join(f"{a},{b}\n" for a, b in rows_))
        expected += [(name, float(a)) for a, _ in rows_]
    settings = {"spark.sql.files.maxPartitionBytes": block, "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        trees = read_table(spark, str(tmp_path), CSV_SCHEMA, fmt="csv", with_position=True, number_rows=True, header=True)
        got = [tuple(r) for r in trees.orderBy("src_row").select("src_row", "tree_num").collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [t for _, t in got] == [t for _, t in sorted(expected, key=lambda r: r[0])]
    assert [p % tables.ROWS_PER_FILE for p, _ in got] == [*range(60), *range(60)]


def test_text_and_parquet_agree_on_later_entries(spark, tmp_path):
    from understory.operators import duplicates

    frame = spark.range(400).selectExpr(
        "'2024' as year", "'P' as plot_id", "cast(id % 150 as double) as tree_num", "cast(id as double) as dbh_cm").coalesce(1)
    schema = frame.schema
    frame.write.option("maxRecordsPerFile", 70).parquet(str(tmp_path / "p"))
    frame.write.option("maxRecordsPerFile", 90).csv(str(tmp_path / "c"))
    found = []
    for fmt, path in (("parquet", "p"), ("csv", "c")):
        trees = read_table(spark, str(tmp_path / path), schema, fmt=fmt, with_position=True, number_rows=fmt == "csv")
        found.append(rows(duplicates.later_rows(trees), "tree_num", "dbh_cm"))
    assert found[0] == found[1] and len(found[0]) == 250 and min(r[1] for r in found[0]) == 150


def test_year_literal_prunes_the_other_survey(spark, tree_files):
    both = bind_surveys(
        [read_table(spark, tree_files, schemas.TREES, year=y) for y in ("2024", "2025")], schemas.TREES
    )
    assert both.count() == 80
    plan = both.where(F.col("year") == "2024")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_csv_with_exporter_positions(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("plot_id,tree_num,species_code,status,dbh_cm,src_row\nA,1,PSME,L,20.5,0\nA,,,,,1\n")
    trees = read_table(spark, str(path), schemas.TREES, year="2024", fmt="csv", with_position=True, header=True)
    assert rows(trees, "plot_id", "tree_num", "dbh_cm", "src_row") == [("A", 1.0, 20.5, 0), ("A", None, None, 1)]


def test_union_by_name_fills_missing_columns(spark):
    a = spark.createDataFrame([("2024", "A")], "year string, plot_id string")
    b = spark.createDataFrame([("y", "B", "2025")], "treated string, plot_id string, year string")
    assert rows(bind_surveys([a, b], schemas.PLOTS), "year", "plot_id", "treated") == [
        ("2024", "A", None), ("2025", "B", "y"),
    ]


def test_type_clash_is_refused(spark):
    text = spark.createDataFrame([("A", "12")], "plot_id string, dbh_cm string")
    with pytest.raises(TypeError, match="dbh_cm: string is not double"):
        check_types(text, schemas.TREES)


def test_write_and_reread(spark, tmp_path):
    frame = spark.createDataFrame([("2024", "A", 1.0), ("2025", "A", 2.0)], "year string, plot_id string, x double")
    write_tables({"out": frame}, str(tmp_path), partition_by={"out": ["year"]})
    again = spark.read.schema(frame.schema).parquet(str(tmp_path / "out"))
    assert rows(again, "year", "plot_id", "x") == rows(frame)
    assert {f.name for f in again.schema.fields} == {"year", "plot_id", "x"}


def test_lineage_is_cut_in_the_session_folder(spark):
    frame = cut_lineage(spark.range(10).selectExpr("id * 2 as x"))
    assert "Range" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert frame.agg(F.sum("x")).first()[0] == 90 and frame.inputFiles()


def test_lineage_needs_a_shared_folder(spark, tmp_path, monkeypatch):
    frame = spark.range(3)
    assert cut_lineage(frame, str(tmp_path / "given")).count() == 3
    folder = spark.conf.get("spark.checkpoint.dir")
    monkeypatch.setattr(shared, "SETTING", "spark.checkpoint.none")
    monkeypatch.setattr(type(spark.sparkContext), "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(spark.sparkContext, "master", "yarn")
    with pytest.raises(ValueError, match="set spark.checkpoint.none"):
        cut_lineage(frame)
    monkeypatch.setattr(shared, "SETTING", "spark.checkpoint.dir")
    assert shared.shared_folder(spark) == folder
    monkeypatch.setattr(shared, "SETTING", "spark.checkpoint.file")
    spark.conf.set("spark.checkpoint.file", "file:///tmp/x")
    with pytest.raises(ValueError, match="a cluster needs a shared one"):
        cut_lineage(frame)


def test_schema_types():
    assert schemas.TREES["dbh_cm"].dataType == T.DoubleType()
    assert schemas.PLOTS["cwhr_size"].dataType == T.StringType()
