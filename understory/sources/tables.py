"""Reading survey tables, keeping their file order, and writing results."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Position of a row in its source: one number, by file name, then by row within the file.
POSITION = "src_row"
ROWS_PER_FILE = 1 << 40

POSITION_FIELDS = [T.StructField(POSITION, T.LongType())]


def read_table(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    *,
    year: str | None = None,
    fmt: str = "parquet",
    with_position: bool = False,
    number_rows: bool = False,
    **options,
) -> DataFrame:
    """Read one table of one survey year with a declared schema.

    ``schema`` describes the columns in the files; a ``year`` in it is ignored
    when ``year`` is given, and the literal is used instead, so a filter on the
    year drops a whole survey at planning time.

    ``with_position`` adds :data:`POSITION`. Parquet files know the index of
    each row, so no window or sort is needed and a rerun task finds the same
    positions. Other formats must carry the column from the exporter; rows of
    CSV files can be numbered instead (``number_rows``, see :func:`add_text_position`).
    """
    if year is not None:
        schema = T.StructType([f for f in schema.fields if f.name != "year"])
    names = schema.fieldNames()
    numbered = fmt == "parquet" or number_rows
    if with_position and not numbered:
        schema = T.StructType(schema.fields + [f for f in POSITION_FIELDS if f.name not in names])
    frame = spark.read.format(fmt).options(**options).schema(schema).load(path)
    if with_position and numbered:
        frame = add_file_position(frame) if fmt == "parquet" else add_text_position(frame)
    if year is not None:
        frame = frame.withColumn("year", F.lit(year))
    return frame


def file_ordinals(frame: DataFrame) -> DataFrame:
    """(_file, _file_no) of a frame that was just read: its files numbered by name.

    The list is the one the scan was planned with, so no job runs for it. It is not hinted: a list
    too long to broadcast is shuffled like any other table.
    """
    files = enumerate(sorted(set(frame.inputFiles())))
    numbered = frame.sparkSession.createDataFrame(list(files), "_file_no long, _file string")
    return numbered.select(_one_form(F.col("_file")).alias("_file"), "_file_no")


def _one_form(path: Column) -> Column:
    """Spark writes a path without a host as ``file:/`` in one place and ``file:///`` in another."""
    return F.regexp_replace(path, "^([^:/]+):/+", "$1:/")


def add_file_position(frame: DataFrame) -> DataFrame:
    """Add the file order of a frame that was just read from Parquet.

    A single file, the usual survey export, needs no number.
    """
    if len(frame.inputFiles()) <= 1:
        return frame.withColumn(POSITION, F.col("_metadata.row_index"))
    placed = frame.select("*", _one_form(F.col("_metadata.file_path")).alias("_file"), F.col("_metadata.row_index").alias("_row"))
    placed = placed.join(file_ordinals(frame), "_file", "left")
    return placed.withColumn(POSITION, F.col("_file_no") * ROWS_PER_FILE + F.col("_row")).drop("_file", "_file_no", "_row")


def add_text_position(frame: DataFrame) -> DataFrame:
    """Add the file order of a frame that was just read from files of lines, in two passes.

    Such files are read in blocks, each by one task from start to end, so a row's place in its block is the
    distance of its running number from the block's first. The first pass counts the rows of each block; a prefix sum
    over the blocks of a file says where each begins. Should the second pass deal blocks to
    tasks otherwise than the first, running numbers leave their block, and the job stops.
    """
    block = {"_file": _one_form(F.col("_metadata.file_path")), "_start": F.col("_metadata.file_block_start"), "_run": F.monotonically_increasing_id()}
    placed = frame.select("*", *[c.alias(name) for name, c in block.items()])
    blocks = placed.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_rows"), F.min("_run").alias("_first"))
    before = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).join(file_ordinals(frame), "_file")
    met = placed.join(blocks, ["_file", "_start"], "left")
    within = F.col("_run") - F.col("_first")
    astray = F.coalesce((within < 0) | (within >= F.col("_rows")), F.lit(True))
    stop = F.raise_error(F.lit("files were dealt to tasks differently in two passes"))
    number = F.col("_file_no") * ROWS_PER_FILE + F.col("_before") + within
    return met.select(*frame.columns, F.when(astray, stop).otherwise(number).cast("long").alias(POSITION))


def check_types(frame: DataFrame, schema: T.StructType) -> DataFrame:
    """Fail at planning time when a shared column has an undeclared type.

    A union would otherwise widen text and numbers to one type without a word.
    """
    declared = {f.name: f.dataType for f in schema.fields}
    clashes = [
        f"{f.name}: {f.dataType.simpleString()} is not {declared[f.name].simpleString()}"
        for f in frame.schema.fields
        if f.name in declared and f.dataType != declared[f.name]
    ]
    if clashes:
        raise TypeError("column types differ from the schema: " + "; ".join(clashes))
    return frame


def bind_surveys(frames: Iterable[DataFrame], schema: T.StructType) -> DataFrame:
    """Union all by column name; a column missing from one survey is null there."""
    first, *rest = [check_types(f, schema) for f in frames]
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def write_tables(
    tables: Mapping[str, DataFrame],
    out_dir: str,
    *,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    partition_by: Mapping[str, list[str]] | None = None,
) -> None:
    """Write each result table to ``out_dir/<name>``."""
    for name, frame in tables.items():
        writer = frame.write.format(fmt).mode(mode)
        keys = (partition_by or {}).get(name)
        (writer.partitionBy(*keys) if keys else writer).save(f"{out_dir}/{name}")
