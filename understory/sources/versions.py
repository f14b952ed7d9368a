"""Tables that change together: a version of a set is there as a whole or not at all.

Rows are written to new folders first. Then one small file, the manifest of the version, lists
the folders each table is made of. A reader takes the newest manifest, so a write that
stops halfway leaves the old set as it was. A table may be kept in parts (survey years): writing
one replaces that part and refers to the folders of the others, which are neither read nor moved.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from understory.sources.tables import bind_surveys

MANIFEST = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("table", T.StringType()), T.StructField("part", T.StringType()),
    T.StructField("path", T.StringType()), T.StructField("columns", T.StringType()),
])


class TableSet:
    """Versioned tables below ``root``, a folder that all executors share. One writer at a time.

    ``by`` is the text column whose values are the parts of tables kept in parts.
    """

    def __init__(self, spark: SparkSession, root: str, by: str = "year"):
        self.spark, self.root, self.by = spark, root.rstrip("/"), by

    def versions(self) -> list[int]:
        """Finished versions, in order; none where nothing was written."""
        try:
            listed = self.spark.read.schema(MANIFEST).option("recursiveFileLookup", "true").json(f"{self.root}/versions")
            return [r.version for r in listed.select("version").distinct().orderBy("version").collect()]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def manifest(self, version: int | None = None) -> list[Row]:
        """The folders of a version (the newest by default): a row for each part of each table."""
        known = self.versions()
        if version is None and not known:
            return []
        if version is not None and version not in known:
            raise ValueError(f"no version {version} below {self.root}; there are {known}")
        number = known[-1] if version is None else version
        return self.spark.read.schema(MANIFEST).json(self._folder(number)).orderBy("table", "part").collect()

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """One table. The part is a literal in each of its folders, so a filter on it drops folders at planning time."""
        frames = []
        for row in (r for r in self.manifest(version) if r.table == table):
            columns = T.StructType.fromJson(json.loads(row.columns))
            inside = columns if row.part is None else T.StructType([f for f in columns.fields if f.name != self.by])
            frame = self.spark.read.schema(inside).parquet(f"{self.root}/{row.path}")
            if row.part is not None:
                frame = frame.withColumn(self.by, F.lit(row.part))
            frames.append(frame.select(*columns.fieldNames()))
        if not frames:
            raise ValueError(f"no table {table} below {self.root}")
        return bind_surveys(frames, frames[0].schema)

    def write(self, tables: Mapping[str, DataFrame], part: str | None = None) -> int:
        """Replace ``tables``, or one part of each, and return the new version; other tables and parts stay.

        A row that belongs to another part stops the job before anything changes.
        """
        before = self.manifest()
        mixed = [r.table for r in before if r.table in tables and (r.part is None) != (part is None)]
        if mixed:
            raise ValueError(f"a table is either whole or in parts: {sorted(set(mixed))}")
        stamp, rows = uuid.uuid4().hex, []
        for name, frame in tables.items():
            path = f"data/{name}/{stamp}"
            own = frame if part is None else self._of_part(frame, part)
            own.write.mode("errorifexists").parquet(f"{self.root}/{path}")
            rows.append((name, part, path, frame.schema.json()))
        kept = [(r.table, r.part, r.path, r.columns) for r in before if r.table not in tables or r.part != part]
        return self._commit(kept + rows)

    def drop_part(self, part: str) -> int:
        """A version without one part of every table."""
        rows = [(r.table, r.part, r.path, r.columns) for r in self.manifest()]
        if part not in [r[1] for r in rows]:
            raise ValueError(f"no part {part} below {self.root}")
        return self._commit([r for r in rows if r[1] != part])

    def _of_part(self, frame: DataFrame, part: str) -> DataFrame:
        astray = F.raise_error(F.concat(F.lit(f"row of another part than {part}: "), F.coalesce(F.col(self.by), F.lit("null"))))
        checked = F.when(F.col(self.by).eqNullSafe(F.lit(part)), F.lit(True)).otherwise(astray.cast("boolean"))
        return frame.where(checked).drop(self.by)

    def _folder(self, version: int) -> str:
        return f"{self.root}/versions/{version:09d}"

    def _commit(self, rows: list[tuple]) -> int:
        """One file names all folders, so the set changes when that file appears. Numbers a stopped writer left are passed over."""
        version = max(self.versions(), default=0) + 1
        while True:
            listed = self.spark.createDataFrame([(version, *r) for r in rows], MANIFEST).coalesce(1)
            try:
                listed.write.mode("errorifexists").json(self._folder(version))
                return version
            except AnalysisException as error:
                if error.getCondition() != "PATH_ALREADY_EXISTS":
                    raise
                if version in self.versions():
                    raise RuntimeError(f"version {version} was written meanwhile by another writer") from error
                version += 1
