"""Cutting lineage: a table written to the cluster's shared folder and read back."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` (or by ``setCheckpointDir``).

    Where none is set, a session of one process (``local[*]``) gets a temporary one.
    On a cluster that is a ValueError, and so is a folder on one machine's disk:
    executors would write files others miss.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError(f"set {SETTING} to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        folder = spark.sparkContext.getCheckpointDir()
    if urlparse(folder).scheme == "file" and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{SETTING} is {folder}, a local folder; a cluster needs a shared one")
    return folder.rstrip("/")


def cut_lineage(frame: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``frame`` as Parquet to ``path``, or to a new folder in the shared one, and read it back.

    A lost executor then rereads files instead of repeating what led to them;
    later readers keep column pruning, filters on the files and statistics.
    The rows are those of one run, also where the frame is not deterministic.
    """
    spark = frame.sparkSession
    path = path or f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    frame.write.mode("errorifexists").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
