"""Tables in the shared folder, for loops and for what is read more than once."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests), a temporary folder that becomes the setting."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="metaloom-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written as Parquet (in a folder for each value of by) in the shared folder and read again: a cut in the
    lineage that survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a rule table up to which it is broadcast.
SMALL_ROWS = 50_000


def small(rows: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """rows, to be broadcast where they are counted to be few; else as they are, and the join shuffles."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows
