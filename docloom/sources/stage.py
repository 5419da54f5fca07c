"""The shared work folder, and tables written to it between steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``. Where the session names none, in a temporary folder if all
    of Spark is one process; on a cluster, whose executors wouldn't share it, an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/docloom/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written and read again: it is made once, and a lost executor costs no recomputation."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, mb: int = 8) -> None:
    """Arrow batches of few rows and bytes for the session, so that what a Python worker holds at once doesn't grow with
    the input: a batch of long texts or of blocks of vectors has few rows."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", mb << 20)):
        name = f"spark.sql.execution.arrow.{name}"
        known = spark.conf.get(name, None)
        if known is None or not 0 < int(re.match(r"-?[0-9]+", known)[0]) <= most:
            spark.conf.set(name, str(most))
