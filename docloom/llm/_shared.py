"""Session helpers: the shared work folder, written stages, shipping this package to Python workers."""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The ASCII white space of the word and line rules: blank and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where the session names none, a temporary one if all of Spark is one
    process; on a cluster, whose executors wouldn't share it, an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/docloom/{name}-{uuid.uuid4().hex}"


#: Rows of a file, where a table's size is known.
FILE_ROWS = 200_000


def staged(df: DataFrame, name: str, rows: int | None = None, file_rows: int = FILE_ROWS) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again: lineage is cut, and a lost executor costs no recomputation.

    ``rows`` bounds the table's rows, where that is known; a small table goes to few files then."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // file_rows)))
    df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete consumed stages, on whatever file system holds them."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once for each Spark application."""
    sc = spark.sparkContext
    if getattr(ship_package, "sent", None) == sc.applicationId:
        return
    top = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="docloom-ship-"), "docloom_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent).as_posix())
    sc.addPyFile(target)
    ship_package.sent = sc.applicationId


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of few rows, so that a batch of long texts stays small in a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_KEPT: dict[str, Callable[[], object]] = {}


def trim() -> None:
    """Give unused memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library isn't glibc
        ctypes.CDLL(None).malloc_trim(0)


def keep_only(name: str | None = None, clear: Callable[[], object] | None = None) -> None:
    """Clears what other operators have kept in this Python worker, which Spark uses again for later stages. ``name``
    keeps something too, and ``clear`` lets go of it."""
    others = [k for k in _KEPT if k != name]
    for k in others:
        _KEPT.pop(k)()
    if name is not None and clear is not None:
        _KEPT[name] = clear
    if others:
        trim()


def frugal(run, keeps: str | None = None):
    """A function for mapInArrow that begins without what other operators have kept, and gives memory back at its end."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only(keeps)
        try:
            yield from run(batches)
        finally:
            trim()

    return held


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of narrow rows, put together to about ``rows``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def free_name(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that ``df`` doesn't have (case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out
