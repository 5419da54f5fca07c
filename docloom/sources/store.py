"""Sinks: a content-addressed blob table and a batch commit whose parts become visible together."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import blob_path, digest_hex


def addressed(contents: DataFrame, content: str = "content") -> DataFrame:
    """``contents`` with digest_hex, length_bytes and blob_path."""
    digest = digest_hex(F.col(content))
    return contents.withColumn("digest_hex", digest).withColumn("length_bytes", F.octet_length(content).cast("long")).withColumn("blob_path", blob_path(F.col("digest_hex")))


def to_store(contents: DataFrame, existing: DataFrame | None, max_bytes: int, content: str = "content") -> DataFrame:
    """digest_hex, length_bytes, blob_path and content of the blobs that aren't stored yet, each once; none over ``max_bytes``."""
    fits = addressed(contents.where(F.octet_length(content) <= max_bytes).select(content), content)
    new = fits if existing is None else fits.join(existing.select("digest_hex"), "digest_hex", "left_anti")
    return new.dropDuplicates(["digest_hex"])


def write_blobs(contents: DataFrame, path: str, max_bytes: int, content: str = "content") -> None:
    """Appends what isn't stored yet, in folders by the digest's first two digits. One writer at a time."""
    spark = contents.sparkSession
    existing = spark.read.parquet(path) if _exists(spark, path) else None
    rows = to_store(contents, existing, max_bytes, content).withColumn("prefix", F.substring("digest_hex", 1, 2))
    rows.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(path)


def integrity(blobs: DataFrame, owner: str, media_type: str, max_bytes: int) -> DataFrame:
    """(owner_service, media_type, algorithm, digest_hex, length_bytes, content) rows with ``problem``, null if none: what
    a read refuses."""
    content = F.col("content")
    problem = F.when(F.col("owner_service") != owner, "owner").when(F.col("media_type") != media_type, "media_type").when(F.col("algorithm") != "sha256", "algorithm").when(F.col("length_bytes") > max_bytes, "too_large").when((digest_hex(content) != F.col("digest_hex")) | (F.octet_length(content) != F.col("length_bytes")), "content")
    return blobs.withColumn("problem", problem)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def commit_batch(tables: Mapping[str, DataFrame], root: str, batch: str) -> bool:
    """Writes each table to root/<table>/batch=<batch> and then, in one rename, root/_manifest/<batch>.

    Readers go by the manifest, so all tables of a batch appear together or not at all; a batch that is in it is not
    written again (False)."""
    spark = next(iter(tables.values())).sparkSession
    if _exists(spark, f"{root}/_manifest/{batch}"):
        return False
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    temp, final = (jvm.org.apache.hadoop.fs.Path(f"{root}/{p}/{batch}") for p in ("_staging", "_manifest"))
    fs = final.getFileSystem(conf)
    fs.mkdirs(final.getParent())
    fs.mkdirs(temp.getParent())
    fs.create(temp, True).close()
    return bool(fs.rename(temp, final))


def read_committed(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The table's rows of all batches in the manifest; None before the first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/_manifest")
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return None
    batches = sorted(s.getPath().getName() for s in fs.listStatus(path))  # one small file for each batch
    return spark.read.option("basePath", f"{root}/{name}").parquet(*(f"{root}/{name}/batch={b}" for b in batches)) if batches else None
