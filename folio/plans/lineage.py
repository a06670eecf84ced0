"""Lineage cuts that outlive executors: everything goes to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.folio.scratch"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset a temporary one is made for a local master, whose tasks share the driver's disk; anywhere else
    executors could not see each other's files, so that is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.conf.set("spark.checkpoint.dir", made := tempfile.mkdtemp(prefix="folio-checkpoint-"))
    return made


def scratch(spark: SparkSession) -> str:
    """This session's folder below the shared one; the file system removes it, with all stored tables, as the driver ends."""
    known = spark.conf.get(FOLDER, None)
    if known:
        return known
    folder = f"{shared_dir(spark)}/folio-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    spark.conf.set(FOLDER, folder)
    return folder


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it again.

    Later plans start from the files, so a lost executor costs at most the scan of
    its share, and a result that is used twice is computed once.
    """
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """``store`` in buckets of ``key``, as many as the session shuffles to: joins by ``key`` move only their other side.

    Each task writes its rows by bucket, so nothing is shuffled for it. There are at most as many tasks as buckets, so files grow with the square of
    the buckets at most and not with the input; rows that are dealt by ``key`` already (``spread``) make one file a bucket.
    """
    spark = df.sparkSession
    label = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.coalesce(buckets).write.bucketBy(buckets, key).option("path", f"{scratch(spark)}/{label}").saveAsTable(label, format="parquet")
    return spark.table(label)


def kept(spark: SparkSession, name: str, build) -> str:
    """The folder of what ``build(folder)`` wrote for ``name``; written at the first call of a session and removed with its other stored tables."""
    key = f"{FOLDER}.{uuid.uuid5(uuid.NAMESPACE_URL, name).hex}"
    known = spark.conf.get(key, None)
    if known:
        return known
    folder = f"{scratch(spark)}/kept-{uuid.uuid4().hex}"
    build(folder)
    spark.conf.set(key, folder)
    return folder
