"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; existing settings of a cluster win."""
    b = (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; in local mode a temporary one where that is unset."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="granthika-")
    atexit.register(shutil.rmtree, own, True)
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir() or own


def settle(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and executors may be lost.

    The files go when the session's process ends.
    """
    spark = df.sparkSession
    path = scratch(spark, "settled")
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _remove(spark: SparkSession, path: str) -> None:
    try:
        fs, p = file_system(spark, path)
        fs.delete(p, True)
    except Exception:
        shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; it goes when the session's process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


@contextmanager
def replace_folder(spark: SparkSession, path: str) -> Iterator[str]:
    """A folder to write to, which takes the place of ``path`` when all is written; a failure leaves the old one."""
    part = f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
    try:
        yield part
        fs, new = file_system(spark, part)
        _, old = file_system(spark, path)
        away = file_system(spark, f"{part}-old")[1]
        had = fs.exists(old)
        if had and not fs.rename(old, away):
            raise OSError(f"cannot move {path} away")
        if not fs.rename(new, old):
            if had:
                fs.rename(away, old)
            raise OSError(f"cannot put the new files at {path}")
        if had:
            fs.delete(away, True)
    except BaseException:
        _remove(spark, part)
        raise


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
