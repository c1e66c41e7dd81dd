"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, or a temporary folder on a local master only."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="riskloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def written(df: DataFrame) -> DataFrame:
    """`df` written once as Parquet and read back: it survives lost executors, cuts the lineage and has true sizes.

    Tables go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/riskloom-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, column: str, dealt: bool = False) -> DataFrame:
    """`df` written once, in buckets by `column`: joins on it don't shuffle these rows again, however often they are read.

    `dealt`: its rows are shuffled by `column` alone already, so that a bucket is one task's and needs no shuffle of its own.
    """
    spark = df.sparkSession
    name = f"riskloom_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    _written.append((spark, path))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df if dealt else df.repartition(n, column)).write.bucketBy(n, column).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


@atexit.register
def _drop_tables() -> None:
    for spark, path in _written:
        try:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session has ended already
            return
