"""Tables that cut a plan's lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Local sessions without one use their warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", "")
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (path or spark.conf.get("spark.sql.warehouse.dir") + "/_work").rstrip("/") + "/" + spark.sparkContext.applicationId


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def sweep(spark: SparkSession) -> None:
    """Deletes all that materialize() wrote in this application; results that read it must be written by then.

    Runs by itself when Python ends while Spark is still up."""
    if spark.sparkContext._jsc is not None:
        _delete(spark, shared_dir(spark))


@cache
def _sweep_at_end(application: str) -> None:
    def end() -> None:
        spark = SparkSession.getActiveSession()
        if spark is not None and spark.sparkContext._jsc is not None and spark.sparkContext.applicationId == application:
            sweep(spark)

    atexit.register(end)


def materialize(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it back with its true size known."""
    spark = df.sparkSession
    _sweep_at_end(spark.sparkContext.applicationId)
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing reads it any more."""
    _delete(df.sparkSession, df._written_to)
