"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is missing and everything runs on one machine, a temporary
    folder is set; elsewhere executors could not read it, which is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    """Where this application's tables are; ``clear_saved`` removes it."""
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread of the written table only.
    """
    path = f"{tables_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_saved(spark: SparkSession) -> None:
    """Remove all tables that ``saved`` has written for this application.

    For the caller, when the outputs of its queries are written: results that are not yet
    written still read these tables.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df``, a written table of narrow rows, as a broadcast side where it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df
