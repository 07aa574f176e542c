"""Writing what several later steps read."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Lets a query remove its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, from ``spark.checkpoint.dir``; only a local session may do without it."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="rooftide-")


def cut(df: DataFrame) -> DataFrame:
    """The rows as written to the shared folder: later steps read them and don't derive them again."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as written to the shared folder by columns, a fraction of what :func:`cut` takes; the shuffles behind them go at once.

    Spark before 4.1 does not know that setting and keeps the shuffles until the driver collects its garbage.
    """
    spark, place = df.sparkSession, f"{shared_folder(df.sparkSession)}/rows-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(place)  # a frame takes the setting when it is made
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(place)
