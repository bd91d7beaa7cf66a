"""Tables written between the steps of a job that reads them more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the driver and all executors share; on a local master a folder of its own where it is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top:
        return top
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    top = f"file://{tempfile.mkdtemp(prefix='tidepool-stage-')}"
    spark.conf.set("spark.checkpoint.dir", top)
    return top


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame) -> DataFrame:
    """df written under the shared folder and read back: what follows reads it as often as it likes, and a lost executor costs a read.

    The shuffles that it was made by go as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)
