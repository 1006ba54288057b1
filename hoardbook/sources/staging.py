"""Tables staged between jobs, in the folder the cluster shares."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by the session. Only a session on one machine (master ``local``) may lack
    it and gets a folder of its own; elsewhere executors could not read each other's files."""
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if spark.sparkContext.master.split("[")[0] == "local":
        return tempfile.mkdtemp(prefix="hoardbook-")
    raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: later jobs neither recompute it nor depend on
    the executors that did."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
