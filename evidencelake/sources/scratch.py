"""Tables that a job writes for itself into the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, a temporary one, but in local mode alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def kept(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: computed once, whatever reads it, and safe from lost executors."""
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_dir(spark)}/evidencelake-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    del df
    gc.collect()  # Spark deletes a job's shuffle files once the driver has collected its plan
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)
