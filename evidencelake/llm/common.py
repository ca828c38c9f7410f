"""What the training-data operators share: table reading, shared scratch space, word splitting."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is named, a temporary one, but in local mode alone."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


class Scratch:
    """Tables written to the shared folder, so that lineage is cut and lost executors cost nothing."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/evidencelake-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path, schema = f"{self.base}/{name}", df.schema
        df.write.options(**({"compression": "zstd"} | options)).parquet(path)
        del df
        self._free_shuffles()
        return self.spark.read.schema(schema).parquet(path)

    def _free_shuffles(self) -> None:
        """Spark deletes a finished job's shuffle files once the driver has collected its plan."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str) -> None:
        """Deletes a kept table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_HELD: dict = {"owner": None, "free": None}


def occupy(owner: str, free: Callable[[], object] | None = None) -> None:
    """Says in a Python worker whose caches it holds. What another operator left there is freed first, as Spark reuses workers."""
    if _HELD["owner"] != owner:
        if _HELD["free"]:
            _HELD["free"]()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)
    _HELD.update(owner=owner, free=free)


def only(df: DataFrame, **types: str) -> DataFrame:
    """The named columns with the wanted types; every other column is left out."""
    return df.select(*(F.col(f"`{name}`").cast(kind).alias(name) for name, kind in types.items()))


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lower_ascii(data: bytes) -> bytes:
    """Only A-Z change: bytes.lower() leaves bytes over 127 alone."""
    return data.lower()


def words(text: str | None) -> list[bytes]:
    """Maximal runs outside space, tab, newline, vertical tab, form feed and return, in UTF-8.

    bytes.split() splits at exactly these six, unlike str.split().
    """
    return text.encode("utf-8", "surrogatepass").split() if text else []
