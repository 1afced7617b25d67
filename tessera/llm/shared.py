"""Tables written once in the folder that driver and executors share."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of tables kept for this driver.
_WRITTEN: list[str] = []
_RESIDENT: dict = {}


def resident(key, make: Callable):
    """An object that a worker process keeps from task to task. It keeps one only: another key's takes its place, so
    the stages of a pipeline do not add up their memos in the workers that they share."""
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder in the warehouse only where that is unset, as in tests. Both are
    shared by driver and executors; no machine's own folder is ever used."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return named.rstrip("/") if named else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_tessera"


def written(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept as Parquet, so that a lost executor costs no recomputation, and a join
    of two such tables reads plain shuffles, of which Spark splits the skewed partitions at run time.

    The files stay as long as a returned table may be read, which this library cannot tell: `cleared` removes them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession) -> int:
    """Removes all tables that `written` has kept for this driver, and tells how many. Call it when the results that
    read them have been saved."""
    jvm, n = spark.sparkContext._jvm, len(_WRITTEN)
    while _WRITTEN:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def sampled(key: Column, share: Column) -> Column:
    """Whether the row's key is among about that share of all keys, by a 64-bit hash, so that no share is too small."""
    return (F.xxhash64(key).cast("double") / F.lit(2.0**64) + F.lit(0.5) < share) | (share >= 1)
