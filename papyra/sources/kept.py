"""Tables that outlive a query: a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def kept_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one in local mode without that setting, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="papyra-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path of any scheme."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def changed_at(spark: SparkSession, path: str) -> int:
    """When the files of a table were last written, in milliseconds."""
    fs, at = hadoop(spark, path)
    status = fs.getFileStatus(at)
    return max([status.getModificationTime(), *(s.getModificationTime() for s in fs.listStatus(at))]) if status.isDirectory() else status.getModificationTime()


def save(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read from there: what follows does not compute it again."""
    path = f"{kept_dir(df.sparkSession)}/papyra/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sorted_parts(df: DataFrame, keys: list, name: str) -> DataFrame:
    """df sorted over all by range partitions, written once, with its part's number ``_part``: parts are in order, each can be gone through alone."""
    return save(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()), name)


def running_total(df: DataFrame, order: list, value, out: str) -> DataFrame:
    """df with ``out``: the sum of value over the rows before each, in an order over the whole table.

    Sums of sorted parts, one row each, are added up and joined back to the parts, so no task
    sees more than its own part.
    """
    parts = sorted_parts(df.withColumn("_value", value), order, "running")
    sums = parts.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_sum_before"))  # a row for each part
    own = F.coalesce(F.sum("_value").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.join(F.broadcast(before), "_part").withColumn(out, F.col("_sum_before") + own).drop("_part", "_value", "_sum_before")


def running_count(df: DataFrame, keys: list[str], order: str, out: str) -> DataFrame:
    """df with ``out``: the place, from 1, of each row among those with equal keys, by order.  A key may have any share of the rows."""
    parts = sorted_parts(df, [*keys, order], "counted")
    own = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(order))
    counts = parts.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    # only a part's first key can have begun in an earlier part
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    carried = before.where("_before > 0").select("_part", *keys, "_before")
    return parts.withColumn("_own", own).join(F.broadcast(carried), ["_part", *keys], "left").withColumn(out, F.col("_own").cast("long") + F.coalesce("_before", F.lit(0))).drop("_part", "_own", "_before")
