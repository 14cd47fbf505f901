"""Tables that cut lineage, kept in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one in local mode, an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="papyra-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Bytes of an Arrow batch, where the session has Spark's default: rows may be whole long texts.
BATCH_SETTING, BATCH_DEFAULT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 8 << 20


class Scratch:
    """Written tables of one run, under a path of their own.  ``made`` are those of this session that still stand."""

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        if spark.conf.get(BATCH_SETTING).rstrip("b") == str(BATCH_DEFAULT):
            spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
        self.spark, self.root, self.count = spark, f"{shared_dir(spark)}/papyra/{name}-{uuid.uuid4().hex}", 0
        Scratch.made.append(self)

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count}-{name}"

    def save(self, df: DataFrame, name: str = "table") -> DataFrame:
        """Write df and read it back: a lost executor then costs no recomputation."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def bucketed(self, df: DataFrame, keys: list[str], name: str) -> DataFrame:
        """Write df in buckets by keys and read it back: joins by all of them then leave its rows where they are."""
        table, path = f"papyra_{name}_{uuid.uuid4().hex}", self.path(name)
        buckets = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        df.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(buckets, *keys).saveAsTable(table)
        out = self.spark.table(table)
        out.scratch_path = path
        return out

    def remove(self) -> None:
        """Delete all tables of the run."""
        delete(self.spark, self.root)
        Scratch.made.remove(self)

    def drop(self, df: DataFrame) -> None:
        """Delete a saved table that nothing reads any more."""
        delete(self.spark, df.scratch_path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bytes_in(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
