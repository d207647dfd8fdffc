"""Shared steps: picking rows by rank, writing a step's result."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Spark's setting that removes an execution's shuffle files when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

def _pick(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("pick_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("pick_ = 1").drop("pick_")


def first_wins(df: DataFrame, keys: list[str], rank: str = "ingest_rank") -> DataFrame:
    """One row for each key, the first by rank; Spark keeps one candidate per key and task before the shuffle."""
    return _pick(df, keys, [F.col(rank).asc()])


def last_wins(df: DataFrame, keys: list[str], rank: str = "ingest_rank") -> DataFrame:
    return _pick(df, keys, [F.col(rank).desc()])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, in local mode) a new local one; on a cluster an unset one is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def numbered(df: DataFrame, keys: list, name: str = "place") -> DataFrame:
    """`df` with each row's place in the order of `keys`: rows are dealt to tasks by ranges of the keys, numbered within a range, and the rows of the ranges before are added."""
    ranged = keep(df.repartitionByRange(*keys).withColumn("range_", F.spark_partition_id()), "ranges")
    before = F.sum("count").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranged.groupBy("range_").count().select("range_", F.coalesce(before, F.lit(0)).alias("before_"))  # a row for each range
    within = F.row_number().over(Window.partitionBy("range_").orderBy(*keys))
    return ranged.withColumn("within_", within).join(F.broadcast(offsets), "range_").withColumn(name, (F.col("before_") + F.col("within_")).cast("int")).drop("range_", "within_", "before_")


def keep(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again; cuts the lineage of loops. The write's own shuffle files go at once, the table goes by `free`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, was)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def free(*tables: DataFrame) -> None:
    """Deletes tables that `keep` wrote and that nothing reads any more."""
    for t in tables:
        jvm = t.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(t.kept_at)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
