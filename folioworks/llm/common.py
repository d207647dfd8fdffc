"""What the operators share: reading, tables written between jobs, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that removes an execution's shuffle files when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's setting for the bytes of a batch of rows on its way to Python, and what `small_batches` sets.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
#: Words are runs of bytes other than these: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, in local mode) a new local one.

    On a cluster a local folder would hold only the rows of its own machine, so an unset one is an error there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs the running job's tasks, not the jobs before it. The reread
    table has sizes that the planner can trust when it chooses between a broadcast and a shuffle. The write's own
    shuffle files are no longer needed after it and are removed at once.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    was = df.sparkSession.conf.get(CLEAN, "false")
    df.sparkSession.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        df.sparkSession.conf.set(CLEAN, was)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def small_batches(spark: SparkSession) -> None:
    """From now on batches of rows on their way to Python have BATCH_BYTES, about (a longer row is one batch), unless the session has less.

    At Spark's 64 MB a batch of texts is held twice or more outside the heap, in the executor and in the Python worker, for each core.
    """
    if int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH))) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def free(*tables: DataFrame | None) -> None:
    """Delete tables that `keep` wrote and that nothing reads any more."""
    for t in tables:
        if t is not None:
            jvm = t.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(t.kept_at)
            path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores before it that `df` has no such column, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def some_rows(df: DataFrame, n: int, *by: str, seed: int = 0) -> DataFrame:
    """n rows (all, if fewer) of a written table with the smallest hashes of columns `by`, in that order.

    The count gives a hash below which about 4 n rows lie, so tasks hand on some 4 n rows in all, however many tasks.
    """
    total = max(df.count(), 1)
    turn = F.xxhash64(F.lit(seed), *by)
    below = int(min(1.0, 4 * n / total + 64 / total) * 2**32)
    return df.where(F.pmod(turn, F.lit(2**32)) < below).orderBy(F.pmod(turn, F.lit(2**32)), *by).limit(n)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an undirected graph; component is the smallest node reachable.

    Alternates large-star and small-star: each node tells its neighbours the smallest node it knows, so every
    round is two aggregations by node with a partial sum before the shuffle, hubs included, and the number of
    rounds grows with the logarithm of the longest path. Edges with a null end and loops are left out. The result is a kept
    table: `free` it when it isn't read any more.
    """
    e = keep(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct(),
        "edges",
    )
    seen = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, keep(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        free(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    own = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = keep(own.union(roots), "components")
    free(e)
    return out
