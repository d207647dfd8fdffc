"""The feed of inserted documents as a stream: one row per key, running statistics, bursts.

State is bounded by watermarks where a bounded answer is enough (`dedupe_within`, `bursts`); the catalogue's own
uniqueness, which has no time bound, and statistics by burst are in `keyed`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_inserts(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the files at `path` (a folder or a pattern)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def dedupe_within(events: DataFrame, ts: str = "ts", key: str = "archive_url", lateness: str = "10 minutes") -> DataFrame:
    """The first event of each key; a key is forgotten `lateness` after its time."""
    return events.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def bursts(events: DataFrame, gap: str = "500 milliseconds", ts: str = "ts", lateness: str = "1 minute") -> DataFrame:
    """(start, end, n): runs of events with no pause of `gap` between them; `end` is the last event plus the gap."""
    w = F.session_window(ts, gap)
    out = events.withWatermark(ts, lateness).groupBy(w.alias("w")).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_stats(events: DataFrame, path: str, checkpoint: str) -> None:
    """The statistics of inserted documents: per batch partial counts by department and commune, which `read_stats` adds up.

    events: documents (insee, type, iiif_manifest, licence_overlay_ok, ts). A commune is one row of a batch's table, so
    the set of communes is kept without any set growing in one place.
    """
    from folioworks.functions import parse as P
    from folioworks.functions import text as T

    kinds = ((P.TABLEAU, "assemblages"), (P.SECTION, "sections"), (P.FEUILLE, "feuilles"))

    def write(rows: DataFrame, batch: int) -> None:
        counts = [F.count("*").alias("total"), F.count_if("licence_overlay_ok").alias("overlay_ok"), F.count("iiif_manifest").alias("with_iiif"), *(F.count_if(F.col("type") == k).alias(n) for k, n in kinds)]
        per = rows.groupBy(T.department("insee").alias("dept"), "insee").agg(*counts, F.max("ts").alias("last"))
        per.where("dept is not null").write.mode("overwrite").parquet(f"{path}/batch={batch}")

    events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """(dept, total, overlay_ok, with_iiif, assemblages, sections, feuilles, communes, last) over all batches so far."""
    each = spark.read.parquet(path)
    sums = [F.sum(c).alias(c) for c in ("total", "overlay_ok", "with_iiif", "assemblages", "sections", "feuilles")]
    return each.groupBy("dept").agg(*sums, F.countDistinct("insee").alias("communes"), F.max("last").alias("last"))


def burst_refreshes(events: DataFrame, gap: str = "500 milliseconds", ts: str = "ts", lateness: str = "1 minute") -> DataFrame:
    """(start, end, n, depts): one refresh for each burst of inserts, with the departments whose statistics it changes (at most as many as there are)."""
    w = F.session_window(ts, gap)
    out = events.withWatermark(ts, lateness).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("dept")).alias("depts"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "depts")
