"""Streams with keyed state and timers: statistics by burst, one row for each key without a time bound.

State lies in RocksDB on the executors' disks, with a changelog in the checkpoint: a batch uploads what it changed, and
a lost executor's state is rebuilt from there. What a batch reads and writes depends on its own rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioworks.functions import parse as P

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: What is counted of inserted documents, in the order of the columns.
MEASURES = ("total", "overlay_ok", "with_iiif", "assemblages", "sections", "feuilles")
_COUNTS = ", ".join(f"{m} long" for m in MEASURES)
_BURST = f"dept string, start long, last long, n long, {_COUNTS}, communes long"


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB with a changelog."""
    was = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class BurstStatistics(StatefulProcessor):
    """A department's inserts: counters and communes so far, the bursts that are still open, a timer for the end of the first.

    No more bursts are open than fit between the watermark and the latest event, beside a batch's own. A burst is open until the watermark is `gap` after its last event; events may arrive in any order until then, join two
    open bursts or stand between them. Bursts close in the order of time, so "so far" is up to the burst's end by event time.
    """

    def __init__(self, gap_us: int):
        self.gap = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", f"{_COUNTS}, communes long")
        self.communes = handle.getMapState("communes", "insee string", "first long")
        self.open = handle.getListState("open", f"start long, last long, n long, {_COUNTS}, insees array<string>")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(v[0], v[1], list(v[2:-1]), set(v[-1])) for v in self.open.get()]
        for frame in rows:
            frame = frame.sort_values("at")
            burst = (frame["at"].diff() >= self.gap).cumsum()
            sums = frame.groupby(burst)[list(MEASURES)].sum()
            for (i, own), (_, counts) in zip(frame.groupby(burst), sums.iterrows(), strict=True):
                parts.append((int(own["at"].iloc[0]), int(own["at"].iloc[-1]), [len(own), *map(int, counts)], set(own["insee"].dropna())))
        joined: list[tuple] = []
        for start, last, counts, insees in sorted(parts, key=lambda p: p[:2]):
            if joined and start - joined[-1][1] < self.gap:
                first, end, sums, seen = joined[-1]
                joined[-1] = first, max(end, last), [a + b for a, b in zip(sums, counts, strict=True)], seen | insees
            else:
                joined.append((start, last, counts, insees))
        self._wait_for(joined)
        yield from ()

    def _wait_for(self, bursts: list[tuple]) -> None:
        """Keeps the open bursts, in order, and one timer: for the end of the one whose end comes first."""
        if bursts:
            self.open.put([(start, last, *counts, sorted(insees)) for start, last, counts, insees in bursts])
        else:
            self.open.clear()
        ends = -(-(bursts[0][1] + self.gap) // 1000) if bursts else None
        was = self.timer.get()[0] if self.timer.exists() else None
        if was != ends:
            if was is not None:
                self.handle.deleteTimer(was)
                self.timer.clear()
            if ends is not None:
                self.handle.registerTimer(ends)
                self.timer.update((ends,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        parts = [(v[0], v[1], list(v[2:-1]), set(v[-1])) for v in self.open.get()]
        so_far = list(self.totals.get()) if self.totals.exists() else [0] * (len(MEASURES) + 1)
        known, found = {k[0] for k in self.communes.keys()}, []
        for start, last, (n, *counts), insees in (p for p in parts if p[1] + self.gap <= now):
            for i in insees - known:
                self.communes.updateValue((i,), (start,))
            known |= insees
            so_far = [*(a + b for a, b in zip(so_far, counts)), len(known)]
            found.append((key[0], start, last, n, *so_far))
        self.timer.clear()
        self._wait_for([p for p in parts if p[1] + self.gap > now])
        if found:
            self.totals.update(tuple(so_far))
            yield pd.DataFrame(found, columns=["dept", "start", "last", "n", *MEASURES, "communes"])

    def close(self) -> None:
        pass


def _microseconds(gap: str) -> int:
    n, unit = gap.split()
    return round(float(n) * {"millisecond": 1e3, "second": 1e6, "minute": 6e7}[unit.rstrip("s")])


def burst_statistics(events: DataFrame, gap: str = "500 milliseconds", lateness: str = "1 minute") -> DataFrame:
    """One row for each department's burst of inserts: (dept, start, last, n, total, overlay_ok, with_iiif, assemblages, sections, feuilles, communes).

    events: a stream of documents (dept, insee, type, iiif_manifest, licence_overlay_ok, ts). A burst is a run of events
    with less than `gap` between neighbours; its row comes when the watermark (`lateness` behind the latest event) has
    passed its end by `gap`, and holds the department's statistics up to there. Events behind the watermark are dropped;
    rows without a department or time are left out; a null commune counts as a document but as no commune.
    """
    kinds = ((P.TABLEAU, "assemblages"), (P.SECTION, "sections"), (P.FEUILLE, "feuilles"))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    counted = events.where("dept is not null and ts is not null").select(
        "dept", "ts", F.unix_micros("ts").alias("at"), "insee", F.lit(1).cast("long").alias("total"), one(F.col("licence_overlay_ok")).alias("overlay_ok"), one(F.col("iiif_manifest").isNotNull()).alias("with_iiif"), *(one(F.col("type") == k).alias(n) for k, n in kinds))
    keyed = counted.withWatermark("ts", lateness).groupBy("dept")
    out = keyed.transformWithStateInPandas(BurstStatistics(_microseconds(gap)), _BURST, "Append", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("start", "last")})


class FirstOfKey(StatefulProcessor):
    """Keys seen so far in one of the buckets that keys are hashed to; a new key's first row, by order, goes on."""

    def __init__(self, key: str, order: str, names: list[str]):
        self.key, self.order, self.names = key, order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "key string", "first boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Only the first row of each key is held, whatever a batch brings of it.
        first: pd.DataFrame | None = None
        for frame in rows:
            both = frame if first is None else pd.concat([first, frame])
            first = both.sort_values(self.order, kind="stable").drop_duplicates(self.key)
        if first is not None:
            new = first[[not self.seen.containsKey((k,)) for k in first[self.key]]]
            for k in new[self.key]:
                self.seen.updateValue((k,), (True,))
            if len(new):
                yield new[self.names]

    def close(self) -> None:
        pass


def unique_rows(events: DataFrame, key: str = "archive_url", order: str = "event_id", buckets: int = 1024) -> DataFrame:
    """The stream's rows that are the first of their key: over all batches, within a batch by `order`.

    Keys (text) are dealt to `buckets` by hash; each bucket looks up only the keys that a batch brings. Rows without a
    key are equal to no others and all stay, as under a UNIQUE constraint.
    """
    names = events.columns
    kept = events.where(F.col(key).isNotNull()).withColumn("bucket_", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    shape = ", ".join(f"`{n}` {t}" for n, t in events.dtypes)
    first = kept.groupBy("bucket_").transformWithStateInPandas(FirstOfKey(key, order, names), shape, "Append", "None")
    return first.union(events.where(F.col(key).isNull()))


def run(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what is there into a table at `path`, each row exactly once also after a failure, and returns when it is done."""
    with rocksdb(rows.sparkSession):
        query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
