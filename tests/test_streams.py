from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from folioworks.streaming import inserts, keyed

EVENT = "dept string, insee string, type string, iiif_manifest string, licence_overlay_ok boolean, ms long"
KINDS = "dept string, insee string, type string, iiif_manifest string, licence_overlay_ok boolean, ts timestamp"


def put(spark, path, events):
    """Appends one file of (dept, insee, ms) events."""
    data = [(d, i, ("tableau_assemblage", "section", "feuille", None)[ms % 4], "m" if ms % 3 else None, (True, False, None)[ms % 3], ms) for d, i, ms in events]
    spark.createDataFrame(data, EVENT).withColumn("ts", F.timestamp_millis("ms")).drop("ms").coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, lateness="10 seconds", name="b"):
    rows_ = keyed.burst_statistics(inserts.read_inserts(spark, str(tmp_path / "in"), KINDS), "500 milliseconds", lateness)
    keyed.run(rows_, str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-ck"))
    out = spark.read.parquet(str(tmp_path / f"{name}-out"))
    return rows(out.select("dept", F.unix_millis("start"), F.unix_millis("last"), "n", *keyed.MEASURES, "communes"))


def plain(events, watermark, gap=500):
    """Bursts and statistics so far of the events, by plain loops; those that the watermark has passed."""
    out = []
    for dept in sorted({d for d, _, _ in events if d is not None}):
        own = sorted((ms, i) for d, i, ms in events if d == dept)
        bursts = []
        for ms, i in own:
            if bursts and ms - bursts[-1][-1][0] < gap:
                bursts[-1].append((ms, i))
            else:
                bursts.append([(ms, i)])
        for k, b in enumerate(bursts):
            so_far = [x for past in bursts[: k + 1] for x in past]
            count = lambda f: sum(f(ms) for ms, _ in so_far)
            if b[-1][0] + gap <= watermark:
                out.append((dept, b[0][0], b[-1][0], len(b), len(so_far), count(lambda ms: ms % 3 == 0), count(lambda ms: ms % 3 != 0), count(lambda ms: ms % 4 == 0), count(lambda ms: ms % 4 == 1), count(lambda ms: ms % 4 == 2), len({i for _, i in so_far if i})))
    return sorted(out, key=str)


def test_statistics_by_burst_match_plain_loops(spark, tmp_path):
    """Events out of order within a batch and between batches, bursts that grow together, a hot department, restarts from the checkpoint, late rows."""
    rng = random.Random(2)
    base = 1_700_000_000_000
    event = lambda lo, hi: (rng.choice(["01", "01", "01", "02", "2A"]), rng.choice([None, *(f"i{k}" for k in range(9))]), base + rng.randrange(lo, hi))
    batches = [[event(9_000 * b, 9_000 * b + 15_000) for _ in range(60)] for b in range(3)]
    batches[0] += [("02", "x", base), ("02", "y", base + 500), ("02", "x", base + 999)]  # a pause of exactly the gap parts them, a shorter one doesn't
    batches[1].append((None, "x", base + 20_000))
    seen = []
    for batch in batches:
        put(spark, str(tmp_path / "in"), batch)
        seen += batch
        got = run(spark, tmp_path)  # each run starts anew from the checkpoint
        assert got == plain(seen, max(ms for _, _, ms in seen) - 10_000)
    # Behind the watermark: dropped, so neither bursts nor counts change.
    put(spark, str(tmp_path / "in"), [("01", "late", base + 1), ("01", "new", base + 60_000), ("02", "new", base + 90_000)])
    seen += [("01", "new", base + 60_000), ("02", "new", base + 90_000)]
    assert run(spark, tmp_path) == plain(seen, base + 80_000)
    assert {r[0] for r in got} == {"01", "02", "2A"} and len(got) > 20


def test_a_burst_may_join_two_open_ones(spark, tmp_path):
    base = 1_700_000_000_000
    for batch in ([("01", "a", base), ("01", "b", base + 800)], [("01", "c", base + 400)], [("01", "d", base + 30_000)]):
        put(spark, str(tmp_path / "in"), batch)
    got = run(spark, tmp_path)
    assert [(r[1] - base, r[2] - base, r[3], r[-1]) for r in got] == [(0, 800, 3, 3)]


@pytest.mark.parametrize("turns", [1, 3])
def test_unique_rows(spark, tmp_path, turns):
    """First of each key over all batches, within a batch by order; rows without a key all stay; a restart forgets nothing."""
    rng = random.Random(turns)
    want, seen, n = [], set(), 0
    for _ in range(turns):
        batch = [(rng.choice([None, *(f"k{i}" for i in range(30))]), n + i, f"v{i}") for i in range(40)]
        n += 40
        spark.createDataFrame(rng.sample(batch, 40), "archive_url string, event_id long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for k, i, v in batch:
            if k is None or k not in seen:
                want.append((k, i, v))
                seen.add(k)
        stream = inserts.read_inserts(spark, str(tmp_path / "in"), "archive_url string, event_id long, v string")
        keyed.run(keyed.unique_rows(stream, buckets=4), str(tmp_path / "out"), str(tmp_path / "ck"))
        assert rows(spark.read.parquet(str(tmp_path / "out"))) == sorted(want, key=str)


def test_what_a_batch_uploads_does_not_grow(spark, tmp_path):
    """Batches of equal size with new keys each: a batch's changelog is of its own keys, however many came before."""
    for b in range(6):
        spark.createDataFrame([(f"key-{b}-{i}", i) for i in range(500)], "archive_url string, event_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = inserts.read_inserts(spark, str(tmp_path / "in"), "archive_url string, event_id long")
    keyed.run(keyed.unique_rows(stream, buckets=8), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3000
    sizes = {}
    for f in (tmp_path / "ck" / "state").rglob("*.changelog"):
        sizes[f.name] = sizes.get(f.name, 0) + f.stat().st_size
    sizes = [n for n in sizes.values() if n > 1000]
    assert len(sizes) >= 5 and max(sizes) < 1.5 * min(sizes), sizes
