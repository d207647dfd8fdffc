from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from folioworks.operators import places

KIND = "insee string, rings array<array<struct<lon:double,lat:double>>>"


def star(rng, lon, lat, size, n):
    """A closed ring with n corners at uneven distances."""
    ring = [(lon + size * r * math.cos(a), lat + size * r * math.sin(a)) for a, r in ((2 * math.pi * k / n, rng.uniform(0.3, 1)) for k in range(n))]
    return [*ring, ring[0]]


def holds(rings, lon, lat):
    n = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
            n += (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
    return n % 2 == 1


def plain(points, communes):
    return {i: min((c for c, rings in communes if lon is not None and lat is not None and holds(rings, lon, lat)), default=None) for i, lon, lat in points}


def table(spark, points, communes):
    return spark.createDataFrame(points, "id long, lon double, lat double"), spark.createDataFrame(communes, KIND)


@pytest.mark.parametrize(("seed", "most"), [(0, None), (1, 20), (2, 3)])
def test_points_match_plain_loops(spark, seed, most):
    """Stars with holes, overlapping communes, tiny and huge ones, points on corners and edges and cell borders, coarse cells and finest ones."""
    rng = random.Random(seed)
    communes = []
    for k in range(60):
        lon, lat, size = rng.uniform(1, 3), rng.uniform(45, 46), rng.choice((0.001, 0.05, 0.2, 1.0))
        rings = [star(rng, lon, lat, size, rng.randrange(3, 40))]
        if k % 3 == 0:
            rings.append(star(rng, lon, lat, size / 4, 7))
        communes.append((f"{k:05d}", rings))
    communes += [("90000", [[(1.0, 45.0), (2.0, 45.0), (2.0, 46.0), (1.0, 46.0), (1.0, 45.0)]]), ("90001", []), ("90002", None), ("90003", [[]])]
    at = [(rng.uniform(0.5, 3.5), rng.uniform(44.5, 46.5)) for _ in range(400)] + [(1.5 + rng.gauss(0, 1e-5), 45.5 + rng.gauss(0, 1e-5)) for _ in range(300)] + [(1.5, 45.5)] * 200
    at += [p for _, rings in communes[:20] for p in rings[0][:3]] + [(1.0, 45.0), (2.0, 45.5), (1.5, 46.0), (360 / 1024 * 516 - 180, 45.0), (360 / 1024 * 516 - 180, 180 / 1024 * 770 - 90), (None, 1.0), (1.0, None), (181.0, 45.0), (-180.0, -90.0), (180.0, 90.0)]
    points = [(i, *p) for i, p in enumerate(at)]
    p, c = table(spark, points, [(i, r) for i, r in communes])
    got = rows(places.commune_at_point(p.repartition(3), c, most))
    assert {r[0]: r[-1] for r in got} == plain(points, [(i, r or []) for i, r in communes]) and len(got) == len(points)


def test_crowded_points_are_split(spark):
    """Nine points in ten stand in one coarse cell, half of those at one place: no key of the join holds more than twice the points asked for."""
    rng = random.Random(5)
    points = [(i, 2.3 + rng.gauss(0, 0.01), 48.8 + rng.gauss(0, 0.01)) for i in range(4500)] + [(i, 2.31, 48.81) for i in range(4500, 9000)] + [(i, rng.uniform(-4, 8), rng.uniform(42, 51)) for i in range(9000, 10_000)]
    communes = [("75000", [star(rng, 2.3, 48.8, 0.05, 200)]), ("75001", [star(rng, 2.33, 48.82, 0.3, 50)])]
    p, c = table(spark, points, communes)
    out = places.commune_at_point(p, c, 200)
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "cell_" in x and "copy_" in x and "Join" in x]
    assert joins
    assert {r["id"]: r["insee"] for r in out.collect()} == plain(points, communes)
    crowded = places._crowded(p, 200)
    cells, splits = places.cover(c, crowded)
    assert len(splits) > 5
    # Every point's cell: coarse, or below the last split one.
    split = {level: {r[0] for r in cells.collect()} for level, cells in splits}
    keys = p.select("id", *(places.cell_of(level, F.col("lon"), F.col("lat")).alias(f"c{level}") for level in range(places.COARSE, places.FINE + 1))).collect()
    leaf = Counter()
    for r in keys:
        level = places.COARSE
        while level in split and r[f"c{level}"] in split[level]:
            level += 1
        leaf[r[f"c{level}"]] += 1
    full = {r["cell"]: -(-r["n"] // 200) for r in crowded.where(F.col("level") == places.FINE).collect()}
    assert max(n / full.get(cell, 1) for cell, n in leaf.items()) <= 200 and max(full.values()) >= 22


def test_cells_wholly_inside_need_no_edges(spark):
    square = [[(0.0, 40.0), (8.0, 40.0), (8.0, 48.0), (0.0, 48.0), (0.0, 40.0)]]
    p, c = table(spark, [(1, 4.0, 44.0)], [("A", square)])
    cells, _ = places.cover(c, places._crowded(p, 10))
    got = cells.collect()
    inner = [r for r in got if r["whole"] == "A" and not r["parts"]]
    assert len(inner) > 0.8 * len(got) and all(len(x["edges"]) <= 3 for r in got for x in r["parts"])
