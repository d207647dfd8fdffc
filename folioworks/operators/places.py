"""Points in polygons by an adaptive quadtree.

The plane is cut into cells; a cell that many points or many borders crowd falls into four, and so on. A polygon's part in a
cell keeps the edges that matter there. Where no edge comes near, the cell lies wholly inside or outside, and a point
in it is answered without any edge. Each point belongs to one cell and meets that cell's parts only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.operators.shared import keep

#: Coarsest and finest cells, as halvings of the globe (0.35 degrees; 20 metres); levels on which crowded borders split a cell too.
COARSE, FINE, BORDER_LEVELS = 10, 21, 4
#: Points of a cell at least before it is split; parts with edges of a cell before it is split; crowded cells of a level at most.
LEAST_POINTS, MOST_PARTS, MOST_CELLS = 10_000, 32, 4096
#: Cells are taken this much wider when edges are assigned, far beyond rounding, in degrees.
WIDE = 1e-9


def _cell(level: int, x: Column, y: Column) -> Column:
    return F.lit(level << 56) + F.shiftleft(x.cast("long"), 28) + y.cast("long")


def _at(level: int, lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.floor((lon + 180) / 360 * 2**level), F.floor((lat + 90) / 180 * 2**level)


def cell_of(level: int, lon: Column, lat: Column) -> Column:
    """The cell of a point, null outside of the globe's range."""
    return F.when(lon.between(-180, 180) & lat.between(-90, 90), _cell(level, *_at(level, lon, lat)))


def _edges(rings: Column) -> Column:
    """All edges of all rings as (x1, y1, x2, y2)."""
    pair = lambda a, b: F.named_struct(F.lit("x1"), a["lon"], F.lit("y1"), a["lat"], F.lit("x2"), b["lon"], F.lit("y2"), b["lat"])
    return F.flatten(F.transform(rings, lambda r: F.zip_with(F.slice(r, F.lit(1), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), pair)))


def inside(edges: Column, lon: Column, lat: Column) -> Column:
    """Even-odd rule: whether a ray to the east meets an odd number of edges; holes are rings too."""
    hit = lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / F.nullif(e["y2"] - e["y1"], F.lit(0.0)) + e["x1"])
    return F.size(F.filter(edges, hit)) % 2 == 1


def _parts(rows: DataFrame, level: int) -> DataFrame:
    """Parts (insee, edges, x, y) cut to their cells: (insee, cell, x, y, whole, edges); parts wholly outside go."""
    side_x, side_y = 360 / 2**level, 180 / 2**level
    x0, y0 = F.col("x") * side_x - 180, F.col("y") * side_y - 90
    # A ray to the east from the cell meets no others than these.
    ahead = lambda e: (F.greatest(e["x1"], e["x2"]) >= F.col("x0_") - WIDE) & (F.greatest(e["y1"], e["y2"]) >= F.col("y0_") - WIDE) & (F.least(e["y1"], e["y2"]) <= F.col("y0_") + side_y + WIDE)
    near = F.exists("edges", lambda e: F.least(e["x1"], e["x2"]) <= F.col("x0_") + side_x + WIDE)
    cut = rows.withColumns({"x0_": x0, "y0_": y0}).withColumn("edges", F.filter("edges", ahead))
    cut = cut.withColumn("near_", near).withColumn("in_", F.when(~F.col("near_"), inside(F.col("edges"), F.col("x0_") + side_x / 2, F.col("y0_") + side_y / 2)))
    cut = cut.where(F.col("near_") | F.col("in_"))
    empty = F.filter("edges", lambda e: F.lit(False))
    return cut.select("insee", _cell(level, F.col("x"), F.col("y")).alias("cell"), "x", "y", (~F.col("near_")).alias("whole"), F.when(F.col("near_"), F.col("edges")).otherwise(empty).alias("edges"))


def _crowded(points: DataFrame, most: int) -> DataFrame:
    """(level, cell, n) of cells with over `most` points, on all levels: at most MOST_CELLS on each."""
    fine = keep(points.where("lon is not null and lat is not null").groupBy(cell_of(FINE, F.col("lon"), F.col("lat")).alias("cell")).agg(F.count("*").alias("n")), "point-cells")
    x, y = F.shiftright("cell", 28).bitwiseAND(F.lit((1 << 28) - 1)), F.col("cell").bitwiseAND(F.lit((1 << 28) - 1))
    levels = F.array(*(F.struct(F.lit(level).alias("level"), _cell(level, F.shiftright(x, FINE - level), F.shiftright(y, FINE - level)).alias("cell")) for level in range(COARSE, FINE + 1)))
    each = fine.where("cell is not null").select(F.explode(levels).alias("c"), "n").groupBy("c.level", "c.cell").agg(F.sum("n").alias("n"))
    return keep(each.where(F.col("n") > most), "crowded-cells")


def cover(communes: DataFrame, crowded: DataFrame) -> tuple[DataFrame, list[tuple[int, DataFrame]]]:
    """((cell, whole, parts) for each final cell, [(level, split cells), ...]).

    whole: the smallest code of those that hold the cell wholly; parts: the codes and edges of the others. A cell is split if
    it is crowded with points or, on the first levels, with more than MOST_PARTS borders.
    """
    flat = F.flatten("rings")
    clamp = lambda v, most: F.greatest(F.least(v, F.lit(most - 1)), F.lit(0))
    at = lambda f, k, base, span: clamp(F.floor((f(F.transform(flat, lambda p: p[k])) + base) / span * 2**COARSE), 2**COARSE)
    box = communes.where(F.size(flat) > 0).select("insee", _edges(F.col("rings")).alias("edges"), *(at(f, k, base, span).alias(n) for n, f, k, base, span in (
        ("x0", F.array_min, "lon", 180, 360), ("x1", F.array_max, "lon", 180, 360), ("y0", F.array_min, "lat", 90, 180), ("y1", F.array_max, "lat", 90, 180))))
    start = box.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1")))
    level, now, done, splits = COARSE, keep(_parts(start, COARSE), "cell-parts"), [], []
    while level < FINE:
        split = crowded.where(F.col("level") == level).select("cell")
        if level < COARSE + BORDER_LEVELS:
            split = split.union(now.where(~F.col("whole")).groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > MOST_PARTS).select("cell"))
        split = keep(split.distinct(), "split-cells")
        if split.isEmpty():
            break
        splits.append((level, split))
        done.append(now.join(split, "cell", "left_anti"))
        child = F.explode(F.array(*(F.struct((F.col("x") * 2 + i).alias("x"), (F.col("y") * 2 + j).alias("y")) for i in (0, 1) for j in (0, 1))))
        four = now.join(split, "cell", "left_semi").select("insee", "edges", "whole", child.alias("c")).select("insee", "edges", "whole", "c.x", "c.y")
        level += 1
        kept = four.where("whole").select("insee", _cell(level, F.col("x"), F.col("y")).alias("cell"), "x", "y", "whole", "edges")
        now = keep(_parts(four.where("not whole").drop("whole"), level).unionByName(kept), "cell-parts")
    every = reduce(DataFrame.unionByName, [*done, now])
    return every.groupBy("cell").agg(F.min(F.when(F.col("whole"), F.col("insee"))).alias("whole"), F.collect_list(F.when(~F.col("whole"), F.struct("insee", "edges"))).alias("parts")), splits


def commune_at_point(points: DataFrame, communes: DataFrame, most_points: int | None = None) -> DataFrame:
    """points (lon, lat, ...) with the `insee` of the commune that holds them, the smallest code if several do; null if none does or a coordinate is null.

    communes: (insee, rings), rings an array of closed arrays of (lon, lat). most_points: of a cell before it is split;
    by default LEAST_POINTS, and so many of large tables that a level has MOST_CELLS crowded cells at most, so their lists
    can be sent to every task. Points that crowd a finest cell are dealt to as many copies of its parts.
    """
    most = most_points or max(LEAST_POINTS, -(-points.count() // MOST_CELLS))
    crowded = _crowded(points, most)
    cells, splits = cover(communes, crowded)
    names, level, out = points.columns, COARSE, points
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    own = cell_of(COARSE, lon, lat)
    for level, split in splits:
        out = out.join(F.broadcast(split.select(F.col("cell").alias(f"split{level}_"))), cell_of(level, lon, lat) == F.col(f"split{level}_"), "left")
        own = F.when(F.col(f"split{level}_").isNotNull(), cell_of(level + 1, lon, lat)).otherwise(own)
    out = out.select(*names, own.alias("cell_"))
    # Finest cells that still are crowded: `copies` of their parts.
    full = crowded.where(F.col("level") == FINE).select("cell", F.ceil(F.col("n") / most).cast("int").alias("copies"))
    out = out.join(F.broadcast(full.select(F.col("cell").alias("full_"), "copies")), F.col("cell_") == F.col("full_"), "left")
    # By hash, so that a task that runs again deals its rows alike.
    out = out.withColumn("copy_", F.when(F.col("copies").isNotNull(), F.pmod(F.xxhash64(*names), F.col("copies"))).otherwise(F.lit(0)).cast("int"))
    dealt = cells.join(F.broadcast(full), "cell", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
    met = out.join(dealt.select(F.col("cell").alias("c_"), F.col("copy").alias("k_"), "whole", "parts"), (F.col("cell_") == F.col("c_")) & (F.col("copy_") == F.col("k_")), "left")
    some = F.array_min(F.transform(F.filter("parts", lambda p: inside(p["edges"], lon, lat)), lambda p: p["insee"]))
    return met.select(*names, F.least("whole", some).alias("insee"))
