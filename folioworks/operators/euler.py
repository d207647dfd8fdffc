"""Whole-tree questions by intervals: leaves are taken off while that is cheap, an Euler tour of the rest is ranked as a list.

A node whose children are all taken off is taken off too, with its size, as long as a round takes at least a third of
what is left; a shallow tree needs no more. The tour of the rest enters each node, goes through its children in order and
leaves it. Its places make a linked list; pointers that double their reach give every place's rank in about log2(n) joins,
whatever the depth: first up to the next of some marked places (one in `MARKED`), then among the marked ones alone. A node's
interval holds its own number in pre-order and that of its last descendant, so "below" is "between", and a question about all
subtrees is one pass in pre-order instead of a join for each level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from folioworks.operators.shared import free, keep

#: One place in so many is marked.
MARKED = 32
#: Leaves are taken off while they are one in so many of the nodes.
LEAVES = 3


class NotATree(ValueError):
    """A node with several parents, or a cycle."""


def intervals(edges: DataFrame) -> DataFrame:
    """(id, enter, leave, depth) of each node of a forest (parent_id, child_id, pos), children by pos and id.

    enter: the node's number in pre-order, from 1, trees by their root's id; leave: the number of its last descendant; depth: 0 for roots.
    Edges with a null end are left out; shared children (also edges that stand twice) and cycles raise NotATree.
    """
    e = edges.where("parent_id is not null and child_id is not null").select("parent_id", "child_id", "pos")
    e, sorted_ = _placed(e, ["parent_id", "pos", "child_id"], "tour-edges")
    # Siblings have neighbouring numbers k; first and last are those of a node's children.
    ends = e.groupBy("parent_id").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    ids = e.select(F.col("child_id").alias("id"), "k").unionByName(ends.select(F.col("parent_id").alias("id"), "first", "last"), allowMissingColumns=True)
    seen = Observation()
    nodes = ids.groupBy("id").agg(F.count("k").alias("n"), *(F.max(c).alias(c) for c in ("k", "first", "last")))
    nodes = keep(nodes.observe(seen, F.count("*").alias("nodes"), F.max("n").alias("most"), F.count_if(F.col("n") == 0).alias("roots")).drop("n"), "tour-nodes")
    free(sorted_)
    if (seen.get["most"] or 0) > 1:
        raise NotATree("a node has several parents")
    total, n_roots = seen.get["nodes"], seen.get["roots"]
    if not total:
        return nodes.select("id", F.col("k").alias("enter"), F.col("k").alias("leave"), F.col("k").cast("int").alias("depth"))
    # Roots are the children of nothing: their numbers end at 0.
    roots, sorted_ = _placed(nodes.where("k is null").select("id", "first", "last"), ["id"], "tour-roots")
    inner = nodes.where("first is not null and k is not null").unionByName(roots.withColumn("k", F.col("k") - n_roots))
    inner = keep(inner.select("id", "k", "first", "last"), "tour-inner")
    free(sorted_)
    placed = _entered(inner, total, n_roots)
    # The leaves: within a family a running sum starts at the parent's number and grows by each child's size.
    found = keep(inner.join(placed, "k"), "tour-found")
    free(inner, placed)
    leaf = nodes.where("first is null").select((F.col("k") * 2).alias("at"), "id", F.lit(1).cast("long").alias("grows"), F.lit(0).cast("long").alias("deeper"))
    marks = found.select(F.inline(F.array(
        F.struct((F.col("first") * 2 - 1).alias("at"), F.col("enter").alias("grows"), (F.col("depth") + 1).alias("deeper")),
        F.struct((F.col("last") * 2 + 1).alias("at"), (-F.col("leave")).alias("grows"), (-F.col("depth") - 1).alias("deeper")),
        F.struct((F.col("k") * 2).alias("at"), F.when(F.col("k") > 0, F.col("leave") - F.col("enter") + 1).otherwise(F.lit(0)).alias("grows"), F.lit(0).cast("long").alias("deeper")))))
    rows = scanned(leaf.unionByName(marks, allowMissingColumns=True), "at", {"enter": F.col("grows"), "depth": F.col("deeper")}, {}, {})
    leaves = rows.where("id is not null").select("id", "enter", F.col("enter").alias("leave"), F.col("depth").cast("int").alias("depth"))
    free(nodes)
    out = keep(leaves.unionByName(found.select("id", "enter", "leave", F.col("depth").cast("int").alias("depth"))), "tour")
    free(found, rows)
    return out


def _placed(df: DataFrame, order: list[str], name: str, number: str = "k") -> tuple[DataFrame, DataFrame]:
    """`df` with each row's number, from 1, in the order of some columns, and the table behind it: rows are dealt to tasks by ranges and numbered as they are written."""
    ranged = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()), name)
    range_ = F.shiftright("at_", 33).alias("range_")  # the task's number stands above the row's
    before = F.sum("count").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1))
    offsets = ranged.groupBy(range_).count().select("range_", F.coalesce(before, F.lit(0)).alias("before_"))  # a row for each range
    within = F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranged.withColumn("range_", range_).join(F.broadcast(offsets), "range_").withColumn(number, F.col("before_") + within).drop("at_", "range_", "before_"), ranged


def _entered(inner: DataFrame, total: int, n_roots: int) -> DataFrame:
    """(k, enter, leave, depth) of the nodes with children (k, first, last): sizes go up the tree, numbers down."""
    spark = inner.sparkSession
    start, end = (F.col("first") * 2 - 1).alias("at"), (F.col("last") * 2 + 1).alias("at")
    ups = scanned(inner.select((F.col("k") * 2).alias("at"), "k", "first", "last").unionByName(inner.select(start, F.col("k").alias("of_")), allowMissingColumns=True), "at", {}, {"up": F.col("of_")}, {})
    below = keep(ups.where("k is not null").select("k", "first", "last", "up"), "tour-below")
    free(ups)
    many = below.where("up is not null").groupBy(F.col("up").alias("k")).agg(F.count("*").alias("open"))
    children = F.col("last") - F.col("first") + 1
    open_ = F.coalesce("open", F.lit(0))
    left = keep(below.join(many, "k", "left").select("k", "up", "first", "last", open_.alias("inner"), open_.alias("open"), (1 + children - open_).alias("size")), "tour-left")
    free(below)
    # Up: what has no open child is taken off, its size goes to its parent.
    kept, layers = [left], []
    while True:
        n, off = left.agg(F.count("*"), F.count_if(F.col("open") == 0)).first()
        if off * LEAVES < n or not n:
            break
        done = left.where("open = 0")
        layers.append(done.select("k", "up", "first", "last", "inner", "size"))
        given = done.where("up is not null").groupBy(F.col("up").alias("k")).agg(F.count("*").alias("n_"), F.sum("size").alias("s_"))
        left = left.where("open > 0").join(given, "k", "left")
        left = keep(left.select("k", "up", "first", "last", "inner", (F.col("open") - F.coalesce("n_", F.lit(0))).alias("open"), (F.col("size") + F.coalesce("s_", F.lit(0))).alias("size")), "tour-left")
        kept.append(left)
    sized = [x.withColumns({"layer": F.lit(i), "depth": F.lit(None).cast("long"), "in_": F.lit(None).cast("long"), "out_": F.lit(None).cast("long")}) for i, x in enumerate(layers)]
    if n:
        rest = _toured(left, n)
        sized.append(rest.withColumn("layer", F.lit(len(layers))))
        kept.append(rest)
    every = sized[0]
    for x in sized[1:]:
        every = every.unionByName(x)
    # A node's place among its siblings: their sizes before it. Sizes of siblings without children are 1, so k counts them.
    families = every.where("inner > 0").select(F.inline(F.array(
        F.struct(start, F.col("first").alias("base"), F.lit(0).cast("long").alias("more")),
        F.struct(end, (-F.col("first")).alias("base"), (children - F.col("size") + 1).alias("more")))))
    top = spark.createDataFrame([(2 * (1 - n_roots) - 1, 1 - n_roots, 0), (1, n_roots - 1, n_roots - total)], "at long, base long, more long")
    own = every.withColumns({"at": F.col("k") * 2, "base": F.lit(0).cast("long"), "more": F.col("size") - 1})
    rows = scanned(own.unionByName(families, allowMissingColumns=True).unionByName(top, allowMissingColumns=True), "at", {"base_": F.col("base"), "more_": F.col("more")}, {}, {})
    step = 1 + F.col("k") - F.col("base_") + F.col("more_") - F.col("more")
    steps = keep(rows.where("k is not null").select("k", "up", "size", "layer", "depth", "in_", "out_", step.alias("step")), "tour-steps")
    free(rows, *kept)
    # Down: a node's number is its parent's and its step; in the tour a running sum along the way gives it.
    kept, found = [steps], []
    if n:
        walk = steps.where(F.col("layer") == len(layers))
        walk = walk.select("k", "size", "depth", F.inline(F.array(F.struct((-F.col("in_")).alias("at"), F.col("step").alias("by")), F.struct((-F.col("out_")).alias("at"), (-F.col("step")).alias("by")))))
        rows = scanned(walk, "at", {"enter": F.col("by")}, {}, {})
        found.append(keep(rows.where("by > 0").select("k", "size", "enter", "depth"), "tour-entered"))
        free(rows)
    for i in reversed(range(len(layers))):
        layer = steps.where(F.col("layer") == i).drop("depth")
        if found:
            above = found[0]
            for x in found[1:]:
                above = above.unionByName(x)
            layer = layer.join(above.select(F.col("k").alias("up"), F.col("enter").alias("enter_"), F.col("depth").alias("depth_")), "up", "left")
        else:
            layer = layer.withColumns({"enter_": F.lit(None).cast("long"), "depth_": F.lit(None).cast("long")})
        found.append(keep(layer.select("k", "size", (F.coalesce("enter_", F.lit(0)) + F.col("step")).alias("enter"), (F.coalesce("depth_", F.lit(-1)) + 1).cast("long").alias("depth")), "tour-entered"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    out = keep(out.select("k", "enter", (F.col("enter") + F.col("size") - 1).alias("leave"), "depth"), "tour-placed")
    free(*kept, *found)
    return out


def _toured(left: DataFrame, n: int) -> DataFrame:
    """The n nodes that are left, with their whole sizes, their depth and the places (from the end) where the tour goes in and out."""
    numbers, sorted_ = _placed(left.drop("open"), ["k"], "tour-rest", "j")
    nodes = keep(numbers, "tour-rest")
    family = keep(nodes.groupBy("up").agg(F.min("j").alias("first_j"), F.max("j").alias("last_j")), "tour-families")
    own = nodes.select("k", "up", "j", "size").join(family.where("up is not null").select(F.col("up").alias("k"), "first_j"), "k", "left")
    own = own.join(nodes.select(F.col("k").alias("up"), F.col("j").alias("up_j")), "up", "left")
    own = own.join(family.select(F.col("up").alias("up_"), "last_j"), F.col("up").eqNullSafe(F.col("up_")))
    # A node's place on the way in is 2j, on the way out 2j + 1; the tour ends at 1, the way out of what is above all roots.
    long = lambda x: F.lit(x).cast("long")
    enter = F.struct((F.col("j") * 2).alias("e"), F.coalesce(F.col("first_j") * 2, F.col("j") * 2 + 1).alias("to"), F.col("size").alias("n"), long(1).alias("d"), long(1).alias("p"))
    leave = F.struct((F.col("j") * 2 + 1).alias("e"), F.when(F.col("j") < F.col("last_j"), F.col("j") * 2 + 2).otherwise(F.coalesce("up_j", F.lit(0)) * 2 + 1).alias("to"), long(0).alias("n"), long(-1).alias("d"), long(1).alias("p"))
    ranked, behind = _ranks(own.select(F.inline(F.array(enter, leave))), n)
    way = lambda out, c: F.max(F.when(F.col("e") % 2 == out, F.col(c)))
    per = ranked.groupBy(F.shiftright("e", 1).alias("j")).agg((way(0, "n") - way(1, "n")).alias("size"), (-way(0, "d")).alias("depth"), way(0, "p").alias("in_"), way(1, "p").alias("out_"))
    out = keep(nodes.drop("size").join(per, "j").select("k", "up", "first", "last", "inner", "size", "depth", "in_", "out_"), "tour-sizes")
    free(sorted_, nodes, family, *behind)
    return out


#: What is summed along the tour: the nodes entered, the depth, the places.
SUMS = ("n", "d", "p")


def _ranks(places: DataFrame, nodes: int) -> tuple[DataFrame, list[DataFrame]]:
    """(e, n, d, p): for each place the sums from it to the end; and the tables behind them."""
    marked = lambda e: (F.pmod(F.xxhash64(e), F.lit(MARKED)) == 0) | (F.col(e) == 1)
    near, behind = _jumped(places.withColumn("done", marked("to")), nodes)
    # The marked places alone: each points to the next.
    far, more = _jumped(near.where(marked("e")).withColumn("done", F.col("to") == 1), nodes)
    ends = far.select(F.col("e").alias("to"), *(F.col(c).alias(f"{c}2") for c in SUMS))
    out = near.join(ends, "to", "left")
    return out.select("e", *((F.col(c) + F.coalesce(f"{c}2", F.lit(0))).alias(c) for c in SUMS)), behind + more


def _jumped(places: DataFrame, nodes: int) -> tuple[DataFrame, list[DataFrame]]:
    """Pointers moved on until all are done, and the tables that hold them; each round they reach twice as far, and only those that move are written."""
    tables = [keep(places, "tour-places")]
    for _ in range(nodes.bit_length() + 3):
        done = tables[0].where("done")
        for t in tables[1:]:
            done = done.unionByName(t.where("done"))
        now = tables[-1].where("not done")
        if now.isEmpty():
            return done, tables
        next_ = done.unionByName(now).select(F.col("e").alias("to"), F.col("to").alias("to2"), *(F.col(c).alias(f"{c}2") for c in SUMS), F.col("done").alias("done2"))
        tables.append(keep(now.join(next_, "to").select("e", F.col("to2").alias("to"), *((F.col(c) + F.col(f"{c}2")).alias(c) for c in SUMS), F.col("done2").alias("done")), "tour-places"))
    raise NotATree("a cycle")


def scanned(rows: DataFrame, order: str, sums: dict[str, Column], lasts: dict[str, Column], ahead: dict[str, Column]) -> DataFrame:
    """`rows` in a total order with running sums, last values that aren't null up to each row, and first ones from each row on.

    Rows are dealt to tasks by ranges of `order`; what a range hands to the next is one row, and there are as many of those as ranges.
    The result reads a kept table: `free` it when it isn't read any more.
    """
    ranged = keep(rows.repartitionByRange(order).withColumn("range_", F.spark_partition_id()).withColumns({f"{n}_v": c for n, c in (sums | lasts | ahead).items()}), "scan-ranges")
    own = ranged.groupBy("range_").agg(
        F.lit(1).alias("one_"), *(F.sum(f"{n}_v").alias(n) for n in sums), *(F.max_by(f"{n}_v", F.when(F.col(f"{n}_v").isNotNull(), F.col(order))).alias(n) for n in lasts),
        *(F.min_by(f"{n}_v", F.when(F.col(f"{n}_v").isNotNull(), F.col(order))).alias(n) for n in ahead))
    before, after = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("range_").rowsBetween(1, Window.unboundedFollowing)
    carried = own.select("range_", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_c") for n in sums), *(F.last(n, True).over(before).alias(f"{n}_c") for n in lasts), *(F.first(n, True).over(after).alias(f"{n}_c") for n in ahead))
    # What lies ahead is read in falling order, where it has been passed: Spark works a frame that ends ahead out anew for each row.
    upto, back = (Window.partitionBy("range_").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc(order), F.desc(order)))
    out = ranged.join(F.broadcast(carried), "range_")
    out = out.withColumns({n: F.sum(f"{n}_v").over(upto) + F.col(f"{n}_c") for n in sums} | {n: F.coalesce(F.last(f"{n}_v", True).over(upto), F.col(f"{n}_c")) for n in lasts} | {n: F.coalesce(F.last(f"{n}_v", True).over(back), F.col(f"{n}_c")) for n in ahead})
    out = out.select(*rows.columns, *sums, *lasts, *ahead)
    out.kept_at = ranged.kept_at
    return out


def first_below(tour: DataFrame, values: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, value): for each node of `asked` (id) the first value in pre-order at it or below it. values: (id, value)."""
    rows = tour.join(values.where("value is not null"), "id", "left").join(asked.select("id", F.lit(True).alias("asked_")).distinct(), "id", "left")
    rows = rows.where("asked_ or value is not null").select("id", "enter", F.when(F.col("asked_"), F.col("leave")).alias("leave"), "value", "asked_")
    seen = scanned(rows, "enter", {}, {}, {"next_": F.when(F.col("value").isNotNull(), F.struct("enter", "value"))})
    return seen.where(F.col("asked_") & (F.col("next_.enter") <= F.col("leave"))).select("id", F.col("next_.value").alias("value"))


def from_depth(tour: DataFrame, values: DataFrame, depth: int) -> DataFrame:
    """(id, value): each node's value of its ancestor at `depth` (or its own there), null above. values: (id, value)."""
    at = tour.where(F.col("depth") == depth).join(values, "id", "left").select("id", "enter", "leave", "value")  # only their values go along
    rows = tour.where(F.col("depth") != depth).select("id", "enter").unionByName(at, allowMissingColumns=True)
    seen = scanned(rows, "enter", {}, {"up_": F.when(F.col("leave").isNotNull(), F.struct("leave", "value"))}, {})
    return seen.select("id", F.when(F.col("enter") <= F.col("up_.leave"), F.col("up_.value")).alias("value"))


def without_stops_above(tour: DataFrame, stops: DataFrame) -> DataFrame:
    """(id, enter, leave, depth) of the nodes that no node of `stops` (id) stands above; the stops themselves stay if none is above them."""
    # A stop opens behind its own number and closes behind its last descendant: a running sum counts those that are open.
    step = lambda at, by: F.struct(at.cast("double").alias("at"), F.lit(by).alias("step"))
    over = tour.where("leave > enter").join(stops.select("id"), "id", "left_semi")
    steps = over.select(F.inline(F.array(step(F.col("enter") + 0.5, 1), step(F.col("leave") + 0.25, -1)))).groupBy("at").agg(F.sum("step").cast("int").alias("step"))
    rows = tour.select(F.col("enter").cast("double").alias("at"), F.lit(0).alias("step"), *tour.columns).unionByName(steps, allowMissingColumns=True)
    seen = scanned(rows, "at", {"open_": F.col("step")}, {}, {})
    return seen.where("id is not null and open_ = 0").select(*tour.columns)
