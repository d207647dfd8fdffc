"""Near-duplicate vectors by NN-descent.

Equal vectors of a label form a class and are handled once. A first neighbour graph comes from a few orders of the
vectors by the signs of random projections: vectors that lie near in an order meet in a window. NN-descent then refines
it: each vector's neighbours, both ways, meet one another (a crowd of them in parts of bounded size), and each keeps its
`k` nearest. Only pairs of cosine `floor` or more enter lists, so vectors without near ones drop out at once. The
number of orders grows with the largest label, so that a lone pair shares a window in one of them.

A list of k neighbours above the threshold is saturated: there may be more. Lists are enlarged to the whole component
of threshold edges in which a vector lies: the members of a component meet in blocks, in each of which cosines are
taken in double precision, and each member's links are counted; pairs never become rows. In a component of several
blocks, the members within half the threshold's angle of a centre (its core) are all linked with one another by the
triangle inequality, so they don't meet: each gets the core's count, and only blocks of strangers meet all blocks. A
crowd of near copies thus costs one pass over its vectors, whatever its size; of the rest, a vector is copied once for
each block of strangers in its component.

An audit compares a bounded sample with every vector: for each vector of it that has links, the share of them within
its component, and their mean is the recall. While it is too low and grows, more orders are added to the graph.

Lists, windows and parts are bounded, so the graph may miss links: two crowds that link, for one, have all their
lists full of their own. An exact check finds every link between two components (vectors alone included) and joins
them. Large groups form blocks by the nearest of a few pivots, or by component where one fills a block; a block's
least and greatest angles to the pivots bound all its angles to another's, so blocks out of reach don't meet, nor do
blocks within one component, and a vector goes only to blocks that it may reach. Where nothing is out of reach the
check costs the square of a group.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and null labels, link with
nothing; vectors of different lengths never link; a repeated row counts as another vector; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.llm.common import connected_components, free, keep, some_rows

#: Vectors of a component's block, and those of it that are multiplied at once.
BLOCK, STRIP = 2048, 256
#: Members of a component, chosen by hash, whose mean direction is its centre.
CENTRE = 64
#: Vectors of a large group, at most, that its angles are measured from.
PIVOTS = 32


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length, scaled to length 1 in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten(), float).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The runs of rows with equal first `keys` columns in a sorted stream; a run may go over batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_pylist() for i in range(keys)]
        marks = list(zip(*columns, strict=True))
        cuts = [i for i in range(1, len(marks)) if marks[i] != marks[i - 1]]
        if last is not None and marks[0] != last:
            yield pa.concat_tables(held)
            held = []
        last = marks[-1]
        t = pa.Table.from_batches([batch])
        for a, b in zip([0, *cuts], cuts, strict=False):
            yield pa.concat_tables([*held, t.slice(a, b - a)])
            held = []
        held.append(t.slice(cuts[-1] if cuts else 0))
    if held:
        yield pa.concat_tables(held)


def _edges(v: list, u: list, s: list) -> pa.RecordBatch:
    cat = lambda c, t: pa.array(np.concatenate(c) if c else np.empty(0, t), pa.from_numpy_dtype(t))
    return pa.RecordBatch.from_arrays([cat(v, np.dtype("int64")), cat(u, np.dtype("int64")), cat(s, np.dtype("float64"))], ["v", "u", "sim"])


def _near(ids: np.ndarray, x: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's k nearest of the others, of cosine `floor` or more, as (v, u, sim)."""
    g = x @ x.T
    np.fill_diagonal(g, -2)
    k = min(k, len(ids) - 1)
    if k < 1:
        return ids[:0], ids[:0], np.empty(0)
    top = np.argpartition(-g, k - 1, axis=1)[:, :k]
    sim = np.take_along_axis(g, top, axis=1)
    i, j = np.nonzero(sim >= floor)
    return ids[i], ids[top[i, j]], sim[i, j]


def _windows(k: int, floor: float, size: int):
    """Neighbours within windows of a stream sorted by (order, group, key), an eighth shared with the next window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Columns: order, group, id, vector. Windows don't pass an order or group.
        held: pa.Table | None = None
        mark = None

        def work(t: pa.Table) -> pa.RecordBatch:
            a, b, c = _near(np.asarray(t.column(2)), _vectors(t.column(3)), k, floor)
            return _edges([a], [b], [c])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            marks = list(zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True))
            a = 0
            while a < len(marks):
                b = a
                while b < len(marks) and marks[b] == marks[a]:
                    b += 1
                if held is not None and mark != marks[a]:
                    yield work(held)
                    held = None
                mark = marks[a]
                held = t.slice(a, b - a) if held is None else pa.concat_tables([held, t.slice(a, b - a)])
                while held.num_rows > size:
                    yield work(held.slice(0, size))
                    held = held.slice(size - size // 8)
                a = b
        if held is not None:
            yield work(held)

    return run


def _descend(floor: float):
    """Local joins: rows sorted by (v, part) are (v, part, u, u's worst kept cosine, u's vector); the neighbours of v in a part meet one another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, u, s, n = [], [], [], 0
        for t in runs(batches, 2):
            ids, worst, x = np.asarray(t.column(2)), np.asarray(t.column(3)), _vectors(t.column(4))
            g = x @ x.T
            i, j = np.nonzero((g >= floor) & (g > worst[:, None]) & (ids[:, None] != ids[None, :]))
            v.append(ids[i])
            u.append(ids[j])
            s.append(g[i, j])
            n += len(i)
            if n > 50_000:
                yield _edges(v, u, s)
                v, u, s, n = [], [], [], 0
        yield _edges(v, u, s)

    return run


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    best = edges.groupBy("v", "u").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _first_graph(base: DataFrame, orders: range, bits: int, k: int, floor: float, window: int) -> DataFrame:
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_size: dict[int, list[int]] = {}
            for i, n in enumerate(np.asarray(pa.compute.list_value_length(batch.column(2)))):
                by_size.setdefault(int(n), []).append(i)
            for n, own in by_size.items():
                part = batch.take(pa.array(own))
                x = _vectors(part.column(2))
                for o in orders:
                    w = np.random.default_rng(1000 + o).normal(size=(n, bits))
                    signs = ((x @ w) > 0) @ (1 << np.arange(bits)[::-1])
                    yield pa.RecordBatch.from_arrays([pa.array([o] * len(own), pa.int32()), part.column(0), pa.array(signs, pa.int64()), part.column(1), part.column(2)], ["o", "g", "key", "id", "x"])

    keyed = base.select("g", "id", "x").mapInArrow(key, f"o int, g string, key long, id long, x {base.schema['x'].dataType.simpleString()}")
    keyed = keyed.withColumn("turn", F.xxhash64("id")).repartitionByRange("o", "g", "key", "turn").sortWithinPartitions("o", "g", "key", "turn")
    return keyed.select("o", "g", "id", "x").mapInArrow(_windows(k, floor, window), "v long, u long, sim double")


def _core(members: DataFrame, threshold: float) -> DataFrame:
    """`members` (component, id, x, ...) with core: within half the threshold's angle of the component's centre.

    Any direction would do as the centre. The rounding of an angle is far below the margin, so core members are linked.
    """
    chosen = members.groupBy("component", F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(CENTRE)).alias("turn")).agg(F.min_by("x", F.xxhash64(F.lit(8), "id")).alias("x"))
    at = chosen.groupBy("component").agg(F.collect_list("x").alias("at"))  # CENTRE vectors at most

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means = [_vectors(column).mean(axis=0) for column in (batch.column(1).slice(i, 1).flatten() for i in range(batch.num_rows))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.tolist() for m in means], pa.list_(pa.float64()))], ["component", "at"])

    at = at.mapInArrow(centre, "component long, at array<double>")
    half = np.arccos(np.clip(threshold, -1, 1)) / 2 - 1e-6
    names = members.columns

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            core = np.zeros(batch.num_rows, bool)
            length = np.asarray(pa.compute.list_value_length(batch.column(names.index("x"))))
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                part = batch.take(pa.array(own))
                x, c = _vectors(part.column(names.index("x"))), np.asarray(part.column(len(names)).flatten(), float).reshape(-1, n)
                size = np.sqrt((c * c).sum(axis=1))
                # A centre without a direction has no core.
                core[own] = (size > 1e-9) & (np.arccos(np.clip((x * c).sum(axis=1) / np.maximum(size, 1e-9), -1, 1)) <= half)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(core)], [*names, "core"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema)
    return members.join(at, "component").select(*members.columns, "at").mapInArrow(near, f"{kind}, core boolean")


def _count_links(base: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """(id, links): for each member of a component, how many other vectors of it reach the threshold, copies counted."""
    members = base.join(parts, F.col("id") == F.col("node")).select("component", "id", "copies", "x")
    size = members.groupBy("component").agg(F.count("*").alias("n"))
    large = keep(size.where(F.col("n") > BLOCK).select("component"), "near-large")
    small = members.join(large, "component", "left_anti").withColumn("core", F.lit(False))
    large_members = keep(_core(members.join(large, "component"), threshold), "near-core")
    # What the members of a core have in one another.
    cores = large_members.where("core").groupBy("component").agg(F.sum("copies").alias("all"))
    linked = large_members.where("core").join(cores, "component").select("id", (F.col("all") - F.col("copies")).alias("links"))

    blocks = large_members.groupBy("component").agg(F.ceil(F.count_if("core") / BLOCK).cast("int").alias("crowd"), F.ceil(F.count_if(~F.col("core")) / BLOCK).cast("int").alias("strangers"))
    dealt = large_members.join(blocks, "component").where("strangers > 0")
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("id"), F.when(F.col("core"), F.col("crowd")).otherwise(F.col("strangers"))).cast("int"))
    # Strangers' blocks are 0, 1, ...; the core's come after them. Each pair of blocks with a stranger's in it meets.
    dealt = dealt.withColumn("mine", F.when(F.col("core"), F.col("strangers") + F.col("mine")).otherwise(F.col("mine")))
    every = F.sequence(F.lit(0), F.col("strangers") - 1)
    others = F.when(F.col("core"), every).otherwise(F.sequence(F.lit(0), F.col("strangers") + F.col("crowd") - 1))
    dealt = dealt.select("component", "mine", "id", "copies", "x", F.explode(others).alias("theirs"))
    whole = small.select("component", F.lit(0).alias("mine"), "id", "copies", "x", F.lit(0).alias("theirs"))
    keyed = whole.union(dealt)
    keyed = keyed.select("component", F.least("mine", "theirs").alias("a"), F.greatest("mine", "theirs").alias("b"), "id", "copies", (F.col("mine") <= F.col("theirs")).alias("first"), "x")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            ids, copies, first, x = np.asarray(t.column(3)), np.asarray(t.column(4)), np.asarray(t.column(5)), _vectors(t.column(6))
            alone = t.column(1)[0].as_py() == t.column(2)[0].as_py()
            mine, theirs = (np.arange(len(ids)),) * 2 if alone else (np.flatnonzero(first), np.flatnonzero(~first))
            links = np.zeros(len(ids), np.int64)
            for a in range(0, len(mine), STRIP):
                own = mine[a : a + STRIP]
                hit = x[own] @ x[theirs].T >= threshold
                if alone:
                    hit[np.arange(len(own)), own] = False
                links[own] += hit @ copies[theirs]
                if not alone:
                    links[theirs] += hit.T @ copies[own]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], ["id", "links"])

    dealt = keyed.repartition("component", "a", "b").sortWithinPartitions("component", "a", "b", "id")
    counted = dealt.select("component", "a", "b", "id", "copies", "first", "x").mapInArrow(count, "id long, links long")
    out = keep(counted.union(linked).groupBy("id").agg(F.sum("links").alias("links")), "near-links")
    free(large, large_members)
    return out


def _pivot_angles(placed: DataFrame) -> DataFrame:
    """`placed` (g, part, pivot, id, c, x) without its pivots' rows, with angles: from each pivot of the group, by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 2):
            t = t.combine_chunks()
            n = pa.compute.sum(t.column("pivot")).as_py()  # sorted first
            x, rest = _vectors(t.column("x")), t.slice(n)
            angles = np.arccos(np.clip(x[n:] @ x[:n].T, -1, 1))
            ends = pa.array(np.arange(len(angles) + 1) * n, pa.int32())
            columns = [*(rest.column(c).combine_chunks() for c in ("g", "id", "c", "x")), pa.ListArray.from_arrays(ends, angles.ravel()), pa.array(angles.argmin(axis=1), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["g", "id", "c", "x", "angles", "near"])

    kind = f"g string, id long, c long, x {placed.schema['x'].dataType.simpleString()}, angles array<double>, near long"
    sorted_ = placed.repartition("g", "part").sortWithinPartitions("g", "part", F.desc("pivot"), "id")
    return sorted_.select("g", "part", F.col("pivot").cast("int").alias("pivot"), "id", "c", "x").mapInArrow(run, kind)


def _blocks_in_reach(named: DataFrame, threshold: float) -> tuple[DataFrame, list[DataFrame]]:
    """(g, a, b, id, c, first, x): each vector once for each pair of blocks a <= b of its group that it may have a link in; first: it is of a. And what to free."""
    large = keep(named.groupBy("g").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n")).where("n > 1"), "near-large")
    one = F.lit("")
    whole = named.join(large, "g", "left_anti").select("g", one.alias("a"), one.alias("b"), "id", "c", F.lit(True).alias("first"), "x")
    rows = named.join(large, "g")
    # A component has one pivot at most, so a crowd doesn't have them all.
    turn = F.pmod(F.xxhash64(F.lit(11), "c"), F.least("n", F.lit(PIVOTS)))
    pivots = rows.groupBy("g", "n", turn.alias("turn")).agg(F.min_by("x", F.xxhash64(F.lit(12), "id")).alias("x"))
    pivots = pivots.select("g", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("part"), F.lit(True).alias("pivot"), F.col("turn").cast("long").alias("id"), F.lit(None).cast("long").alias("c"), "x")
    dealt = rows.select("g", F.pmod(F.xxhash64(F.lit(13), "id"), "n").cast("int").alias("part"), F.lit(False).alias("pivot"), "id", "c", "x")
    placed = keep(_pivot_angles(pivots.union(dealt)), "near-angles")

    crowds = placed.groupBy("c").agg(F.count("*").alias("members")).where(F.col("members") > BLOCK).select("c", F.lit(True).alias("crowd"))
    cells = placed.join(crowds, "c", "left").withColumn("cell", F.when(F.col("crowd"), F.concat(F.lit("c"), "c")).otherwise(F.concat(F.lit("p"), "near")))
    cells = keep(cells.drop("crowd", "near"), "near-cells")
    filled = cells.groupBy("g", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    own = cells.join(filled, ["g", "cell"]).withColumn("block", F.concat_ws(":", "cell", F.pmod(F.xxhash64(F.lit(14), "id"), "n").cast("string")))
    own = keep(own.drop("cell", "n"), "near-blocks")
    each = lambda how: F.array(*(how(F.get("angles", F.lit(i))) for i in range(PIVOTS)))
    bounds = own.groupBy("g", "block").agg(each(F.min).alias("lo"), each(F.max).alias("hi"), F.when(F.min("c") == F.max("c"), F.min("c")).alias("only"))
    bounds = keep(bounds, "near-bounds")

    # Rounding is far below the slack.
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6
    a, b = (bounds.select("g", *(F.col(c).alias(c + side) for c in ("block", "lo", "hi", "only"))) for side in "ab")
    apart = F.array_max(F.zip_with(F.zip_with("loa", "hib", lambda p, q: p - q), F.zip_with("lob", "hia", lambda p, q: p - q), lambda p, q: F.greatest(p, q)))
    met = a.join(b, "g").where((F.col("blocka") <= F.col("blockb")) & (apart <= reach) & ~F.coalesce(F.col("onlya") == F.col("onlyb"), F.lit(False)))
    met = keep(met.select("g", "blocka", "blockb", "loa", "hia", "lob", "hib"), "near-met")
    # A vector of one block meets the other only if the angle to the other's nearest pivot allows.
    sides = []
    for mine, other in ("ab", "ba"):
        pairs = met if mine == "a" else met.where("blocka != blockb")
        pivot = F.array_position(f"hi{other}", F.array_min(f"hi{other}")).cast("int") - 1
        pairs = pairs.select("g", F.col(f"block{mine}").alias("block"), F.col("blocka").alias("a"), F.col("blockb").alias("b"), pivot.alias("p"), F.get(f"lo{other}", pivot).alias("lo"), F.get(f"hi{other}", pivot).alias("hi"))
        at = F.get("angles", F.col("p"))
        near = own.join(pairs, ["g", "block"]).where((at >= F.col("lo") - reach) & (at <= F.col("hi") + reach))
        sides.append(near.select("g", "a", "b", "id", "c", F.lit(mine == "a").alias("first"), "x"))
    return whole.union(sides[0]).union(sides[1]), [large, placed, cells, own, bounds, met]


def _bridges(base: DataFrame, parts: DataFrame, threshold: float) -> DataFrame:
    """(v, u): components to be joined, so that no link is left between two of them; every pair within reach is compared. A kept table."""
    named = base.join(parts, F.col("id") == F.col("node"), "left").select("g", "id", F.coalesce("component", "id").alias("c"), "x")
    named = keep(named, "near-named")
    keyed, kept = _blocks_in_reach(named, threshold)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, 3):
            c, first = np.asarray(t.column(4)), np.asarray(t.column(5))
            alone = t.column(1)[0].as_py() == t.column(2)[0].as_py()
            mine, theirs = (np.arange(len(c)),) * 2 if alone else (np.flatnonzero(first), np.flatnonzero(~first))
            if not len(mine) or not len(theirs) or len(np.unique(c)) < 2:
                continue
            x, v, u = _vectors(t.column(6)), [], []
            for a in range(0, len(mine), STRIP):
                own = mine[a : a + STRIP]
                i, j = np.nonzero((x[own] @ x[theirs].T >= threshold) & (c[own][:, None] != c[theirs]))
                for p, q in np.unique(np.column_stack([c[own][i], c[theirs][j]]), axis=0).tolist():
                    up.setdefault(p, p), up.setdefault(q, q)
                    p, q = root(p), root(q)
                    if p != q:  # a forest: no more pairs than components here
                        up[p] = q
                        v.append(p)
                        u.append(q)
            up.clear()
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(u, pa.int64())], ["v", "u"])

    up: dict[int, int] = {}

    def root(p: int) -> int:
        while up[p] != p:
            up[p] = p = up[up[p]]
        return p

    dealt = keyed.repartition("g", "a", "b").sortWithinPartitions("g", "a", "b", "id")
    out = keep(dealt.mapInArrow(meet, "v long, u long").distinct(), "near-bridges")
    free(named, *kept)
    return out


def _audit(base: DataFrame, parts: DataFrame, sample: int, threshold: float) -> float:
    """The recall: of a sample's vectors that have links, the mean share of links within one component; 1 if none has any."""
    named = base.join(parts, F.col("id") == F.col("node"), "left").select("g", "id", "x", F.coalesce("component", "id").alias("c"))
    rows = some_rows(named, sample, "id", seed=5).collect()
    mine = {}
    for r in rows:
        mine.setdefault(r["g"], []).append(r)
    sets = {g: (np.array([r["id"] for r in own]), np.array([r["c"] for r in own]), _vectors(pa.array([r["x"] for r in own]))) for g, own in mine.items()}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        true = {g: np.zeros(len(own[0]), np.int64) for g, own in sets.items()}
        hit = {g: np.zeros(len(own[0]), np.int64) for g, own in sets.items()}
        for batch in batches:
            groups = np.asarray(batch.column(0).to_pylist(), object)
            for g in set(groups.tolist()) & set(sets):
                part = batch.take(pa.array(np.flatnonzero(groups == g)))
                ids, c, x = sets[g]
                near = (_vectors(part.column(2)) @ x.T >= threshold) & (np.asarray(part.column(1))[:, None] != ids)
                true[g] += near.sum(axis=0)
                hit[g] += (near & (np.asarray(part.column(3))[:, None] == c)).sum(axis=0)
        for g, n in true.items():
            use = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(sets[g][0][use]), pa.array(n[use]), pa.array(hit[g][use])], ["id", "t", "h"])

    each = named.mapInArrow(compare, "id long, t long, h long").groupBy("id").agg((F.sum("h") / F.sum("t")).alias("share"))
    out = each.agg(F.avg("share")).first()[0]
    return 1.0 if out is None else out


def _orders(rows: int, window: int, threshold: float, miss: float = 0.01) -> int:
    """So many orders that a pair of cosine `threshold` misses a shared window of `rows` vectors in all of them with chance `miss`, about."""
    bit = 1 - np.arccos(min(threshold, 1.0)) / np.pi
    share = bit ** max(0.0, np.log2(max(rows, 1) / (window / 2)))
    return int(np.ceil(np.log(miss) / np.log1p(-min(share, 0.99))))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, k: int = 12, floor: float = 0.9, orders: int = 4, bits: int = 24, window: int = 1024,
                    rounds: int = 3, audit: int = 1024, recall: float = 0.97, most_turns: int = 4,
                    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept, recall) for each row; recall: the audit's figure, the same in each row.

    k: a list's length. orders, bits, window: the first graph (orders: at least). rounds: of NN-descent, fewer when a
    round finds next to nothing new. audit: vectors, chosen by hash, that meet all others; below `recall` the graph gets
    as many orders again, up to `most_turns` times, while that helps. The exact check adds what the graph lacks; should
    the result still be below `recall`, a RuntimeError gives the figure.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("x"))
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))) & F.exists("x", lambda v: v != 0)
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(good, F.lit(False))
    rows = rows.withColumn("g", F.when(good, F.concat_ws(":", F.col("label").cast("string"), F.size("x").cast("string"))))
    if dict(rows.dtypes)["x"] != "array<float>":
        rows = rows.withColumn("x", F.col("x").cast("array<double>"))
    rows = keep(rows.withColumn("print", F.xxhash64("g", "x")), "near-rows")
    base = keep(rows.where("g is not null").groupBy("g", "x").agg(F.min("id").cast("long").alias("id"), F.count("*").alias("copies")), "near-classes")

    largest = base.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    orders = max(orders, _orders(largest, window, threshold))
    found, parts, measured = None, None, -1.0
    for start in range(0, most_turns * orders, orders):
        new = _first_graph(base, range(start, start + orders), bits, k, floor, window)
        graph = keep(_nearest(new if found is None else found.select("v", "u", "sim").union(new), k), "near-graph")
        free(found)
        size = graph.count()
        for _ in range(rounds):
            both = graph.select("v", "u").union(graph.select("u", "v")).distinct()
            many = both.groupBy("v").agg(F.ceil(F.count("*") / (4 * k)).cast("int").alias("n_parts"))  # a crowded reverse list meets in parts
            both = both.join(many, "v").withColumn("part", F.pmod(F.xxhash64("v", "u"), F.col("n_parts")).cast("int"))
            worst = graph.groupBy("v").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-1.0)).alias("worst"))
            known = base.select("id", "x").join(worst, F.col("id") == F.col("v"), "left").select("id", "x", F.coalesce("worst", F.lit(-1.0)).alias("worst"))
            dealt = both.join(known, F.col("u") == F.col("id")).select("v", "part", "u", "worst", "x").repartition("v", "part").sortWithinPartitions("v", "part", "u")
            better = dealt.mapInArrow(_descend(floor), "v long, u long, sim double")
            before, graph = graph, keep(_nearest(graph.union(better), k), "near-graph")
            free(before)
            was, size = size, graph.count()
            if size - was <= 0.001 * size:
                break
        found = graph
        free(parts)
        parts = connected_components(graph.where(F.col("sim") >= threshold), "v", "u")
        last, measured = measured, _audit(base, parts, audit, threshold)
        if measured >= recall or measured <= last:
            break
    bridges = _bridges(base, parts, threshold)
    if not bridges.isEmpty():
        # A component bears the name of a member.
        before, parts = parts, connected_components(graph.where(F.col("sim") >= threshold).select("v", "u").union(bridges), "v", "u")
        free(before)
        measured = _audit(base, parts, audit, threshold)
    free(bridges)
    if measured < recall:
        raise RuntimeError(f"the neighbour graph's recall is {measured:.4f} after {start + orders} orders and the exact check; {recall} was asked for")
    links = _count_links(base, parts, threshold)
    named = base.join(parts, F.col("id") == F.col("node"), "left").join(links.withColumnRenamed("id", "id_"), F.col("id") == F.col("id_"), "left")
    named = named.select(F.col("g").alias("g_"), F.col("x").alias("x_"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("c"))
    named = named.withColumn("print_", F.xxhash64("g_", "x_"))
    same = (F.col("print") == F.col("print_")) & (F.col("g") == F.col("g_")) & (F.col("x") == F.col("x_"))
    out = rows.join(named, same, "left")
    component = F.coalesce("c", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), F.lit(float(measured)).alias("recall"))
