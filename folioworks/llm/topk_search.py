"""Exact top-k search by inner product, with pivot-table elimination.

Vectors are integers: each component x becomes floor(scale * x). With M the largest norm, a candidate x gets one more
component sqrt(M^2 - |x|^2) and a query q gets 0; their distance d then satisfies q.x = (|q|^2 + M^2 - d^2) / 2. A table
holds each vector's distances to the pivots; max |d(q, p) - d(x, p)| over the pivots is a lower bound of d(q, x), so it
gives an upper bound of the score. Candidates are scored in the order of their bounds until the next bound is below
the query's k-th best score so far.

Candidates form cells by their nearest pivot (a crowded pivot's by the second nearest too), and cells are dealt over
blocks of about `block_rows`; so do queries. Each query starts from its k-th best score in a bounded sample. A cell or
block knows its least and greatest distance to each pivot, which bounds all distances between two of them. Pairs of
cells (at most the fourth power of the pivots' number, numbers only) that can't reach the least of their queries'
scores never become pairs of blocks, and pairs of blocks that can't are gone before any vector is shuffled. Each
other pair is one row of a join: memory is two blocks, and every task's share is alike.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as
padded with zeros; ties go to the smaller id; fewer than k candidates give fewer rows; a query never meets rows with
its own id; of query rows with one id the one with the least vector is answered; candidate rows with one id count each; scores beyond 64 bits are held at their limits. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.llm.common import free, keep, some_rows


def integer_vectors(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    good = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(F.col(id_col).isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def _matrix(lists, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer inner products of the rows of x and one vector q."""
    largest = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(len(q), 1)
    if largest < 2**53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if largest < 2**63:
        return x @ q
    exact = x.astype(object) @ q.astype(object)
    return np.array([max(-(2**63), min(2**63 - 1, int(s))) for s in exact], np.int64)


class Pivots:
    """Pivots in the space with one more component, and distances to them."""

    def __init__(self, sample: np.ndarray, most: float, n: int):
        self.most = most
        points = self.lift(sample)
        chosen, far = [], np.full(len(points), np.inf)
        for _ in range(min(n, len(points))):
            i = int(far.argmax())
            chosen.append(i)
            far = np.minimum(far, np.sqrt(((points - points[i]) ** 2).sum(axis=1)))
        self.at = points[chosen] if chosen else np.zeros((1, points.shape[1]))

    def lift(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.column_stack([x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0))])

    def distances(self, points: np.ndarray) -> np.ndarray:
        square = (points**2).sum(axis=1)[:, None] + (self.at**2).sum(axis=1) - 2 * points @ self.at.T
        return np.sqrt(np.maximum(square, 0))


def top_of_block(q: np.ndarray, q_id: int, near: np.ndarray, q_near: np.ndarray, x: np.ndarray, ids: np.ndarray, most: float, floor: float, k: int,
                 step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of one query's best k in a block. near, q_near: distances to the pivots; floor: only scores of at least this matter."""
    bound = np.abs(near - q_near).max(axis=1)
    square = float((q.astype(float) ** 2).sum())
    # Distances carry rounding errors; the bound is widened by far more than those.
    upper = (square + most - np.maximum(bound - 1e-6 * (1 + np.sqrt(square + most)), 0) ** 2) / 2 + 1
    order = np.argsort(-upper, kind="stable")
    best_i, best_s = np.empty(0, np.int64), np.empty(0, np.int64)
    for a in range(0, len(order), step):
        least = max(floor, float(best_s[-1])) if len(best_s) == k else floor
        own = order[a : a + step]
        if upper[own[0]] < least:
            break
        own = own[ids[own] != q_id]
        s = np.concatenate([best_s, products(x[own], q)])
        i = np.concatenate([best_i, ids[own]])
        use = np.lexsort((i, -s.astype(float)) if np.abs(s).max(initial=0) < 2**53 else (i, ~s))[:k]
        best_i, best_s = i[use], s[use]
    return best_i, best_s


def _blocks(pivots: Pivots, dim: int, query: bool, sample: tuple[np.ndarray, np.ndarray] | None, k: int):
    """A block's row: its vectors, and what bounds it: lo, hi by pivot, the least of its queries' scores so far (floor), its longest query (square)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        v = _matrix(rows["v"].tolist(), dim)
        points = np.column_stack([v.astype(float), np.zeros(len(v))]) if query else pivots.lift(v)
        ids, near = rows["id"].to_numpy(np.int64), pivots.distances(points)
        least = np.full(len(v), -np.inf)
        if query:
            for i in range(len(v)):
                s = products(sample[1], v[i])[sample[0] != ids[i]]
                if len(s) >= k:
                    least[i] = np.partition(s, len(s) - k)[len(s) - k]
        square = float((v.astype(float) ** 2).sum(axis=1).max())
        return pd.DataFrame({"block": rows["block"].iloc[:1], "cell": rows["cell"].iloc[:1], "ids": [ids.tobytes()], "m": [v.tobytes()], "near": [near.tobytes()], "least": [least.tobytes()],
                             "lo": [near.min(axis=0)], "hi": [near.max(axis=0)], "floor": [least.min()], "square": [square]})

    return run


def _cell_bounds(blocks: DataFrame, n_pivots: int) -> pd.DataFrame:
    """A row for each cell: what its blocks' rows say of it."""
    each = lambda how, c: F.array(*(how(F.col(c)[i]) for i in range(n_pivots))).alias(c)
    return blocks.groupBy("cell").agg(each(F.min, "lo"), each(F.max, "hi"), F.min("floor").alias("floor"), F.max("square").alias("square")).toPandas()


def _cells_in_reach(x: pd.DataFrame, q: pd.DataFrame, most: float) -> Iterator[tuple[int, int]]:
    """(cell of candidates, cell of queries) where a score may come up to the queries' least (see top_of_block for the slack)."""
    lo, hi = np.array(x["lo"].tolist()), np.array(x["hi"].tolist())
    for cell, q_lo, q_hi, floor, square in q[["cell", "lo", "hi", "floor", "square"]].itertuples(index=False):
        apart = np.maximum(lo - np.asarray(q_hi), np.asarray(q_lo) - hi).max(axis=1)
        near = np.maximum(apart - 1e-6 * (1 + np.sqrt(square + most)), 0)
        for i in np.flatnonzero((square + most - near * near) / 2 + 1 >= floor):
            yield int(x["cell"].iloc[i]), int(cell)


def _meet(pivots: Pivots, dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(pivots.at)
        for batch in batches:
            for r in range(batch.num_rows):
                qi, qm, qn, ql, xi, xm, xn = (batch.column(c)[r].as_buffer() for c in range(7))
                qi, xi, ql = np.frombuffer(qi, np.int64), np.frombuffer(xi, np.int64), np.frombuffer(ql, float)
                qm, xm = np.frombuffer(qm, np.int64).reshape(len(qi), dim), np.frombuffer(xm, np.int64).reshape(len(xi), dim)
                qn, xn = np.frombuffer(qn, float).reshape(-1, n), np.frombuffer(xn, float).reshape(-1, n)
                ids, scores, of = [], [], []
                for i in range(len(qi)):
                    a, b = top_of_block(qm[i], qi[i], xn, qn[i], xm, xi, pivots.most, ql[i], k)
                    ids.append(a)
                    scores.append(b)
                    of.append(np.full(len(a), qi[i]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (of, ids, scores)], ["query_id", "vec_id", "score"])

    return run


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, pivots: int = 24, sample_rows: int = 2048, block_rows: int = 4096,
                query_rows: int = 512, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores among the candidates with another id.

    sample_rows: candidates, chosen by hash of the id, from which the driver picks the pivots and queries take their
    first k-th best score. block_rows, query_rows: rows of a block, about.
    """
    spark = candidates.sparkSession
    x = keep(integer_vectors(candidates, scale, id_col, vector_col), "topk-vectors")
    q = integer_vectors(queries, scale, id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    q = keep(q, "topk-queries")
    square = F.aggregate("v", F.lit(0.0), lambda a, b: a + b.cast("double") * b.cast("double"))
    one = x.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(square).alias("most")).first()
    two = q.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    names = "query_id long, rank int, vec_id long, score long"
    if not one["n"] or not two["n"]:
        return spark.createDataFrame([], names)
    dim = max(one["dim"], two["dim"], 1)
    rows = some_rows(x, sample_rows, "id").collect()
    sample = np.array([r["id"] for r in rows], np.int64), _matrix([r["v"] for r in rows], dim)
    table = Pivots(sample[1], one["most"], pivots)

    n_pivots = len(table.at)

    def nearest(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                v = _matrix(batch.column(1).to_pylist(), dim)
                points = np.column_stack([v.astype(float), np.zeros(len(v))]) if query else table.lift(v)
                order = np.argsort(table.distances(points), axis=1, kind="stable")
                near, second = order[:, 0], order[:, min(1, n_pivots - 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near * n_pivots + second, pa.int32())], ["id", "v", "cell"])

        return run

    kind = "block long, cell int, ids binary, m binary, near binary, least binary, lo array<double>, hi array<double>, floor double, square double"

    def blocks(rows: DataFrame, query: bool, size: int) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
        """Rows in blocks of a cell, a kept table; the first and last block of each cell."""
        placed = keep(rows.mapInArrow(nearest(query), "id long, v array<long>, cell int"), "topk-placed")
        counts = {r["cell"]: r["n"] for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each two pivots
        of_pivot: dict[int, int] = {}
        for c, n in counts.items():
            of_pivot[c // n_pivots] = of_pivot.get(c // n_pivots, 0) + n
        # A pivot's rows that fill no more than a block stay one cell.
        own = {c: c if of_pivot[c // n_pivots] > size else c // n_pivots * n_pivots for c in counts}
        total: dict[int, int] = {}
        for c, n in counts.items():
            total[own[c]] = total.get(own[c], 0) + n
        spans, at = {}, 0
        for c in sorted(total):
            spans[c] = at, at + -(-total[c] // size) - 1
            at = spans[c][1] + 1
        lookup = spark.createDataFrame([(c, own[c], *spans[own[c]]) for c in counts], "cell int, own int, first long, last long")
        block = F.col("first") + F.pmod(F.xxhash64("id"), F.col("last") - F.col("first") + 1)
        out = placed.join(F.broadcast(lookup), "cell").select(block.alias("block"), F.col("own").alias("cell"), "id", "v")
        out = keep(out.groupBy("block").applyInPandas(_blocks(table, dim, query, sample, k), kind), "topk-blocks")
        free(placed)
        return out, spans

    (xs, _), (qs, q_spans) = blocks(x, False, block_rows), blocks(q, True, query_rows)
    free(x, q)
    reach = _cells_in_reach(_cell_bounds(xs, n_pivots), _cell_bounds(qs, n_pivots), one["most"])
    spans = [(x_cell, *q_spans[q_cell]) for x_cell, q_cell in reach]
    spans = F.broadcast(spark.createDataFrame(spans, "cell int, first long, last long"))
    # The bounds of each pair of blocks of such cells, without their vectors (see top_of_block for the slack).
    xb = xs.select(F.col("block").alias("b"), "cell", F.col("lo").alias("xlo"), F.col("hi").alias("xhi")).join(spans, "cell")
    xb = xb.select("b", "xlo", "xhi", F.explode(F.sequence("first", "last")).alias("a"))
    bounds = xb.join(qs.select(F.col("block").alias("a"), "lo", "hi", "floor", "square"), "a")
    apart = F.array_max(F.zip_with(F.zip_with("xlo", "hi", lambda p, r: p - r), F.zip_with("lo", "xhi", lambda p, r: p - r), lambda p, r: F.greatest(p, r)))
    most = F.lit(float(one["most"]))
    near = F.greatest(apart - 1e-6 * (1 + F.sqrt(F.col("square") + most)), F.lit(0.0))
    met = keep(bounds.where((F.col("square") + most - near * near) / 2 + 1 >= F.col("floor")).select("a", "b"), "topk-pairs")
    of_x = xs.select(F.col("block").alias("b"), F.col("ids").alias("xi"), F.col("m").alias("xm"), F.col("near").alias("xn"))
    of_q = qs.select(F.col("block").alias("a"), F.col("ids").alias("qi"), F.col("m").alias("qm"), F.col("near").alias("qn"), "least")
    met = met.join(of_x, "b").join(of_q, "a").select("qi", "qm", "qn", "least", "xi", "xm", "xn").mapInArrow(_meet(table, dim, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return met.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
