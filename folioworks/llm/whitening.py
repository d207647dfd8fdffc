"""Embedding whitening by the exact characteristic polynomial of the vectors' integer scatter.

Each component c becomes the whole number x = floor(scale * c) + shift. With n vectors and sums S, the scatter
M = n * sum(x x') - S S' is an integer matrix, n^2 times the covariance. From it

* its characteristic polynomial, exactly: modulo many primes below 2^31 it is reduced to Hessenberg form, which gives
  the polynomial modulo the prime; Chinese remainders join the coefficients, which Maclaurin's inequality bounds;
* its largest eigenvalues: all roots are real, so the sign variations of the polynomial moved by a count its roots
  beyond a exactly (Descartes, Budan); intervals are halved until each holds one root, or several that agree to `BITS` bits, and
  then until they are 2^-`BITS` of the trace wide;
* its components: inverse iteration on M less the root, in fixed-point numbers of so many bits, finds the null space; roots
  that stand for several get as many orthogonal vectors. Each has its largest entry positive.

Sums over vectors are exact and made in tasks (matrix products whose every number fits a double, in limbs if needed);
primes and roots are dealt to tasks too. The driver sees d * d sums, a polynomial for each prime and `components`
vectors, all bounded by the dimension d alone.

Defined cases: vectors that are null or hold null, non-finite components or ones whose x leaves 52 bits take no part,
nor do vectors of another length than the most frequent one (the longer, if two are as frequent); empty vectors take no
part; rows count each, also with one id or none; components without variance don't exist, so there are at most as
many as the rank; a lone or constant vector and an empty table give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm.common import free, keep

#: Bits of roots and of fixed-point numbers; bits of a limb, whose products stay exact in doubles; vectors of one matrix product.
BITS, LIMB, ROWS = 256, 18, 1 << 16


def integer_vectors(vectors: DataFrame, scale: int, shift: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, x) of the rows that take part."""
    v = F.col(vector_col)
    near = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < float(2**52)))
    good = vectors.where(F.coalesce(near, F.lit(False)) & (F.size(v) > 0)).select(F.col(id_col).alias("id"), v.alias("v"))
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    good = good.where(F.size("v") == F.lit(sizes["d"] if sizes else 0))
    return good.select("id", F.transform("v", lambda c: F.floor(c.cast("double") * scale).cast("long") + shift).alias("x"))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """x as sum of limbs[i] * 2^(LIMB i): all but the last within [0, 2^LIMB), the last within +-2^LIMB."""
    out = []
    while np.abs(x).max(initial=0) >= 1 << LIMB:
        out.append((x & ((1 << LIMB) - 1)).astype(float))
        x = x >> LIMB
    return [*out, x.astype(float)]


def products(x: np.ndarray) -> np.ndarray:
    """x'x in exact integers, as objects."""
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for a in range(0, len(x), ROWS):
        limbs = _limbs(x[a : a + ROWS])
        for i, p in enumerate(limbs):
            for j, q in enumerate(limbs):
                out += (p.T @ q).astype(np.int64).astype(object) << LIMB * (i + j)  # each below 2^(2 LIMB) * ROWS, within 53 bits
    return out


def _sums(shift: int):
    """Sums of x - shift and of its products, each as high * 2^60 + low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = second = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0)) - shift
                s, p = x.astype(object).sum(axis=0) if np.abs(x).max() > 2**40 else x.sum(axis=0).astype(object), products(x)
                first, second = (s, p) if first is None else (first + s, second + p)
        if first is not None:
            d = len(first)
            i, j = np.triu_indices(d)
            values = [*first.tolist(), *second[i, j].tolist()]
            where = [pa.array(np.concatenate([np.full(d, -1), i]), pa.int32()), pa.array(np.concatenate([np.arange(d), j]), pa.int32())]
            yield pa.RecordBatch.from_arrays([*where, *(pa.array(v, pa.decimal128(38, 0)) for v in ([v >> 60 for v in values], [v & (2**60 - 1) for v in values]))], ["i", "j", "high", "low"])

    return run


def scatter(x: DataFrame, shift: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, M) of the vectors x."""
    n = x.count()
    each = x.select("x").mapInArrow(_sums(shift), "i int, j int, high decimal(38,0), low decimal(38,0)")
    rows = each.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()  # d * (d + 3) / 2
    d = sum(r["i"] == -1 for r in rows)
    s, m = [0] * d, [[0] * d for _ in range(d)]
    for r in rows:
        value = (int(r["high"]) << 60) + int(r["low"])
        if r["i"] < 0:
            s[r["j"]] = value
        else:
            m[r["i"]][r["j"]] = m[r["j"]][r["i"]] = value
    # The scatter doesn't change when all vectors move, so it is taken of x - shift.
    return n, [v + shift * n for v in s], [[n * m[i][j] - s[i] * s[j] for j in range(d)] for i in range(d)]


def primes(bits: int) -> list[int]:
    """The largest primes below 2^31, until their product has over so many bits."""
    out, p, size = [], 2**31 - 1, 0
    while size <= bits:
        if all(pow(a, p - 1, p) == 1 for a in (2, 3, 5, 7)) and _strong(p):
            out.append(p)
            size += 30
        p -= 2
    return out


def _strong(p: int) -> bool:
    """Whether an odd number below 3,215,031,751 is prime (Miller-Rabin with bases 2, 3, 5, 7)."""
    odd, twos = p - 1, 0
    while not odd % 2:
        odd, twos = odd // 2, twos + 1
    for a in (2, 3, 5, 7):
        y = pow(a, odd, p)
        if y not in (1, p - 1) and all((y := y * y % p) != p - 1 for _ in range(twos - 1)):
            return False
    return True


def _inverse(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """1 / a modulo p by Fermat's theorem; 0 for 0."""
    out, e = np.ones_like(a), p - 2
    while e.any():
        out = np.where(e & 1, out * a % p, out)
        a, e = a * a % p, e >> 1
    return out


def polynomials(limbs: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The characteristic polynomial of sum limbs[i] * 2^(30 i) modulo each prime of p: coefficients from the constant up.

    Similarity steps bring the matrix to Hessenberg form, one column for all primes at a time; its leading minors'
    polynomials follow from one another.
    """
    k, d = len(p), limbs.shape[1]
    p1, p2, p3 = p[:, None], p[:, None, None], np.arange(k)
    h = np.zeros((k, d, d), np.int64)
    for limb in limbs[::-1]:
        h = (h * (2**30 % p2) + limb) % p2
    for j in range(d - 2):
        pivot = j + 1 + (h[:, j + 1 :, j] != 0).argmax(axis=1)
        for axis in (1, 2):
            view = h if axis == 1 else h.transpose(0, 2, 1)
            one, two = view[p3, pivot].copy(), view[:, j + 1].copy()
            view[p3, pivot], view[:, j + 1] = two, one
        u = h[:, j + 2 :, j] * _inverse(h[:, j + 1, j], p)[:, None] % p1
        h[:, j + 2 :, j:] = (h[:, j + 2 :, j:] - u[:, :, None] * h[:, j + 1, None, j:] % p2) % p2
        h[:, :, j + 1] = (h[:, :, j + 1] + (h[:, :, j + 2 :] * u[:, None, :] % p2).sum(axis=2)) % p1
    out = np.zeros((k, d + 1, d + 1), np.int64)
    out[:, 0, 0] = 1
    for m in range(1, d + 1):
        # c[i]: the entry above the diagonal in row i of column m - 1, times the subdiagonal between.
        c, run = np.zeros((k, m), np.int64), np.ones(k, np.int64)
        for i in range(m - 1, -1, -1):
            c[:, i] = h[:, i, m - 1] * run % p
            run = run * (h[:, i, i - 1] if i else 0) % p
        out[:, m, 1:] = out[:, m - 1, :-1]
        out[:, m] = (out[:, m] - (c[:, :, None] * out[:, :m] % p2).sum(axis=1)) % p1
    return out[:, d]


def _modular(limbs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (4 << 20) // limbs.shape[1] ** 2)
        for batch in batches:
            p = batch.column(0).to_numpy()
            for a in range(0, len(p), step):
                part = polynomials(limbs, p[a : a + step])
                yield pa.RecordBatch.from_arrays([pa.array(p[a : a + step]), pa.array(part.tolist(), pa.list_(pa.int64()))], ["p", "c"])

    return run


def characteristic(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """e with det(y - M) = sum (-1)^k e[k] y^(d - k), exactly, for a symmetric M without negative eigenvalues."""
    d, trace = len(m), sum(m[i][i] for i in range(len(m)))
    most = max(comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))  # e[k] is greatest when all eigenvalues are equal
    wanted = primes(most.bit_length() + 31)
    width = max((abs(v).bit_length() for row in m for v in row), default=1)
    limbs = np.array([[[(abs(v) >> 30 * i & (2**30 - 1)) * (1 if v >= 0 else -1) for v in row] for row in m] for i in range(width // 30 + 1)], np.int64)
    tasks = max(1, min(len(wanted), 2 * spark.sparkContext.defaultParallelism))
    dealt = spark.createDataFrame([(p,) for p in wanted], "p long").repartition(tasks, "p")
    rows = dealt.mapInArrow(_modular(limbs), "p long, c array<long>").collect()  # d + 1 numbers for each prime
    whole = 1
    for p in wanted:
        whole *= p
    total = [0] * (d + 1)
    for r in rows:
        other = whole // r["p"]
        basis = other * pow(other % r["p"], -1, r["p"])
        total = [t + basis * c for t, c in zip(total, r["c"], strict=True)]
    e = [(t if not k % 2 else -t) % whole for k, t in enumerate(reversed(total))]
    if e[0] != 1 or e[1] != trace or max(e) > most:
        raise ArithmeticError("the characteristic polynomial doesn't fit its matrix")
    return e


def variations(c: list[int], a: int) -> int:
    """The roots beyond a of a polynomial whose roots are all real, coefficients from the highest: sign changes of c moved by a."""
    c = list(c)
    for stop in range(len(c), 1, -1):  # Taylor's shift by repeated division
        for i in range(1, stop):
            c[i] += a * c[i - 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(e: list[int], count: int) -> tuple[list[tuple[int, int]], int]:
    """([(root, how many), ...], scale): the `count` largest positive roots, falling, as whole numbers times 2^-scale; roots that can't be told apart come as one."""
    d = len(e) - 1
    rank = max(k for k in range(d + 1) if e[k])
    c = [(-1) ** k * e[k] for k in range(rank + 1)]  # the roots that are 0 go
    if not rank:
        return [], 0
    scale = max(0, BITS - e[1].bit_length())
    c = [v << scale * k for k, v in enumerate(c)]
    low, high, out = 0, e[1] << scale, []
    waiting, need = [(low, high, rank, 0)], min(count, rank)  # (low, high]: roots beyond low, beyond high
    while waiting:
        low, high, more, less = waiting.pop()
        if less >= need or more == less:
            continue
        if high - low <= 1:
            out.append((high, more - less))
        elif more - less == 1:
            out.append((_refined(c, low, high, less), 1))
        else:
            mid = (low + high) // 2
            at = variations(c, mid)
            waiting += [(low, mid, more, at), (mid, high, at, less)]
    return out, scale


def _refined(c: list[int], low: int, high: int, less: int) -> int:
    """The single root in (low, high], rounded up; beyond high the polynomial has `less` roots, so its sign there is known."""
    after = 1 - 2 * (less % 2)
    while high - low > 1:
        mid = (low + high) // 2
        value = 0
        for v in c:
            value = value * mid + v
        if value * after > 0 or not value:
            high = mid
        else:
            low = mid
    return high


def null_space(m: list[list[int]], root: int, scale: int, count: int) -> list[list[float]]:
    """Orthogonal unit vectors of M's eigenspace at root * 2^-scale, by inverse iteration in fixed-point numbers."""
    d = len(m)
    a = np.array([[(v << scale) - (root if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(m)], object)
    order = list(range(d))
    for k in range(d):  # elimination with the largest pivot; factors keep BITS bits
        best = max(range(k, d), key=lambda i: abs(a[i, k]))
        a[[k, best]] = a[[best, k]]
        order[k], order[best] = order[best], order[k]
        a[k, k] = a[k, k] or 1
        for i in range(k + 1, d):
            f = (a[i, k] << BITS) // a[k, k]
            a[i, k + 1 :] = a[i, k + 1 :] - (f * a[k, k + 1 :] >> BITS)
            a[i, k] = f  # the factor, for the right sides

    def solved(b: list[int]) -> list[int]:
        y = [b[i] for i in order]
        for i in range(d):
            y[i] -= sum(int(a[i, k]) * y[k] for k in range(i)) >> BITS
        for i in range(d - 1, -1, -1):
            y[i] = ((y[i] << BITS) - sum(int(a[i, k]) * y[k] for k in range(i + 1, d))) // int(a[i, i])
        return y

    def unit(vectors: list[list[int]]) -> list[list[int]]:
        out: list[list[int]] = []
        for v in vectors:
            for _ in range(2):
                cut = max(0, max(map(abs, v)).bit_length() - 2 * BITS)
                v = [x >> cut for x in v]
                for u in out:
                    part = sum(x * y for x, y in zip(u, v, strict=True))
                    v = [x - (part * y >> 2 * BITS) for x, y in zip(v, u, strict=True)]
                length = isqrt(sum(x * x for x in v)) or 1
                v = [(x << BITS) // length for x in v]
            out.append(v)
        return out

    vectors = unit([[((i * 7919 + k * 104729 + 12345) * 2654435761 % 2**32 - 2**31) << BITS for i in range(d)] for k in range(count)])
    for _ in range(3):
        vectors = unit([solved(v) for v in vectors])
    out = []
    for v in vectors:
        sign = 1 if max(v, key=abs) > 0 else -1
        out.append([sign * float(Fraction(x, 1 << BITS)) for x in v])
    return out


def components(spark: SparkSession, m: list[list[int]], count: int) -> list[tuple[Fraction, list[float]]]:
    """(eigenvalue of M to BITS bits of its trace, unit eigenvector) of the `count` largest, falling."""
    if not any(m[i][i] for i in range(len(m))):
        return []
    roots, scale = largest_roots(characteristic(spark, m), count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, root, several in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                found = null_space(m, int(root), scale, several)
                yield pa.RecordBatch.from_arrays([pa.array([place] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.list_(pa.float64()))], ["place", "i", "v"])

    each = [(i, str(root), several) for i, (root, several) in enumerate(roots)]
    dealt = spark.createDataFrame(each, "place int, root string, several int").repartition(len(each), "place")
    found = sorted((r["place"], r["i"], r["v"]) for r in dealt.mapInArrow(run, "place int, i int, v array<double>").collect())
    return [(Fraction(roots[place][0], 1 << scale), v) for place, _, v in found][:count]


def squares(y: np.ndarray) -> list[int]:
    """The exact sum of squares of each row of whole numbers."""
    most = max(abs(int(y.max())), abs(int(y.min())))
    if most**2 * y.shape[1] < 2**63:
        return (y.astype(np.int64) ** 2).sum(axis=1).tolist()
    if most < 2**45 and y.shape[1] < 2**12:
        high, low = y.astype(np.int64) >> 20, y.astype(np.int64) & (2**20 - 1)
        return [(a << 40) + (b << 21) + c for a, b, c in zip(*(v.sum(axis=1).tolist() for v in (high * high, high * low, low * low)), strict=True)]
    return (y.astype(object) ** 2).sum(axis=1).tolist()


def _projected(n: int, s: list[int], shift: int, axes: np.ndarray):
    """Each vector's exact deviation and its whitened coordinates; axes: a column for each component, over its standard deviation times n."""
    t = [v - n * shift for v in s]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1)) - shift  # n x - S stays the same when all move
            small = int(np.abs(x).max()) * n + max(map(abs, t)) < 2**62
            y = n * x - np.array(t, np.int64) if small else n * x.astype(object) - np.array(t, object)
            far = squares(y)
            w = y.astype(float) @ axes
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v if v < 2**63 else None for v in far], pa.int64()), pa.array(list(map(str, far))), pa.array(w.tolist(), pa.list_(pa.float64()))], ["id", "deviation", "whole", "w"])

    return run


def whiten(vectors: DataFrame, count: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error, exact_deviation): a row for each vector and component.

    deviation: the sum over dimensions of (n x - S)^2, null where it leaves 64 bits; exact_deviation is the same as text.
    identity_error: the largest entry of the whitened vectors' covariance less the identity, by a pass over them all.
    """
    spark = vectors.sparkSession
    id_kind = vectors.schema[id_col].dataType.simpleString()
    names = f"{id_col} {id_kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, exact_deviation string"
    x = keep(integer_vectors(vectors, scale, shift, id_col, vector_col), "white-vectors")
    n, s, m = scatter(x, shift) if not x.isEmpty() else (0, [], [])
    found = components(spark, m, count)
    if not found:
        free(x)
        return spark.createDataFrame([], names)
    trace = sum(m[i][i] for i in range(len(m)))
    # Of variance e / n^2, the whitened coordinate is (n x - S) / n along the axis, over sqrt(e) / n.
    axes = np.array([[c / float(e) ** 0.5 for c in v] for e, v in found]).T
    done = keep(x.mapInArrow(_projected(n, s, shift, axes), f"id {id_kind}, deviation long, whole string, w array<double>"), "white-projected")
    free(x)
    k = len(found)
    w = [F.get("w", i) for i in range(k)]
    mean = done.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(w))).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = done.agg(*(F.avg((w[i] - mean[i]) * (w[j] - mean[j])).alias(f"c{i}_{j}") for i, j in pairs)).first()
    error = max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs, strict=True))
    share = F.array(*(F.lit(float(e / trace)) for e, _ in found))
    each = done.select("id", "deviation", "whole", F.posexplode("w").alias("at", "whitened"))
    return each.select(F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("at")).alias("explained"),
                       F.lit(error).alias("identity_error"), F.col("whole").alias("exact_deviation"))
