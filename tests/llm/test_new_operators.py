from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from folioworks.llm import common, merkle, ranked_search, whitening

DOC = "doc_id long, text string, key_ string, copies int, before string, n int, k1 int, id string"


def documents(spark, data):
    """(id, text) rows with columns that clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 1, None, 2, 3, "y") for i, t in data], DOC)


# Merkle trees --------------------------------------------------------------------------------------------------------

def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_tree(text):
    """The fingerprint by plain loops."""
    paragraphs = []
    if text:
        paragraphs.append(re.findall(r"[^ \n]{1,63}[ \n]?|[ \n]", text[:160]))
    for line in re.findall(r"[^\n]*\n|[^\n]+", text[160:]):
        paragraphs.append(re.findall(r"[^\n]{0,62}?(?:[.!?…] |\n)|[^\n]{1,64}", line))
    assert "".join(x for p in paragraphs for x in p) == text
    sections, own = [], []
    for i, pieces in enumerate(paragraphs):
        own.append((sha("".join(sha(p) + f"{len(p):02d}" for p in pieces)), "".join(sha(p)[:8] + f"{len(p):02d}" for p in pieces)))
        if own[-1][0][-1] in "01" or i == len(paragraphs) - 1:
            sections.append((sha("".join(h for h, _ in own)), ".".join(t for _, t in own)))
            own = []
    return sha("".join(h for h, _ in sections)) + "".join(f"/{h[:16]}:{t}" for h, t in sections)


def plain_likeness(a, b):
    if a[:64] == b[:64]:
        return 1.0
    x, y = ({p for line in f.split("/")[1:] for p in re.findall("[0-9a-f]{10}", line[17:])} for f in (a, b))
    size = lambda ps: sum(int(p[8:]) for p in ps)
    return 2 * size(x & y) / (size(x) + size(y))


def prose(rng, n):
    word = lambda: "".join(rng.choice("aeioubdgkß😀") for _ in range(rng.randrange(1, 9)))
    return "".join(word() + rng.choice((" ", " ", " ", ". ", "\n", "\n\n", "! ")) for _ in range(n))


def some_texts():
    rng = random.Random(4)
    long = prose(rng, 30_000)
    return [None, "", "\n", "a", "a b", "same", "x" * 1000, " " * 500, "\n" * 400, "tab\tand\r\nline", long, long[:100_000] + "new " + long[100_000:], *[prose(rng, rng.randrange(1, 300)) for _ in range(40)], prose(rng, 50) * 3, "/:.0123456789" * 30]


def test_tree_and_likeness_match_plain_loops(spark):
    texts = some_texts()
    pairs = [(a, b) for a in texts[:12] for b in texts[:12]] + list(zip(texts, texts[1:], strict=False))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", merkle.fingerprint("a").alias("x"), merkle.fingerprint(F.col("b")).alias("y"))
    for r in df.select("*", merkle.likeness("x", "y").alias("near")).collect():
        assert r["x"] == plain_tree(r["a"] or "") and abs(r["near"] - plain_likeness(r["x"], r["y"])) < 1e-12
        assert (r["x"] == r["y"]) == ((r["a"] or "") == (r["b"] or ""))


def plain_with_edits(data):
    order = sorted({(i, t or "") for i, t in data}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = {}
    for k, (i, t) in enumerate(order):
        j, u = order[(k + 1) % len(order)]
        third = len(t) // 3
        edited = t[: len(t) - third] + u[:third]
        a, b = plain_tree(t), plain_tree(edited)
        out[i, t] = (i, len(t), sha(edited), a, b, round(plain_likeness(a, b), 9), round(plain_likeness(a, plain_tree(u)), 9), j)
    return sorted((out[i, t or ""] for i, t in data), key=str)


def test_with_edits_matches_plain_loops(spark):
    texts = some_texts()
    data = [(3 * i + 1, t) for i, t in enumerate(texts)] + [(7, texts[2])] * 5 + [(None, "no id"), (10, texts[3])]
    got = merkle.with_edits(documents(spark, data).repartition(7)).withColumns({c: F.round(c, 9) for c in ("near_edited", "near_next")})
    assert rows(got) == plain_with_edits(data)
    assert rows(merkle.with_edits(documents(spark, [(1, "alone by itself")])), "near_next", "next_id") == [(1.0, 1)]
    assert merkle.with_edits(documents(spark, [])).isEmpty()


def test_rows_of_one_id_follow_one_another(spark):
    data = [(5, f"text {i}") for i in range(30)] + [(4, "four"), (6, "six")] + [(5, "text 1")] * 40
    got = merkle.with_edits(documents(spark, data)).collect()
    assert len(got) == len(data) and {r["next_id"] for r in got if r["doc_id"] == 4} == {6} and {r["next_id"] for r in got if r["doc_id"] == 6} == {5}
    assert Counter(r["next_id"] for r in {(r["doc_id"], r["fingerprint"]): r for r in got}.values() if r["doc_id"] == 5) == {5: 29, 4: 1}


def test_edits_locate_what_differs(spark):
    rng = random.Random(9)
    a = prose(rng, 3000)
    b = a[:4000] + "inserted words" + a[4000:9000] + a[9300:]
    df = spark.createDataFrame([(1, a, b), (2, a, a), (3, "", a), (4, a, "")], "k int, a string, b string").select("k", merkle.fingerprint("a").alias("a"), merkle.fingerprint("b").alias("b"))
    got = {}
    for r in merkle.edits(df, "k", "a", "b").collect():
        got.setdefault(r["k"], []).append((r["start"], r["end"]))
    assert set(got) == {1, 4} and sum(y - x for x, y in got[4]) == len(a)
    covered = {i for x, y in got[1] for i in range(x, y)}
    assert set(range(9000, 9300)) - covered <= {i for i in range(9000, 9300) if a[max(0, i - 64) : i + 64].strip()} and len(covered) < 300 + 4 * 64
    assert any(x <= 4000 <= y for x, y in got[1]) and all(min(abs(i - 4000), max(0, 9000 - i, i - 9299)) <= 64 for i in covered)


def test_fingerprints_stay_in_the_jvm(spark):
    plan = merkle.with_edits(documents(spark, [(1, "a"), (2, "b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# Whitening -----------------------------------------------------------------------------------------------------------

def exact_polynomial(m):
    """Faddeev and LeVerrier's recursion in integers."""
    d, k, c = len(m), None, [1]
    a, one = np.array(m, object), np.array([[int(i == j) for j in range(len(m))] for i in range(len(m))], object)
    k = np.zeros((d, d), object)
    for step in range(1, d + 1):
        k = a @ k + c[-1] * one
        c.append(-sum((a @ k)[i, i] for i in range(d)) // step)
    return [(-1) ** i * v for i, v in enumerate(c)]


def scatter(x):
    n, x = len(x), np.array(x, object)
    s = x.sum(axis=0)
    return [[int(n * (x[:, i] * x[:, j]).sum() - s[i] * s[j]) for j in range(x.shape[1])] for i in range(x.shape[1])]


@pytest.mark.parametrize(("d", "n", "most"), [(1, 4, 9), (2, 9, 9), (3, 3, 2), (6, 40, 50), (9, 5, 1000), (7, 30, 2**40)])
def test_characteristic_polynomial_is_exact(spark, d, n, most):
    rng = random.Random(d * n)
    x = [[rng.randrange(-most, most) for _ in range(d)] for _ in range(n)]
    m = scatter(x)
    assert whitening.characteristic(spark, m) == exact_polynomial(m)
    got, s, own = whitening.scatter(spark.createDataFrame([(i, v) for i, v in enumerate(x)], "id int, x array<long>").repartition(3), 5)
    assert (got, s, own) == (n, [sum(c) for c in zip(*x, strict=True)], m)


def test_roots_and_null_spaces():
    m = [[int(v) for v in r] for r in np.diag([7, 7, 7, 4, 1, 0])]
    e = exact_polynomial(m)
    roots, scale = whitening.largest_roots(e, 4)
    assert [(round(r / 2**scale, 12), n) for r, n in roots] == [(7, 3), (4, 1)]
    space = np.array(whitening.null_space(m, roots[0][0], scale, 3))
    assert np.allclose(space @ space.T, np.eye(3), atol=1e-14) and np.abs(space[:, 3:]).max() < 1e-14
    assert whitening.largest_roots(exact_polynomial([[0, 0], [0, 0]]), 3) == ([], 0)
    # Two eigenvalues that doubles can't tell apart.
    near = [[10**20, 0, 1], [0, 10**20, 0], [1, 0, 10**20]]
    roots, scale = whitening.largest_roots(exact_polynomial(near), 3)
    assert [n for _, n in roots] == [1, 1, 1] and [round((r - (10**20 << scale)) / 2**scale, 6) for r, _ in roots] == [1, 0, -1]
    v = np.array([whitening.null_space(near, r, scale, 1)[0] for r, _ in roots])
    assert np.allclose(np.abs(v), [[0.5**0.5, 0, 0.5**0.5], [0, 1, 0], [0.5**0.5, 0, 0.5**0.5]], atol=1e-15)


def vectors(spark, data):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in data], "vec_id long, embedding array<float>, n int, w int, x string")


def check_whitening(data, got, count=8):
    good = [(i, v) for i, v in data if v and all(c is not None and math.isfinite(c) for c in v)]
    size = Counter(len(v) for _, v in good).most_common(1)[0][0]
    good = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in good if len(v) == size]
    n, x = len(good), np.array([v for _, v in good], object)
    s = x.sum(axis=0)
    y = n * x - s
    e, axes = np.linalg.eigh((y.T @ y).astype(float) / float(n) ** 3)
    e, axes = e[::-1], axes[:, ::-1]
    k = min(count, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == n * k and {r["component"] for r in got} == set(range(1, k + 1))
    want_deviation = Counter((i, sum(int(c) ** 2 for c in row)) for (i, _), row in zip(good, y, strict=True))
    assert Counter((r["vec_id"], int(r["exact_deviation"])) for r in got if r["component"] == 1) == want_deviation
    assert all(r["n"] == n and r["identity_error"] < 1e-9 and (r["deviation"] == int(r["exact_deviation"]) or r["deviation"] is None and int(r["exact_deviation"]) >= 2**63) for r in got)
    for c in range(k):
        own = {(r["vec_id"], r["exact_deviation"]): r for r in got if r["component"] == c + 1}
        assert abs(next(iter(own.values()))["explained"] - e[c] / e.sum()) <= 1e-9
        w = (y.astype(float) / n) @ axes[:, c] / math.sqrt(e[c])
        mine = np.array([own[i, str(sum(int(v) ** 2 for v in row))]["whitened"] for (i, _), row in zip(good, y, strict=True)])
        assert min(np.abs(mine - w).max(), np.abs(mine + w).max()) < 1e-6


def test_whitening_matches_a_direct_decomposition(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(c) for c in rng.normal(size=12) * np.arange(1, 13)]) for i in range(150)]
    odd = [(500, None), (501, []), (502, [1.0, None] * 6), (503, [float("nan")] * 12), (504, [float("inf")] + [0.0] * 11), (505, [1.0]), (None, data[0][1]), (3, data[3][1]), (506, [1e30] + [0.0] * 11)]
    got = whitening.whiten(vectors(spark, data + odd).repartition(5)).collect()
    check_whitening([r for r in data + odd if r[0] != 506], got)


def test_whitening_of_large_low_rank_and_lone_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(2, 6))
    low = [(i, [float(c) for c in rng.integers(-9, 9, 2) @ base.round(1) * 64]) for i in range(60)]
    check_whitening(low, whitening.whiten(vectors(spark, low), 2).collect(), 2)
    large = [(i, [float(c) for c in rng.normal(size=3) * 2.0**30]) for i in range(40)]
    check_whitening(large, whitening.whiten(vectors(spark, large)).collect())
    for few in ([], [(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(5)], [(1, None)]):
        got = whitening.whiten(vectors(spark, few))
        assert got.isEmpty() and got.columns[:4] == ["vec_id", "component", "n", "deviation"]


def test_squares_are_exact():
    rng = random.Random(1)
    for most in (10, 2**30, 2**40, 2**44, 2**60):
        y = np.array([[rng.randrange(-most, most) for _ in range(7)] for _ in range(20)], np.int64)
        assert whitening.squares(y) == [sum(int(v) ** 2 for v in r) for r in y]


# Ranked search -------------------------------------------------------------------------------------------------------

def plain_search(docs, items, k=10):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own = [(i, Counter(term(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    of: dict = {}
    for i, t in items:
        of.setdefault(i, set()).update(term(t))
    out = []
    for item, ts in of.items():
        scored = []
        for i, c in own:
            m = 100 - 90 + (90 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def search_data(seed, docs=400):
    rng = random.Random(seed)
    word = lambda: rng.choice(("Été", "ß", "x", "A1")) if rng.random() < 0.1 else f"w{int(rng.paretovariate(0.7)) % 500}"
    line = lambda n: rng.choice((" ", ", ", "\x00", "\x7f")).join(word() for _ in range(n))
    data = [(i, line(rng.randrange(0, 60))) for i in range(docs)] + [(1000, None), (1001, ""), (1002, "..."), (1003, line(30_000)), (None, line(20)), (None, line(20)), (5, line(9))]
    copy = line(25)
    data += [(2000 + i, copy) for i in range(200)] + [(2000, copy)] * 3
    items = [(i, line(rng.randrange(1, 12))) for i in range(30)] + [(40, copy), (41, None), (42, ""), (43, "nowhere zzz"), (None, "w1 w2"), (44, line(300)), (3, "w7 w8"), (44, "w1")]
    return data, items


@pytest.mark.parametrize(("seed", "options"), [(1, {}), (2, {"seed_rows": 8, "bucket_rows": 16}), (3, {"slice_bytes": 300, "bucket_entries": 50, "k": 3})])
def test_ranked_search_matches_a_plain_one(spark, seed, options):
    data, items = search_data(seed)
    table = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    got = ranked_search.ranked_search(documents(spark, data).repartition(6), table, **options)
    assert rows(got) == plain_search(data, items, options.get("k", 10))


def test_ranked_search_of_nothing(spark):
    data, items = search_data(4, 5)
    table = spark.createDataFrame(items, "item_id long, text string")
    assert ranked_search.ranked_search(documents(spark, []), table).isEmpty()
    assert ranked_search.ranked_search(documents(spark, [(1, None)]), table).isEmpty()
    assert ranked_search.ranked_search(documents(spark, data), table.limit(0)).isEmpty()


def test_buckets_pass_over_what_is_out_of_reach():
    """With high floors only what can reach them is scored, and a floor that is met exactly still counts."""
    rng = np.random.default_rng(0)
    docs = [(i, 9, np.sort(rng.choice(50, 6, replace=False)).astype(np.int32), rng.integers(1, 1000, 6)) for i in range(300)]
    longest = max(math.sqrt(float((r[3] ** 2).sum())) for r in docs)
    items = [np.sort(rng.choice(50, 5, replace=False)).astype(np.int32) for _ in range(20)]
    query = np.concatenate(items), np.concatenate([[0], np.cumsum([len(x) for x in items])])
    scores = [[sum(int(u) for t, u in zip(r[2], r[3], strict=True) if t in x) for r in docs] for x in items]
    floors = np.array([max(s) for s in scores])
    best = ranked_search.Best(floors, 4)
    ranked_search.Bucket(docs, longest, 50).meet(query, best)
    for own, ids, s in zip(scores, best.ids, best.scores, strict=True):
        assert list(ids) == [i for i, x in enumerate(own) if x == max(own)] and set(s) == {max(own)}
    above = ranked_search.Best(floors + 1, 4)
    ranked_search.Bucket(docs, longest, 50).meet(query, above)
    assert not any(map(len, above.ids))


# Queries -------------------------------------------------------------------------------------------------------------

def test_queries_on_the_small_tables(spark, sf):
    from folioworks.llm import queries

    docs = [tuple(r) for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in common.table(spark, sf, "benchmark").select("item_id", "text").collect()]
    assert rows(queries.op13_ranked_search(spark, sf)) == plain_search(docs, items)
    got = queries.op11_merkle_fingerprint(spark, sf).withColumns({c: F.round(c, 9) for c in ("near_edited", "near_next")})
    assert rows(got) == plain_with_edits(docs)
    check_whitening([tuple(r) for r in common.table(spark, sf, "embeddings").select("vec_id", "embedding").collect()], queries.op12_embedding_whitening(spark, sf).collect())
