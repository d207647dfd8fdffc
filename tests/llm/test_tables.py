from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioworks.llm import common, mixing, ngram_join, nn_descent, packing, quality, tokens, topk_search, url_filter

DOC = "doc_id long, text string, lang string, source string, n_chars long, id string, size long, n long"


def documents(spark, *texts, sources=("a", "b", None)):
    data = [(i, t, "en", sources[i % len(sources)], len(t or ""), None, 7, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, DOC)


def words(rng, n, of=400):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(500, k) for k in range(501, 560)]
    u = Union()
    for a, b in edges:
        u.join(a, b)
    got = dict(rows(common.connected_components(spark.createDataFrame([*edges, (7, None)], "a long, b long"))))
    assert got == {n: u.find(n) for n in {x for e in edges if e[0] != e[1] for x in e}}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


# N-gram join ---------------------------------------------------------------------------------------------------------

def shingle_set(text, n):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def expected_components(texts, n, percent):
    sets, u = [shingle_set(t, n) for t in texts], Union()
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                u.join(i, j)
    return [(i, len(s), u.find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("n, percent, block, passes", [(3, 90, 4096, 1), (5, 80, 3, 3)])
def test_jaccard_matches_brute_force(spark, n, percent, block, passes, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(n)
    texts = [None, "", " \t\n", "one", "One", "one two", "a b c d e f", "É a\u00a0b ÉÉ c", words(rng, 20_000, 9000)]
    for size in (8, 12, 25, 60, 150, 300):
        for _ in range(4):
            base = words(rng, size).split()
            texts.append(" ".join(base))
            for edits in (0, 1, 2, 4, 8):
                copy = base[:]
                for _ in range(edits):
                    copy[rng.randrange(len(copy))] = f"x{rng.randrange(9999)}"
                texts.append(" ".join(copy[: rng.randrange(len(copy) * 9 // 10, len(copy) + 1)]))
    got = rows(ngram_join.jaccard_components(documents(spark, *texts).repartition(5), n, percent, leaders=1 if block == 3 else 2, passes=passes), "doc_id", "n_shingles", "component_id")
    assert sorted(got) == expected_components(texts, n, percent)


def test_keep_first_and_edge_rows(spark):
    text = words(random.Random(1), 50)
    d = documents(spark, text, text, "else", "", "").union(documents(spark, text).withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(r["doc_id"] for r in ngram_join.keep_first(d).collect() if r["doc_id"] is not None) == [0, 2, 3, 4]
    assert ngram_join.jaccard_components(d.limit(0)).isEmpty() and ngram_join.keep_first(d).columns == d.columns


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(0)
    for percent in (80, 90):
        for size in (5, 10, 11, 14, 30, 100, 333, 2000):
            for _ in range(15):
                a = rng.integers(1, 2**63, size, dtype=np.uint64)
                most = int(ngram_join.differences(np.array([size]), percent)[0])
                drop = int(rng.integers(0, most + 1)) // 2
                b = np.concatenate([a[drop:], rng.integers(1, 2**63, drop, dtype=np.uint64)])
                if 100 * (size - drop) < percent * (size + drop) or not drop:
                    continue
                x, y = (set(ngram_join.signatures(np.sort(s), np.zeros(len(s), np.int64), 1, percent)[0].tolist()) for s in (a, b))
                assert x & y, (percent, size, drop)


def test_signatures_of_all_passes_are_the_signatures():
    rng = np.random.default_rng(3)
    s, d = rng.integers(1, 2**63, 900, dtype=np.uint64), np.repeat([0, 1, 2], 300)
    s[300:600] = s[:300]
    s = s[np.lexsort((s, d))]
    whole = set(zip(*map(np.ndarray.tolist, ngram_join.signatures(s, d, 3, 80)), strict=True))
    parts = [set(zip(*map(np.ndarray.tolist, ngram_join.signatures(s, d, 3, 80, None, 4, t)), strict=True)) for t in range(4)]
    assert set().union(*parts) == whole and sum(map(len, parts)) == len(whole) and all(parts)


def test_shared_rows_of_a_sorted_stream():
    import pyarrow as pa

    rng = random.Random(13)
    for _ in range(200):
        data = sorted((rng.randrange(6), rng.randrange(4)) for _ in range(rng.randrange(20)))
        cuts = sorted(rng.randrange(len(data) + 1) for _ in range(3))
        batches = [pa.RecordBatch.from_arrays([pa.array([r[i] for r in data[a:b]], pa.int64()) for i in (0, 1)], ["sig", "f1"]) for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
        got = [tuple(r.values()) for b in ngram_join._shared(iter(batches)) for r in b.to_pylist()]
        assert got == [x for x in sorted(set(data)) if len({f for s, f in data if s == x[0]}) > 1]


def meeting(sets, group, label, side=None):
    """A stream for `_meet` and `_link`, in two batches: the rows' sets, and sketches that tell nothing."""
    n = len(sets)
    side = side or [0] * n
    d = {"key": group, "band": [0] * n, "i": [0] * n, "j": [0] * n, "side": side, "two": [any(side)] * n, "id": list(range(n)), "label": label, "n": [len(s) for s in sets],
         "w": [[0] * ngram_join.LEAST] * n, "set": pa.array([sorted(s) for s in sets], pa.list_(pa.int64()))}
    whole = pa.RecordBatch.from_pydict(d)
    return iter([whole.slice(0, n // 3), whole.slice(n // 3)])


def test_a_family_below_the_limit_makes_fewer_rows_than_it_has_members():
    sets = [set(range(i, i + 70)) for i in range(60)] + [{1, 2}, {3, 4}]
    group = [0] * 60 + [1, 2]
    got = [tuple(r.values()) for b in ngram_join._meet(80)(meeting([range(70)] * 62, group, list(range(62)))) for r in b.to_pylist()]
    assert len(got) == 59  # each of the 1,770 pairs may link; before, each was a row
    u = Union()
    for x, y in got:
        u.join(x, y)
    assert {u.find(x) for x in range(60)} == {0}
    assert not [r for b in ngram_join._link(98)(meeting(sets, group, list(range(62)))) for r in b.to_pylist()]


def test_a_forest_joins_what_the_links_join():
    rng = random.Random(5)
    for case in range(30):
        sets, group, label = [], sorted(rng.randrange(4) for _ in range(50)), [rng.randrange(25) for _ in range(50)]
        for _ in range(50):
            sets.append({x for x in range(40) if rng.random() < 0.93})
        side = [rng.randrange(2) for _ in range(50)] if case % 2 else [0] * 50
        both = lambda u: {(a, b): u.find(("l", label[a], group[a])) == u.find(("l", label[b], group[b])) for a in range(50) for b in range(a) if group[a] == group[b]}
        truth, got = Union(), Union()
        for a in range(50):
            for b in range(a):
                if group[a] == group[b] and label[a] != label[b] and (not any(side) or side[a] != side[b]) and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    truth.join(("l", label[a], group[a]), ("l", label[b], group[b]))
        found = [tuple(r.values()) for x in ngram_join._link(90)(meeting(sets, group, label, side)) for r in x.to_pylist()]
        for a, b in found:
            assert group[a] == group[b] and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])
            got.join(("l", label[a], group[a]), ("l", label[b], group[b]))
        assert both(truth) == both(got) and len(found) < 50


@pytest.mark.parametrize("elements", [1 << 21, 700])
def test_families_about_the_limit_match_brute_force(spark, elements, monkeypatch):
    monkeypatch.setattr(ngram_join, "ELEMENTS", elements)
    rng = random.Random(8)
    texts = []
    for size, edits in ((60, 1), (100, 1), (150, 2), (300, 4)):
        base = words(rng, size).split()
        for k in range(25):
            copy = base[:]
            for _ in range(edits + k % 2):
                copy[rng.randrange(size)] = f"x{rng.randrange(9999)}"
            texts.append(" ".join(copy))
    expected = expected_components(texts, 5, 80)
    assert 5 < len({c for _, _, c in expected}) < 95
    got = rows(ngram_join.jaccard_components(documents(spark, *texts), 5, 80, leaders=1, passes=1), "doc_id", "n_shingles", "component_id")
    assert sorted(got) == expected


# Top-k ---------------------------------------------------------------------------------------------------------------

def vectors(spark, data, label=None):
    return spark.createDataFrame([(i, v, 1 if label is None else label[i], "x") for i, v in enumerate(data)], "vec_id long, embedding array<float>, label int, id string")


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)).astype(np.float32)
    x[50:60] = x[0]
    data = [v.tolist() for v in x] + [None, [float("nan")] * 6, [1.0, None], [1e6] * 6, [2.0], []]
    f = vectors(spark, data)
    got = defaultdict(list)
    for r in topk_search.exact_top_k(f, f.where("vec_id % 20 = 0"), k=7, block_rows=64, query_rows=8, sample_rows=50).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [int(np.floor(1024 * float(c))) for c in v] for i, v in enumerate(data) if v is not None and all(c is not None and np.isfinite(c) for c in v)}
    for q in (i for i in whole if i % 20 == 0):
        s = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=False)), i) for i, v in whole.items() if i != q)[:7]
        assert sorted(got[q]) == [(k + 1, i, -v) for k, (v, i) in enumerate(s)]
    assert set(got) == {i for i in whole if i % 20 == 0}
    assert topk_search.exact_top_k(f.limit(0), f).isEmpty() and topk_search.exact_top_k(f.where("vec_id = 3"), f.where("vec_id = 3")).isEmpty()


def test_topk_with_repeated_ids_and_ties(spark):
    f = vectors(spark, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0], [1.0, 1.0]])
    twice = f.union(spark.createDataFrame([(0, [0.0, 2.0], 1, "x"), (2, [1.0, 1.0], 1, "x"), (None, [5.0, 5.0], 1, "x")], f.schema))
    got = rows(topk_search.exact_top_k(twice, twice.where("vec_id = 0 or vec_id = 2"), k=3), "query_id", "rank", "vec_id", "score")
    one = 1024 * 1024
    # Query 0 is answered by its least vector (0, 2); both rows of id 2 are candidates; ties go to the smaller id.
    assert got == sorted([(0, 1, 1, 2 * one), (0, 2, 2, 2 * one), (0, 3, 2, 2 * one), (2, 1, 0, 2 * one), (2, 2, 3, 2 * one), (2, 3, 0, one)], key=str)


def test_blocks_out_of_reach_are_not_met(spark, monkeypatch):
    """Two far clusters: blocks of the other cluster are gone before vectors are joined, and the result is whole."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.01, (300, 8)) + 1, rng.normal(0, 0.01, (300, 8)) - 1]).astype(np.float32)
    f = vectors(spark, [v.tolist() for v in x])
    kept = {}
    real = topk_search.keep
    monkeypatch.setattr(topk_search, "keep", lambda df, name: kept.setdefault(name, []).append(real(df, name)) or kept[name][-1])
    monkeypatch.setattr(topk_search, "free", lambda *_: None)
    out = topk_search.exact_top_k(f, f.where("vec_id < 40"), k=5, block_rows=50, query_rows=20, sample_rows=200, pivots=4).collect()
    candidates, queries = (t.count() for t in kept["topk-blocks"])
    assert kept["topk-pairs"][0].count() <= 0.6 * candidates * queries
    v = np.floor(1024 * x.astype(float)).astype(np.int64)
    for q in range(40):
        s = v @ v[q]
        want = sorted((-int(s[i]), i) for i in range(len(v)) if i != q)[:5]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q) == [(n + 1, i, -w) for n, (w, i) in enumerate(want)]


def test_cells_out_of_reach_never_become_pairs_of_blocks(spark):
    """What bounds rule out can't hold a score of the floor; two far clusters' cells don't reach one another."""
    rng = np.random.default_rng(12)
    x = np.floor(1024 * np.concatenate([rng.normal(0, 0.2, (200, 8)) + 1, rng.normal(0, 0.2, (200, 8)) - 1])).astype(np.int64)
    most = float((x.astype(float) ** 2).sum(axis=1).max())
    p = topk_search.Pivots(x[::20], most, 6)
    q = x[::10]
    near, q_near = p.distances(p.lift(x)), p.distances(np.column_stack([q.astype(float), np.zeros(len(q))]))
    score = q @ x.T
    floor = np.sort(score, axis=1)[:, -5].astype(float)

    def cells(d, extra):
        cell = d.argmin(axis=1)
        return cell, pd.DataFrame([{"cell": c, "lo": d[cell == c].min(axis=0), "hi": d[cell == c].max(axis=0), **extra(cell == c)} for c in np.unique(cell)])

    x_cell, xs = cells(near, lambda own: {})
    q_cell, qs = cells(q_near, lambda own: {"floor": floor[own].min(), "square": float((q[own].astype(float) ** 2).sum(axis=1).max())})
    reach = set(topk_search._cells_in_reach(xs, qs, most))
    i, j = np.nonzero(score >= floor[:, None])
    assert {(int(x_cell[b]), int(q_cell[a])) for a, b in zip(i, j, strict=True)} <= reach
    assert len(reach) < len(xs) * len(qs)


def test_topk_with_every_row_near_one_pivot(spark):
    """A crowded pivot's rows lie in cells by their second pivot; ties in scores and far rows come out right."""
    rng = np.random.default_rng(13)
    x = np.concatenate([rng.normal(0, 0.01, (500, 5)), rng.normal(0, 3, (20, 5)), np.zeros((30, 5))])
    f = vectors(spark, [v.tolist() for v in x])
    out = topk_search.exact_top_k(f, f.where("vec_id % 10 = 0"), k=6, block_rows=40, query_rows=5, sample_rows=60, pivots=5).collect()
    v = np.floor(1024 * x.astype(np.float32).astype(float)).astype(np.int64)
    for q in range(0, len(x), 10):
        s = v @ v[q]
        want = sorted((-int(s[i]), i) for i in range(len(v)) if i != q)[:6]
        assert sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q) == [(n + 1, i, -w) for n, (w, i) in enumerate(want)]


def test_bounds_stop_early():
    """Near candidates are found without scoring the far ones."""
    rng = np.random.default_rng(2)
    x = np.floor(1024 * np.concatenate([rng.normal(0, 0.01, (50, 8)) + 1, rng.normal(0, 0.01, (4000, 8)) - 1])).astype(np.int64)
    most = float((x.astype(float) ** 2).sum(axis=1).max())
    p = topk_search.Pivots(x[::40], most, 8)
    near = p.distances(p.lift(x))
    q = x[0]
    q_near = p.distances(np.append(q, 0).astype(float)[None])[0]
    scored = []
    real = topk_search.products
    topk_search.products = lambda a, b: scored.append(len(a)) or real(a, b)
    try:
        ids, _ = topk_search.top_of_block(q, 0, near, q_near, x, np.arange(len(x)), most, -np.inf, 5, step=64)
    finally:
        topk_search.products = real
    assert set(ids) < set(range(50)) and sum(scored) <= 128


# Near-duplicate vectors ----------------------------------------------------------------------------------------------

def test_nn_descent_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(260, 16))
    crowd = rng.normal(size=16) + rng.normal(0, 0.02, (90, 16))
    x = np.concatenate([base, base[:40] + rng.normal(0, 0.05, (40, 16)), crowd, np.repeat(base[:1], 5, 0) * 2]).astype(np.float32)
    label = [int(v) if v else None for v in rng.integers(0, 4, len(x))]
    label[300:390] = [1] * 90
    data = [v.tolist() for v in x] + [None, [0.0] * 16, [float("inf")] * 16, [1.0] * 3, [1.0] * 3, []]
    label += [1, 1, 1, 2, 2, 2]
    f = vectors(spark, data, label)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in nn_descent.near_duplicates(f.repartition(4), k=6, orders=3, window=128, recall=1.0, audit=10_000).collect()}
    u, links = Union(), defaultdict(int)
    ok = [i for i, v in enumerate(data) if v and np.isfinite(v).all() and any(v) and label[i] is not None]
    for a in ok:
        for b in ok:
            if a < b and label[a] == label[b] and len(data[a]) == len(data[b]):
                p, q = np.array(data[a], float), np.array(data[b], float)
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= 0.98:
                    u.join(a, b)
                    links[a] += 1
                    links[b] += 1
    # The audit meets every vector here and asks for all links, so nothing may be missing.
    assert not [i for i in range(len(data)) if got[i] != (links[i], u.find(i), u.find(i) == i)]
    assert nn_descent.near_duplicates(f.limit(0)).isEmpty()


def test_links_of_large_components_match_brute_force(spark, monkeypatch):
    """Crowds, chains and mixtures of several blocks; copies count; a crowd that is all core meets nobody."""
    monkeypatch.setattr(nn_descent, "BLOCK", 16)
    rng = np.random.default_rng(14)
    turn = np.arange(60) * 0.05
    crowd = np.array([1.0, 0, 0, 0]) + rng.normal(0, 0.02, (80, 4))
    chain = np.column_stack([np.cos(turn), np.sin(turn), np.zeros(60), np.zeros(60)])
    mixed = np.concatenate([np.array([0, 0, 1.0, 0]) + rng.normal(0, 0.04, (50, 4)), np.array([0, 0, 1.0, 0]) + rng.normal(0, 0.15, (45, 4))])
    no_centre = np.concatenate([np.eye(4), -np.eye(4)]).repeat(5, axis=0) + rng.normal(0, 0.01, (40, 4))
    few = rng.normal(size=(1, 4)) + rng.normal(0, 0.1, (10, 4))
    data = [(c, v.tolist()) for c, x in enumerate((crowd, chain, mixed, no_centre, few)) for v in x]
    copies = rng.integers(1, 4, len(data))
    base = spark.createDataFrame([("g", i, v, int(n)) for i, ((_, v), n) in enumerate(zip(data, copies, strict=True))], "g string, id long, x array<double>, copies long")
    parts = spark.createDataFrame([(i, 1000 + c) for i, (c, _) in enumerate(data)], "node long, component long")
    got = dict(rows(nn_descent._count_links(base, parts, 0.98), "id", "links"))
    x, c = np.array([v for _, v in data]), np.array([c for c, _ in data])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    hit = (x @ x.T >= 0.98) & (c[:, None] == c) & ~np.eye(len(x), dtype=bool)
    assert {i: got.get(i, 0) for i in range(len(x))} == dict(enumerate((hit @ copies).tolist()))

    members = base.join(parts, F.col("id") == F.col("node")).select("component", "id", "copies", "x")
    core = {r["id"] for r in nn_descent._core(members, 0.98).where("core").collect()}
    assert core >= set(range(80)) and hit[np.ix_(range(80), range(80))].sum() == 80 * 79
    for one in range(5):
        own = [i for i in core if c[i] == one]
        assert hit[np.ix_(own, own)].sum() == len(own) * (len(own) - 1)
    assert nn_descent._count_links(base.limit(0), parts, 0.98).isEmpty()


def test_crowds_with_full_lists_are_joined(spark):
    """Two crowds 11 degrees apart: every list is full of the own crowd, so NN-descent alone finds no link between them."""
    rng = np.random.default_rng(21)
    turn = np.radians(np.repeat([0, 11], 60))
    x = np.column_stack([np.cos(turn), np.sin(turn), *np.zeros((6, 120))]) + rng.normal(0, 1e-4, (120, 8))
    got = rows(nn_descent.near_duplicates(vectors(spark, x.tolist(), [1] * 120), k=6, recall=0.4, audit=10), "n_links", "component_id", "recall")
    assert got == [(119, 0, 1.0)] * 120


def test_links_between_components_match_brute_force(spark, monkeypatch):
    """Blocks by pivot, crowds of several blocks, blocks out of reach; from parts that know some links and from none."""
    monkeypatch.setattr(nn_descent, "BLOCK", 16)
    rng = np.random.default_rng(22)
    turn = np.arange(70) * 0.15
    chain = np.column_stack([np.cos(turn), np.sin(turn), np.zeros(70), np.zeros(70)])
    crowds = np.concatenate([v + rng.normal(0, 0.003, (50, 4)) for v in ([0, 0, 1, 0], [0, 0, 1, 0.19], [0, 0, -1, 0])])
    spread = rng.normal(size=(200, 4))
    data = [(g, v.tolist()) for g, x in (("a", np.concatenate([chain, crowds])), ("b", spread), ("c", spread[:9] * 3)) for v in x]
    base = spark.createDataFrame([(g, i, v) for i, (g, v) in enumerate(data)], "g string, id long, x array<double>")
    x, g = np.array([v for _, v in data]), np.array([g for g, _ in data])
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    links = np.argwhere(np.triu((x @ x.T >= 0.98) & (g[:, None] == g), 1)).tolist()
    want = Union()
    for a, b in links:
        want.join(a, b)
    crowd = [(i, 70 + 50 * ((i - 70) // 50)) for i in range(70, 220)]
    for known in (crowd, [(0, 0), (1, 0)], []):
        got, own = Union(), dict(known)
        pairs = rows(nn_descent._bridges(base, spark.createDataFrame(known, "node long, component long"), 0.98), "v", "u")
        for a, b in [*known, *pairs]:
            got.join(a, b)
        assert all(own.get(a, a) == a and own.get(b, b) == b for a, b in pairs)
        assert [got.find(i) for i in range(len(data))] == [want.find(i) for i in range(len(data))]
    named = base.select("g", "id", F.lit(0).cast("long").alias("c"), "x")
    assert nn_descent._blocks_in_reach(named.where("g = 'a'"), 0.98)[0].isEmpty()  # one component: nobody meets
    apart = base.select("g", "id", F.col("id").alias("c"), "x")
    met, n = nn_descent._blocks_in_reach(apart.where("g = 'a'"), 0.98)[0], 220
    assert met.select("a", "b").distinct().count() < len(crowds) and met.count() < n * n / 16
    assert nn_descent._bridges(base.limit(0), spark.createDataFrame([], "node long, component long"), 0.98).isEmpty()


def test_a_low_recall_is_no_result(spark, monkeypatch):
    f = vectors(spark, [[1.0, 0.0], [1.0, 0.001], [0.0, 1.0]])
    monkeypatch.setattr(nn_descent, "_audit", lambda *_: 0.5)
    with pytest.raises(RuntimeError, match="recall is 0.5"):
        nn_descent.near_duplicates(f, rounds=1, most_turns=2)


def test_the_audit_counts_vectors_not_links(spark):
    """A crowd within one component and a lone pair apart: half of the linked vectors' links are there, seen by vector 10 of 12."""
    x = [[1.0, 0.001 * i] for i in range(10)] + [[0.0, 1.0], [0.001, 1.0]]
    base = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "g string, id long, x array<double>")
    parts = spark.createDataFrame([(i, 0) for i in range(10)], "node long, component long")
    assert abs(nn_descent._audit(base, parts, 100, 0.98) - 10 / 12) < 1e-9


def test_doubles_stay_doubles_and_repeated_ids_count(spark):
    tiny = [[1e-300, 1e-305], [1e-300, 0.0], [0.0, 1e-310], None]
    f = spark.createDataFrame([(i, v, 1) for i, v in enumerate(tiny)] + [(0, tiny[0], 1), (None, tiny[0], 1)], "vec_id long, embedding array<double>, label int")
    got = rows(nn_descent.near_duplicates(f), "vec_id", "n_links", "component_id")
    assert got == sorted([(0, 2, 0), (0, 2, 0), (1, 2, 0), (2, 0, 2), (3, 0, 3), (None, 0, None)], key=str)


# Packing -------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\u00a0\u2003'ſst0²½é中🙂_<|endoftext|>aB.,"), st.characters(codec="utf-8")), max_size=60))
def test_pieces_are_the_tokenizer(text):
    import public_tokenizers as P

    p = tokens.pieces()
    assert p.ids(text) == np.array(p.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert P.path("byte_bpe_50k.json")


def test_packing_round_trip(spark, tokenizer):
    rng = random.Random(4)
    texts = [None, "", "é'll <|endoftext|>", "x" * 9000, words(rng, 30_000)] + [words(rng, rng.randrange(1, 900)) for _ in range(120)] + ["a"] * 400
    d = documents(spark, *texts)
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in enumerate(texts)}
    out = packing.pack_documents(d.repartition(3)).collect()
    at, seqs = defaultdict(int), defaultdict(list)
    for r in sorted(out, key=lambda r: (r["doc_id"], r["start"])):
        i, a, n = r["doc_id"], r["start"], r["length"]
        assert a == at[i] and r["doc_tokens"] == len(ids[i]) and r["ids_crc32"] == zlib.crc32(ids[i][a : a + n].tobytes())
        at[i] += n
        seqs[r["sequence_id"]].append((r["offset"], n))
    assert at == {i: len(v) for i, v in ids.items()}
    padding = 0
    for s in seqs.values():
        end = 0
        for offset, n in sorted(s):
            assert offset == end
            end += n
        assert end <= 1024 and len(s) <= 128
        padding += 1024 - end if end & (end - 1) else 0
    assert padding <= 3 * 1024 + 0.01 * sum(at.values())
    assert packing.pack_documents(d.limit(0)).isEmpty()
    none = d.where("doc_id in (2, 4)").withColumn("doc_id", F.lit(None).cast("long"))
    assert sum(r["length"] for r in packing.pack_documents(none).collect()) == len(ids[2]) + len(ids[4])


@pytest.mark.parametrize("least, most", [(1, 1), (3, 3), (1, 5), (2, 40)])
def test_short_documents_are_packed_without_padding(least, most):
    """The segment limit binds: sequences are full or end at a power of two, but for each task's last ones."""
    rng, out = random.Random(least), []
    packer = packing.Packer((1024, 128, 1024), lambda item, take, sequence, offset: out.append((item, take, sequence, offset)), True, 0)
    n = [rng.randrange(least, most + 1) for _ in range(20_000)]
    for i, x in enumerate(n):
        packer.add(i, x, x - 1)
    packer.finish()
    of, seqs, loss = defaultdict(int), defaultdict(int), defaultdict(int)
    for i, take, q, offset in out:
        assert offset == seqs[q]
        of[i], seqs[q], loss[q] = of[i] + take, seqs[q] + take, loss[q] + 1
    assert [of[i] for i in range(len(n))] == n and max(loss.values()) <= 128 and max(seqs.values()) <= 1024
    assert sum(1024 - x for x in seqs.values() if x & (x - 1)) <= 2 * 1024


def test_examples_keep_every_limit(spark):
    rng = random.Random(5)
    data = [(i, rng.randrange(1, 600), 0) for i in range(300)] + [(1000, 5000, 1), (1001, None, None), (1002, 10, 900)]
    data = [(i, n, min(n or 0, rng.randrange(400)) if loss == 0 else loss) for i, n, loss in data]
    f = spark.createDataFrame(data, "conv_id long, n_tokens long, n_loss long")
    out = packing.pack_examples(f.coalesce(1), tokens=1024, segments=4, loss_tokens=700).collect()
    assert sorted(r["conv_id"] for r in out) == sorted(i for i, _, _ in data)
    per, loss = defaultdict(list), {i: x for i, _, x in data}
    for r in out:
        per[r["sequence_id"]].append(r)
    for s in per.values():
        if not s[0]["over"]:
            assert sum(r["length"] for r in s) <= 1024 and len(s) <= 4 and sum(loss[r["conv_id"]] or 0 for r in s) <= 700
        else:
            assert len(s) == 1
    low = max(sum(n or 0 for _, n, _ in data) / 1024, sum(x or 0 for _, _, x in data) / 700, len(data) / 4)
    assert len(per) <= 1.35 * low + 3


def replay(examples, limits, got, window=256):
    """Goes through a packing step by step, by plain loops: each example placed must be, of the waiting ones that fit, one with the largest dot product of demand and what is left; a sequence ends only when none fits or a limit is used up. Gives the limits that ended sequences."""
    turn = iter(sorted(got, key=got.get))
    waiting, place, left, ended = {}, (0, 0), list(limits), set()

    def step():
        nonlocal place, left
        fits = {i: sum(n / m * x / m for n, x, m in zip(need, left, limits, strict=True)) for i, need in waiting.items() if all(n <= x for n, x in zip(need, left, strict=True))}
        if fits:
            i = next(turn)
            assert got[i] == place and fits[i] >= max(fits.values()) - 1e-12
            need = waiting.pop(i)
            place, left = (place[0], place[1] + need[0]), [x - n for n, x in zip(need, left, strict=True)]
        else:
            assert place[1]
            ended.update(k for k in range(3) if all(need[k] > left[k] for need in waiting.values()))
        if not fits or min(left) < 1:
            ended.update(k for k in range(3) if left[k] < 1)
            place, left = (place[0] + 1, 0), list(limits)

    for i, n, loss in examples:
        waiting[i] = (n, 1, loss)
        while len(waiting) >= window:
            step()
    while waiting:
        step()
    assert next(turn, None) is None
    return ended


def test_three_limits_choose_what_comes_next(spark):
    """Every choice is the dot product's, and each of the three limits ends sequences somewhere."""
    ended = set()
    for limits, short in (((1024, 16, 768), 300), ((1024, 4, 700), 200), ((2000, 50, 300), 100)):
        rng = random.Random(short)
        examples = [(i, n, rng.randrange(n + 1)) for i, n in enumerate(rng.randrange(1, short) for _ in range(900))]
        f = spark.createDataFrame(examples, "conv_id long, n_tokens long, n_loss long").coalesce(1)
        got = {r["conv_id"]: (r["sequence_id"], r["offset"]) for r in packing.pack_examples(f, *limits).collect()}
        ended |= replay(examples, limits, got)
    assert ended == {0, 1, 2}


def test_conversations_are_packed_under_three_limits(spark, sf):
    from folioworks.llm import queries

    asked = {r["conv_id"]: (r["n_tokens"], r["n_loss"]) for r in packing.conversation_examples(common.table(spark, sf, "conversations")).collect()}
    got = queries.conversation_packing(spark, sf).collect()
    assert {r["conv_id"] for r in got} == set(asked) and len(got) == len(asked)
    by = defaultdict(list)
    for r in got:
        assert r["length"] == asked[r["conv_id"]][0] and r["over"] == (asked[r["conv_id"]][0] > 1024 or asked[r["conv_id"]][1] > 768)
        by[r["sequence_id"]].append(r)
    for own in by.values():
        own.sort(key=lambda r: (r["offset"], r["length"]))
        assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
        assert own[0]["over"] and len(own) == 1 or sum(r["length"] for r in own) <= 1024 and len(own) <= 16 and sum(asked[r["conv_id"]][1] for r in own) <= 768


def test_conversation_examples(spark, tokenizer):
    f = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "general answer"), (2, 0, None, None)], "conv_id long, turn long, role string, text string")
    n = lambda t: len(tokenizer.encode(t).ids)
    assert rows(packing.conversation_examples(f)) == [(1, n("hello there") + n("general answer"), n("general answer")), (2, 0, 0)]


# Quality -------------------------------------------------------------------------------------------------------------

def test_quality_on_held_out_rows(spark, sf):
    d, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    out = quality.score_documents(d, labels)
    assert rows(out, "doc_id", "held_out") == sorted(((r["doc_id"], zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in d.collect()), key=str)
    assert rows(quality.keep_good(d, labels)) == rows(d.join(out.where("predicted = 1"), "doc_id", "left_semi"))
    held = out.where("held_out").join(labels, "doc_id").collect()
    assert np.mean([(r["predicted"] == r["quality"]) for r in held]) >= 0.9 and all(0 <= r["score"] <= 1 for r in held)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in quality.score_documents(d.withColumn("lang", F.lit("zz")), flipped).collect()}
    assert max(abs(again[r["doc_id"]] - r["score"]) for r in out.collect()) < 1e-6  # held-out labels and columns are not read


def plain_isotonic(x, y, w):
    """The rising curve by its min-max formula; a knot at the mean x of each run of equal values."""
    n = len(x)
    mean = lambda a, b: np.average(y[a : b + 1], weights=w[a : b + 1])
    value = np.array([max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)])
    cuts = np.flatnonzero(np.diff(value) > 1e-12) + 1
    runs = np.split(np.arange(n), cuts)
    return np.array([np.average(x[r], weights=w[r]) for r in runs]), np.array([value[r[0]] for r in runs])


def test_scores_match_a_direct_fit(spark, sf):
    """The whole result against NumPy alone: statistics, cosines, one least-squares problem, the isotonic curve."""
    import pyarrow as pa

    docs = [(r["doc_id"], r["text"]) for r in common.table(spark, sf, "documents").collect()]
    label = {r["doc_id"]: r["quality"] for r in common.table(spark, sf, "labels").collect()}
    x = quality.statistics(pa.array([t for _, t in docs], pa.string())).astype(np.float32).astype(float)
    fold = np.array([zlib.crc32(str(i).encode()) % 4 for i, _ in docs])
    y = np.array([label.get(i, np.nan) for i, _ in docs], float)
    known = ~np.isnan(y) & (fold != 2)
    rng = np.random.default_rng(11)
    w, b = rng.normal(0, 1 / 3.0, (x.shape[1], 256)), rng.uniform(0, 2 * np.pi, 256)
    z = np.clip((x - x[known].mean(axis=0)) / np.maximum(x[known].std(axis=0), 1e-6), -8, 8)
    z = np.column_stack([np.cos(z @ w + b) * np.sqrt(2 / 256), np.ones(len(x))])
    fits, curve = known & (fold != 3), known & (fold == 3)
    n = fits.sum()
    root = np.sqrt(1e-3 * n * np.append(np.ones(256), 1e-6))
    weights = np.linalg.lstsq(np.vstack([z[fits], np.diag(root)]), np.append(y[fits], np.zeros(257)), rcond=None)[0]
    raw = z @ weights
    bins = np.floor(np.clip(raw[curve], -1, 2) * (1000 / 3) + 0.5)
    groups = [np.flatnonzero(bins == v) for v in np.unique(bins)]
    cx, cy, cn = (np.array([f(g) for g in groups], float) for f in (lambda g: raw[curve][g].mean(), lambda g: y[curve][g].mean(), len))
    want = np.clip(0.998 * np.interp(raw, *plain_isotonic(cx, cy, cn)) + 0.002 * np.clip(raw, 0, 1), 0, 1)
    got = {r["doc_id"]: r for r in quality.score_documents(common.table(spark, sf, "documents"), common.table(spark, sf, "labels")).collect()}
    assert len(got) == len(docs) and max(abs(got[i]["score"] - s) for (i, _), s in zip(docs, want, strict=True)) < 1e-5
    assert all(got[i]["held_out"] == (f == 2) and got[i]["predicted"] == int(got[i]["score"] >= 0.7) for (i, _), f in zip(docs, fold, strict=True))


def test_isotonic_matches_its_formula():
    rng = np.random.default_rng(15)
    for _ in range(50):
        n = rng.integers(1, 30)
        x, y, w = np.sort(rng.normal(size=n)), rng.choice([0.0, 0.3, 0.5, 1.0], n), rng.integers(1, 5, n).astype(float)
        a, b = quality.isotonic(x, y, w), plain_isotonic(x, y, w)
        assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1])


def test_quality_edge_cases(spark):
    d = documents(spark, None, "", "x " * 100_000, "good text", "good text")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_documents(d, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(5)] + [(None, 0), (3, None)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_documents(d, one).collect()} == {1.0}
    assert quality.score_documents(d.limit(0), one).isEmpty()
    odd = d.select(F.lit(None).cast("long").alias("doc_id"), "text").union(d.select("doc_id", "text"))
    got = quality.score_documents(odd, one).collect()
    assert len(got) == 10 and not any(r["held_out"] for r in got if r["doc_id"] is None) and quality.keep_good(odd, one).count() == 10


def test_normal_equations_and_isotonic():
    rng = np.random.default_rng(6)
    x, y = np.sort(rng.normal(size=200)), rng.random(200)
    knots = quality.isotonic(x, y, np.ones(200))
    assert (np.diff(knots[1]) > 0).all() and (np.diff(knots[0]) > 0).all()
    f = quality.Fourier(np.zeros(3), np.ones(3), 4000, 2.0, 1)
    p, q = rng.normal(size=(2, 3))
    zp, zq = f(p[None])[0, :-1], f(q[None])[0, :-1]
    assert abs(zp @ zq - np.exp(-((p - q) ** 2).sum() / 8)) < 0.06


# Mixing --------------------------------------------------------------------------------------------------------------

def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        t = {s: 3 * sizes[s] if s in capped else left * w[s] / sum(w[x] for x in names if x not in capped) for s in names}
        over = {s for s in names if s not in capped and t[s] > 3 * sizes[s]}
        if not over:
            return t
        capped |= over


def test_mix(spark):
    rng = random.Random(7)
    texts = [words(rng, rng.randrange(1, 300)) if i % 7 else None if i % 2 else "" for i in range(400)]
    names = ["b", "a", None, "é", "Z", "a" * 50, "tiny"]
    d = documents(spark, *texts, sources=[names[i] for i in (0, 0, 0, 1, 1, 2, 3, 4, 5)]).union(spark.createDataFrame([(999, "one two", "en", "tiny", 7, None, 1, 1)], DOC))
    out = mixing.mix(d)
    got = out.join(d.select("doc_id", "source"), "doc_id").collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
    want = brute_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    assert len(got) == 401 and all(abs(taken[s] - want[s]) <= 32 for s in want)
    assert rows(out) == rows(mixing.mix(d.repartition(7)))
    text = {r["doc_id"]: r for r in mixing.take(d, out).collect()}
    for r in got:
        assert (r["doc_id"] in text) == (r["taken"] > 0)
        if r["taken"]:
            assert len(text[r["doc_id"]]["text"].split()) == r["taken"] and (r["taken"] != r["size"] or text[r["doc_id"]]["text"] == texts[r["doc_id"]] if r["doc_id"] < 400 else True)
    assert mixing.mix(d.limit(0)).isEmpty() and set(mixing.take(d, out).columns) == set(d.columns)


def highest_quotients(votes, seats, caps):
    out = [0] * len(votes)
    for _ in range(seats):
        free = [i for i, v in enumerate(votes) if v > 0 and out[i] < caps[i]]
        if not free:
            break
        out[max(free, key=lambda i: (votes[i] / (2 * out[i] + 1), -i))] += 1
    return out


def test_what_each_document_gives_is_a_run_on_its_shards_ring(spark, monkeypatch):
    """`taken` of every document, against rings laid out word by word; sources of several sections of several shards."""
    monkeypatch.setattr(mixing, "SHARD_DOCS", 8)
    monkeypatch.setattr(mixing, "SECTION", 3)
    rng = random.Random(17)
    texts = [words(rng, rng.randrange(1, 90)) if i % 9 else "" for i in range(240)]
    d = documents(spark, *texts, sources=[("a", "a", "a", "b", None, "a")[i] for i in (0, 1, 2, 3, 4, 5)])
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(d).collect()}

    facts = d.select("doc_id", "source", "text", F.xxhash64(F.lit(7), "doc_id", "text").alias("turn")).collect()
    by_source = defaultdict(list)
    for r in facts:
        by_source[r["source"]].append((r["turn"], r["doc_id"], len(r["text"].split())))
    names = sorted(by_source, key=lambda s: (s is None, s))
    sizes = {s: sum(n for _, _, n in by_source[s]) for s in names}
    targets = brute_targets(sizes)
    blocks_of = lambda n: -(-3 * n // 16)
    quotas = highest_quotients([targets[s] for s in names], round(sum(targets.values()) / 16), [blocks_of(sizes[s]) for s in names])
    want, sections_seen = defaultdict(int), 0
    for rank, (s, quota) in enumerate(zip(names, quotas, strict=True), 1):
        n_shards = -(-len(by_source[s]) // 8)
        rings = defaultdict(list)
        for turn, i, n in sorted(by_source[s]):
            rings[(turn >> 17) % n_shards] += [i] * n
        # Shards whose documents are all empty have no words and win nothing.
        sections = sorted({k // 3 for k in rings})
        sections_seen = max(sections_seen, len(sections))
        words_in = [sum(len(rings[k]) for k in rings if k // 3 == c) for c in sections]
        for c, seats in zip(sections, highest_quotients(words_in, quota, [*map(blocks_of, words_in)]), strict=True):
            shards = sorted(k for k in rings if k // 3 == c)
            for k, blocks in zip(shards, highest_quotients([len(rings[k]) for k in shards], seats, [blocks_of(len(rings[k])) for k in shards]), strict=True):
                ring = rings[k]
                if ring:
                    h = spark.createDataFrame([(rank, k)], "rank int, shard long").select(F.xxhash64(F.lit(7), "rank", "shard")).first()[0]
                    first = h % max(len(ring) // 16, 1) * 16
                    for t in range(min(blocks * 16, 3 * len(ring))):
                        want[ring[(first + t) % len(ring)]] += 1
    assert sections_seen > 2 and got == {r["doc_id"]: want[r["doc_id"]] for r in facts}


def test_rows_equal_in_all_but_other_columns_are_taken_in_a_fixed_order(spark):
    data = [(1, "one two three four", "a", f"x{i}") for i in range(6)] + [(2, "w " * 40, "b", "y")]
    d = spark.createDataFrame(data, "doc_id long, text string, source string, `more.of it` string")
    plans = mixing.mix(d, block_words=1)
    turned = spark.createDataFrame(data[::-1], d.schema).repartition(3)
    assert rows(mixing.take(d, plans)) == rows(mixing.take(turned, mixing.mix(turned, block_words=1)))


def test_small_sources_and_null_ids_are_mixed(spark):
    data = [(None, "one two three", "tiny"), (None, "one two three", "tiny"), (1, None, "none"), (2, "w " * 400, "big"), (None, "x " * 100, None)]
    d = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = mixing.mix(d)
    assert out.count() == 5
    for r in out.groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect():
        assert abs(r["t"] - r["target"]) <= 16 and (r["target"] < 9 or r["t"] > 0)
    assert not out.where("taken > 3 * size").collect()


def test_sainte_lague_by_quotients():
    rng = random.Random(8)
    for _ in range(200):
        votes = [rng.choice([0, rng.random() * 10 ** rng.randrange(4)]) for _ in range(rng.randrange(1, 9))]
        caps = [rng.randrange(40) for _ in votes]
        seats, want = rng.randrange(60), [0] * len(votes)
        for _ in range(seats):
            free = [i for i, v in enumerate(votes) if v > 0 and want[i] < caps[i]]
            if not free:
                break
            want[max(free, key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
        assert mixing.sainte_lague(np.array(votes), seats, np.array(caps)).tolist() == want


# URLs ----------------------------------------------------------------------------------------------------------------

def brute_url(url, listed=()):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    hits = [(len(h + p), v, h + p) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, verdict, rule = max(hits) if hits else (0, "block" if host + path in listed else "allow", None)
    return host, path, rule, verdict


@pytest.mark.parametrize("sizes", [{}, {"most_bits": 64, "segment_bits": 256}])
def test_urls_match_brute_force(spark, sizes):
    rng = random.Random(9)
    hosts = ["example.com", "EXAMPLE.com", "a.example.net", "notexample.com", "x.org", "org", "example.net:80", "É.com", ""]
    urls = [None, "", "no scheme", "http://", "a://b://c", "http://x?y/z", "http://x#/en/"] + [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es', 'EN'])}/{rng.randrange(99)}{rng.choice(['', '?q=1', '#t', '/'])}" for _ in range(3000)]
    f = spark.createDataFrame([(i, u, "k", "s") for i, u in enumerate(urls)], "page_id long, url string, key string, segment string")
    listed = ["x.org/de/5", "notexample.com/en/7", "unknown"]
    got = rows(url_filter.filter_urls(f, listed=spark.createDataFrame([(k,) for k in listed], "key string"), **sizes), "page_id", "host", "path", "rule", "verdict")
    assert sorted(got) == [(i, *brute_url(u, listed)) for i, u in enumerate(urls)]
    assert url_filter.filter_urls(f.limit(0)).isEmpty()
    long = ["http://" + "a" * 300_000 + ".example.com/en/7", "http://example.com/en/" + "b" * 300_000, "x" * 300_000 + "://example.net/de/8"]
    f = spark.createDataFrame([(None, u) for u in long], "page_id long, url string")
    assert sorted(r["rule"] for r in url_filter.filter_urls(f, **sizes).collect()) == ["com/en/", "example.com/en/7", "example.net/de/8"]


def test_cascade_is_exact_and_small(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 10 == 0).alias("listed"))
    c = url_filter.build_cascade(universe, bits_per_key=6)
    assert 2 <= len(c.levels) <= 20 and sum(bits for _, bits in c.levels) < 20_000 * 2
    marked = c.listed(universe.select("key", F.col("listed").alias("truth")).withColumn("segment", c.segment("key")))
    assert marked.where("listed <> truth").isEmpty()


# The pipeline --------------------------------------------------------------------------------------------------------

def test_pipeline_stages(spark, sf):
    import corpus_pipeline as pipe

    docs = common.table(spark, sf, "documents")
    numbers = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = pipe.good_quality(spark, docs, sf)
    kept = {r["doc_id"] for r in good.collect()}
    clean = {r["doc_id"] for r in common.table(spark, sf, "labels").where("quality = 1").collect()}
    assert good.columns == docs.columns and len(clean & kept) >= 0.97 * len(clean)
    one = pipe.one_of_each_group(spark, good, sf)
    ids = sorted(kept)
    want = expected_components([numbers[i] for i in ids], 5, 80)
    assert {r["doc_id"] for r in one.collect()} == {ids[i] for i, _, c in want if i == c}
    safe = pipe.without_secrets(spark, one, sf)
    assert safe.count() == one.count() and not safe.where(F.col("text").rlike("AKIA[A-Z0-9]{14}")).collect()
    mix = pipe.mixed(spark, safe, sf)
    assert mix.columns == docs.columns and mix.count() <= safe.count()
    packed = pipe.packed(spark, mix, sf)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in mix.collect()}


def test_rows_without_an_id_or_with_a_repeated_one_go_through_the_stages(spark):
    rng = random.Random(12)
    texts = [words(rng, n) for n in (40, 70, 90, 120, 50, 60)]
    ids = [None, None, 5, 5, 6, 7]
    d = spark.createDataFrame([(i, t, "en", "a" if n % 2 else None, 0, None, 7, 1) for n, (i, t) in enumerate(zip(ids, texts, strict=True))], DOC)
    plans = mixing.mix(d.union(d), block_words=1)
    got = mixing.take(d.union(d), plans).collect()
    assert sorted(len(r["text"].split()) for r in got) == sorted(r["taken"] for r in plans.collect() if r["taken"])
    for source in ("a", None):
        want = {r["target"] for r in plans.collect() if r["source_size"] == 2 * sum(len(t.split()) for n, t in enumerate(texts) if (n % 2 == 1) == (source == "a"))}
        assert abs(sum(len(r["text"].split()) for r in got if r["source"] == source) - want.pop()) <= 2
    near = texts[3] + " more"
    more = spark.createDataFrame([(None, near, "en", "a", 0, None, 7, 1), (8, near, "en", "a", 0, None, 7, 1), (9, "", "en", "a", 0, None, 7, 1), (9, "", "en", "a", 0, None, 7, 1)], DOC)
    kept = ngram_join.keep_first(d.union(d).union(more))
    assert rows(kept, "doc_id", "text") == sorted([*zip(ids, texts, strict=True), (9, ""), (9, "")], key=str)


def test_words_out_are_words_planned_and_names_do_not_clash(spark):
    """Repeated ids with other texts, null ids and repeated rows, beside columns named as the operators' own."""
    rng = random.Random(14)
    names = ["_id", "_print", "_size", "_taken", "_again", "_mine", "_place", "_spans", "_drop", "_key", "_text", "ID", "size", "taken", "print", "component", "rows", "x", "y", "label"]
    texts = [words(rng, n) for n in (10, 70, 22, 120, 50, 60, 9)]
    data = [(i, t, s) for i, t, s in zip([1, 1, None, None, 5, 6, 7], texts, "aabbabc", strict=True)] * 2
    d = spark.createDataFrame(data, "doc_id long, text string, source string").select("*", *(F.lit(7).alias(n) for n in names))
    plans = mixing.mix(d, block_words=1)
    got = mixing.take(d, plans)
    assert got.columns == d.columns and sorted(len(r["text"].split()) for r in got.collect()) == sorted(r["taken"] for r in plans.collect() if r["taken"])
    assert sum(len(r["text"].split()) for r in got.collect()) == plans.agg(F.sum("taken")).first()[0]
    once = ngram_join.keep_first(d)
    assert once.columns == d.columns and rows(once, "doc_id", "text") == sorted({(i, t) for i, t, _ in data}, key=str)
    from folioworks.llm import pii, secret_scan

    for module in (pii, secret_scan):
        assert module.redact(d).columns == d.columns and module.redact(d).count() == len(data)


def test_each_row_is_judged_by_its_own_text(spark, monkeypatch):
    import corpus_pipeline as pipe

    d = spark.createDataFrame([(i, t, "en", "a", 0, None, 7, 1) for i, t in ((None, "bad x"), (None, "good x"), (1, "bad y"), (1, "good y"), (2, "good z"))], DOC)

    class Model:
        def score(self, x):
            return (x[:, quality.STATISTICS.index("digits")] == 0).astype(float)

    monkeypatch.setattr(pipe.quality, "fit", lambda labelled, **_: Model())
    d = d.withColumn("text", F.replace("text", F.lit("bad"), F.lit("bad 1")))
    assert rows(pipe.good_quality(spark, d, "/root/testdata/sf0.001"), "doc_id", "text") == sorted([(None, "good x"), (1, "good y"), (2, "good z")], key=str)


def test_pipeline_of_nothing(spark, sf):
    import corpus_pipeline as pipe

    docs = common.table(spark, sf, "documents").limit(0)
    for _, stage in pipe.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.isEmpty()


def test_pipeline_hands_on_texts_in_small_batches(spark, tmp_path):
    """Each stage, run alone, bounds the bytes of a batch, and a session's own smaller bound stays."""
    import corpus_pipeline

    was = spark.conf.get(common.BATCH)
    try:
        spark.conf.set(common.BATCH, str(64 << 20))
        packed = corpus_pipeline.packed(spark, documents(spark, "a b", None), str(tmp_path))
        assert spark.conf.get(common.BATCH) == str(common.BATCH_BYTES)
        assert rows(packed, "doc_id", "length")[-1] == (1, 1)
        texts = documents(spark, *["x" * (1 << 20)] * 8).coalesce(1).select("text")
        sizes = texts.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long")
        assert sum(r["n"] for r in sizes.collect()) == 8 and max(r["n"] for r in sizes.collect()) <= 3
        spark.conf.set(common.BATCH, "1m")
        common.small_batches(spark)
        assert spark.conf.get(common.BATCH) == "1m"
    finally:
        spark.conf.set(common.BATCH, was)
