from __future__ import annotations

import random

import pytest
from conftest import rows

from folioworks.operators import euler, tree

EDGE = "parent_id string, child_id string, pos long"


def forest(rng, n, roots=2, wide=False):
    """Edges of a random forest: names don't follow the order, some positions tie."""
    names = [f"n{i}" for i in rng.sample(range(10 * n), n)]
    return [(names[0 if wide and rng.random() < 0.8 else rng.randrange(i)], names[i], rng.randrange(5)) for i in range(roots, n)]


def plain(edges):
    kids, below = {}, set()
    for p, c, pos in edges:
        kids.setdefault(p, []).append((pos, c))
        below.add(c)
    out, n = {}, 0
    for root in sorted({p for p, _, _ in edges} - below):
        stack = [(root, 0, False)]
        while stack:
            node, depth, leaving = stack.pop()
            if leaving:
                out[node] = (out[node][0], n, depth)
                continue
            n += 1
            out[node] = (n, None, depth)
            stack.append((node, depth, True))
            stack += [(c, depth + 1, False) for _, c in sorted(kids.get(node, ()), reverse=True)]
    return out


def tour(spark, edges):
    return euler.intervals(spark.createDataFrame(edges, EDGE).repartition(3))


@pytest.mark.parametrize(("seed", "n", "wide"), [(0, 3, False), (1, 200, False), (2, 1500, True)])
def test_intervals_match_a_plain_walk(spark, seed, n, wide):
    edges = forest(random.Random(seed), n, wide=wide)
    assert {r[0]: r[1:] for r in rows(tour(spark, edges))} == plain(edges)


def test_a_chain_of_ten_thousand(spark):
    """Depth costs no joins: the levels would be 10,000."""
    edges = [(f"c{i}", f"c{i + 1}", 0) for i in range(9_999)]
    got = {r[0]: r[1:] for r in rows(tour(spark, edges))}
    assert got == {f"c{i}": (i + 1, 10_000, i) for i in range(10_000)}


def test_what_is_no_tree_is_refused(spark):
    shared = [("r", "a", 1), ("r", "b", 2), ("a", "d", 1), ("b", "d", 1)]
    for edges in (shared, [("a", "b", 1), ("b", "a", 1)], [("r", "a", 1), ("x", "y", 1), ("y", "z", 1), ("z", "x", 1)], [("r", "a", 1), ("r", "a", 2)], [("a", "a", 0)]):
        with pytest.raises(euler.NotATree):
            tour(spark, edges)
    nodes = spark.createDataFrame([(x, "m" if x == "d" else None) for x in "rabd"], "id string, manifest string")
    asked = spark.createDataFrame([("a",), ("b",)], "id string")
    assert rows(tree.sample_manifest(nodes, spark.createDataFrame(shared, EDGE), asked)) == [("a", "m"), ("b", "m")]  # by levels, which allow it
    assert euler.intervals(spark.createDataFrame([(None, "a", 1), ("a", None, 1)], EDGE)).isEmpty()


def test_questions_about_all_subtrees(spark):
    rng = random.Random(8)
    edges = forest(rng, 400)
    of = plain(edges)
    up = {c: p for p, c, _ in edges}

    def above(x):
        while x in up:
            x = up[x]
            yield x

    t = tour(spark, edges)
    values = {x: f"v{x}" for x in of if rng.random() < 0.15}
    asked = [x for x in of if rng.random() < 0.5] + ["not there"]
    df = spark.createDataFrame(list(values.items()), "id string, value string")
    got = dict(rows(euler.first_below(t, df, spark.createDataFrame([(x,) for x in asked], "id string"))))
    first = lambda x: min((of[y][0], v) for y, v in values.items() if of[x][0] <= of[y][0] <= of[x][1])[1]
    assert got == {x: first(x) for x in asked if x in of and any(of[x][0] <= of[y][0] <= of[x][1] for y in values)}
    got = dict(rows(euler.from_depth(t, df, 1)))
    at_one = lambda x: next((values.get(y) for y in (x, *above(x)) if of[y][2] == 1), None)
    assert got == {x: at_one(x) for x in of}
    stops = [x for x in of if rng.random() < 0.1]
    left = euler.without_stops_above(t, spark.createDataFrame([(x,) for x in stops], "id string"))
    assert {r[0]: r[1:] for r in rows(left)} == {x: of[x] for x in of if not set(above(x)) & set(stops)}


def test_first_manifests_by_intervals_and_by_levels_agree(spark, sf):
    from folioworks.plans.fixtures import view
    from folioworks.plans.operator_queries import _branches

    v = view(spark, sf)
    nodes, edges, branches = v("v_node"), v("v_edge"), _branches(v)
    by_intervals = rows(tree.sample_manifest(nodes, edges, branches, tour=euler.intervals(edges)))
    assert by_intervals and by_intervals == rows(tree.sample_manifest(nodes, edges, branches))


def test_a_shallow_tree_takes_no_tour_and_little_disk(spark, monkeypatch):
    """20,000 leaves below 200 branches: no pointers, and the tables kept on the way are gone when the intervals are there."""
    import os

    from folioworks.operators.shared import shared_dir

    monkeypatch.setattr(euler, "_jumped", None)
    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    edges = [("r", f"b{i}", i) for i in range(200)] + [(f"b{i}", f"l{i}-{j}", j) for i in range(200) for j in range(100)]
    got = tour(spark, edges)
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - before] == ["tour"]
    assert {r[0]: r[1:] for r in rows(got)} == plain(edges)


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_forests_of_chains_and_brooms(spark, seed):
    """Trees of which some nodes are taken off and the rest is toured, several roots among them."""
    rng = random.Random(seed)
    edges = []
    for t in range(rng.randrange(2, 5)):
        chain = [f"t{t}c{i}" for i in range(rng.randrange(2, 150))]
        edges += [(a, b, rng.randrange(9)) for a, b in zip(chain, chain[1:])]
        edges += [(x, f"{x}l{j}", rng.randrange(9)) for x in chain for j in range(rng.randrange(3))]
        edges += [(f"{x}l0", f"{x}l0m{j}", j) for x in chain for j in range(rng.randrange(3)) if any(c == f"{x}l0" for _, c, _ in edges)]
    assert {r[0]: r[1:] for r in rows(tour(spark, edges))} == plain(edges)
