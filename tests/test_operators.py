from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from folioworks.functions.parse import image_url_from_cote
from folioworks.operators import browse, load, resolve, stats, tree
from folioworks.operators.shared import numbered
from folioworks.plans import job_queries, jobs, operator_queries, text_queries  # noqa: F401  the queries register themselves
from folioworks.plans.registry import ORACLES, QUERIES


def frame(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


ALIAS = "dept string, name string, code string"
COMMUNE = "dept string, nom string, insee string, population long"


def test_alias_ambiguity_gives_null(spark):
    names = frame(spark, "dept string, name string", ("16", "Saint-Médard"), ("16", "L'Ancien"), (None, "L'Ancien"))
    alias = frame(spark, ALIAS, ("16", "Saint Medard", "16001"), ("16", "SAINT-MÉDARD", "16002"), ("16", "l'ancien", "16003"))
    assert rows(resolve.resolve_by_alias(names, alias)) == sorted([("16", "Saint-Médard", None), ("16", "L'Ancien", "16003"), (None, "L'Ancien", None)], key=str)


def test_name_without_department_takes_the_most_populous(spark):
    communes = frame(spark, COMMUNE, ("01", "Étrez", "01001", 10), ("02", "Etrez", "02001", 99), ("03", "Deux", "03001", 1), ("03", "deux", "03002", 2))
    names = frame(spark, "dept string, name string", (None, "étrez"), ("01", "ETREZ"), ("04", "Etrez"), ("03", "Deux"))
    got = {(r["dept"], r["name"]): r["code"] for r in resolve.resolve_by_name(names, communes).collect()}
    assert got == {(None, "étrez"): "02001", ("01", "ETREZ"): "01001", ("04", "Etrez"): None, ("03", "Deux"): None}


def naive_chase(moves, current, code):
    seen = set()
    while code not in current:
        if code in seen or len(moves.get(code, ())) != 1:
            return None
        seen.add(code)
        code = next(iter(moves[code]))
    return code


def test_succession_matches_a_naive_chase(spark):
    moves = {"25015": {"A", "B", "C", "D"}, "x": {"y"}, "y": {"x"}, "lost": {"gone"}, **{str(i): {str(i + 1)} for i in range(40)}, "p": {"25015"}, "q": {"7"}}
    current = {"40", "A", "B", "C", "D", "x9"}
    m = frame(spark, "typecom_av string, com_av string, typecom_ap string, com_ap string", *(("COM", a, "COM", b) for a, bs in moves.items() for b in bs), ("COMD", "z", "COM", "A"))
    c = frame(spark, "code string, nom string", *((x, x) for x in current))
    got = dict(rows(resolve.resolve_succession(m, c)))
    assert got == {k: naive_chase(moves, current, k) for k in got} and got["0"] == "40" and got["x"] is None and got["25015"] is None


def test_guard(spark):
    ok = frame(spark, "insee string", *[("01001",)] * 95, *[("02001",)] * 5, (None,))
    assert resolve.department_guard(ok, ["01"]) is ok
    for bad in (ok.union(frame(spark, "insee string", ("02002",))), frame(spark, "insee string", (None,))):
        with pytest.raises(resolve.WrongDepartment):
            resolve.department_guard(bad, ["01"])


def test_point_in_polygon_with_hole_and_border_cells(spark):
    ring = lambda *p: [(float(a), float(b)) for a, b in p]
    kind = "insee string, rings array<array<struct<lon:double,lat:double>>>"
    communes = frame(spark, kind, ("A", [ring((0, 0), (3, 0), (3, 3), (0, 3), (0, 0)), ring((1, 1), (2, 1), (2, 2), (1, 2), (1, 1))]), ("B", [ring((3, 0), (5, 0), (4, 3), (3, 0))]))
    points = frame(spark, "id int, lon double, lat double", (1, 0.5, 0.5), (2, 1.5, 1.5), (3, 4.0, 1.0), (4, 9.0, 9.0), (5, None, 1.0))
    assert dict(rows(resolve.commune_at_point(points, communes), "id", "insee")) == {1: "A", 2: None, 3: "B", 4: None, 5: None}


NODE = "id string, title string, begin_year int, end_year int, manifest string"


def test_descend_tests_leaves_before_pruning(spark):
    nodes = frame(spark, NODE, ("r", "Fonds", None, None, None), ("c", "Sevran", None, None, None), ("p", "Plans", 1800, 1850, None), ("x", "Cadastre rénové", None, None, None), ("late", "Plans", 1900, 1950, None),
                  ("l1", "Plan rénové", 1820, None, "m1"), ("l2", "Section A", 1900, None, "m2"), ("l3", "Section B", None, None, "m3"), ("l4", "S", 1820, None, "m4"), ("l5", "S", 1820, None, "m5"), ("n", "sans", 1820, None, None))
    edges = frame(spark, "parent_id string, child_id string, pos int", ("r", "c", 0), ("c", "p", 0), ("c", "x", 1), ("c", "late", 2), ("p", "l1", 0), ("p", "l2", 1), ("p", "l3", 2), ("p", "n", 3), ("x", "l4", 0), ("late", "l5", 0), ("p", "r", 9), ("c", "l3", 5))
    got = rows(tree.descend(nodes, edges, "r"), "id", "commune", "depth")
    assert got == [("l1", "Sevran", 3), ("l3", "Sevran", 2)]


def test_isolated_branches(spark):
    nodes = frame(spark, NODE, ("r", "Fonds", None, None, None), ("a", "Plans du cadastre", None, None, None), ("b", "Matrices", None, None, None), ("c", "Commune", None, None, None), ("l", "Section A", None, None, "m"), ("k", "Plan", None, None, "m2"), ("d", "Atlas", None, None, None), ("e", "Feuille", None, None, None))
    edges = frame(spark, "parent_id string, child_id string, pos int", ("r", "a", 0), ("r", "b", 1), ("r", "c", 2), ("a", "l", 0), ("b", "k", 0), ("c", "d", 0), ("c", "k", 1), ("d", "e", 0))
    assert rows(tree.isolate_plan_branches(nodes, edges, "r"), "id") == [("a",), ("c",), ("d",)]
    assert dict(rows(tree.sample_manifest(nodes, edges, frame(spark, "id string", ("a",), ("d",))))) == {"a": "m"}


DOC = "ingest_rank long, insee string, type string, section_lettre string, feuille_num int, annee int, cote string, archive_url string, iiif_manifest string, image_url string, licence_overlay_ok boolean, georef_url string"


def docs(spark):
    return frame(spark, DOC, (1, "93071", "section", "A", 2, 1819, "c1", "u1", None, "i1", True, None), (2, "93071", "tableau_assemblage", None, None, 1819, "c2", "u2", "m2", None, True, None),
                 (3, "93071", "feuille", None, 3, None, None, "u3", None, None, False, None), (4, "93072", "feuille", None, None, 0, None, "u4", "m4", None, None, None), (5, None, "section", "B", None, 1700, "c5", "u5", None, None, True, None))


def test_stats_and_cards(spark):
    d = docs(spark)
    assert rows(stats.stats_by_dept(d)) == [("93", 4, 2, 2, 1, 1, 2, 2)]
    cards = {r["insee"]: r for r in stats.commune_card(d).collect()}
    assert (cards["93071"]["manifest"], cards["93071"]["image"], cards["93071"]["plates"]) == ("m2", "i1", ["Sect. A f.2", "Feuille 3"])
    assert cards["93072"]["plates"] == ["Planche"] and cards["93072"]["overview"] is None
    none = frame(spark, "id string, items int, fetch_ok boolean")
    assert dict(rows(stats.commune_status(d, none), "insee", "status")) == {"93071": "georef_ready", "93072": "absent", None: "absent"}
    facets = {(r["facet"], r["value"]): r["n"] for r in stats.facet_counts(d).collect()}
    assert facets[("decade", "1810")] == 2 and ("decade", "0") not in facets and facets[("iiif", "yes")] == 2


def test_upsert_and_replace_are_idempotent(spark):
    d = docs(spark)
    once = load.upsert_ignore(d.where("ingest_rank = 1"), d.union(d))
    assert rows(once) == rows(load.upsert_ignore(once, d)) == rows(d)
    batch = d.where("ingest_rank <= 2")
    assert rows(load.replace_department(load.replace_department(d, batch, "93"), batch, "93"), "ingest_rank") == [(1,), (2,), (5,)]


def test_georef_diff_then_apply_leaves_nothing_to_do(spark):
    d = docs(spark).withColumn("georef_url", F.when(F.col("ingest_rank") == 4, "kept"))
    a = frame(spark, "m string, items int, fetch_ok boolean", ("m2", 1, True), ("m4", 1, True)).select(F.substring(F.sha1(F.col("m").cast("binary")), 1, 16).alias("id"), "items", "fetch_ok")
    diff = load.diff_georef(d, a)
    assert rows(diff, "archive_url") == [("u2",)]
    done = load.apply_georef(d, diff)
    assert load.diff_georef(done, a).isEmpty() and dict(rows(done, "archive_url", "georef_url"))["u4"] == "kept"
    failed = a.withColumn("fetch_ok", F.lit(False))
    assert load.diff_georef(done, failed, strict=False).isEmpty() and rows(load.diff_georef(done, failed)) == [("u2", None)]
    with pytest.raises(ValueError):
        load.annotation_collection(d, a, "93")


def test_seed_sql_quotes(spark):
    d = docs(spark).where("ingest_rank = 1").withColumn("cote", F.lit("l'a"))
    assert load.seed_sql(d).first()[0].endswith("values ('93071', 'section', 'A', 2, 1819, 'l''a', 'u1', null, 'i1', true);")


def test_write_department_keeps_others(spark, tmp_path):
    d = docs(spark).where("insee is not null").withColumn("dept", F.substring("insee", 4, 2))
    path = str(tmp_path / "out")
    load.write_department(d, path)
    load.write_department(d.where("dept = '71'").limit(1), path)
    assert sorted(r["count"] for r in spark.read.parquet(path).groupBy("dept").count().collect()) == [1, 1]


def test_browse(spark):
    d = docs(spark)
    assert [r["ingest_rank"] for r in browse.order_documents(d.withColumn("insee", F.lit("01001"))).orderBy("place").collect()] == [4, 3, 1, 5, 2]
    assert {r["place"] for r in browse.order_documents(d.withColumn("insee", F.col("ingest_rank").cast("string"))).collect()} == {1}
    assert rows(browse.regression_diff(d, d, d.columns)) == []
    c = frame(spark, "insee string, nom string, lon double, lat double, dept string, population long", *((f"01{i:03d}", f"N{i:02d}", 1.0, 1.0, "01", i) for i in range(15)))
    top = browse.viewport_topk(c, c, (0, 0, 2, 2), 12, "01014").orderBy("place").collect()
    assert [r["nom"] for r in top[:2]] == ["N14", "N00"] and len(top) == 12 and top[0]["total"] == 15
    assert browse.viewport_topk(c, c, (0, 0, 2, 2), 9).isEmpty()


#: As French dictionaries have it; space, hyphen and apostrophes, in ICU's order, come before letters.
FRENCH = ["", "Ærø", "Aérodrome", "cote", "Cote", "coté", "Coté", "côte", "Côte", "côté", "côtes", "Eu", "Évreux", "L’Aigle", "L'Île", "L'Isle", "Œuf", "Oz", "Saint Bx", "Saint-Be", "Saint-Bé", "Ussé"]


def test_places_by_ranges_are_places(spark):
    rng = random.Random(3)
    data = [(i, rng.randrange(50)) for i in range(500)]
    f = frame(spark, "id int, k int", *data).repartition(7)
    got = {r["id"]: r["place"] for r in numbered(f, [F.desc("k"), F.col("id")]).collect()}
    assert got == {i: n for n, (i, _) in enumerate(sorted(data, key=lambda x: (-x[1], x[0])), 1)}
    d = frame(spark, "ingest_rank int, nom string", (1, "Évreux"), (2, "Dax"), (3, "eu"), (4, "evreux"))
    assert [r["ingest_rank"] for r in browse.sort_documents(d, "commune").orderBy("place").collect()] == [2, 3, 4, 1]


def test_french_order(spark):
    """A hand-made order: accents and case only break ties, ligatures sort as their letters, numbers by value however long."""
    want = FRENCH
    d = frame(spark, "ingest_rank int, nom string", *random.Random(1).sample([(i, x) for i, x in enumerate(want)], len(want)))
    assert [r["nom"] for r in browse.sort_documents(d.repartition(5), "commune").orderBy("place").collect()] == want
    marks = ["", "3 P 007", "3 P 8", "3 P 10", "3 P 10/2", "3 P 10/11", "3 P 9999999999999", "3 P 12345678901234567890", "3 P 12345678901234567891", "3 p 99999999999999999999", "3 P 100000000000000000000", "côte 2", "Cote 10", "côte 10", "cote 11"]
    d = frame(spark, "ingest_rank int, cote string", *random.Random(2).sample(list(enumerate(marks)), len(marks)))
    assert [r["cote"] for r in browse.sort_documents(d.repartition(5), "cote").orderBy("place").collect()] == marks


def test_a_graph_is_visited_once_by_its_first_path(spark):
    nodes = frame(spark, "id string, title string, begin_year int, end_year int, manifest string", *((x, x, None, None, "m" if x == "d" else None) for x in "rabcd"))
    edges = frame(spark, "parent_id string, child_id string, pos long", ("r", "a", 1), ("r", "b", 2), ("a", "d", 5), ("b", "d", 1), ("b", "r", 3), ("r", "c", 3))
    assert rows(tree.descend(nodes, edges, "r"), "id", "commune") == [("d", "a")]
    assert rows(tree.descend(nodes, edges.where("parent_id <> 'b'"), "r"), "id", "commune") == [("d", "a")]


def test_derived_picture_addresses(spark):
    f = frame(spark, "root string, plate int", ("28A", 5), ("102", 120), ("1", None))
    got = [r[0] for r in f.select(image_url_from_cote("root", "plate", "https://x", "FR_")).collect()]
    assert got == ["https://x/3P_028A/FR_3P_028A_05.jpg", "https://x/3P_102/FR_3P_102_120.jpg", None]


def test_tree_job_is_what_its_parts_give(spark, sf):
    from folioworks.plans.fixtures import view

    v = view(spark, sf)
    out = rows(QUERIES["tree_to_documents"](spark, sf), "id", "insee", "method")
    leaves = {r["id"]: r["commune"] for r in tree.descend(v("v_node"), v("v_edge"), "root").collect()}
    assert {r[0] for r in out} == set(leaves)
    assert all((i is None) == (m is None) for _, i, m in out)


def test_one_and_many_partitions_agree(spark, sf):
    from folioworks.plans.fixtures import view

    v = view(spark, sf)
    n = v("v_notice")
    a, b = (jobs.documents_from_notices(n.repartition(k), v("v_alias"), v("v_commune")) for k in (1, 16))
    assert browse.regression_diff(a, b, a.columns).isEmpty()


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_communes_of_equal_rank_go_by_name(spark):
    """However the rows come, the i-th cote has the same commune."""
    from folioworks.functions.parse import natural_cote_key

    cotes = frame(spark, "cote string", *((f"{i}",) for i in range(1, 41)))
    tree_ = [(f"commune {i:02d}", f"{i // 15}") for i in range(40)]
    for order in (tree_, tree_[::-1], random.Random(2).sample(tree_, 40)):
        got = resolve.tree_commune_by_cote_order(cotes, frame(spark, "nom string, rang string", *order), natural_cote_key("cote"))
        assert rows(got) == sorted(((f"{i + 1}", f"commune {i:02d}") for i in range(40)), key=str)


def test_levels_keep_only_what_is_asked_about(spark, monkeypatch):
    """Plan branches carry no manifest, counted leaves no address and no service; the table of all nodes goes when the levels are there."""
    kept, gone = [], []
    keep, free = tree.keep, tree.free
    monkeypatch.setattr(tree, "keep", lambda df, name: kept.append((name, df.columns)) or keep(df, name))
    monkeypatch.setattr(tree, "free", lambda *t: gone.append(t) or free(*t))
    nodes = frame(spark, "id string, title string, begin_year int, end_year int, manifest string, service_uri string", ("r", "Fonds", None, None, None, None), ("a", "Plans", None, None, None, "s"), ("b", "x", 1820, None, "m", "s"))
    edges = frame(spark, "parent_id string, child_id string, pos long", ("r", "a", 1), ("a", "b", 1))
    assert rows(tree.isolate_plan_branches(nodes, edges, "r"), "id", "title") == [("a", "Plans")]
    assert all(not {"manifest", "service_uri"} & set(c) for _, c in kept) and [n for n, _ in kept].count("tree-nodes") == len(gone) == 1
    kept.clear()
    got = rows(QUERIES["propagate_commune"](spark, "/root/testdata/sf0.001"))
    assert got and all("service_uri" not in c for _, c in kept)
