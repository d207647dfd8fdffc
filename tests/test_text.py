from __future__ import annotations

import unicodedata
from urllib.parse import quote

import pytest
from pyspark.sql import functions as F

from folioworks.functions import parse as P
from folioworks.functions import text as T


def value(spark, make, *texts):
    df = spark.createDataFrame([tuple(texts)], ", ".join(f"c{i} string" for i in range(len(texts))))
    out = df.select(make(*(f"c{i}" for i in range(len(texts)))).alias("x")).first()["x"]
    return tuple(out) if hasattr(out, "asDict") else out


CASES = [
    (T.norm_ws, " a \t\n b  ", "a b"),
    (T.key_spaced, "L'Île-Saint  Étienne", "l ile saint etienne"),
    (T.key_spaced, "Étrez", "etrez"),
    (T.key_compact, "Étrez-sur (Ain)", "etrezsurain"),
    (T.clean_commune_listed, "Aubervilliers (Seine-Saint-Denis, France)", "Aubervilliers"),
    (T.clean_commune_listed, "SEVRAN [commune]", "SEVRAN"),
    (T.clean_commune_listed, "Bobigny, Bondy, …", "Bobigny"),
    (lambda c: T.clean_commune_paren(c, ["Aisne"]), "Abbécourt (Aisne, France)", "Abbécourt"),
    (lambda c: T.clean_commune_paren(c, ["Aisne"]), "Agnicourt (Agnicourt-et-Séchelles, Aisne, France)", "Agnicourt-et-Séchelles"),
    (lambda c: T.clean_commune_paren(c, ["Aisne"]), "Beaulne-et-Chivy", "Beaulne-et-Chivy"),
    (T.clean_commune_slash, "Aignes / Aignes-et-Puypéroux", "Aignes-et-Puypéroux"),
    (T.clean_commune_slash, "Les Adjots.", "Les Adjots"),
    (T.reorder_article, "Allemands (Les)", "Les Allemands"),
    (T.reorder_article, "Isle (L’)", "L'Isle"),
    (T.is_non_commune_place, "Ain (France ; département)", True),
    (T.is_rubric_title, "États de section", True),
    (T.is_rubric_title, "Plan-d'Orgon", False),
    (P.parse_title_line, "3 P 1/2 - Section A dite de Chardat. Feuille 1. | 1825", ("3 P 1/2", "Section A dite de Chardat. Feuille 1.", 1825)),
    (P.parse_cote, "3 P 28A/5", ("28A", 5)),
    (P.parse_cote, "3 P 1", ("1", None)),
    (P.image_folder_from_cote, "28A", "3P_028A"),
    (lambda c: P.classify(c, "inventory"), "Section A dite de Chardat. Feuille 1.", ("feuille", "A", 1)),
    (lambda c: P.classify(c, "inventory"), "Plan général.", ("tableau_assemblage", None, None)),
    (lambda c: P.classify(c, "manifest"), "TABLEAU d'assemblage Section B", ("tableau_assemblage", None, None)),
    (lambda c: P.classify(c, "manifest"), "section b", ("feuille", None, None)),
    (P.parse_ident, "E_Dépôt_0418_1G1_02", ("E_Dépôt_0418_1G1_02", 2)),
    (P.ident_family, "3P0001_02", "#P#_#"),
    (lambda c: P.parse_year(c, "modern"), "1843-1859", 1843),
    (lambda c: P.parse_year(c, "modern"), "s.d", None),
    (lambda c: P.parse_year(c, "prefix4"), "1825-01-01", 1825),
    (lambda c: P.parse_year(c, "digits"), "1825-01-01", None),
    (P.is_plans_title, "État de section", False),
    (P.is_plans_title, "Tableau d'assemblage", True),
    (P.excluded_branch, "CADASTRE RÉNOVÉ", True),
    (P.page_type, "https://x/a_01.JPG", ("tableau_assemblage", None)),
    (P.page_type, "https://x/a_12.jpg", ("feuille", 12)),
]


@pytest.mark.parametrize("make, text, expected", CASES)
def test_cases(spark, make, text, expected):
    assert value(spark, make, text) == expected


def test_nulls(spark):
    for make, _, _ in CASES:
        value(spark, make, None)


def test_two_arguments(spark):
    assert value(spark, T.commune_from_titles, "Aulnay-sous-Bois, 1782.", "x") == "Aulnay-sous-Bois"
    assert value(spark, T.commune_from_titles, "Tableau d'assemblage", "Sevran") == "Sevran"
    assert value(spark, P.parse_manifest_label, "3P0001_01 • Abbecourt : Tableau d'assemblage • 1828", None) == ("3P0001_01", "Tableau d'assemblage", 1828)
    assert value(spark, P.parse_manifest_label, "Abbecourt : Plan", "vers 1831") == (None, "Plan", 1831)


def test_folding_matches_unicode(spark):
    letters = "".join(chr(c) for c in range(0xC0, 0x250)) + "ṩǖéœŒ"
    want = "".join(c for c in unicodedata.normalize("NFD", letters) if unicodedata.category(c) != "Mn")
    assert value(spark, T.fold_accents, letters) == want


def test_url_quote_matches_python(spark):
    text = "/a b*~é+%?&=(x)_.-"
    assert value(spark, T.url_quote, text) == quote(text, safe="")


def test_natural_order(spark):
    df = spark.createDataFrame([(x,) for x in ("102", "28B", "9", "28A", "x")], "r string")
    assert [r["r"] for r in df.orderBy(P.natural_cote_key("r")).collect()] == ["9", "28A", "28B", "102", "x"]
    assert [r["r"] for r in df.orderBy(P.natural_key(F.col("r"))).collect()] == ["9", "28A", "28B", "102", "x"]


def test_period(spark):
    df = spark.createDataFrame([(None, None), (1700, 1789), (1860, None), (1861, 1900)], "b int, e int")
    assert [r[0] for r in df.select(P.period_overlaps("b", "e", 1790, 1860)).collect()] == [True, False, True, False]
