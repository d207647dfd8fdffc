"""Orders, searches and top lists as a reader of the catalogue sees them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions import parse as P
from folioworks.functions import text as T
from folioworks.operators.compare import where_they_differ
from folioworks.operators.shared import numbered
from folioworks.operators.stats import document_order, region_dim


def order_documents(docs: DataFrame) -> DataFrame:
    """`docs` with `place` within the commune: by type, section and sheet."""
    order = Window.partitionBy("insee").orderBy("type", F.asc_nulls_first("section_lettre"), F.asc_nulls_first("feuille_num"), "ingest_rank")
    return docs.withColumn("place", F.row_number().over(order))


def sort_keys(mode: str) -> list[Column]:
    """Sort keys of documents: type, year_asc, year_desc, cote or commune; names and marks sort by French collation, numbers in marks by value."""
    name = T.french(F.coalesce("nom", F.lit("")))
    if mode == "commune":
        return [name]
    year = F.when(F.col("annee") != 0, F.col("annee"))
    if mode == "type":
        rank = F.when(F.col("type") == P.TABLEAU, 0).when(F.col("type") == P.SECTION, 1).when(F.col("type") == P.FEUILLE, 2).otherwise(9)
        return [rank, name]
    if mode == "year_asc":
        return [F.coalesce(year, F.lit(9999))]
    if mode == "year_desc":
        return [-F.coalesce(year, F.lit(-1))]
    if mode == "cote":
        return [T.french(P.natural_key(F.coalesce("cote", F.lit(""))))]
    raise ValueError(f"no such order: {mode}")


def sort_documents(docs: DataFrame, mode: str) -> DataFrame:
    """`docs` with `place` in the order of `mode` over all of them."""
    return numbered(docs, [*sort_keys(mode), F.col("ingest_rank")])


def order_communes(docs: DataFrame, mode: str) -> DataFrame:
    """(insee, nom, annee, place): communes by their first document's year (unknown last) or by name, names by French collation."""
    per = docs.groupBy("insee").agg(F.min_by("nom", "ingest_rank").alias("nom"), F.min_by("annee", document_order()).alias("annee"))
    name = T.french(F.coalesce("nom", F.lit("")))
    keys = {"name": [name], "year_asc": [F.coalesce("annee", F.lit(9999)), name], "year_desc": [-F.coalesce("annee", F.lit(-1)), name]}[mode]
    return numbered(per, [*keys, F.col("insee")])


def facet_filter(docs: DataFrame, kind: str | None = None, decade: int | None = None, iiif: bool = False, georef: bool = False) -> DataFrame:
    """Documents that meet every facet that is set."""
    if kind is not None:
        docs = docs.where(F.col("type") == kind)
    if decade is not None:
        docs = docs.where((F.col("annee") != 0) & (F.floor(F.col("annee") / 10) * 10 == decade))
    if iiif:
        docs = docs.where(F.coalesce(F.col("iiif_manifest") != "", F.lit(False)))
    if georef:
        docs = docs.where(F.coalesce(F.col("georef_url") != "", F.lit(False)))
    return docs


def dept_filter(docs: DataFrame, dept: str) -> DataFrame:
    return docs.where(F.startswith("insee", F.lit(dept)))


def viewport_topk(communes: DataFrame, documented: DataFrame, bounds: tuple[float, float, float, float], zoom: float, selected: str | None = None, k: int = 12, least_zoom: float = 11) -> DataFrame:
    """(insee, nom, place, total): the first k documented communes in view by name (French collation); a selected one beyond them comes first, with k - 1 others."""
    if zoom < least_zoom:
        communes = communes.limit(0)
    seen = communes.where(P.in_viewport("lon", "lat", *bounds)).join(documented.select("insee").distinct(), "insee", "left_semi")
    name = [T.french("nom"), F.col("insee")]
    total = seen.agg(F.count("*").alias("total"))
    # The first k and the selected one: each task hands on k + 1 rows at most.
    first = seen.orderBy(*name).limit(k).withColumn("n", F.lit(1))
    chosen = seen.where(F.col("insee") == F.lit(selected)).withColumn("n", F.lit(0))
    top = first.union(chosen).groupBy("insee", "nom").agg(F.max("n").alias("n"))
    place = F.row_number().over(Window.orderBy("n", T.french("nom"), "insee"))
    return top.withColumn("place", place).where(F.col("place") <= k).select("insee", "nom", "place").join(F.broadcast(total), F.lit(True))


def search_communes(communes: DataFrame, text: str, k: int = 8, least: int = 2) -> DataFrame:
    """(insee, nom, place): communes whose key begins with the text's, exact ones and populous ones first."""
    if len(text.strip()) < least:
        communes = communes.limit(0)
    key, want = T.key_spaced("nom"), T.key_spaced(F.lit(text))
    hits = communes.where(F.startswith(key, want))
    place = F.row_number().over(Window.orderBy(F.desc(key == want), F.desc("population"), "insee"))
    return hits.withColumn("place", place).where(F.col("place") <= k).select("insee", "nom", "place")


def search_documented(communes: DataFrame, docs: DataFrame, text: str, first: int = 25, k: int = 8) -> DataFrame:
    """As search_communes, but of the first `first` only those in departments that have documents."""
    hits = search_communes(communes, text, first, 3)
    depts = docs.select(T.department("insee").alias("d_")).distinct()
    some = hits.join(depts, T.department("insee") == F.col("d_"), "left_semi")
    return some.withColumn("place", F.row_number().over(Window.orderBy("place"))).where(F.col("place") <= k)


def communes_in_documented_depts(communes: DataFrame, docs: DataFrame) -> DataFrame:
    depts = docs.select(T.department("insee").alias("d_")).distinct()
    return communes.join(depts, F.col("dept") == F.col("d_"), "left_semi")


def missing_communes(expected: DataFrame, docs: DataFrame) -> DataFrame:
    return expected.join(docs.select("insee").distinct(), "insee", "left_anti")


def sort_plates(plates: DataFrame) -> DataFrame:
    """plates (root, rank, id) with `place` within the root."""
    return plates.withColumn("place", F.row_number().over(Window.partitionBy("root").orderBy(F.asc_nulls_last("rank"), "id")))


def commune_route(rows: DataFrame, base: str = "/") -> DataFrame:
    """rows (insee, dept) with `route` and `card`; null for departments of no region."""
    regions = region_dim(rows.sparkSession).select("dept", "region")
    tail = F.when(F.col("region").isNotNull(), F.concat_ws("/", "region", "dept", "insee"))
    return rows.join(regions, "dept", "left").withColumn("route", F.concat(F.lit(base), tail)).withColumn("card", F.concat(F.lit(f"{base}card/"), tail)).drop("region")


def sample_first_n(rows: DataFrame, n: int, rank: str = "rank") -> DataFrame:
    return rows.orderBy(rank).limit(n)


def union_sources(done: DataFrame, branches: list[DataFrame], key: str) -> DataFrame:
    """`done` and the rows of those branches whose key isn't in it yet."""
    new = branches[0]
    for b in branches[1:]:
        new = new.unionByName(b, allowMissingColumns=True)
    return done.unionByName(new.join(done.select(key).distinct(), key, "left_anti").select(*new.columns), allowMissingColumns=True)


def regression_diff(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that only one side has, as often as it has more of them, with `side`; only parts whose digests differ are compared."""
    a, b = where_they_differ(a, b, columns)
    return a.exceptAll(b).withColumn("side", F.lit("a")).union(b.exceptAll(a).withColumn("side", F.lit("b")))
