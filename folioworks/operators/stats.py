"""Aggregates over the catalogue: departments, regions, facets, communes, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.functions import parse as P
from folioworks.functions import text as T

# The regions and their departments.
REGIONS = {
    "ara": ("Auvergne-Rhône-Alpes", "01 03 07 15 26 38 42 43 63 69 73 74"),
    "bfc": ("Bourgogne-Franche-Comté", "21 25 39 58 70 71 89 90"),
    "bre": ("Bretagne", "22 29 35 56"),
    "cvl": ("Centre-Val de Loire", "18 28 36 37 41 45"),
    "cor": ("Corse", "2A 2B"),
    "ges": ("Grand Est", "08 10 51 52 54 55 57 67 68 88"),
    "hdf": ("Hauts-de-France", "02 59 60 62 80"),
    "idf": ("Île-de-France", "75 77 78 91 92 93 94 95"),
    "nor": ("Normandie", "14 27 50 61 76"),
    "naq": ("Nouvelle-Aquitaine", "16 17 19 23 24 33 40 47 64 79 86 87"),
    "occ": ("Occitanie", "09 11 12 30 31 32 34 46 48 65 66 81 82"),
    "pdl": ("Pays de la Loire", "44 49 53 72 85"),
    "pac": ("Provence-Alpes-Côte d'Azur", "04 05 06 13 83 84"),
}
# Departments whose overviews are georeferenced at the source.
GEOREF_AT_SOURCE = ("92", "93")
KINDS = (P.TABLEAU, P.SECTION, P.FEUILLE)


def region_dim(spark) -> DataFrame:
    return spark.createDataFrame([(r, nom, d) for r, (nom, depts) in REGIONS.items() for d in depts.split()], "region string, region_nom string, dept string")


def _dept(docs: DataFrame) -> DataFrame:
    return docs.withColumn("dept", T.department("insee")).where("dept is not null")


def stats_by_dept(docs: DataFrame) -> DataFrame:
    """(dept, total, overlay_ok, with_iiif, assemblages, sections, feuilles, communes)."""
    return _dept(docs).groupBy("dept").agg(
        F.count("*").alias("total"), F.count_if("licence_overlay_ok").alias("overlay_ok"), F.count("iiif_manifest").alias("with_iiif"),
        *(F.count_if(F.col("type") == k).alias(n) for k, n in zip(KINDS, ("assemblages", "sections", "feuilles"), strict=True)), F.countDistinct("insee").alias("communes"))


def georef_count_by_dept(docs: DataFrame) -> DataFrame:
    """(dept, georef): overviews with an annotation."""
    return _dept(docs).where((F.col("type") == P.TABLEAU) & F.col("georef_url").isNotNull()).groupBy("dept").agg(F.count("*").alias("georef"))


def georef_pct(stats: DataFrame, georef: DataFrame) -> DataFrame:
    """(dept, pct): share of overviews that are georeferenced, in whole percent; fixed at 100 where the source does it."""
    share = F.floor(100 * F.coalesce("georef", F.lit(0)) / F.col("assemblages") + 0.5)
    pct = F.when(F.col("dept").isin(*GEOREF_AT_SOURCE), 100).when(F.col("assemblages") > 0, share).otherwise(0)
    return stats.join(georef, "dept", "left").select("dept", pct.cast("int").alias("pct"))


def stats_by_region(stats: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, region_nom, documents, present, departments): every region, those without data too; departments of no region drop out."""
    out = regions.join(stats.select("dept", "total"), "dept", "left").groupBy("region", "region_nom")
    return out.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("documents"), F.count("total").alias("present"), F.count("*").alias("departments"))


def stats_rollup(docs: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, dept, total, level) for departments, regions and the whole in one pass; level 0, 1 and 3."""
    return _dept(docs).join(regions.select("dept", "region"), "dept").rollup("region", "dept").agg(F.count("*").alias("total"), F.grouping_id().cast("int").alias("level"))


def load_check(docs: DataFrame, dept: str) -> DataFrame:
    own = docs.where(F.startswith("insee", F.lit(dept)))
    return own.agg(F.countDistinct("insee").alias("communes"), F.count("*").alias("total"), F.count_if(F.col("type") == P.TABLEAU).alias("assemblages"), F.count_if("licence_overlay_ok").alias("overlay"))


def facet_counts(docs: DataFrame) -> DataFrame:
    """(facet, value, n) for type, decade, iiif and georef over all rows: grouping sets in one shuffle; facets of 0 don't occur."""
    decade = F.when(F.col("annee").isNotNull() & (F.col("annee") != 0), (F.floor(F.col("annee") / 10) * 10).cast("string"))
    base = docs.select("type", decade.alias("decade"), F.when(F.col("iiif_manifest") != "", "yes").alias("iiif"), F.when(F.col("georef_url") != "", "yes").alias("georef"))
    long = base.select(F.explode(F.create_map(*(x for c in base.columns for x in (F.lit(c), F.col(c))))).alias("facet", "value"))
    return long.where("value is not null").groupBy("facet", "value").agg(F.count("*").alias("n"))


def document_order():
    """Order of a commune's documents: type, letter and number, nulls first."""
    return F.struct("type", F.col("section_lettre").isNotNull(), "section_lettre", F.col("feuille_num").isNotNull(), "feuille_num", "ingest_rank")


def _first(value, when):
    return F.min_by(F.when(when, value), F.when(when, document_order()))


def commune_card(docs: DataFrame) -> DataFrame:
    """(insee, overview, manifest, image, plates): an overview's own manifest and image come first; plates are sections, then sheets."""
    some = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    ta = F.col("type") == P.TABLEAU
    label = F.when(some("section_lettre"), F.concat(F.lit("Sect. "), "section_lettre")).when(some("cote"), F.col("cote"))
    label = F.coalesce(label, F.when(F.col("feuille_num") != 0, F.concat(F.lit("Feuille "), F.col("feuille_num").cast("string"))), F.lit("Planche"))
    label = F.concat(label, F.when(some("section_lettre") & F.coalesce(F.col("feuille_num") != 0, F.lit(False)), F.concat(F.lit(" f."), F.col("feuille_num").cast("string"))).otherwise(""))
    plate = F.when(F.col("type").isin(P.SECTION, P.FEUILLE), F.struct((F.col("type") == P.FEUILLE).alias("a"), document_order().alias("o"), label.alias("label")))
    out = docs.groupBy("insee").agg(
        _first(F.col("archive_url"), ta).alias("overview"), _first(F.struct(F.nullif("iiif_manifest", F.lit("")).alias("m"), F.nullif("image_url", F.lit("")).alias("i")), ta).alias("own"),
        _first(F.col("iiif_manifest"), some("iiif_manifest")).alias("m"), _first(F.col("image_url"), some("image_url")).alias("i"), F.array_sort(F.collect_list(plate)).alias("p"))
    return out.select("insee", "overview", F.coalesce("own.m", "m").alias("manifest"), F.coalesce("own.i", "i").alias("image"), F.transform("p", lambda x: x["label"]).alias("plates"))


def commune_status(docs: DataFrame, annotations: DataFrame) -> DataFrame:
    """(insee, status, manifest): absent, iiif_only, georef_ready or georef, by the first overview that has a manifest."""
    ta = F.col("type") == P.TABLEAU
    first = _first(F.struct("iiif_manifest", "licence_overlay_ok"), ta & F.col("iiif_manifest").isNotNull())
    per = docs.groupBy("insee").agg(F.max(ta).alias("any"), first.alias("f")).withColumn("id", T.annotation_id("f.iiif_manifest"))
    found = annotations.where("items > 0").select(F.col("id").alias("id_")).distinct()
    per = per.join(found, F.col("id") == F.col("id_"), "left")
    status = F.when(~F.col("any"), "absent").when(F.col("f").isNull() | ~F.coalesce("f.licence_overlay_ok", F.lit(False)), "iiif_only").when(F.col("id_").isNotNull(), "georef").otherwise("georef_ready")
    return per.select("insee", status.alias("status"), F.col("f.iiif_manifest").alias("manifest"))


def source_attribution(docs: DataFrame) -> DataFrame:
    """(source, source_url): each source with the first URL seen."""
    return docs.where("source is not null").groupBy("source").agg(F.min_by("source_url", F.when(F.col("source_url").isNotNull(), F.col("ingest_rank"))).alias("source_url"))


def corpus_profile(plates: DataFrame, lo: int, hi: int, expected: list[str], names: DataFrame | None = None, families: int = 8) -> DataFrame:
    """(point, value, n): the checks before a load. plates: (manifest_ok, commune, ident, annee, type, image, insee).

    The `families` commonest families of identifiers stay, ties by name. year_min and year_max hold the extreme years.
    names: (name, code) of known communes; a name of several codes is a row `ambiguous` with their number.
    """
    inside = F.when(F.col("annee").isNull(), "undated").when(F.col("annee").between(lo, hi), "in period").otherwise("out of period")
    form = F.concat(F.when(F.col("commune").isNull(), "0").otherwise(F.size(F.split("commune", r"[(,/]")).cast("string")), F.lit(" parts"))
    points = {
        "read": F.when(F.col("manifest_ok"), "read").otherwise("failed"), "commune": form, "ident": P.ident_family("ident"), "year": inside,
        "decade": (F.floor(F.col("annee") / 10) * 10).cast("string"), "type": F.col("type"), "image": F.when(F.col("image").isNull(), "missing").otherwise("present"),
        "insee": F.when(F.col("insee").isNull(), "unresolved").when(T.department("insee").isin(expected), "inside").otherwise("outside"),
    }
    long = plates.select(F.explode(F.create_map(*(x for k, c in points.items() for x in (F.lit(k), c)))).alias("point", "value"))
    counts = long.where("value is not null").groupBy("point", "value").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("point").orderBy(F.desc("n"), "value"))
    top = counts.where("point = 'ident'").withColumn("place", place).where(F.col("place") <= families).drop("place")
    out = counts.where("point <> 'ident'").union(top)
    for name, pick in (("year_min", F.min), ("year_max", F.max)):
        out = out.union(plates.agg(pick("annee").cast("string").alias("value")).where("value is not null").select(F.lit(name), "value", F.lit(1).cast("long")))
    if names is not None:
        several = names.groupBy("name").agg(F.countDistinct("code").alias("n")).where("n > 1")
        out = out.union(several.select(F.lit("ambiguous"), "name", "n"))
    return out


# Texts by which a manifest states its licence.
LICENCES = ((("licence ouverte", "etalab", "open licence"), "Licence Ouverte"), (("creativecommons.org/licenses/by", "cc-by"), "CC-BY"), (("publicdomain", "domaine public"), "Domaine public"))


def licence_by_service(leaves: DataFrame, manifests: DataFrame, overrides: DataFrame) -> DataFrame:
    """(service_id, licence, overlay_ok): a table entry wins, else the text of the service's first manifest; null text is unchecked.

    leaves: (service_id, manifest, rank); manifests: (manifest, text); overrides: (service_id, licence, overlay_ok).
    """
    first = leaves.where("manifest is not null").groupBy("service_id").agg(F.min_by("manifest", "rank").alias("manifest"))
    services = leaves.select("service_id").distinct().join(first, "service_id", "left").join(manifests, "manifest", "left")
    text, found = F.lower("text"), F.lit(None).cast("string")
    for words, name in reversed(LICENCES):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        found = F.when(hit, name).otherwise(found)
    o = overrides.select("service_id", F.col("licence").alias("lo"), F.col("overlay_ok").alias("oo"))
    out = services.join(o, "service_id", "left")
    return out.select("service_id", F.coalesce("lo", found, F.lit("À vérifier")).alias("licence"), F.coalesce("oo", found.isNotNull()).alias("overlay_ok"))


# Names of viewer families.
VIEWERS = ("Ligeo", "Mnesys", "Arkothèque", "Archinoë", "Bach", "Naoned", "Thot")


def national_levels(inventory: DataFrame, departments: int = 95) -> DataFrame:
    """(measure, n, pct) over (num, source, formats, etat, licence): levels N0-N5 and thresholds, IIIF, open licence, verified."""
    level = T.extract("etat", r"N([0-5])").cast("int")
    i = inventory.select(level.alias("level"), F.contains("formats", F.lit("IIIF")).alias("iiif"), F.lower("licence").contains("ouverte").alias("open"), F.contains("etat", F.lit("✅")).alias("verified"))
    hits = [*((f"N{k}", F.col("level") == k) for k in range(6)), (">=N4", F.col("level") >= 4), (">=N3", F.col("level") >= 3), ("IIIF", F.col("iiif")), ("open", F.col("open")), ("verified", F.col("verified"))]
    one = i.agg(*(F.count_if(c).alias(n) for n, c in hits))
    long = one.select(F.explode(F.create_map(*(x for n, _ in hits for x in (F.lit(n), F.col(f"`{n}`"))))).alias("measure", "n"))
    return long.select("measure", "n", F.floor(100 * F.col("n") / departments + 0.5).cast("int").alias("pct"))


def viewer_family(source):
    name = F.lit(None).cast("string")
    for v in reversed(VIEWERS):
        name = F.when(F.contains(F.lower(T.col(source)), F.lit(v.lower())), v).otherwise(name)
    return name


def alphabetical_coverage(rows: DataFrame, fund: str, name: str) -> DataFrame:
    """(fund, first, last, missing): initials of the names and those between first and last that don't occur."""
    initial = F.upper(F.substring(T.fold_accents(name), 1, 1))
    per = rows.select(F.col(fund).alias("fund"), initial.alias("i")).where(F.col("i").rlike("^[A-Z]$")).groupBy("fund")
    per = per.agg(F.min("i").alias("first"), F.max("i").alias("last"), F.collect_set("i").alias("seen"))
    every = F.transform(F.sequence(F.ascii("first"), F.ascii("last")), lambda c: F.chr(c))
    return per.select("fund", "first", "last", F.array_join(F.array_except(every, "seen"), "").alias("missing"))


def completeness_check(pages: DataFrame, announced: DataFrame, least: float = 0.98) -> DataFrame:
    """(fund, collected, announced, verdict). pages: (fund, page, arks). stuck: a page holds nothing that the one before lacks."""
    before = F.lag("arks").over(Window.partitionBy("fund").orderBy("page"))
    stuck = F.coalesce((F.size("arks") > 0) & (F.size(F.array_except("arks", before)) == 0), F.lit(False))
    p = pages.withColumn("stuck", stuck)
    n = p.select("fund", F.explode("arks").alias("ark")).groupBy("fund").agg(F.countDistinct("ark").alias("collected"))
    out = announced.join(n, "fund", "left").join(p.groupBy("fund").agg(F.max("stuck").alias("stuck")), "fund", "left").withColumn("collected", F.coalesce("collected", F.lit(0)))
    verdict = F.when(F.col("stuck"), "stuck").when(F.col("collected") < least * F.col("announced"), "incomplete").when(F.col("collected") != F.col("announced"), "differs").otherwise("complete")
    return out.select("fund", "collected", "announced", verdict.alias("verdict"))


def extent(communes: DataFrame) -> DataFrame:
    """(insee, west, south, east, north) of rings of (lon, lat)."""
    flat = F.flatten("rings")
    of = lambda f, k: f(F.transform(flat, lambda p: p[k]))
    return communes.select("insee", of(F.array_min, "lon").alias("west"), of(F.array_min, "lat").alias("south"), of(F.array_max, "lon").alias("east"), of(F.array_max, "lat").alias("north"))


def duplicates_report(docs: DataFrame, key: str = "archive_url") -> DataFrame:
    return docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def lieu_by_cote_root(plates: DataFrame) -> DataFrame:
    """(root, lieu): the place of a shelf mark's first readable plate. plates: (root, rank, lieu)."""
    return plates.where("root is not null and lieu is not null").groupBy("root").agg(F.min_by("lieu", F.struct("rank", "lieu")).alias("lieu"))
