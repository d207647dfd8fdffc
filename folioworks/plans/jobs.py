"""Whole jobs: notices to documents, finding-aid trees to documents, annotation refresh and statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.functions import parse as P
from folioworks.functions import text as T
from folioworks.operators import load, resolve, stats, tree
from folioworks.operators.shared import first_wins, keep


@dataclass(frozen=True)
class SourceProfile:
    """What differs between sources."""

    title_profile: str = "manifest"
    year_dialect: str = "prefix4"
    year_min: int | None = 1780
    year_max: int | None = 1860
    places: tuple[str, ...] = ("Nord",)
    most_outside: float = 0.05


def documents_from_notices(notices: DataFrame, alias: DataFrame, communes: DataFrame, profile: SourceProfile = SourceProfile(), expected: list[str] | None = None) -> DataFrame:
    """Documents of a fund: parse, keep the period, resolve each distinct name once, guard, classify, one row for each URL.

    notices: (rank, title, year_raw, dept_expected, commune_raw, ident, cote, service_id, manifest_url, image_url, archive_url).
    """
    n = notices.withColumn("annee", P.parse_year("year_raw", profile.year_dialect)).where(P.in_period("annee", profile.year_min, profile.year_max))
    names = resolve.distinct_names(n, "commune_raw", "dept_expected")
    clean = names.select(F.col("dept").alias("d_"), F.col("name").alias("raw_"), F.col("dept"), T.clean_commune_paren("name", list(profile.places)).alias("name"))
    by_alias = resolve.resolve_by_alias(clean.select("dept", "name").distinct(), alias).withColumnRenamed("code", "by_alias")
    codes = resolve.resolve_by_name(by_alias, communes).select("dept", "name", F.coalesce("by_alias", "code").alias("insee"))
    table = keep(clean.join(codes, ["dept", "name"]).where("insee is not null").select("d_", "raw_", "insee"), "names")
    n = n.join(table, (F.col("dept_expected") == F.col("d_")) & (F.col("commune_raw") == F.col("raw_")), "left").drop("d_", "raw_")
    if expected is not None:
        resolve.department_guard(n, expected, profile.most_outside)
    n = first_wins(n.where("insee is not null"), ["archive_url"], "rank")
    # A title's class becomes three columns by one evaluation, after the rows that fall away.
    n = n.select("*", P.parse_ident("ident")["plate"].alias("plate_"), F.inline(F.array(P.classify("title", profile.title_profile))).alias("type", "section_lettre", "feuille_"))
    sheet = F.coalesce("feuille_", F.when(F.col("type") == P.FEUILLE, F.col("plate_")))
    return n.select(F.col("rank").alias("ingest_rank"), "insee", "type", "section_lettre", sheet.alias("feuille_num"), "annee", "cote", "archive_url", F.col("manifest_url").alias("iiif_manifest"), "image_url", "service_id")


def documents_from_tree(nodes: DataFrame, edges: DataFrame, root: str, alias: DataFrame, communes: DataFrame, services: DataFrame, lo: int = 1790, hi: int = 1860) -> DataFrame:
    """Documents of a finding aid: descend with pruning, name each leaf's commune, look up its service, classify."""
    leaves = tree.descend(nodes, edges, root, lo, hi).withColumn("service_id", T.last_segment("service_uri"))
    leaves = resolve.lookup(leaves, services, "service_id", "id", {"dept": "dept"})
    steps = [("title", T.commune_from_titles("title", F.lit(None).cast("string"))), ("branch", F.col("commune"))]
    out = resolve.resolve_cascade(leaves.select("id", "dept", "title", "commune", "begin_year", "manifest", "service_id"), alias, communes, steps)
    return out.select("id", "insee", "method", P.classify("title", "finding_aid")["type"].alias("type"), F.col("begin_year").alias("annee"), F.col("manifest").alias("iiif_manifest"), "service_id")


def refresh(docs: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with refreshed annotations, statistics by department with the share that is georeferenced)."""
    fresh = load.apply_georef(docs, load.diff_georef(docs, annotations))
    by_dept = stats.stats_by_dept(fresh)
    return fresh, by_dept.join(stats.georef_pct(by_dept, stats.georef_count_by_dept(fresh)), "dept")
