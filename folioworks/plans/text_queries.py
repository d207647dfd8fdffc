"""Queries of the text and parsing functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.functions import parse as P
from folioworks.functions import text as T
from folioworks.plans.registry import query

IMAGES, BASE = "https://tiles.example", "https://data.example"


@query(r"SELECT rank, trim(regexp_replace(title || '  ' || commune_raw, '\s+', ' ', 'g')) AS name FROM v_notice")
def norm_ws(view):
    return view("v_notice").select("rank", T.norm_ws(F.concat("title", F.lit(" \t "), "commune_raw")).alias("name"))


@query("SELECT insee, strip_accents(nom) AS name FROM v_commune")
def fold_accents(view):
    return view("v_commune").select("insee", T.fold_accents("nom").alias("name"))


@query(r"SELECT insee, trim(regexp_replace(strip_accents(lower(nom)), '[\s\-'']+', ' ', 'g')) AS key FROM v_commune")
def key_spaced(view):
    return view("v_commune").select("insee", T.key_spaced("nom").alias("key"))


@query(r"SELECT insee, trim(regexp_replace(strip_accents(lower(replace(nom, '''', '’'))), '[\s\-’]+', ' ', 'g')) AS key FROM v_commune")
def key_spaced_curly(view):
    """Names written with curly apostrophes, which count as straight ones."""
    return view("v_commune").select("insee", T.key_spaced(F.replace("nom", F.lit("'"), F.lit("’")), curly=True).alias("key"))


@query("SELECT insee, regexp_replace(lower(strip_accents(nom)), '[^a-z0-9]+', '', 'g') AS key FROM v_commune")
def key_compact(view):
    return view("v_commune").select("insee", T.key_compact("nom").alias("key"))


@query(r"SELECT rank, nullif(regexp_replace(str_split(regexp_replace(regexp_replace(commune_raw, '\(.*?\)', '', 'g'), '\[.*?\]', '', 'g'), ',')[1], '^[\s.]+|[\s.]+$', '', 'g'), '') AS name FROM v_notice")
def clean_commune_listed(view):
    return view("v_notice").select("rank", T.clean_commune_listed("commune_raw").alias("name"))


@query(r"""
    WITH n AS (SELECT rank, trim(rtrim(trim(commune_raw), '.')) AS n FROM v_notice),
    p AS (SELECT rank, n, regexp_matches(n, '^(.*?)\s*\((.*)\)\s*$') AS b, regexp_extract(n, '^(.*?)\s*\((.*)\)\s*$', 1) AS head,
                 list_filter(list_transform(str_split(regexp_extract(n, '^(.*?)\s*\((.*)\)\s*$', 2), ','), lambda x: trim(x)), lambda x: x <> '' AND lower(x) NOT IN ('nord', 'france')) AS inside FROM n)
    SELECT rank, trim(str_split(CASE WHEN b THEN coalesce(inside[1], head) ELSE n END, '/')[-1]) AS name FROM p""")
def clean_commune_paren(view):
    return view("v_notice").select("rank", T.clean_commune_paren("commune_raw", ["Nord"]).alias("name"))


@query(r"SELECT rank, trim(str_split(regexp_replace(trim(rtrim(trim(commune_raw), '.')), '\s*\(.*?\)\s*$', ''), '/')[-1]) AS name FROM v_notice")
def clean_commune_slash(view):
    return view("v_notice").select("rank", T.clean_commune_slash("commune_raw").alias("name"))


@query("""
    SELECT insee, CASE WHEN nom LIKE 'Les %' THEN nom WHEN nom LIKE 'L''%' THEN nom ELSE nom END AS name FROM v_commune""")
def reorder_article(view):
    nom = F.col("nom")
    turned = F.when(F.startswith(nom, F.lit("Les ")), F.concat(F.substring(nom, 5, 100), F.lit(" (Les)"))).when(
        F.startswith(nom, F.lit("L'")), F.concat(F.substring(nom, 3, 100), F.lit(" (L’)"))).otherwise(nom)
    return view("v_commune").select("insee", T.reorder_article(turned).alias("name"))


@query(r"""
    SELECT id, CASE WHEN t <> '' AND NOT regexp_matches(lower(t), '^(tableau|section|plan|feuille|matrice|état|etat|atlas|registre|cadastre)')
                    THEN regexp_replace(regexp_replace(t, '[\s,]+\d{3,4}.*$', ''), '^[\s.,]+|[\s.,]+$', '', 'g') ELSE parent END AS name
    FROM (SELECT n.id, trim(coalesce(n.title, '')) AS t, p.title AS parent FROM v_node n JOIN v_edge e ON n.id = e.child_id JOIN v_node p ON e.parent_id = p.id) x""")
def commune_from_titles(view):
    n, p, e = view("v_node"), view("v_node").select(F.col("id").alias("parent_id"), F.col("title").alias("parent")), view("v_edge")
    both = n.join(e, n["id"] == e["child_id"]).join(p, "parent_id")
    return both.select("id", T.commune_from_titles("title", "parent").alias("name"))


@query(r"SELECT id, regexp_matches(title, '(?i)^(sections?|feuilles?|tableaux?|matrices?|registres?|listes?|folios?|cases\s|renvois|proc[èe]s|limites|[ée]tats?|atlas|cadastres?|plans?\s)') AS rubric FROM v_node")
def is_rubric_title(view):
    return view("v_node").select("id", T.is_rubric_title("title").alias("rubric"))


@query(r"SELECT insee, regexp_matches(label, '(?i);\s*(d[ée]partement|r[ée]gion|pays|canton|arrondissement|province)\s*\)') AS other FROM (SELECT insee, nom || CASE WHEN custkey % 4 = 0 THEN ' (France ; Département)' WHEN custkey % 4 = 1 THEN ' (France; canton )' ELSE ' (France)' END AS label FROM v_commune) x")
def is_non_commune_place(view):
    k = F.col("custkey") % 4
    label = F.concat("nom", F.when(k == 0, F.lit(" (France ; Département)")).when(k == 1, F.lit(" (France; canton )")).otherwise(F.lit(" (France)")))
    return view("v_commune").select("insee", T.is_non_commune_place(label).alias("other"))


@query("SELECT ingest_rank, url_encode(cote || '*~é ' || archive_url) AS quoted FROM v_document")
def url_quote(view):
    return view("v_document").select("ingest_rank", T.url_quote(F.concat("cote", F.lit("*~é "), "archive_url")).alias("quoted"))


@query("SELECT ingest_rank, 'https://tiles.example/static-manifest?u=' || url_encode(image_url) AS url FROM v_document")
def static_manifest_url(view):
    return view("v_document").select("ingest_rank", T.static_manifest_url("image_url", IMAGES).alias("url"))


@query("SELECT ingest_rank, substr(sha1(iiif_manifest), 1, 16) AS id FROM v_document")
def annotation_id(view):
    return view("v_document").select("ingest_rank", T.annotation_id("iiif_manifest").alias("id"))


@query("SELECT id, str_split(rtrim(service_uri, '/'), '/')[-1] AS service FROM v_node")
def last_segment(view):
    return view("v_node").select("id", T.last_segment("service_uri").alias("service"))


@query("SELECT id, replace(service_uri, 'https://data.example/', 'https://data.example/fr/') AS url FROM v_node")
def public_url(view):
    return view("v_node").select("id", T.public_url("service_uri", BASE).alias("url"))


_NUM = r"TRY_CAST(nullif(regexp_extract(title, '(?i)Feuille\s+(\d+)', 1), '') AS INTEGER)"
_FREE = "CASE WHEN num IS NOT NULL THEN 'feuille' WHEN letter IS NOT NULL THEN 'section' ELSE 'feuille' END"


def _classify(view, profile):
    return view("v_notice").select("rank", P.classify("title", profile).alias("c")).select("rank", "c.*")


@query("""SELECT rank, CASE WHEN lower(title) LIKE '%tableau%' THEN 'tableau_assemblage' WHEN lower(title) LIKE '%section%' THEN 'section' ELSE 'feuille' END AS type,
          CAST(NULL AS VARCHAR) AS section_lettre, CAST(NULL AS INTEGER) AS feuille_num FROM v_notice""")
def classify_finding_aid(view):
    return _classify(view, "finding_aid")


@query(rf"""SELECT rank, CASE WHEN ta THEN 'tableau_assemblage' ELSE {_FREE} END AS type, CASE WHEN NOT ta THEN letter END AS section_lettre, CASE WHEN NOT ta THEN num END AS feuille_num
    FROM (SELECT rank, regexp_matches(title, '(?i)tableau|plan\s+g[ée]n[ée]ral') AS ta, {_NUM} AS num, nullif(regexp_extract(title, '(?:^|\s)Sections?\s+([A-Z]{{1,2}})(?:[\s.,]|$)', 1), '') AS letter FROM v_notice) x""")
def classify_manifest(view):
    return _classify(view, "manifest")


@query(rf"""SELECT rank, CASE WHEN ta THEN 'tableau_assemblage' ELSE {_FREE} END AS type, letter AS section_lettre, CASE WHEN NOT ta THEN num END AS feuille_num
    FROM (SELECT rank, regexp_matches(title, '(?i)tableau|plan\s+g[ée]n[ée]ral') AS ta, {_NUM} AS num,
                 coalesce(nullif(regexp_extract(title, '(?:^|\s)Section\s+([A-Z]{{1,2}})(?:[\s.,]|$)', 1), ''), nullif(regexp_extract(title, '^Sections?\s+([A-Z])(?:[\s.,]|$)', 1), '')) AS letter FROM v_notice) x""")
def classify_inventory(view):
    return _classify(view, "inventory")


@query(r"""SELECT rank, CASE WHEN regexp_matches(title, '(?i)tableau\s+d.assemb|atlas|ta([^\p{L}\p{N}_]|$)') THEN 'tableau_assemblage' ELSE 'feuille' END AS type,
          CAST(NULL AS VARCHAR) AS section_lettre, CAST(NULL AS INTEGER) AS feuille_num FROM v_notice""")
def classify_portal(view):
    return _classify(view, "portal")


@query("""SELECT rank, CASE WHEN lower(title) LIKE '%assemblage%' THEN 'tableau_assemblage' WHEN lower(title) LIKE '%section%' THEN 'section' ELSE 'feuille' END AS type,
          CAST(NULL AS VARCHAR) AS section_lettre, CAST(NULL AS INTEGER) AS feuille_num FROM v_notice""")
def classify_open_data(view):
    return _classify(view, "open_data")


@query(r"""SELECT rank, trim(nullif(regexp_extract(r, '^(3\s*P\s*\d+[A-Za-z]?(?:/\d+)?)\s*-\s*(.*)$', 1), '')) AS cote,
                  trim(CASE WHEN regexp_matches(r, '^(3\s*P\s*\d+[A-Za-z]?(?:/\d+)?)\s*-\s*(.*)$') THEN regexp_extract(r, '^(3\s*P\s*\d+[A-Za-z]?(?:/\d+)?)\s*-\s*(.*)$', 2) ELSE r END) AS title, year
    FROM (SELECT rank, trim(CASE WHEN y IS NOT NULL THEN str_split(line, '|')[1] ELSE line END) AS r, y AS year
          FROM (SELECT rank, line, TRY_CAST(nullif(regexp_extract(line, '\|\s*(\d{4})', 1), '') AS INTEGER) AS y
                FROM (SELECT rank, cote || ' - ' || title || coalesce(' | ' || year_raw, '') AS line FROM v_notice) a) b) c""")
def parse_title_line(view):
    line = F.concat("cote", F.lit(" - "), "title", F.coalesce(F.concat(F.lit(" | "), "year_raw"), F.lit("")))
    return view("v_notice").select("rank", P.parse_title_line(line).alias("p")).select("rank", "p.*")


@query(r"SELECT rank, upper(nullif(regexp_extract(cote, '(?i)^3\s*P\s*(\d+[A-Z]?)(?:/(\d+))?$', 1), '')) AS root, TRY_CAST(nullif(regexp_extract(cote, '(?i)^3\s*P\s*(\d+[A-Z]?)(?:/(\d+))?$', 2), '') AS INTEGER) AS plate FROM v_notice")
def parse_cote(view):
    return view("v_notice").select(F.col("rank"), P.parse_cote("cote").alias("p")).select("rank", "p.root", F.col("p.rank").alias("plate"))


@query(r"SELECT rank, trim(nullif(regexp_extract('AD ' || cote || ' n', '(\d+\s*[WP]\s*[\d\s/]+)', 1), '')) AS cote FROM v_notice")
def parse_cote_free(view):
    return view("v_notice").select("rank", P.parse_cote_free(F.concat(F.lit("AD "), "cote", F.lit(" n"))).alias("cote"))


_YEARS = {"any4": r"(\d{4})", "modern": r"(1[6-9]\d{2})", "prefix4": r"^(\d{4})", "digits": r"^(\d+)$"}


@query("SELECT rank, " + ", ".join(f"TRY_CAST(nullif(regexp_extract(year_raw, '{p}', 1), '') AS INTEGER) AS {k}" for k, p in _YEARS.items()) + " FROM v_notice")
def parse_year(view):
    return view("v_notice").select("rank", *(P.parse_year("year_raw", k).alias(k) for k in _YEARS))


@query("SELECT rank, CASE WHEN regexp_matches(substr(s, 1, 1), '^[A-Za-zÀ-ÿ]$') THEN upper(substr(s, 1, 1)) END AS letter FROM (SELECT rank, trim(CASE WHEN custkey % 3 = 0 THEN ' b2' WHEN custkey % 3 = 1 THEN '12' ELSE title END) AS s FROM v_notice) x")
def section_letter(view):
    k = F.col("custkey") % 3
    return view("v_notice").select("rank", P.section_letter(F.when(k == 0, F.lit(" b2")).when(k == 1, F.lit("12")).otherwise(F.col("title"))).alias("letter"))


@query(r"""
    SELECT ingest_rank, CASE WHEN page = 1 THEN 'tableau_assemblage' ELSE 'feuille' END AS type, CASE WHEN page <> 1 THEN page END AS feuille_num
    FROM (SELECT *, TRY_CAST(nullif(regexp_extract(image_url, '(?i)_(\d{1,3})\.jpe?g$', 1), '') AS INTEGER) AS page FROM v_document) x
    WHERE page IS NOT NULL AND (type IS DISTINCT FROM (CASE WHEN page = 1 THEN 'tableau_assemblage' ELSE 'feuille' END) OR feuille_num IS DISTINCT FROM (CASE WHEN page <> 1 THEN page END))""")
def page_type_changes(view):
    d = view("v_document").select("ingest_rank", "type", "feuille_num", P.page_type("image_url").alias("p")).where("p is not null")
    return d.where(~F.col("type").eqNullSafe(F.col("p.type")) | ~F.col("feuille_num").eqNullSafe(F.col("p.feuille_num"))).select("ingest_rank", "p.*")


@query(r"""SELECT root, CAST(row_number() OVER (ORDER BY CASE WHEN regexp_matches(root, '^\d+[A-Z]?$') THEN CAST(regexp_extract(root, '^(\d+)', 1) AS INTEGER) ELSE 1000000000 END, regexp_extract(root, '^\d+([A-Z]?)$', 1)) AS INTEGER) AS place
    FROM (SELECT DISTINCT regexp_extract(cote, '^3 P (\d+[A-Z]?)', 1) AS root FROM v_notice) x""")
def natural_cote_key(view):
    from pyspark.sql import Window

    roots = view("v_notice").select(P.parse_cote("cote")["root"].alias("root")).distinct()
    return roots.select("root", F.row_number().over(Window.orderBy(P.natural_cote_key("root"))).alias("place"))


@query(r"SELECT root, '3P_' || lpad(regexp_extract(root, '^(\d+)', 1), 3, '0') || regexp_extract(root, '([A-Z]?)$', 1) AS folder FROM (SELECT DISTINCT regexp_extract(cote, '^3 P (\d+[A-Z]?)', 1) AS root FROM v_notice) x")
def image_folder_from_cote(view):
    return view("v_notice").select(P.parse_cote("cote")["root"].alias("root")).distinct().select("root", P.image_folder_from_cote("root").alias("folder"))


@query(r"""
    WITH p AS (SELECT ark, dates, list_filter(list_transform(str_split_regex(label, '[•·|]'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM v_manifest),
    q AS (SELECT ark, dates, CASE WHEN len(parts) >= 2 AND NOT contains(parts[1], ':') THEN parts[1] END AS ident, CASE WHEN len(parts) >= 2 AND NOT contains(parts[1], ':') THEN parts[2:] ELSE parts END AS rest FROM p),
    r AS (SELECT *, list_filter(rest, lambda x: NOT regexp_full_match(x, '1[6-9]\d\d'))[1] AS t, list_filter(rest, lambda x: regexp_full_match(x, '1[6-9]\d\d')) AS ys FROM q)
    SELECT ark, ident, CASE WHEN contains(t, ':') THEN trim(substr(t, strpos(t, ':') + 1)) ELSE t END AS title,
           coalesce(TRY_CAST(ys[-1] AS INTEGER), TRY_CAST(nullif(regexp_extract(dates, '(1[6-9]\d\d)', 1), '') AS INTEGER)) AS year FROM r""")
def parse_manifest_label(view):
    return view("v_manifest").select("ark", P.parse_manifest_label("label", "dates").alias("p")).select("ark", "p.*")


@query(r"SELECT ark, ident AS cote, TRY_CAST(nullif(regexp_extract(ident, '_(\d{1,3})$', 1), '') AS INTEGER) AS plate FROM v_manifest")
def parse_ident(view):
    return view("v_manifest").select("ark", P.parse_ident("ident").alias("p")).select("ark", "p.*")


@query(r"SELECT family, count(*) AS n FROM (SELECT coalesce(regexp_replace(nullif(ident, ''), '\d+', '#', 'g'), '(aucun identifiant)') AS family FROM v_manifest) x GROUP BY family")
def ident_family(view):
    return view("v_manifest").groupBy(P.ident_family("ident").alias("family")).agg(F.count("*").alias("n"))


@query("SELECT ark, nullif(trim(str_split('Fonds > ' || commune, '>')[-1]), '') AS name FROM v_manifest")
def last_context(view):
    return view("v_manifest").select("ark", P.last_context(F.concat(F.lit("Fonds > "), "commune")).alias("name"))


@query("""SELECT ingest_rank, CASE WHEN image_url IS NOT NULL THEN 'image' WHEN iiif_manifest IS NOT NULL THEN 'manifest' WHEN dept IN ('01', '02') THEN 'frozen' ELSE 'none' END AS kind,
          coalesce(image_url, iiif_manifest, CASE WHEN dept IN ('01', '02') THEN '/thumbs/' || dept || '.jpg' END) AS url FROM v_document""")
def thumbnail_choice(view):
    frozen = F.when(F.col("dept").isin("01", "02"), F.concat(F.lit("/thumbs/"), "dept", F.lit(".jpg")))
    return view("v_document").select("ingest_rank", P.thumbnail_choice("image_url", "iiif_manifest", frozen).alias("t")).select("ingest_rank", "t.*")


@query("""SELECT insee, 'POLYGON((' || a || ' ' || b || ', ' || c || ' ' || b || ', ' || c || ' ' || d || ', ' || a || ' ' || d || ', ' || a || ' ' || b || '))' AS wkt
    FROM (SELECT insee, CAST(lon AS VARCHAR) AS a, CAST(lat AS VARCHAR) AS b, CAST(lon + 0.125 AS VARCHAR) AS c, CAST(lat + 0.125 AS VARCHAR) AS d FROM v_commune) x""")
def bbox_wkt(view):
    step = F.lit(0.125).cast("double")
    return view("v_commune").select("insee", P.bbox_wkt("lon", "lat", F.col("lon") + step, F.col("lat") + step).alias("wkt"))


@query("SELECT id FROM v_node WHERE coalesce(begin_year, -1000000000) <= 1860 AND coalesce(end_year, 1000000000) >= 1790")
def period_overlaps(view):
    return view("v_node").where(P.period_overlaps("begin_year", "end_year", 1790, 1860)).select("id")


@query("SELECT ingest_rank, annee IS NULL OR annee BETWEEN 1790 AND 1860 AS fa, annee IS NULL OR annee BETWEEN 1780 AND 1860 AS wide, annee IS NULL OR annee <= 1830 AS early FROM v_document")
def in_period(view):
    return view("v_document").select("ingest_rank", P.in_period("annee", 1790, 1860).alias("fa"), P.in_period("annee", 1780, 1860).alias("wide"), P.in_period("annee", None, 1830).alias("early"))


@query("SELECT id FROM v_node WHERE regexp_matches(title, '(?i)rénov|renov|intendance|masse de culture')")
def excluded_branch(view):
    return view("v_node").where(P.excluded_branch("title")).select("id")


@query(r"""SELECT id FROM v_node WHERE regexp_matches(title, '(?i)plan|atlas|cadastr|tableau\s+d[''e ]assemblage|assemblage|(^|[^\p{L}\p{N}_])section([^\p{L}\p{N}_]|$)')
    AND NOT regexp_matches(title, '(?i)matric|mutation|(^|[^\p{L}\p{N}_])[ée]tats?([^\p{L}\p{N}_]|$)|registre|répertoire|repertoire|(^|[^\p{L}\p{N}_])table([^\p{L}\p{N}_]|$)|classement|arpentage|proc[èe]s|délimitation|delimitation|limites?\s+de\s+commune|propri[ée]t|(^|[^\p{L}\p{N}_])folios?([^\p{L}\p{N}_]|$)|sommier|r[ée]nov|remembr')""")
def is_plans_title(view):
    return view("v_node").where(P.is_plans_title("title")).select("id")


@query(r"SELECT id FROM v_node WHERE regexp_matches(title, '(?i)atlas\s+parcellaire|tableau\s+d|plan')")
def keep_leaf_title(view):
    return view("v_node").where(P.keep_leaf_title("title")).select("id")


@query("SELECT insee FROM v_commune WHERE lon BETWEEN -3 AND 4.5 AND lat BETWEEN 42 AND 43")
def in_viewport(view):
    return view("v_commune").where(P.in_viewport("lon", "lat", -3, 42, 4.5, 43)).select("insee")
