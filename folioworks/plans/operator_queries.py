"""Queries of the resolving, tree, statistics, browsing and loading operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.functions import parse as P
from folioworks.functions import text as T
from folioworks.operators import browse, euler, load, resolve, stats, tree
from folioworks.operators.shared import first_wins as first
from folioworks.operators.shared import last_wins as last
from folioworks.operators.shared import numbered
from folioworks.plans.registry import query

_KEY = r"trim(regexp_replace(strip_accents(lower({0})), '[\s\-'']+', ' ', 'g'))"
_COMPACT = "regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', '', 'g')"
_LISTED = r"nullif(regexp_replace(str_split(regexp_replace(regexp_replace({0}, '\(.*?\)', '', 'g'), '\[.*?\]', '', 'g'), ',')[1], '^[\s.]+|[\s.]+$', '', 'g'), '')"


def _names(view):
    return resolve.distinct_names(view("v_notice"), "commune_raw", "dept_expected")


_NAMES = "(SELECT DISTINCT dept_expected AS dept, commune_raw AS name FROM v_notice)"
_ALIAS = f"(SELECT dept, {_KEY.format('name')} AS key, min(code) AS code FROM v_alias GROUP BY 1, 2 HAVING count(DISTINCT code) = 1)"


@query(f"SELECT n.dept, n.name, a.code FROM {_NAMES} n LEFT JOIN {_ALIAS} a ON n.dept = a.dept AND {_KEY.format('n.name')} = a.key")
def resolve_by_alias(view):
    return resolve.resolve_by_alias(_names(view), view("v_alias"))


_LOCAL = "(SELECT dept, {k} AS key, min(insee) AS code FROM v_commune GROUP BY 1, 2 HAVING count(DISTINCT insee) = 1)"


@query(f"""
    WITH n AS (SELECT CASE WHEN custkey % 3 = 0 THEN NULL ELSE dept END AS dept, nom AS name FROM v_commune),
    l AS {_LOCAL.format(k=_COMPACT.format('nom'))},
    a AS (SELECT {_COMPACT.format('nom')} AS key, arg_min(insee, (-population, insee)) AS code FROM v_commune GROUP BY 1)
    SELECT n.dept, n.name, CASE WHEN n.dept IS NULL THEN a.code ELSE l.code END AS code
    FROM n LEFT JOIN l ON n.dept = l.dept AND {_COMPACT.format('n.name')} = l.key LEFT JOIN a ON {_COMPACT.format('n.name')} = a.key""")
def resolve_by_name(view):
    names = view("v_commune").select(F.when(F.col("custkey") % 3 != 0, F.col("dept")).alias("dept"), F.col("nom").alias("name"))
    return resolve.resolve_by_name(names, view("v_commune"))


@query(f"""
    SELECT n.name, CASE WHEN h.n = 1 THEN h.code END AS code, coalesce(h.n > 1, false) AS ambiguous
    FROM (SELECT DISTINCT true_nom AS name FROM v_notice) n
    LEFT JOIN (SELECT {_COMPACT.format('nom')} AS key, count(DISTINCT insee) AS n, min(insee) AS code FROM v_commune WHERE dept IN ('01', '02', '03', '04', '05', '06', '07', '08') GROUP BY 1) h ON {_COMPACT.format('n.name')} = h.key""")
def resolve_multi_dept(view):
    return resolve.resolve_multi_dept(view("v_notice").select(F.col("true_nom").alias("name")).distinct(), view("v_commune"), ["01", "02", "03", "04", "05", "06", "07", "08"])


_RUBRIC = r"regexp_matches({0}, '(?i)^(sections?|feuilles?|tableaux?|matrices?|registres?|listes?|folios?|cases\s|renvois|proc[èe]s|limites|[ée]tats?|atlas|cadastres?|plans?\s)')"
_CASCADE = f"""
    WITH n AS (SELECT rank, dept_expected AS dept, {_LISTED.format('title')} AS t, {_LISTED.format('commune_raw')} AS c, {_LISTED.format('true_nom')} AS p FROM v_notice),
    a AS {_ALIAS}, l AS {_LOCAL.format(k=_KEY.format('nom'))},
    names AS (SELECT DISTINCT dept, name FROM (SELECT dept, t AS name FROM n UNION ALL SELECT dept, c FROM n UNION ALL SELECT dept, p FROM n) x WHERE name IS NOT NULL),
    f AS (SELECT names.dept, names.name, coalesce(a.code, CASE WHEN NOT {_RUBRIC.format('names.name')} THEN l.code END) AS code
          FROM names LEFT JOIN a ON names.dept = a.dept AND {_KEY.format('names.name')} = a.key LEFT JOIN l ON names.dept = l.dept AND {_KEY.format('names.name')} = l.key)
    SELECT n.rank, coalesce(f1.code, f2.code, f3.code) AS insee, CASE WHEN f1.code IS NOT NULL THEN 'title' WHEN f2.code IS NOT NULL THEN 'branch' WHEN f3.code IS NOT NULL THEN 'place' END AS method,
           CASE WHEN f1.code IS NOT NULL THEN t WHEN f2.code IS NOT NULL THEN c WHEN f3.code IS NOT NULL THEN p END AS resolved_name
    FROM n LEFT JOIN f f1 ON n.dept = f1.dept AND t = f1.name LEFT JOIN f f2 ON n.dept = f2.dept AND c = f2.name LEFT JOIN f f3 ON n.dept = f3.dept AND p = f3.name"""


@query(_CASCADE)
def resolve_cascade(view):
    n = view("v_notice").select("rank", F.col("dept_expected").alias("dept"), "title", "commune_raw", "true_nom")
    out = resolve.resolve_cascade(n, view("v_alias"), view("v_commune"), [("title", F.col("title")), ("branch", F.col("commune_raw")), ("place", F.col("true_nom"))])
    return out.select("rank", "insee", "method", "resolved_name")


@query("SELECT rank, s.dept AS service_dept, s.name AS service_name FROM v_notice n LEFT JOIN v_service s ON n.service_id = s.id")
def service_lookup(view):
    out = resolve.lookup(view("v_notice"), view("v_service"), "service_id", "id", {"dept": "service_dept", "name": "service_name"})
    return out.select("rank", "service_dept", "service_name")


def _squares(view):
    """Each commune as a square of an eighth of a degree from its point."""
    step = F.lit(0.125).cast("double")
    p = lambda x, y: F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat"))
    zero = F.lit(0).cast("double")
    return view("v_commune").select("insee", F.array(F.array(p(zero, zero), p(step, zero), p(step, step), p(zero, step), p(zero, zero))).alias("rings"))


_POINTS = "(SELECT c_custkey AS id, CAST(c_custkey % 97 AS DOUBLE) / 7 - 5.03125 AS lon, CAST(c_custkey % 53 AS DOUBLE) / 27 + 42.015625 AS lat FROM customer)"


def _points(view):
    k = F.col("c_custkey")
    return view("customer").select(k.alias("id"), ((k % 97).cast("double") / 7 - 5.03125).alias("lon"), ((k % 53).cast("double") / 27 + 42.015625).alias("lat"))


@query(f"""SELECT p.id, min(c.insee) AS insee FROM {_POINTS} p LEFT JOIN v_commune c ON p.lon >= c.lon AND p.lon < c.lon + 0.125 AND p.lat >= c.lat AND p.lat < c.lat + 0.125 GROUP BY p.id""")
def commune_at_point(view):
    return resolve.commune_at_point(_points(view), _squares(view)).select("id", "insee")


@query(f"""SELECT p.id, min(c.insee) AS insee FROM {_POINTS} p LEFT JOIN v_commune c ON p.lon >= c.lon AND p.lon < c.lon + 0.125 AND p.lat >= c.lat AND p.lat < c.lat + 0.125 GROUP BY p.id""")
def assign_insee_to_bbox(view):
    d = F.lit(0.0078125)
    boxes = _points(view).select("id", (F.col("lon") - d).alias("xmin"), (F.col("lat") - d).alias("ymin"), (F.col("lon") + d).alias("xmax"), (F.col("lat") + d).alias("ymax"))
    return resolve.assign_insee_to_bbox(boxes, _squares(view)).select("id", "insee")


@query("SELECT insee, lon AS west, lat AS south, lon + 0.125 AS east, lat + 0.125 AS north FROM v_commune")
def extent(view):
    return stats.extent(_squares(view))


@query("""
    WITH loc AS (SELECT CAST(custkey AS VARCHAR) AS id, nom || CASE WHEN custkey % 3 = 0 THEN ' (France ; canton)' ELSE ' (France)' END AS label FROM v_commune)
    SELECT n.id, arg_min(l.label, n.pos) AS label FROM (SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS id, unnest([0, 1]) AS pos, CAST(unnest([o_custkey, o_custkey + 1]) AS VARCHAR) AS loc FROM orders) n JOIN loc l ON n.loc = l.id
    WHERE l.label NOT LIKE '%; canton)' GROUP BY n.id""")
def first_communal_place(view):
    k = F.col("custkey")
    locations = view("v_commune").select(k.cast("string").alias("id"), F.concat("nom", F.when(k % 3 == 0, F.lit(" (France ; canton)")).otherwise(F.lit(" (France)"))).alias("label"))
    c = F.col("o_custkey")
    nodes = view("orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.array(c.cast("string"), (c + 1).cast("string")).alias("location_ids"))
    return resolve.first_communal_place(nodes, locations)


@query("""
    WITH c AS (SELECT cote, row_number() OVER (ORDER BY n, letter) AS i FROM (SELECT DISTINCT regexp_extract(cote, '^3 P (\\d+[A-Z]?)', 1) AS cote, CAST(regexp_extract(cote, '^3 P (\\d+)', 1) AS INTEGER) AS n, regexp_extract(cote, '^3 P \\d+([A-Z]?)', 1) AS letter FROM v_notice) x),
    t AS (SELECT nom, row_number() OVER (ORDER BY insee) AS i FROM v_commune)
    SELECT c.cote, t.nom AS name FROM c LEFT JOIN t ON c.i = t.i""")
def tree_commune_by_cote_order(view):
    roots = view("v_notice").select(P.parse_cote("cote")["root"].alias("cote")).distinct()
    return resolve.tree_commune_by_cote_order(roots, view("v_commune").select("nom", F.col("insee").alias("rang")), P.natural_cote_key("cote"))


@query(f"""
    WITH a AS (SELECT n.dept, n.name, x.code FROM {_NAMES} n JOIN {_ALIAS} x ON n.dept = x.dept AND {_KEY.format('n.name')} = x.key),
    b AS (SELECT n.dept, n.name, x.code FROM {_NAMES} n JOIN {_LOCAL.format(k=_COMPACT.format('nom'))} x ON n.dept = x.dept AND {_COMPACT.format('n.name')} = x.key)
    SELECT CASE WHEN b.code IS NULL THEN 'only_a' WHEN a.code IS NULL THEN 'only_b' WHEN a.code = b.code THEN 'agree' ELSE 'disagree' END AS outcome, count(*) AS n
    FROM a FULL JOIN b ON a.dept = b.dept AND a.name = b.name GROUP BY 1""")
def compare_methods(view):
    names = _names(view)
    both = F.concat_ws("/", "dept", "name").alias("k")
    a, b = (f.select(both, "code") for f in (resolve.resolve_by_alias(names, view("v_alias")), resolve.resolve_by_name(names, view("v_commune"))))
    return resolve.compare_methods(a, b, "k", "code")


_CHASE = """
    m AS (SELECT DISTINCT com_av, com_ap FROM v_mvt WHERE typecom_av = 'COM' AND typecom_ap = 'COM' AND com_av <> com_ap),
    s AS (SELECT com_av, count(*) AS n, min(com_ap) AS com_ap FROM m GROUP BY 1),
    codes AS (SELECT com_av AS code FROM m UNION SELECT com_ap FROM m),
    chase AS (SELECT code, code AS at, 0 AS d FROM codes
              UNION ALL SELECT chase.code, s.com_ap, d + 1 FROM chase JOIN s ON chase.at = s.com_av AND s.n = 1 WHERE d < 50 AND chase.at NOT IN (SELECT code FROM v_current)),
    target AS (SELECT codes.code, min(chase.at) AS target FROM codes LEFT JOIN chase ON codes.code = chase.code AND chase.at IN (SELECT code FROM v_current) GROUP BY 1)"""


@query(f"WITH RECURSIVE {_CHASE} SELECT code, target FROM target")
def resolve_succession(view):
    return resolve.resolve_succession(view("v_mvt"), view("v_current"))


_BUILT = f"""{_CHASE},
    labels AS (SELECT DISTINCT com, name FROM (SELECT com, libelle AS name FROM v_history UNION ALL SELECT com, nccenr FROM v_history) x WHERE name IS NOT NULL),
    g AS (SELECT name, list_sort(coalesce(list(DISTINCT t) FILTER (t IS NOT NULL), [])) AS targets
          FROM (SELECT name, coalesce(c.code, target.target) AS t FROM labels LEFT JOIN target ON com = target.code LEFT JOIN v_current c ON com = c.code) x GROUP BY name),
    built AS (SELECT g.name, targets, CASE WHEN len(targets) > 1 THEN 'ambiguous' WHEN len(targets) = 0 THEN 'lost' WHEN g.name = c.nom THEN 'current' ELSE 'alias' END AS outcome
              FROM g LEFT JOIN v_current c ON len(targets) = 1 AND targets[1] = c.code)"""


@query(f"WITH RECURSIVE {_BUILT} SELECT name, array_to_string(targets, ',') AS targets, outcome, CASE WHEN outcome = 'alias' THEN targets[1] END AS code FROM built")
def build_alias(view):
    built = resolve.build_alias(view("v_history"), view("v_mvt"), view("v_current"))
    return built.withColumn("targets", F.array_join("targets", ","))


@query("""
    WITH old AS (SELECT dept, name, min(code) AS code FROM v_alias GROUP BY 1, 2), new AS (SELECT dept, 'Ancien ' || nom AS name, min(insee) AS code FROM v_commune WHERE custkey % 5 = 0 GROUP BY 1, 2)
    SELECT coalesce(old.dept, new.dept) AS dept, coalesce(old.name, new.name) AS name, coalesce(old.code, new.code) AS code FROM old FULL JOIN new ON old.dept = new.dept AND old.name = new.name""")
def merge_alias(view):
    old = view("v_alias").groupBy("dept", "name").agg(F.min("code").alias("code"))
    new = view("v_commune").where("custkey % 5 = 0").groupBy("dept", F.concat(F.lit("Ancien "), "nom").alias("name")).agg(F.min("insee").alias("code"))
    return resolve.merge_alias(old, new)


@query(f"SELECT count(*) AS names, count_if(ok) AS resolved, CAST(coalesce(sum(CASE WHEN NOT ok THEN n END), 0) AS BIGINT) AS unresolved_rows FROM (SELECT resolved_name, c, bool_or(insee IS NOT NULL) AS ok, count(*) AS n FROM (SELECT x.*, n.commune_raw AS c FROM ({_CASCADE}) x JOIN (SELECT rank, min(commune_raw) AS commune_raw FROM v_notice GROUP BY rank) n USING (rank)) y GROUP BY ALL) z".replace("SELECT resolved_name, c,", "SELECT c,"))
def resolution_summary(view):
    n = view("v_notice").select("rank", F.col("dept_expected").alias("dept"), "title", "commune_raw", "true_nom")
    out = resolve.resolve_cascade(n, view("v_alias"), view("v_commune"), [("title", F.col("title")), ("branch", F.col("commune_raw")), ("place", F.col("true_nom"))])
    return resolve.resolution_summary(out, "commune_raw", "insee")


@query("SELECT count(*) AS resolved, count_if(substr(insee, 1, 2) NOT IN ('01', '02', '03')) AS outside FROM v_document WHERE insee IS NOT NULL")
def department_guard(view):
    """The guard's figures; the guard itself raises."""
    return resolve.outside_share(view("v_document"), ["01", "02", "03"])


@query(f"""
    WITH h AS (SELECT DISTINCT {_KEY.format('name')} AS key FROM v_alias)
    SELECT label, CASE WHEN {_RUBRIC.format('label')} THEN 'D' WHEN contains(label, '(') THEN 'A' WHEN h.key IS NOT NULL THEN 'C' ELSE 'B' END AS family, n
    FROM (SELECT CASE WHEN custkey % 6 = 0 THEN title ELSE commune_raw END AS label, count(*) AS n FROM v_notice WHERE custkey % 2 = 0 GROUP BY 1) x LEFT JOIN h ON {_KEY.format('label')} = h.key""")
def unresolved_report(view):
    k = F.col("custkey")
    rows = view("v_notice").select(F.when(k % 6 == 0, F.col("title")).otherwise(F.col("commune_raw")).alias("commune_raw"), F.when(k % 2 != 0, F.col("true_insee")).alias("insee"))
    return resolve.unresolved_report(rows, view("v_alias"))


@query(f"""
    WITH n AS (SELECT rank, dept_expected AS dept, CASE WHEN custkey % 2 = 0 THEN true_insee END AS insee, commune_raw,
                      {_LISTED.format('commune_raw')} AS a, {_LISTED.format("trim(str_split(CASE WHEN commune_raw LIKE '%(Nord, France)' THEN regexp_extract(commune_raw, '^(.*?)\\s*\\(', 1) WHEN contains(commune_raw, '(') THEN regexp_extract(commune_raw, '\\((.*?),', 1) ELSE commune_raw END, '/')[-1])")} AS b,
                      {_LISTED.format("trim(str_split(regexp_replace(commune_raw, '\\s*\\(.*?\\)\\s*$', ''), '/')[-1])")} AS c FROM v_notice),
    al AS {_ALIAS}, l AS {_LOCAL.format(k=_KEY.format('nom'))},
    names AS (SELECT DISTINCT dept, name FROM (SELECT dept, a AS name FROM n UNION ALL SELECT dept, b FROM n UNION ALL SELECT dept, c FROM n) x WHERE name IS NOT NULL),
    f AS (SELECT names.dept, names.name, coalesce(al.code, CASE WHEN NOT {_RUBRIC.format('names.name')} THEN l.code END) AS code
          FROM names LEFT JOIN al ON names.dept = al.dept AND {_KEY.format('names.name')} = al.key LEFT JOIN l ON names.dept = l.dept AND {_KEY.format('names.name')} = l.key)
    SELECT rank, coalesce(n.insee, f1.code, f2.code, f3.code) AS insee
    FROM n LEFT JOIN f f1 ON n.dept = f1.dept AND a = f1.name LEFT JOIN f f2 ON n.dept = f2.dept AND b = f2.name LEFT JOIN f f3 ON n.dept = f3.dept AND c = f3.name""")
def replay_unresolved(view):
    rows = view("v_notice").select("rank", "dept_expected", "commune_raw", F.when(F.col("custkey") % 2 == 0, F.col("true_insee")).alias("insee"))
    return resolve.replay_unresolved(rows, view("v_alias"), view("v_commune"), ["Nord"]).select("rank", "insee")


# Trees ---------------------------------------------------------------------------------------------------------------

_LEAVES = r"""
    SELECT l.id, c.title AS commune, o.title AS parent_title, 3 AS depth
    FROM v_node c JOIN v_edge e1 ON e1.parent_id = 'root' AND e1.child_id = c.id JOIN v_edge e2 ON e2.parent_id = c.id JOIN v_node o ON o.id = e2.child_id JOIN v_edge e3 ON e3.parent_id = o.id JOIN v_node l ON l.id = e3.child_id
    WHERE coalesce(c.end_year, 9999) >= 1790 AND NOT regexp_matches(o.title, '(?i)rénov|renov|intendance|masse de culture') AND o.begin_year <= 1860 AND o.end_year >= 1790
      AND l.manifest IS NOT NULL AND (l.begin_year IS NULL OR l.begin_year BETWEEN 1790 AND 1860)"""


@query(_LEAVES)
def descend(view):
    return tree.descend(view("v_node"), view("v_edge"), "root").select("id", "commune", "parent_title", "depth")


@query(_LEAVES.replace("SELECT l.id, c.title AS commune, o.title AS parent_title, 3 AS depth", "SELECT c.title AS commune, count(*) AS leaves") + " GROUP BY c.title")
def propagate_commune(view):
    nodes = view("v_node").select("id", "title", "begin_year", "end_year", F.when(F.col("manifest").isNotNull(), F.lit("")).alias("manifest"))  # counted, not returned
    return tree.descend(nodes, view("v_edge"), "root").groupBy("commune").agg(F.count("*").alias("leaves"))


@query(r"""SELECT n.id, p.title AS commune FROM v_node n JOIN v_edge e ON n.id = e.child_id JOIN v_node p ON p.id = e.parent_id
    WHERE n.id NOT IN (SELECT parent_id FROM v_edge) AND regexp_matches(n.title, '(?i)atlas\s+parcellaire|tableau\s+d|plan')""")
def descend_keep_leaves(view):
    return tree.descend_keep_leaves(view("v_node"), view("v_edge"), "root").select("id", "commune")


@query(r"""SELECT o.id, o.title, c.title AS parent_title FROM v_node o JOIN v_edge e ON o.id = e.child_id JOIN v_node c ON c.id = e.parent_id
    WHERE o.id LIKE 'o%' AND o.id IN (SELECT parent_id FROM v_edge) AND regexp_matches(o.title, '(?i)^plans') AND NOT regexp_matches(o.title, '(?i)r[ée]nov|matric')""")
def isolate_plan_branches(view):
    return tree.isolate_plan_branches(view("v_node"), view("v_edge"), "root").select("id", "title", "parent_title")


def _branches(view):
    return view("v_node").where("id like 'o%' and title = 'Plans du cadastre'").select("id", "title", F.lit("c").alias("parent_title"))


_SAMPLES = "SELECT o.id, arg_min(l.manifest, e.pos) AS manifest FROM v_node o JOIN v_edge e ON o.id = e.parent_id JOIN v_node l ON l.id = e.child_id WHERE o.id LIKE 'o%' AND o.title = 'Plans du cadastre' AND l.manifest IS NOT NULL GROUP BY o.id"


@query(_SAMPLES)
def sample_manifest(view):
    return tree.sample_manifest(view("v_node"), view("v_edge"), _branches(view))


@query(_SAMPLES)
def sample_manifest_by_intervals(view):
    """The same by one pass in pre-order over the intervals of the whole tree."""
    return tree.sample_manifest(view("v_node"), view("v_edge"), _branches(view), tour=euler.intervals(view("v_edge")))


_TOUR = """WITH RECURSIVE walk AS (SELECT 'root' AS id, '' AS path, 0 AS depth UNION ALL SELECT e.child_id, w.path || '/' || lpad(CAST(e.pos AS VARCHAR), 19, '0') || e.child_id, w.depth + 1 FROM walk w JOIN v_edge e ON w.id = e.parent_id),
    numbered AS (SELECT *, row_number() OVER (ORDER BY path) AS enter FROM walk), """


@query(_TOUR + """ancestors AS (SELECT id AS of, id FROM walk UNION ALL SELECT a.of, e.parent_id FROM ancestors a JOIN v_edge e ON a.id = e.child_id), sizes AS (SELECT id, count(*) AS n FROM ancestors GROUP BY 1)
    SELECT id, enter, enter + n - 1 AS leave, depth FROM numbered JOIN sizes USING (id)""")
def tree_intervals(view):
    """Each node's interval in pre-order and its depth."""
    return euler.intervals(view("v_edge"))


@query("SELECT e.child_id AS id, c.title AS commune FROM v_edge e JOIN v_node c ON c.id = CASE WHEN e.parent_id = 'root' THEN e.child_id WHEN e.parent_id LIKE 'c%' THEN e.parent_id ELSE (SELECT any_value(u.parent_id) FROM v_edge u WHERE u.child_id = e.parent_id) END UNION ALL SELECT 'root', NULL")
def commune_of_each_node(view):
    """Every node's title at depth 1, leaves and branches alike, in one pass in pre-order."""
    return euler.from_depth(euler.intervals(view("v_edge")), view("v_node").select("id", F.col("title").alias("value")), 1).select("id", F.col("value").alias("commune"))


@query("SELECT e.child_id AS id FROM v_edge e LEFT JOIN v_node p ON p.id = e.parent_id WHERE p.title IS NULL OR NOT regexp_matches(p.title, '(?i)rénov|renov|intendance|masse de culture') UNION ALL SELECT 'root'")
def nodes_outside_of_excluded_branches(view):
    """Nodes that no excluded branch stands above (in the given tree such branches lie right above their leaves)."""
    stops = view("v_node").where(P.excluded_branch("title")).select("id")
    return euler.without_stops_above(euler.intervals(view("v_edge")), stops).select("id")


@query(f"""SELECT o.id, 'c' AS commune, o.title AS branch, s.manifest, s.manifest IS NOT NULL AS iiif, CASE WHEN s.manifest IS NULL THEN 'À vérifier' END AS licence, CASE WHEN s.manifest IS NULL THEN false END AS overlay_ok
    FROM v_node o LEFT JOIN ({_SAMPLES}) s ON o.id = s.id WHERE o.id LIKE 'o%' AND o.title = 'Plans du cadastre'""")
def branch_report(view):
    b = _branches(view)
    return tree.branch_report(b, tree.sample_manifest(view("v_node"), view("v_edge"), b))


# Statistics ----------------------------------------------------------------------------------------------------------

_STATS = """SELECT substr(insee, 1, 2) AS dept, count(*) AS total, count_if(licence_overlay_ok) AS overlay_ok, count(iiif_manifest) AS with_iiif, count_if(type = 'tableau_assemblage') AS assemblages,
    count_if(type = 'section') AS sections, count_if(type = 'feuille') AS feuilles, count(DISTINCT insee) AS communes FROM v_unique GROUP BY 1"""
_GEOREF = "SELECT substr(insee, 1, 2) AS dept, count(*) AS georef FROM v_georef WHERE type = 'tableau_assemblage' AND georef_url IS NOT NULL GROUP BY 1"
_REGIONS = "(VALUES " + ", ".join("('{}', '{}', '{}')".format(r, n.replace("'", "''"), d) for r, (n, ds) in stats.REGIONS.items() for d in ds.split()) + ") AS regions(region, region_nom, dept)"


def _spark(view):
    return view("nation").sparkSession


@query(_STATS)
def stats_by_dept(view):
    return stats.stats_by_dept(view("v_unique"))


@query(_GEOREF)
def georef_count_by_dept(view):
    return stats.georef_count_by_dept(view("v_georef"))


@query(f"SELECT s.dept, CAST(CASE WHEN s.dept IN ('92', '93') THEN 100 WHEN assemblages > 0 THEN floor(100 * coalesce(georef, 0) / assemblages + 0.5) ELSE 0 END AS INTEGER) AS pct FROM ({_STATS}) s LEFT JOIN ({_GEOREF}) g ON s.dept = g.dept")
def georef_pct(view):
    return stats.georef_pct(stats.stats_by_dept(view("v_unique")), stats.georef_count_by_dept(view("v_georef")))


@query(f"SELECT region, region_nom, CAST(coalesce(sum(total), 0) AS BIGINT) AS documents, count(total) AS present, count(*) AS departments FROM {_REGIONS} LEFT JOIN ({_STATS}) s ON regions.dept = s.dept GROUP BY 1, 2")
def stats_by_region(view):
    return stats.stats_by_region(stats.stats_by_dept(view("v_unique")), stats.region_dim(_spark(view)))


@query(f"SELECT region, regions.dept, count(*) AS total, CAST(grouping(region, regions.dept) AS INTEGER) AS level FROM v_unique JOIN {_REGIONS} ON v_unique.dept = regions.dept GROUP BY ROLLUP (region, regions.dept)")
def stats_rollup(view):
    return stats.stats_rollup(view("v_unique"), stats.region_dim(_spark(view)))


@query("SELECT count(DISTINCT insee) AS communes, count(*) AS total, count_if(type = 'tableau_assemblage') AS assemblages, count_if(licence_overlay_ok) AS overlay FROM v_unique WHERE insee LIKE '07%'")
def load_check(view):
    return stats.load_check(view("v_unique"), "07")


@query("""SELECT facet, value, count(*) AS n FROM (SELECT 'type' AS facet, type AS value FROM v_georef UNION ALL SELECT 'decade', CAST(CAST(floor(annee / 10) * 10 AS INTEGER) AS VARCHAR) FROM v_georef
    UNION ALL SELECT 'iiif', CASE WHEN iiif_manifest IS NOT NULL THEN 'yes' END FROM v_georef UNION ALL SELECT 'georef', CASE WHEN georef_url IS NOT NULL THEN 'yes' END FROM v_georef) x WHERE value IS NOT NULL GROUP BY 1, 2""")
def facet_counts(view):
    return stats.facet_counts(view("v_georef"))


_ORD = "(type, section_lettre IS NOT NULL, coalesce(section_lettre, ''), feuille_num IS NOT NULL, coalesce(feuille_num, 0), ingest_rank)"


@query(f"""SELECT insee, arg_min(archive_url, {_ORD}) FILTER (type = 'tableau_assemblage') AS overview,
        coalesce(arg_min(coalesce(iiif_manifest, ''), {_ORD}) FILTER (type = 'tableau_assemblage' AND iiif_manifest IS NOT NULL AND first_ta), arg_min(iiif_manifest, {_ORD}) FILTER (iiif_manifest IS NOT NULL)) AS manifest,
        coalesce(arg_min(image_url, {_ORD}) FILTER (first_ta AND image_url IS NOT NULL), arg_min(image_url, {_ORD}) FILTER (image_url IS NOT NULL)) AS image,
        coalesce(string_agg(CASE WHEN section_lettre IS NOT NULL THEN 'Sect. ' || section_lettre || coalesce(' f.' || feuille_num, '') ELSE cote END, ',' ORDER BY type = 'feuille', type, section_lettre IS NOT NULL, coalesce(section_lettre, ''), feuille_num IS NOT NULL, coalesce(feuille_num, 0), ingest_rank) FILTER (type <> 'tableau_assemblage'), '') AS plates
    FROM (SELECT *, type = 'tableau_assemblage' AND row_number() OVER (PARTITION BY insee, type ORDER BY section_lettre NULLS FIRST, feuille_num NULLS FIRST, ingest_rank) = 1 AS first_ta FROM v_unique) x GROUP BY insee""")
def commune_card(view):
    return stats.commune_card(view("v_unique")).withColumn("plates", F.array_join("plates", ","))


@query(f"""SELECT insee, CASE WHEN NOT any_ta THEN 'absent' WHEN m IS NULL OR NOT ok THEN 'iiif_only' WHEN a.id IS NOT NULL THEN 'georef' ELSE 'georef_ready' END AS status, m AS manifest
    FROM (SELECT insee, bool_or(type = 'tableau_assemblage') AS any_ta, arg_min(iiif_manifest, {_ORD}) FILTER (type = 'tableau_assemblage' AND iiif_manifest IS NOT NULL) AS m,
                 arg_min(licence_overlay_ok, {_ORD}) FILTER (type = 'tableau_assemblage' AND iiif_manifest IS NOT NULL) AS ok FROM v_unique GROUP BY insee) x
    LEFT JOIN (SELECT id FROM v_annotation WHERE items > 0) a ON substr(sha1(m), 1, 16) = a.id""")
def commune_status(view):
    return stats.commune_status(view("v_unique"), view("v_annotation"))


@query("SELECT source, arg_min(url, ingest_rank) FILTER (url IS NOT NULL) AS source_url FROM (SELECT service_id AS source, CASE WHEN ingest_rank % 3 = 0 THEN NULL ELSE archive_url END AS url, ingest_rank FROM v_unique) x GROUP BY 1")
def source_attribution(view):
    d = view("v_unique").select(F.col("service_id").alias("source"), F.when(F.col("ingest_rank") % 3 != 0, F.col("archive_url")).alias("source_url"), "ingest_rank")
    return stats.source_attribution(d)


@query(r"""WITH p AS (SELECT *, TRY_CAST(substr(year_raw, 1, 4) AS INTEGER) AS annee FROM v_notice)
    SELECT point, value, count(*) AS n FROM (
        SELECT 'read' AS point, CASE WHEN manifest_url IS NOT NULL THEN 'read' ELSE 'failed' END AS value FROM p
        UNION ALL SELECT 'commune', CAST(len(str_split_regex(commune_raw, '[(,/]')) AS VARCHAR) || ' parts' FROM p
        UNION ALL SELECT 'ident', fam FROM (SELECT *, rank() OVER (ORDER BY c DESC, fam) AS r FROM (SELECT regexp_replace(ident, '\d+', '#', 'g') AS fam, count(*) OVER (PARTITION BY regexp_replace(ident, '\d+', '#', 'g')) AS c FROM p) f) g WHERE true
        UNION ALL SELECT 'year', CASE WHEN annee IS NULL THEN 'undated' WHEN annee BETWEEN 1815 AND 1860 THEN 'in period' ELSE 'out of period' END FROM p
        UNION ALL SELECT 'decade', CAST(CAST(floor(annee / 10) * 10 AS INTEGER) AS VARCHAR) FROM p
        UNION ALL SELECT 'type', title FROM p UNION ALL SELECT 'image', CASE WHEN image_url IS NULL THEN 'missing' ELSE 'present' END FROM p
        UNION ALL SELECT 'insee', CASE WHEN custkey % 5 = 0 THEN 'unresolved' WHEN dept_expected IN ('01', '02') THEN 'inside' ELSE 'outside' END FROM p) x WHERE value IS NOT NULL GROUP BY 1, 2
    UNION ALL SELECT 'year_min', CAST(min(annee) AS VARCHAR), 1 FROM p UNION ALL SELECT 'year_max', CAST(max(annee) AS VARCHAR), 1 FROM p
    UNION ALL SELECT 'ambiguous', dept || ' ' || lower(name), count(DISTINCT code) FROM v_alias GROUP BY 2 HAVING count(DISTINCT code) > 1""")
def corpus_profile(view):
    n = view("v_notice")
    plates = n.select(F.col("manifest_url").isNotNull().alias("manifest_ok"), F.col("commune_raw").alias("commune"), "ident", P.parse_year("year_raw", "prefix4").alias("annee"), F.col("title").alias("type"),
                      F.col("image_url").alias("image"), F.when(F.col("custkey") % 5 != 0, F.col("true_insee")).alias("insee"))
    names = view("v_alias").select(F.concat("dept", F.lit(" "), F.lower("name")).alias("name"), "code")
    return stats.corpus_profile(plates, 1815, 1860, ["01", "02"], names)


@query("""WITH first AS (SELECT service_id, arg_min(manifest_url, rank) AS manifest FROM v_notice WHERE manifest_url IS NOT NULL GROUP BY 1),
    s AS (SELECT DISTINCT service_id FROM v_notice),
    t AS (SELECT s.service_id, CASE length(manifest) % 5 WHEN 0 THEN 'licence ouverte' WHEN 1 THEN 'cc-by' WHEN 2 THEN 'publicdomain' WHEN 3 THEN 'tous droits' END AS kind FROM s LEFT JOIN first USING (service_id))
    SELECT service_id, CASE WHEN service_id = 'S3' THEN 'Réutilisation OK' WHEN kind = 'licence ouverte' THEN 'Licence Ouverte' WHEN kind = 'cc-by' THEN 'CC-BY' WHEN kind = 'publicdomain' THEN 'Domaine public' ELSE 'À vérifier' END AS licence,
           service_id = 'S3' OR coalesce(kind IN ('licence ouverte', 'cc-by', 'publicdomain'), false) AS overlay_ok FROM t""")
def licence_by_service(view):
    n = view("v_notice")
    leaves = n.select("service_id", F.col("manifest_url").alias("manifest"), "rank")
    k = F.length("manifest") % 5
    text = F.when(k == 0, "Sous Licence Ouverte (Etalab)").when(k == 1, "https://x/CC-BY").when(k == 2, "rights: publicdomain/mark").when(k == 3, "Tous droits réservés")
    manifests = leaves.where("manifest is not null").select("manifest").distinct().withColumn("text", text)
    overrides = view("v_service").where("id = 'S3'").select(F.col("id").alias("service_id"), F.lit("Réutilisation OK").alias("licence"), F.lit(True).alias("overlay_ok"))
    return stats.licence_by_service(leaves, manifests, overrides)


_INVENTORY = "(SELECT c_custkey AS num, 'N' || CAST(c_custkey % 6 AS VARCHAR) || CASE WHEN c_custkey % 5 = 0 THEN ' ✅' ELSE '' END AS etat, CASE WHEN c_custkey % 4 = 0 THEN 'IIIF, JPEG' ELSE 'JPEG' END AS formats, CASE WHEN c_custkey % 3 = 0 THEN 'Licence Ouverte' ELSE 'À vérifier' END AS licence, CASE c_custkey % 7 WHEN 0 THEN 'Portail Ligeo' WHEN 1 THEN 'Mnesys Expo' ELSE 'autre' END AS source FROM customer)"


def _inventory(view):
    k = F.col("c_custkey")
    return view("customer").select(k.alias("num"), F.concat(F.lit("N"), (k % 6).cast("string"), F.when(k % 5 == 0, " ✅").otherwise("")).alias("etat"), F.when(k % 4 == 0, "IIIF, JPEG").otherwise("JPEG").alias("formats"),
                                   F.when(k % 3 == 0, "Licence Ouverte").otherwise("À vérifier").alias("licence"), F.when(k % 7 == 0, "Portail Ligeo").when(k % 7 == 1, "Mnesys Expo").otherwise("autre").alias("source"))


@query(f"SELECT measure, n, CAST(floor(100 * n / 95 + 0.5) AS INTEGER) AS pct FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS measure, count_if({c}) AS n FROM {_INVENTORY} i" for m, c in [*((f"N{k}", f"num % 6 = {k}") for k in range(6)), (">=N4", "num % 6 >= 4"), (">=N3", "num % 6 >= 3"), ("IIIF", "contains(formats, 'IIIF')"), ("open", "contains(lower(licence), 'ouverte')"), ("verified", "contains(etat, '✅')")]) + ") x")
def national_levels(view):
    return stats.national_levels(_inventory(view))


@query(f"SELECT CASE WHEN contains(source, 'Ligeo') THEN 'Ligeo' WHEN contains(source, 'Mnesys') THEN 'Mnesys' END AS family, count(*) AS n FROM {_INVENTORY} i GROUP BY 1")
def viewer_families(view):
    return _inventory(view).groupBy(stats.viewer_family("source").alias("family")).agg(F.count("*").alias("n"))


@query("""WITH i AS (SELECT service_id AS fund, upper(substr(strip_accents(true_nom), 1, 1)) AS i FROM v_notice), g AS (SELECT fund, min(i) AS first, max(i) AS last, list(DISTINCT i) AS seen FROM i WHERE i BETWEEN 'A' AND 'Z' GROUP BY 1)
    SELECT fund, first, last, array_to_string(list_filter(list_transform(range(ascii(first), ascii(last) + 1), lambda c: chr(CAST(c AS INTEGER))), lambda c: NOT list_contains(seen, c)), '') AS missing FROM g""")
def alphabetical_coverage(view):
    return stats.alphabetical_coverage(view("v_notice"), "service_id", "true_nom")


@query("""WITH p AS (SELECT service_id AS fund, CAST(rank // 1000000000 % 4 AS INTEGER) AS page, list_sort(list(DISTINCT CASE WHEN service_id = 'S2' AND rank // 1000000000 % 4 > 1 THEN 'same' ELSE ark END)) AS arks FROM v_notice GROUP BY 1, 2),
    l AS (SELECT *, lag(arks) OVER (PARTITION BY fund ORDER BY page) AS before FROM p),
    f AS (SELECT fund, coalesce(bool_or(before IS NOT NULL AND len(list_filter(arks, lambda x: NOT list_contains(before, x))) = 0), false) AS stuck FROM l GROUP BY 1),
    n AS (SELECT fund, count(DISTINCT a) AS collected FROM (SELECT fund, unnest(arks) AS a FROM p) x GROUP BY 1),
    an AS (SELECT service_id AS fund, count(DISTINCT ark) + CAST(substr(service_id, 2) AS INTEGER) % 3 * 60 AS announced FROM v_notice GROUP BY 1)
    SELECT an.fund, collected, announced, CASE WHEN stuck THEN 'stuck' WHEN collected < 0.98 * announced THEN 'incomplete' WHEN collected <> announced THEN 'differs' ELSE 'complete' END AS verdict FROM an JOIN n USING (fund) JOIN f USING (fund)""")
def completeness_check(view):
    n = view("v_notice").withColumn("page", (F.floor(F.col("rank") / 1000000000) % 4).cast("int"))
    ark = F.when((F.col("service_id") == "S2") & (F.col("page") > 1), "same").otherwise(F.col("ark"))
    pages = n.groupBy(F.col("service_id").alias("fund"), "page").agg(F.collect_set(ark).alias("arks"))
    announced = n.groupBy(F.col("service_id").alias("fund")).agg(F.countDistinct("ark").alias("d")).select("fund", (F.col("d") + F.substring("fund", 2, 9).cast("int") % 3 * 60).alias("announced"))
    return stats.completeness_check(pages, announced)


@query("SELECT archive_url, count(*) AS n FROM v_document GROUP BY 1 HAVING count(*) > 1")
def duplicates_report(view):
    return stats.duplicates_report(view("v_document"))


@query(r"""SELECT root, arg_min(lieu, (plate, lieu)) AS lieu FROM (SELECT regexp_extract(cote, '^3 P (\d+[A-Z]?)', 1) AS root, CAST(regexp_extract(cote, '/(\d+)$', 1) AS INTEGER) AS plate, CASE WHEN manifest_url IS NOT NULL THEN true_nom END AS lieu FROM v_notice) x WHERE lieu IS NOT NULL GROUP BY root""")
def lieu_by_cote_root(view):
    p = view("v_notice").select(P.parse_cote("cote").alias("p"), F.when(F.col("manifest_url").isNotNull(), F.col("true_nom")).alias("lieu"))
    return stats.lieu_by_cote_root(p.select("p.root", "p.rank", "lieu"))


# Browsing ------------------------------------------------------------------------------------------------------------



@query("SELECT ingest_rank, CAST(row_number() OVER (PARTITION BY insee ORDER BY type, section_lettre NULLS FIRST, feuille_num NULLS FIRST, ingest_rank) AS INTEGER) AS place FROM v_unique")
def order_documents(view):
    return browse.order_documents(view("v_unique")).select("ingest_rank", "place")


def _sorted(mode: str, keys: str):
    def run(view):
        return browse.sort_documents(view("v_unique").select("ingest_rank", "type", "annee", "cote", "nom"), mode).select("ingest_rank", "place")

    run.__name__ = f"sort_documents_{mode}"
    return query(f"SELECT ingest_rank, CAST(row_number() OVER (ORDER BY {keys}, ingest_rank) AS INTEGER) AS place FROM v_unique")(run)


_sorted("type", "CASE type WHEN 'tableau_assemblage' THEN 0 WHEN 'section' THEN 1 ELSE 2 END, nom COLLATE fr")
_sorted("year_asc", "coalesce(annee, 9999)")
_sorted("year_desc", "coalesce(annee, -1) DESC")
_sorted("commune", "nom COLLATE fr")


#: Numbers of marks by their place among all numbers, so that marks of equal form sort by value.
_MARK_NUMBERS = r"""n AS (SELECT x, 'N' || lpad(CAST(dense_rank() OVER (ORDER BY CAST(x AS HUGEINT)) AS VARCHAR), 12, '0') AS place FROM (SELECT DISTINCT unnest(regexp_extract_all(cote, '\d+')) AS x FROM v_unique) r),
    m AS (SELECT map_from_entries(list((x, place))) AS place FROM n),
    k AS (SELECT ingest_rank, array_to_string(list_transform(regexp_extract_all(coalesce(cote, ''), '\d+|\D+'), lambda x: CASE WHEN regexp_matches(x, '^\d') THEN substr(m.place[x], 2) ELSE x END), '') AS mark FROM v_unique, m)"""


@query(f"WITH {_MARK_NUMBERS} SELECT ingest_rank, CAST(row_number() OVER (ORDER BY mark COLLATE fr, ingest_rank) AS INTEGER) AS place FROM k")
def sort_documents_cote(view):
    return browse.sort_documents(view("v_unique").select("ingest_rank", "type", "annee", "cote", "nom"), "cote").select("ingest_rank", "place")


@query(rf"""WITH p AS (SELECT insee, arg_min(nom, ingest_rank) AS nom, arg_min(coalesce(annee, 9999), {_ORD}) AS y FROM v_unique GROUP BY 1)
    SELECT insee, nom, nullif(y, 9999) AS annee, CAST(row_number() OVER (ORDER BY y, nom COLLATE fr, insee) AS INTEGER) AS place FROM p""")
def order_communes(view):
    return browse.order_communes(view("v_unique"), "year_asc")


_ODD_NAMES = """(SELECT k, CASE k % 8 WHEN 0 THEN 'Œuf-en-Ternois' WHEN 1 THEN 'Oz' WHEN 2 THEN 'Saint-Bé' WHEN 3 THEN 'Saint-Be' WHEN 4 THEN 'L''Île' WHEN 5 THEN 'L’Ile' WHEN 6 THEN 'cÔte' ELSE 'Ærø' END
    || ' ' || CAST(CAST(floor(k / 16) AS BIGINT) AS STRING) AS nom FROM (SELECT c_custkey AS k FROM {customer}) c)"""


@query("SELECT k, nom, CAST(row_number() OVER (ORDER BY nom COLLATE fr, k) AS INTEGER) AS place FROM " + _ODD_NAMES.format(customer="customer") + " n")
def french_order(view):
    """Names with ligatures, accents, hyphens and both apostrophes in a reader's order, ranked over all of them."""
    names = _spark(view).sql(f"SELECT * FROM {_ODD_NAMES} n", customer=view("customer"))
    return numbered(names, [T.french("nom"), F.col("k")]).select("k", "nom", "place")


@query("SELECT ingest_rank FROM v_georef WHERE type = 'feuille' AND annee BETWEEN 1820 AND 1829 AND iiif_manifest IS NOT NULL AND georef_url IS NOT NULL")
def facet_filter(view):
    return browse.facet_filter(view("v_georef"), "feuille", 1820, True, True).select("ingest_rank")


@query("SELECT ingest_rank FROM v_unique WHERE insee LIKE '12%'")
def dept_filter(view):
    return browse.dept_filter(view("v_unique"), "12").select("ingest_rank")


@query("""WITH s AS (SELECT c.insee, c.nom, row_number() OVER (ORDER BY c.nom COLLATE fr, c.insee) AS n, count(*) OVER () AS total FROM v_commune c WHERE lon BETWEEN -4 AND 3 AND lat BETWEEN 42 AND 43 AND insee IN (SELECT insee FROM v_unique)),
    m AS (SELECT max(insee) AS pick FROM s)
    SELECT insee, nom, CAST(row_number() OVER (ORDER BY CASE WHEN insee = pick AND n > 12 THEN 0 ELSE 1 END, n) AS INTEGER) AS place, total FROM s, m QUALIFY place <= 12""")
def viewport_topk(view):
    seen = view("v_commune").where(P.in_viewport("lon", "lat", -4, 42, 3, 43)).join(view("v_unique").select("insee").distinct(), "insee", "left_semi")
    pick = seen.agg(F.max("insee")).first()[0]
    return browse.viewport_topk(view("v_commune"), view("v_unique"), (-4, 42, 3, 43), 12, pick)


@query(f"SELECT insee, nom, CAST(row_number() OVER (ORDER BY {_KEY.format('nom')} = 'l ile 1' DESC, population DESC, insee) AS INTEGER) AS place FROM v_commune WHERE {_KEY.format('nom')} LIKE 'l ile 1%' QUALIFY place <= 8")
def search_communes(view):
    return browse.search_communes(view("v_commune"), "L'Île 1")


@query(f"""WITH h AS (SELECT insee, nom, row_number() OVER (ORDER BY population DESC, insee) AS p FROM v_commune WHERE {_KEY.format('nom')} LIKE 'saint etienne 1%' QUALIFY p <= 25)
    SELECT insee, nom, CAST(row_number() OVER (ORDER BY p) AS INTEGER) AS place FROM h WHERE substr(insee, 1, 2) IN (SELECT dept FROM v_unique WHERE annee = 1815) QUALIFY place <= 8""")
def search_documented(view):
    return browse.search_documented(view("v_commune"), view("v_unique").where("annee = 1815"), "saint-étienne 1")


@query("SELECT insee FROM v_commune WHERE dept IN (SELECT dept FROM v_unique WHERE annee = 1880 OR dept = '01')")
def communes_in_documented_depts(view):
    return browse.communes_in_documented_depts(view("v_commune"), view("v_unique").where("annee = 1880 or dept = '01'")).select("insee")


@query("SELECT insee FROM v_commune WHERE insee NOT IN (SELECT insee FROM v_unique WHERE annee = 1815)")
def missing_communes(view):
    """The communes without a document of 1815: some have one, some don't."""
    return browse.missing_communes(view("v_commune"), view("v_unique").where("annee = 1815")).select("insee")


@query(r"SELECT notice_id, rank, CAST(row_number() OVER (PARTITION BY regexp_extract(cote, '^3 P (\d+[A-Z]?)', 1) ORDER BY CAST(regexp_extract(cote, '/(\d+)$', 1) AS INTEGER), rank) AS INTEGER) AS place FROM v_notice")
def sort_plates(view):
    p = view("v_notice").select("notice_id", F.col("rank").alias("id"), P.parse_cote("cote").alias("p")).select("notice_id", "id", "p.root", "p.rank")
    return browse.sort_plates(p).select("notice_id", F.col("id").alias("rank"), "place")


@query(f"SELECT c.insee, '/' || region || '/' || c.dept || '/' || c.insee AS route, '/card/' || region || '/' || c.dept || '/' || c.insee AS card FROM v_commune c LEFT JOIN {_REGIONS} ON c.dept = regions.dept")
def commune_route(view):
    return browse.commune_route(view("v_commune").select("insee", "dept")).select("insee", "route", "card")


@query("SELECT rank FROM v_notice ORDER BY rank LIMIT 60")
def sample_first_n(view):
    return browse.sample_first_n(view("v_notice"), 60).select("rank")


@query("SELECT ingest_rank, service_id, 'done' AS origin FROM v_unique WHERE CAST(substr(service_id, 2) AS INTEGER) < 8 UNION ALL SELECT ingest_rank, service_id, CASE WHEN CAST(substr(service_id, 2) AS INTEGER) % 2 = 0 THEN 'even' ELSE 'odd' END FROM v_unique WHERE CAST(substr(service_id, 2) AS INTEGER) >= 8")
def union_sources(view):
    """Services below 8 are done; two inventories bring the even and the odd ones."""
    d, n = view("v_unique").select("ingest_rank", "service_id"), F.substring("service_id", 2, 9).cast("int")
    parts = [d.where(n % 2 == k).withColumn("origin", F.lit(name)) for k, name in ((0, "even"), (1, "odd"))]
    return browse.union_sources(d.where(n < 8).withColumn("origin", F.lit("done")), parts, "service_id")


@query("SELECT ingest_rank, annee, 'a' AS side FROM v_document WHERE annee = 1820 UNION ALL SELECT ingest_rank, annee, 'b' AS side FROM v_document WHERE annee = 1821")
def regression_diff(view):
    d = view("v_document")
    return browse.regression_diff(d.where("annee is null or annee <> 1821"), d.where("annee is null or annee <> 1820"), ["ingest_rank", "annee"])


@query("SELECT notice_id, min(rank) AS rank FROM v_notice GROUP BY 1")
def first_wins(view):
    return first(view("v_notice").select("notice_id", "rank"), ["notice_id"], "rank")


@query("SELECT notice_id, max(rank) AS rank FROM v_notice GROUP BY 1")
def last_wins(view):
    return last(view("v_notice").select("notice_id", "rank"), ["notice_id"], "rank")


# Loading -------------------------------------------------------------------------------------------------------------

_Q = "CASE WHEN {0} IS NULL OR {0} = '' THEN 'null' ELSE '''' || replace({0}, '''', '''''') || '''' END"
_N = "coalesce(CAST({0} AS VARCHAR), 'null')"


@query("SELECT 'insert into document (" + ", ".join(load.SEED_COLUMNS) + ") values (' || " + " || ', ' || ".join((_N if c in ("feuille_num", "annee", "licence_overlay_ok") else _Q).format(c) for c in load.SEED_COLUMNS) + " || ');' AS value FROM v_unique WHERE insee IS NOT NULL")
def seed_sql(view):
    return load.seed_sql(view("v_unique"))


@query("""WITH old AS (SELECT archive_url, ingest_rank FROM v_unique WHERE ingest_rank % 2 = 0), new AS (SELECT archive_url, min(ingest_rank) AS ingest_rank FROM v_document WHERE archive_url NOT IN (SELECT archive_url FROM old) GROUP BY 1)
    SELECT * FROM old UNION ALL SELECT * FROM new""")
def upsert_ignore(view):
    d = view("v_document").select("archive_url", "ingest_rank")
    return load.upsert_ignore(view("v_unique").where("ingest_rank % 2 = 0").select("archive_url", "ingest_rank"), d)


@query("SELECT insee, ingest_rank FROM v_unique WHERE substr(insee, 1, 2) <> '05' UNION ALL SELECT insee, ingest_rank FROM v_document WHERE insee LIKE '05%' AND annee IS NOT NULL")
def replace_department(view):
    return load.replace_department(view("v_unique").select("insee", "ingest_rank"), view("v_document").where("insee like '05%' and annee is not null").select("insee", "ingest_rank"), "05")


@query("SELECT u.ingest_rank, CASE WHEN n.k IS NOT NULL THEN n.m ELSE u.iiif_manifest END AS iiif_manifest FROM v_unique u LEFT JOIN (SELECT archive_url AS k, arg_min(image_url, ingest_rank) AS m FROM v_document WHERE image_url IS NOT NULL AND annee IS NULL GROUP BY 1) n ON u.archive_url = n.k")
def update_by_key(view):
    updates = view("v_document").where("image_url is not null and annee is null").select("archive_url", F.col("image_url").alias("iiif_manifest"), F.col("ingest_rank").alias("rank"))
    return load.update_by_key(view("v_unique"), updates, "archive_url", ["iiif_manifest"]).select("ingest_rank", "iiif_manifest")


@query("""SELECT ingest_rank, CASE WHEN ingest_rank % 3 = 0 THEN 'x' ELSE CASE dept WHEN '25' THEN 'Archives départementales du Doubs' WHEN '21' THEN 'Archives départementales de la Côte-d''Or' END END AS source,
    CASE WHEN ingest_rank % 3 = 0 THEN NULL ELSE CASE dept WHEN '25' THEN 'https://portail-archives.doubs.fr' WHEN '21' THEN 'https://archives.cotedor.fr' END END AS source_url FROM v_unique""")
def fill_source_by_dept(view):
    d = view("v_unique").select("ingest_rank", "insee", F.when(F.col("ingest_rank") % 3 == 0, "x").alias("source"), F.lit(None).cast("string").alias("source_url"))
    return load.fill_source_by_dept(d).drop("insee")


_ROOT, _FOLDER = r"regexp_extract(cote, '^3 P (\d+[A-Z]?)', 1)", r"'3P_' || lpad(regexp_extract(cote, '^3 P (\d+)', 1), 3, '0') || regexp_extract(cote, '^3 P \d+([A-Z]?)', 1)"


@query(f"SELECT rank, coalesce(CASE WHEN manifest_url IS NOT NULL THEN image_url END, 'https://archives.example/iiif/' || {_FOLDER} || '/FR_' || {_FOLDER} || '_' || lpad(regexp_extract(cote, '/(\\d+)$', 1), 2, '0') || '.jpg') AS image FROM v_notice")
def image_of_notice(view):
    """The manifest's picture, else the one that the shelf mark gives."""
    n = view("v_notice").withColumn("p", P.parse_cote("cote"))
    derived = P.image_url_from_cote("p.root", "p.rank", "https://archives.example/iiif", "FR_")
    return n.select("rank", F.coalesce(F.when(F.col("manifest_url").isNotNull(), F.col("image_url")), derived).alias("image"))


@query("SELECT n.rank, m.label FROM v_notice n JOIN v_manifest m ON n.ark = m.ark")
def manifest_join(view):
    return load.manifest_join(view("v_notice").select("ark", "rank"), view("v_manifest").select("ark", "label")).select("rank", "label")


_FOUND = "CASE WHEN coalesce(a.fetch_ok, true) AND a.items > 0 THEN 'https://annotations.example/images/' || a.id END"


@query(f"SELECT g.ingest_rank, substr(sha1(iiif_manifest), 1, 16) AS annotation_id, {_FOUND} AS found_url FROM v_georef g LEFT JOIN v_annotation a ON substr(sha1(iiif_manifest), 1, 16) = a.id")
def georef_status(view):
    return load.georef_status(view("v_georef"), view("v_annotation"), "https://annotations.example/images/").select("ingest_rank", "annotation_id", "found_url")


_DIFF = f"SELECT g.archive_url, {_FOUND} AS georef_url FROM v_georef g LEFT JOIN v_annotation a ON substr(sha1(iiif_manifest), 1, 16) = a.id WHERE type = 'tableau_assemblage' AND iiif_manifest IS NOT NULL AND {_FOUND} IS DISTINCT FROM g.georef_url"


@query(_DIFF)
def diff_georef(view):
    return load.diff_georef(view("v_georef"), view("v_annotation"))


@query(f"SELECT g.archive_url, CASE WHEN d.archive_url IS NOT NULL THEN d.georef_url ELSE g.georef_url END AS georef_url FROM v_georef g LEFT JOIN ({_DIFF}) d ON g.archive_url = d.archive_url")
def apply_georef(view):
    return load.apply_georef(view("v_georef"), load.diff_georef(view("v_georef"), view("v_annotation"))).select("archive_url", "georef_url")


@query("""SELECT substr(sha1(iiif_manifest), 1, 16) AS annotation_id, 'item-' || substr(sha1(iiif_manifest), 1, 4) AS item FROM v_georef WHERE georef_url IS NOT NULL AND iiif_manifest IS NOT NULL AND substr(sha1(iiif_manifest), 1, 16) IN (SELECT id FROM v_annotation WHERE items > 0)""")
def annotation_collection(view):
    pages = view("v_annotation").where("items > 0").select("id", F.array(F.concat(F.lit("item-"), F.substring("id", 1, 4))).alias("items"))
    return load.annotation_collection(view("v_georef"), pages)


@query("SELECT id, change FROM (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'removed' WHEN o.etag IS DISTINCT FROM n.etag THEN 'changed' END AS change FROM (SELECT id, title AS etag FROM v_node WHERE hash_key % 5 <> 0) o FULL JOIN (SELECT id, CASE WHEN hash_key % 3 = 0 THEN 'x' ELSE title END AS etag FROM v_node WHERE hash_key % 7 <> 0) n ON o.id = n.id) x WHERE change IS NOT NULL".replace("FROM v_node WHERE", "FROM (SELECT *, length(id) + ascii(substr(id, length(id), 1)) AS hash_key FROM v_node) v WHERE"))
def changed_nodes(view):
    n = view("v_node").withColumn("h", F.length("id") + F.ascii(F.substring("id", -1, 1)))
    return load.changed_nodes(n.where("h % 5 <> 0").select("id", F.col("title").alias("etag")), n.where("h % 7 <> 0").select("id", F.when(F.col("h") % 3 == 0, "x").otherwise(F.col("title")).alias("etag")))
