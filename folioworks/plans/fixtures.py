"""Catalogue views over the driver's tables.

Each view is portable SQL over base tables and earlier views, so that queries() and oracle_sql() start from the same
relations. The operators under test are not in here.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

VIEWS = {
    "v_dept": """
        SELECT lpad(CAST(n_nationkey + 1 AS STRING), 2, '0') AS dept, n_name AS nom, n_regionkey AS region FROM {nation}""",
    "v_commune": """
        SELECT dept || lpad(CAST(r AS STRING), 3, '0') AS insee, dept, k AS custkey,
               CASE k % 5 WHEN 0 THEN 'Saint-Étienne-' WHEN 1 THEN 'L''Île ' WHEN 2 THEN 'Évreux sur Œuvre ' WHEN 3 THEN 'Les Allemands ' ELSE 'Beaulne-et-Chivy ' END
                 || CAST(CASE WHEN k % 11 = 0 THEN k % 50 ELSE k END AS STRING) AS nom,
               CAST(floor(abs(bal)) AS BIGINT) * 1000 + k AS population,
               CAST(k % 100 AS DOUBLE) / 8 - 5 AS lon, CAST(floor(k / 100) AS DOUBLE) / 8 + 42 AS lat
        FROM (SELECT lpad(CAST(c_nationkey + 1 AS STRING), 2, '0') AS dept, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r, c_custkey AS k, c_acctbal AS bal
              FROM {customer}) x""",
    "v_alias": """
        SELECT dept, 'Ancien ' || nom AS name, insee AS code FROM {v_commune} WHERE custkey % 7 = 0
        UNION ALL SELECT dept, 'ancien ' || nom AS name, dept || '999' AS code FROM {v_commune} WHERE custkey % 70 = 0""",
    "v_mvt": """
        SELECT 'COM' AS typecom_av, CAST(p_partkey AS STRING) AS com_av, CASE WHEN p_partkey % 29 = 0 THEN 'COMD' ELSE 'COM' END AS typecom_ap,
               CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING) AS com_ap FROM {part}
        UNION ALL SELECT 'COM', CAST(p_partkey AS STRING), 'COM', CAST(CAST(floor(p_partkey / 3) AS BIGINT) + 1 AS STRING) FROM {part} WHERE p_size % 10 = 0""",
    "v_current": """
        SELECT CAST(p_partkey AS STRING) AS code, 'Ville ' || CAST(p_partkey AS STRING) AS nom FROM {part} WHERE p_partkey <= 25""",
    "v_history": """
        SELECT 'COM' AS typecom, CAST(p_partkey AS STRING) AS com, 'Ville ' || CAST(p_partkey % 150 AS STRING) AS libelle, CASE WHEN p_partkey % 4 = 0 THEN 'Bourg ' || CAST(p_partkey % 90 AS STRING) END AS nccenr
        FROM {part}""",
    "v_notice": """
        SELECT l_orderkey * 1000000000 + l_linenumber * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS rank,
               CAST(l_orderkey * 10 + l_linenumber AS STRING) AS notice_id,
               'ark:/12345/a' || CAST(l_orderkey AS STRING) || 'x' || CAST(l_linenumber AS STRING) AS ark,
               c.dept AS dept_expected, c.insee AS true_insee, c.nom AS true_nom, c.custkey,
               CASE WHEN l_partkey % 19 = 0 THEN 'Plan général' WHEN l_partkey % 23 = 0 THEN 'Sections A et B' WHEN l_linenumber = 1 THEN 'Tableau d''assemblage'
                    WHEN l_linenumber % 2 = 0 THEN 'Section ' || chr(CAST(65 + l_partkey % 5 AS INT)) || ' dite de la Côte. Feuille ' || CAST(l_linenumber AS STRING)
                    WHEN l_partkey % 3 = 0 THEN 'Section ' || chr(CAST(65 + l_partkey % 5 AS INT)) ELSE 'Feuille ' || CAST(l_linenumber AS STRING) END AS title,
               CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 17 = 0 THEN '[vers] 1885' ELSE CAST(year(o_orderdate) - 180 + (l_partkey % 7) * 5 AS STRING) || CASE WHEN l_linenumber = 3 THEN '-05-01' ELSE '' END END AS year_raw,
               CASE l_linenumber % 5 WHEN 0 THEN c.nom WHEN 1 THEN c.nom || ' (Nord, France)' WHEN 2 THEN 'Vieux Bourg / ' || c.nom WHEN 3 THEN 'Les Hameaux (' || c.nom || ', Nord, France)' ELSE 'Ancien ' || c.nom END AS commune_raw,
               '3P' || lpad(CAST(c.custkey AS STRING), 4, '0') || '_' || lpad(CAST(l_linenumber AS STRING), 2, '0') AS ident,
               '3 P ' || CAST(c.custkey % 130 AS STRING) || CASE WHEN c.custkey % 3 = 0 THEN chr(CAST(65 + c.custkey % 4 AS INT)) ELSE '' END || '/' || CAST(l_linenumber AS STRING) AS cote,
               'S' || CAST(l_suppkey % 20 AS STRING) AS service_id,
               'https://archives.example/' || CAST(l_orderkey AS STRING) || '/' || CAST(l_linenumber AS STRING) AS archive_url,
               CASE WHEN l_partkey % 4 <> 0 THEN 'https://iiif.example/' || CAST(l_orderkey AS STRING) || '/' || CAST(l_linenumber AS STRING) || '/manifest' END AS manifest_url,
               CASE WHEN l_partkey % 5 <> 0 THEN 'https://images.example/' || CAST(l_orderkey AS STRING) || '/plan_' || lpad(CAST(l_linenumber AS STRING), 2, '0') || '.jpg' END AS image_url
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {v_commune} c ON o_custkey = c.custkey""",
    "v_document": """
        SELECT rank AS ingest_rank, true_insee AS insee, dept_expected AS dept, true_nom AS nom,
               CASE WHEN title LIKE 'Tableau%' OR title LIKE 'Plan g%' THEN 'tableau_assemblage' WHEN title LIKE '%Feuille%' THEN 'feuille' WHEN title LIKE 'Section %' THEN 'section' ELSE 'feuille' END AS type,
               CASE WHEN title LIKE 'Section %' THEN substr(title, 9, 1) END AS section_lettre,
               CASE WHEN title LIKE '%Feuille%' THEN CAST(substr(notice_id, length(notice_id), 1) AS INT) END AS feuille_num,
               CASE WHEN year_raw IS NOT NULL AND year_raw NOT LIKE '[%' THEN CAST(substr(year_raw, 1, 4) AS INT) END AS annee,
               cote, archive_url, manifest_url AS iiif_manifest, image_url, CAST(NULL AS STRING) AS source, service_id,
               CAST(substr(service_id, 2) AS INT) % 3 <> 0 AS licence_overlay_ok
        FROM {v_notice}""",
    "v_unique": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY archive_url ORDER BY ingest_rank) AS pick FROM {v_document}) x WHERE pick = 1""",
    "v_annotation": """
        SELECT substr(sha1(iiif_manifest), 1, 16) AS id, min(CASE WHEN ingest_rank % 3 = 0 THEN 0 ELSE 1 END) AS items, min(ingest_rank % 7) <> 0 AS fetch_ok
        FROM {v_unique} WHERE iiif_manifest IS NOT NULL AND ingest_rank % 2 = 0 GROUP BY 1""",
    "v_georef": """
        SELECT *, CASE WHEN iiif_manifest IS NOT NULL AND ingest_rank % 5 < 2 THEN 'https://annotations.example/images/' || substr(sha1(CASE WHEN ingest_rank % 5 = 0 THEN iiif_manifest ELSE archive_url END), 1, 16) END AS georef_url FROM {v_unique}""",
    "v_node": """
        SELECT 'root' AS id, 'Fonds' AS title, CAST(NULL AS INT) AS begin_year, CAST(NULL AS INT) AS end_year, CAST(NULL AS STRING) AS manifest, CAST(NULL AS STRING) AS service_uri
        UNION ALL SELECT 'c' || CAST(custkey AS STRING), nom, NULL, CASE WHEN custkey % 31 = 0 THEN 1780 END, NULL, NULL FROM {v_commune}
        UNION ALL SELECT 'o' || CAST(o_orderkey AS STRING), CASE o_orderkey % 9 WHEN 0 THEN 'Cadastre rénové' WHEN 1 THEN 'Matrices' WHEN 2 THEN 'Plans d''intendance' ELSE 'Plans du cadastre' END, year(o_orderdate) - 180, year(o_orderdate) - 150, NULL, NULL FROM {orders}
        UNION ALL SELECT 'l' || notice_id, min(title), min(CAST(substr(year_raw, 1, 4) AS INT)), NULL, min(manifest_url), min('https://data.example/service/' || service_id || '/')
                  FROM {v_notice} WHERE year_raw IS NULL OR year_raw NOT LIKE '[%' GROUP BY 1""",
    "v_edge": """
        SELECT 'root' AS parent_id, 'c' || CAST(custkey AS STRING) AS child_id, custkey AS pos FROM {v_commune}
        UNION ALL SELECT 'c' || CAST(o_custkey AS STRING), 'o' || CAST(o_orderkey AS STRING), o_orderkey FROM {orders}
        UNION ALL SELECT 'o' || CAST(CAST(floor(CAST(notice_id AS BIGINT) / 10) AS BIGINT) AS STRING), 'l' || notice_id, CAST(notice_id AS BIGINT)
                  FROM (SELECT DISTINCT notice_id FROM {v_notice} WHERE year_raw IS NULL OR year_raw NOT LIKE '[%') x""",
    "v_service": """
        SELECT DISTINCT 'S' || CAST(s_suppkey % 20 AS STRING) AS id, lpad(CAST(s_suppkey % 20 % 25 + 1 AS STRING), 2, '0') AS dept, 'Archives ' || CAST(s_suppkey % 20 AS STRING) AS name FROM {supplier} WHERE s_suppkey % 20 <> 7""",
    "v_manifest": """
        SELECT ark, min(rank) AS rank, min(CASE WHEN custkey % 9 = 0 THEN ident || ' • ' || true_nom || ' : ' || title || ' • ' || coalesce(substr(year_raw, 1, 4), 's.d.') ELSE true_nom || ' : ' || title END) AS label,
               min(year_raw) AS dates, min(commune_raw) AS commune, min(ident) AS ident, min(service_id) AS service_id
        FROM {v_notice} WHERE manifest_url IS NOT NULL GROUP BY ark""",
    "v_insert_event": """
        SELECT event_id, ts, 'https://archives.example/e' || CAST(CAST(floor(event_id / 2) AS BIGINT) AS STRING) AS archive_url, lpad(CAST(user_id % 25 + 1 AS STRING), 2, '0') AS dept FROM {events}""",
}


def view(spark: SparkSession, sf_dir: str) -> Callable[[str], DataFrame]:
    """A function from the name of a table or view to its DataFrame."""
    made: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name not in made:
            if name in TABLES:
                made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            else:
                made[name] = spark.sql(VIEWS[name], **{d: get(d) for d in _needs(VIEWS[name])})
        return made[name]

    return get


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def oracle(sql: str) -> str:
    """`sql` over the names of views and tables, with the views it needs before it."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in order:
            for d in _needs(VIEWS[name]):
                need(d)
            order.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            need(name)
    if not order:
        return sql
    views = ",\n".join(f"{n} AS MATERIALIZED ({re.sub(r'[{](\w+)[}]', r'\1', VIEWS[n])})" for n in order)
    return f"WITH {views}\nSELECT * FROM ({sql}) AS answer"
