"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from folioworks.llm import merkle
from folioworks.llm.url_filter import RULES

_RULES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)



def _tree(text: str) -> str:
    """A text's fingerprint as an SQL expression."""
    paragraph = lambda p, pieces: f"list_transform(regexp_extract_all({p}, '{pieces}'), lambda x: sha256(x) || lpad(CAST(length(x) AS VARCHAR), 2, '0'))"
    opening = f"CASE WHEN {text} = '' THEN [] ELSE [{paragraph(f'substr({text}, 1, {merkle.OPENING})', merkle.WORDS)}] END"
    rest = f"list_transform(regexp_extract_all(substr({text}, {merkle.OPENING + 1}), '{merkle.PARAGRAPHS}'), lambda q: {paragraph('q', merkle.PIECES)})"
    whole = f"""list_transform(list_concat({opening}, {rest}), lambda ps: {{'h': sha256(coalesce(array_to_string(ps, ''), '')),
                't': coalesce(array_to_string(list_transform(ps, lambda x: x[1:8] || x[65:66]), ''), '')}})"""
    closes = f"substr(p[i].h, 64, 1) IN ({', '.join(repr(c) for c in merkle.CLOSING)}) OR i = len(p)"
    ends = f"(SELECT {{'p': p, 'e': list_filter(range(1, len(p) + 1), lambda i: {closes})}} FROM (SELECT {whole} AS p))"
    cut = "list_transform(range(1, len(s.e) + 1), lambda k: s.p[CASE WHEN k = 1 THEN 1 ELSE s.e[k - 1] + 1 END : s.e[k]])"
    node = "list_transform(c, lambda ps: {'h': sha256(array_to_string(list_transform(ps, lambda x: x.h), '')), 't': array_to_string(list_transform(ps, lambda x: x.t), '.')})"
    line = "sha256(coalesce(array_to_string(list_transform(n, lambda x: x.h), ''), '')) || coalesce(array_to_string(list_transform(n, lambda x: '/' || x.h[1:16] || ':' || x.t), ''), '')"
    return f"(SELECT {line} FROM (SELECT {node} AS n FROM (SELECT {cut} AS c FROM (SELECT {ends} AS s))))"


def _near(a: str, b: str) -> str:
    """The likeness of two fingerprints as an SQL expression."""
    pieces = lambda x: f"list_distinct(flatten(list_transform(string_split({x}, '/')[2:], lambda s: regexp_extract_all(s[18:], '[0-9a-f]{{10}}'))))"
    weight = lambda x: f"coalesce(list_sum(list_transform({x}, lambda t: CAST(t[9:10] AS BIGINT))), 0)"
    return f"""CASE WHEN {a}[1:64] = {b}[1:64] THEN 1.0 ELSE (SELECT CAST(2 * {weight('list_intersect(x, y)')} AS DOUBLE) / CAST({weight('x')} + {weight('y')} AS DOUBLE)
               FROM (SELECT {pieces(a)} AS x, {pieces(b)} AS y)) END"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLES = {
    "op13_ranked_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
        n AS (SELECT r, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
        c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
        q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
        t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term, docs),
        u AS (SELECT t.r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))) AS u FROM t JOIN w USING (term) JOIN n USING (r), c),
        s AS (SELECT item_id, r, doc_id, CAST(sum(u) AS BIGINT) AS score FROM q JOIN u USING (term) GROUP BY ALL HAVING sum(u) > 0),
        k AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s)
        SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10""",
    "op11_merkle_fingerprint": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS h FROM documents),
        k AS (SELECT DISTINCT * FROM d),
        o AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS following, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
              FROM k WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, h)),
        e AS (SELECT o.doc_id, o.h, text, following, next_id, length(text) AS n, substr(text, 1, length(text) - length(text) // 3) || substr(following, 1, length(text) // 3) AS edited FROM o),
        f AS (SELECT *, {_tree('text')} AS fingerprint, {_tree('edited')} AS edited_fingerprint, {_tree('following')} AS next_fingerprint FROM e)
        SELECT d.doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
               {_near('fingerprint', 'edited_fingerprint')} AS near_edited, {_near('fingerprint', 'next_fingerprint')} AS near_next, next_id
        FROM d JOIN f ON d.doc_id IS NOT DISTINCT FROM f.doc_id AND d.h = f.h""",
    "op2_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op6_ngram_jaccard": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
                                  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS ss FROM w),
        n AS (SELECT doc_id, len(ss) AS n_shingles FROM s),
        e AS (SELECT doc_id, unnest(ss) AS x FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * common >= 90 * (na.n_shingles + nb.n_shingles - common)),
        g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        reach AS (SELECT doc_id AS a, doc_id AS r FROM n UNION SELECT g.b, reach.r FROM reach JOIN g ON reach.a = g.a WHERE reach.r < g.b)
        SELECT n.doc_id, n_shingles, min(r) AS component_id FROM n JOIN reach ON n.doc_id = reach.a GROUP BY ALL""",
    "op7_url_filter": f"""
        WITH r(verdict, h, p) AS (VALUES {_RULES}),
        u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        k AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        f AS (SELECT page_id, r.verdict, h || p AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS n
              FROM k JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT k.page_id, host, path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM k LEFT JOIN f ON k.page_id = f.page_id AND f.n = 1""",
}
