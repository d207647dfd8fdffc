"""Parsing of titles, shelf marks, years and manifest labels, and predicates, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioworks.functions.text import col, extract, norm_ws, once, strip

TABLEAU, SECTION, FEUILLE = "tableau_assemblage", "section", "feuille"
# Patterns of titles.
PLANS = r"plan|atlas|cadastr|tableau\s+d['e ]assemblage|assemblage|\bsection\b"
NO_PLANS = (r"matric|mutation|\b[ée]tats?\b|registre|répertoire|repertoire|\btable\b|classement|arpentage|proc[èe]s|délimitation|delimitation|"
            r"limites?\s+de\s+commune|propri[ée]t|\bfolios?\b|sommier|r[ée]nov|remembr")
EXCLUDED = r"rénov|renov|intendance|masse de culture"
KEPT_LEAVES = r"atlas\s+parcellaire|tableau\s+d|plan"


def _int(x: Column) -> Column:
    return x.try_cast("int")


def classify(title, profile: str) -> Column:
    """struct(type, section_lettre, feuille_num) of a title; profiles differ on purpose."""
    return once(norm_ws(F.coalesce(col(title), F.lit(""))), lambda t: _classify(t, profile))


def _classify(t: Column, profile: str) -> Column:
    none, no_num = F.lit(None).cast("string"), F.lit(None).cast("int")
    row = lambda kind, letter=none, num=no_num: F.struct(F.lit(kind).alias("type"), letter.alias("section_lettre"), num.alias("feuille_num"))
    if profile == "finding_aid":
        low = F.lower(t)
        return F.when(F.contains(low, F.lit("tableau")), row(TABLEAU)).when(F.contains(low, F.lit("section")), row(SECTION)).otherwise(row(FEUILLE))
    if profile == "portal":
        return F.when(t.rlike(r"(?iU)tableau\s+d.assemb|atlas|ta\b"), row(TABLEAU)).otherwise(row(FEUILLE))
    if profile == "open_data":
        return F.when(t.rlike("(?iU)assemblage"), row(TABLEAU)).when(t.rlike("(?iU)section"), row(SECTION)).otherwise(row(FEUILLE))
    num = _int(extract(t, r"(?iU)Feuille\s+(\d+)"))
    overview = t.rlike(r"(?iU)tableau|plan\s+g[ée]n[ée]ral")
    if profile == "inventory":
        letter = F.coalesce(extract(t, r"(?U)(?:^|\s)Section\s+([A-Z]{1,2})(?=[\s.,]|$)"), extract(t, r"(?U)^Sections?\s+([A-Z])(?=[\s.,]|$)"))
        first = F.when(overview, row(TABLEAU, letter))
    elif profile == "manifest":
        letter = extract(t, r"(?U)(?:^|\s)Sections?\s+([A-Z]{1,2})(?=[\s.,]|$)")
        first = F.when(overview, row(TABLEAU))
    else:
        raise ValueError(f"no such profile: {profile}")
    return first.when(num.isNotNull(), row(FEUILLE, letter, num)).when(letter.isNotNull(), row(SECTION, letter)).otherwise(row(FEUILLE))


def parse_title_line(line) -> Column:
    """`3 P 1/2 - Section A. | 1825` -> struct(cote, title, year)."""
    year = _int(extract(line, r"\|\s*(\d{4})"))
    rest = strip(F.when(year.isNotNull(), F.regexp_extract(col(line), r"(?s)^(.*?)\|\s*\d{4}", 1)).otherwise(col(line)))
    form = r"^(3\s*P\s*\d+[A-Za-z]?(?:/\d+)?)\s*-\s*(.*)$"
    cote = norm_ws(extract(rest, form, 1))
    return F.struct(cote.alias("cote"), norm_ws(F.when(cote.isNotNull(), F.regexp_extract(rest, form, 2)).otherwise(rest)).alias("title"), year.alias("year"))


def parse_cote(cote) -> Column:
    """`3 P 28A/5` -> struct(root `28A`, rank 5)."""
    form = r"(?i)^3\s*P\s*(\d+[A-Z]?)(?:/(\d+))?$"
    return F.struct(F.upper(extract(norm_ws(cote), form, 1)).alias("root"), _int(extract(norm_ws(cote), form, 2)).alias("rank"))


def parse_cote_free(text) -> Column:
    return strip(extract(text, r"(\d+\s*[WP]\s*[\d\s/]+)"))


def natural_cote_key(root) -> Column:
    """struct that sorts 9 < 28A < 28B < 102; what isn't number and letter comes last."""
    n = _int(extract(root, r"^(\d+)([A-Z]?)$", 1))
    return F.struct(F.coalesce(n, F.lit(10**9)).alias("n"), F.when(n.isNotNull(), F.regexp_extract(col(root), r"^(\d+)([A-Z]?)$", 2)).otherwise(col(root)).alias("letter"))


def natural_key(text) -> Column:
    """String that sorts digit runs by value, of any length: each stands as its length's number of digits, its length and its digits without leading zeros."""

    def run(p: Column) -> Column:
        digits = F.regexp_replace(p, r"^0+(?=\d)", "")
        length = F.length(digits).cast("string")
        return F.when(p.rlike(r"^\d"), F.concat(F.length(length).cast("string"), length, digits)).otherwise(p)

    return F.array_join(F.transform(F.regexp_extract_all(col(text), F.lit(r"(\d+|\D+)"), 1), run), "")


def image_folder_from_cote(root) -> Column:
    n = extract(root, r"^(\d+)([A-Z]?)$", 1)
    padded = F.when(F.length(n) >= 3, n.cast("int").cast("string")).otherwise(F.lpad(n, 3, "0"))
    padded = F.when(F.length(padded) < 3, F.lpad(padded, 3, "0")).otherwise(padded)
    return F.when(n.isNotNull(), F.concat(F.lit("3P_"), padded, F.regexp_extract(col(root), r"^(\d+)([A-Z]?)$", 2))).otherwise(F.concat(F.lit("3P_"), col(root)))


def image_url_from_cote(root, plate, base: str, prefix: str) -> Column:
    """The picture's address by the shelf mark, for plates whose manifest can't be read: base/<folder>/<prefix><folder>_<plate of two digits or more>.jpg"""
    number = col(plate).cast("string")
    folder = image_folder_from_cote(root)
    return F.concat(F.lit(f"{base}/"), folder, F.lit(f"/{prefix}"), folder, F.lit("_"), F.when(F.length(number) < 2, F.concat(F.lit("0"), number)).otherwise(number), F.lit(".jpg"))


def parse_manifest_label(label, dates, separators: str = "•·|") -> Column:
    """`IDENT • Commune : Title • 1828` -> struct(ident, title, year); a year is a whole segment, the last one counts, else the first in `dates`."""
    parts = F.filter(F.transform(F.split(norm_ws(F.coalesce(col(label), F.lit(""))), f"[{separators}]"), lambda p: strip(p)), lambda p: p != "")
    has_ident = (F.size(parts) >= 2) & ~F.contains(F.coalesce(F.get(parts, F.lit(0)), F.lit("")), F.lit(":"))
    ident = F.when(has_ident, F.get(parts, F.lit(0)))
    rest = F.when(has_ident, F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    years = F.filter(rest, lambda p: p.rlike(r"^1[6-9]\d\d$"))
    title = F.get(F.filter(rest, lambda p: ~p.rlike(r"^1[6-9]\d\d$")), F.lit(0))
    title = F.when(F.contains(title, F.lit(":")), strip(F.regexp_extract(title, r"(?s)^[^:]*:(.*)$", 1))).otherwise(title)
    year = F.coalesce(_int(F.try_element_at(years, F.lit(-1))), _int(extract(dates, r"(1[6-9]\d\d)")))
    return F.struct(ident.alias("ident"), title.alias("title"), year.alias("year"))


def parse_ident(ident) -> Column:
    """struct(cote as it is written, plate rank from a `_NN` ending)."""
    cote = norm_ws(F.nullif(col(ident), F.lit("")))
    return F.struct(cote.alias("cote"), _int(extract(cote, r"_(\d{1,3})$")).alias("plate"))


def parse_year(text, dialect: str) -> Column:
    """any4: first four digits in a row; modern: first 1600-1999; prefix4: the text's first four characters; digits: the whole text."""
    pattern = {"any4": r"(\d{4})", "modern": r"(1[6-9]\d{2})", "prefix4": r"^(\d{4})", "digits": r"^(\d+)$"}[dialect]
    return _int(extract(text, pattern))


def section_letter(text) -> Column:
    first = F.substring(strip(col(text)), 1, 1)
    return F.when(first.rlike(r"^\p{L}$"), F.upper(first))


def page_type(image_url) -> Column:
    """struct(type, feuille_num) by the page number that ends an image's name; page 1 is the overview."""
    page = _int(extract(image_url, r"(?i)_(\d{1,3})\.jpe?g$"))
    return F.when(page.isNotNull(), F.struct(F.when(page == 1, F.lit(TABLEAU)).otherwise(F.lit(FEUILLE)).alias("type"), F.when(page != 1, page).alias("feuille_num")))


def ident_family(ident) -> Column:
    return F.coalesce(F.regexp_replace(F.nullif(col(ident), F.lit("")), r"\d+", "#"), F.lit("(aucun identifiant)"))


def last_context(context) -> Column:
    return F.nullif(strip(F.element_at(F.split(col(context), ">"), -1)), F.lit(""))


def bbox_wkt(xmin, ymin, xmax, ymax) -> Column:
    """Closed rectangle, five points."""
    a, b, c, d = (col(v).cast("string") for v in (xmin, ymin, xmax, ymax))
    point = lambda x, y: F.concat_ws(" ", x, y)
    return F.concat(F.lit("POLYGON(("), F.concat_ws(", ", point(a, b), point(c, b), point(c, d), point(a, d), point(a, b)), F.lit("))"))


def thumbnail_choice(image, manifest, frozen) -> Column:
    """struct(kind, url): image before manifest before the department's frozen picture."""
    some = lambda x: F.nullif(col(x), F.lit(""))
    kind = F.when(some(image).isNotNull(), F.lit("image")).when(some(manifest).isNotNull(), F.lit("manifest")).when(some(frozen).isNotNull(), F.lit("frozen")).otherwise(F.lit("none"))
    return F.struct(kind.alias("kind"), F.coalesce(some(image), some(manifest), some(frozen)).alias("url"))


def period_overlaps(begin, end, lo: int, hi: int) -> Column:
    """Whether [begin, end] meets [lo, hi]; null is an open end."""
    return (F.coalesce(col(begin), F.lit(-(10**9))) <= hi) & (F.coalesce(col(end), F.lit(10**9)) >= lo)


def in_period(year, lo: int | None, hi: int | None) -> Column:
    """Unknown years are kept."""
    inside = F.lit(True)
    if lo is not None:
        inside = inside & (col(year) >= lo)
    if hi is not None:
        inside = inside & (col(year) <= hi)
    return col(year).isNull() | inside


def excluded_branch(title) -> Column:
    return F.coalesce(col(title).rlike("(?iU)" + EXCLUDED), F.lit(False))


def is_plans_title(title) -> Column:
    t = F.coalesce(col(title), F.lit(""))
    return t.rlike("(?iU)" + PLANS) & ~t.rlike("(?iU)" + NO_PLANS)


def keep_leaf_title(title) -> Column:
    return F.coalesce(col(title).rlike("(?iU)" + KEPT_LEAVES), F.lit(False))


def in_viewport(lon, lat, west: float, south: float, east: float, north: float) -> Column:
    return col(lon).between(west, east) & col(lat).between(south, north)
