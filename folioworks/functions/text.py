"""Text normalisation as Column expressions; null stays null unless said otherwise.

Patterns carry (?U) or (?iU): white space, digits, word borders and case then follow Unicode, as titles are French.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extract(x, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where there is none or it is empty."""
    return F.nullif(F.regexp_extract(col(x), pattern, group), F.lit(""))


def strip(x, chars: str = r"\s") -> Column:
    """Without leading and trailing characters of the class `chars`."""
    return F.regexp_replace(col(x), f"(?U)^[{chars}]+|[{chars}]+$", "")


def once(x: Column, f) -> Column:
    """f of the value of `x`, which is worked out once however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def norm_ws(x) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(col(x), r"(?U)\s+", " "))


def _folding() -> tuple[str, str]:
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base != chr(code):
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = _folding()


def fold_accents(x) -> Column:
    """Latin letters without their accents; combining marks go, ligatures stay."""
    return F.regexp_replace(F.translate(col(x), _FROM, _TO), r"\p{Mn}", "")


def french(x) -> Column:
    """The text under French collation: sorts and compares as a French reader expects, accents and case only between texts that are equal without them, ligatures as their letters."""
    return F.collate(col(x), "fr")


def key_spaced(x, curly: bool = False) -> Column:
    """Comparison key: lower case, no accents; spaces, hyphens and apostrophes become one space."""
    return F.trim(F.regexp_replace(fold_accents(F.lower(col(x))), "(?U)[\\s\\-'" + ("’" if curly else "") + "]+", " "))


def key_compact(x) -> Column:
    """Comparison key: only a-z and 0-9 are left."""
    return F.regexp_replace(F.lower(fold_accents(col(x))), "[^a-z0-9]+", "")


def clean_commune_listed(x) -> Column:
    """`Name (place) [note], other` -> `Name`; null when nothing is left."""
    out = F.regexp_replace(F.regexp_replace(col(x), r"\(.*?\)", ""), r"\[.*?\]", "")
    return F.nullif(strip(F.split(out, ",")[0], r"\s."), F.lit(""))


def clean_commune_paren(x, places: list[str]) -> Column:
    """`Old (Current, Department, Country)` -> the first part in brackets that names no department or country, else the head; then the text after the last slash."""
    known = F.array(*(F.lit(p.lower()) for p in [*places, "france"]))

    def named(n: Column) -> Column:
        # White space is single spaces by now, so plain string functions do.
        at = F.instr(n, "(")
        inside = F.substr(n, at + 1, F.length(n) - at - 1)
        parts = F.filter(F.transform(F.split(inside, ","), lambda p: F.trim(p)), lambda p: (p != "") & ~F.array_contains(known, F.lower(p)))
        head = F.rtrim(F.substr(n, F.lit(1), at - 1))
        return F.when((at > 0) & F.endswith(n, F.lit(")")), F.coalesce(F.get(parts, F.lit(0)), head)).otherwise(n)

    bare = F.trim(F.rtrim(norm_ws(x), F.lit(".")))
    return F.trim(F.element_at(F.split(once(bare, named), "/"), -1))


def clean_commune_slash(x) -> Column:
    """`Old / Current (note).` -> `Current`."""
    n = F.trim(F.rtrim(norm_ws(x), F.lit(".")))
    return F.trim(F.element_at(F.split(F.regexp_replace(n, r"\s*\(.*?\)\s*$", ""), "/"), -1))


def reorder_article(x) -> Column:
    """`Allemands (Les)` -> `Les Allemands`, `Isle (L')` -> `L'Isle`; then without brackets and list tail."""
    n = strip(F.translate(col(x), "’‘", "''"))
    form = r"(?iU)^(.+?)\s*\(\s*(les|le|la|l')\s*\)\s*$"
    head, article = F.regexp_extract(n, form, 1), F.regexp_extract(n, form, 2)
    glue = F.when(F.endswith(article, F.lit("'")), F.lit("")).otherwise(F.lit(" "))
    return clean_commune_listed(F.when(article != "", F.concat(article, glue, head)).otherwise(n))


# First words of titles that name a kind of document, not a commune.
GENERIC_TITLES = ("tableau", "section", "plan", "feuille", "matrice", "état", "etat", "atlas", "registre", "cadastre")
# Patterns of rubric titles, of places that are no communes, of branches to leave out.
RUBRIC = (r"^(sections?|feuilles?|tableaux?|matrices?|registres?|listes?|folios?|cases\s|"
          r"renvois|proc[èe]s|limites|[ée]tats?|atlas|cadastres?|plans?\s)")
NO_COMMUNE = r";\s*(d[ée]partement|r[ée]gion|pays|canton|arrondissement|province)\s*\)"


def commune_from_titles(leaf, parent) -> Column:
    """The leaf's title without its year, or the parent's title when the leaf's is generic."""
    t = strip(F.coalesce(col(leaf), F.lit("")))
    generic = F.lit(False)
    for w in GENERIC_TITLES:
        generic = generic | F.startswith(F.lower(t), F.lit(w))
    return F.when((t != "") & ~generic, strip(F.regexp_replace(t, r"(?sU)[\s,]+\d{3,4}.*$", ""), r"\s.,")).otherwise(col(parent))


def is_rubric_title(x) -> Column:
    return col(x).rlike("(?iU)" + RUBRIC)


def is_non_commune_place(x) -> Column:
    return col(x).rlike("(?iU)" + NO_COMMUNE)


def url_quote(x) -> Column:
    """Percent-encoding with nothing kept but letters, digits and _.-~"""
    return F.replace(F.replace(F.replace(F.url_encode(col(x)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def static_manifest_url(image, base: str) -> Column:
    return F.concat(F.lit(f"{base}/static-manifest?u="), url_quote(image))


def annotation_id(url) -> Column:
    """First 16 hexadecimal digits of the URL's SHA-1."""
    return F.substring(F.sha1(col(url).cast("binary")), 1, 16)


def last_segment(uri) -> Column:
    return F.element_at(F.split(F.regexp_replace(col(uri), "/+$", ""), "/"), -1)


def public_url(uri, base: str) -> Column:
    return F.replace(col(uri), F.lit(f"{base}/"), F.lit(f"{base}/fr/"))


def department(insee) -> Column:
    return F.substring(col(insee), 1, 2)
