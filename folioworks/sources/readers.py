"""Readers of landed inventories: each turns files, or frames of their lines, into rows. Codes stay text."""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator
from itertools import islice
from typing import IO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.functions import parse as P
from folioworks.functions import text as T
from folioworks.operators.shared import first_wins, last_wins

# Kinds of map in the open data of department 71.
KINDS_71 = {
    "PARCELLAIRE": "feuille",
    "GEOMETRIQUE PARCELLAIRE": "feuille",
    "TABLEAU D'ASSEMBLAGE": "tableau_assemblage",
    "TABLEAUD'ASSEMBLAGE": "tableau_assemblage",
    "MASSE DE CULTURE": "feuille",
}


def numbered(lines: DataFrame) -> DataFrame:
    """Lines (value) with `pos`: their order within the read."""
    return lines.select("value", F.monotonically_increasing_id().alias("pos"))


def notices_tsv(lines: DataFrame) -> DataFrame:
    """(notice_id, ark, title) from `id TAB ark TAB title`; short or empty lines are skipped, a repeated id keeps its last line. lines: (value, pos)."""
    f = F.split("value", "\t", 3)
    rows = lines.where(F.size(f) >= 3).select(T.strip(f[0]).alias("notice_id"), T.strip(f[1]).alias("ark"), T.strip(f[2]).alias("title"), "pos")
    return last_wins(rows.where("notice_id <> '' and ark <> ''"), ["notice_id"], "pos").drop("pos")


def commune_tree(lines: DataFrame) -> DataFrame:
    """(rang, nom, id_notice, leaves, pos) from `rang~nom~id~leaves`."""
    f = F.split("value", "~", 4)
    return lines.where(F.size(f) == 4).select(f[0].alias("rang"), T.strip(f[1]).alias("nom"), f[2].alias("id_notice"), f[3].alias("leaves"), "pos")


def extract_arks(lines: DataFrame, naan: str) -> DataFrame:
    """(file, ark, first): arks of the authority in each file, each once; a file without any gives its first fields that look like ark names. lines: (file, value, pos)."""
    arks = F.regexp_extract_all("value", F.lit(f"ark:/{naan}/([A-Za-z0-9]+)"), 1)
    field = T.strip(F.split("value", "\t")[0])
    bare = F.when(field.rlike("^[A-Za-z0-9]{8,}$"), F.array(field)).otherwise(F.array().cast("array<string>"))
    per = lines.groupBy("file").agg(F.max(F.size(arks) > 0).alias("has_ark"))
    each = lines.join(per, "file").select("file", "pos", F.posexplode(F.when(F.col("has_ark"), arks).otherwise(bare)).alias("at", "ark"))
    return each.groupBy("file", "ark").agg(F.min(F.struct("pos", "at")).alias("first"))


def opendata_71(rows: DataFrame) -> DataFrame:
    """Documents of department 71 from a frame of text columns; header and cells may have spaces around."""
    rows = rows.select(*(T.strip(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(_name(c)) for c in rows.columns))
    section = next((c for c in rows.columns if c.startswith("N") and c.endswith("section")), None)
    kinds = F.create_map(*(F.lit(x) for pair in KINDS_71.items() for x in pair))
    out = rows.withColumn("type", F.try_element_at(kinds, F.col("Cartes"))).where(F.col("INSEE").rlike(r"^\d+$") & (F.col("Lien vers image Open Data") != "") & F.col("type").isNotNull())
    image = F.col("Lien vers image Open Data")
    code = F.col("INSEE").cast("int").cast("string")
    padded = F.when(F.length(code) < 3, F.lpad(code, 3, "0")).otherwise(code)
    return out.select(F.concat(F.lit("71"), padded).alias("insee"), "type", P.section_letter(section).alias("section_lettre") if section else F.lit(None).cast("string").alias("section_lettre"),
                      P.parse_year("Date", "any4").alias("annee"), F.col("Cotes").alias("cote"), F.coalesce(F.nullif(F.col("Lien ark vers Image AD71"), F.lit("")), image).alias("archive_url"), image.alias("image_url"))


def _name(name: str) -> str:
    return " ".join(name.replace("\xa0", " ").split())


def read_opendata_71(spark: SparkSession, path: str) -> DataFrame:
    return opendata_71(spark.read.csv(path, sep=";", header=True, encoding="ISO-8859-1"))


def opendata_25(rows: DataFrame) -> DataFrame:
    """(commune, annee, archive_url, image_url, pos): one row for each URL, the first, before any name is resolved. rows: (unitdate, unittitle, file_path, pos)."""
    r = rows.select(T.strip("unittitle").alias("commune"), P.parse_year("unitdate", "any4").alias("annee"), T.strip("file_path").alias("archive_url"), "pos")
    r = first_wins(r.where("commune <> '' and archive_url <> ''"), ["archive_url"], "pos")
    return r.select("commune", F.lit(P.FEUILLE).alias("type"), "annee", "archive_url", F.col("archive_url").alias("image_url"), "pos")


def opendata_31(rows: DataFrame) -> DataFrame:
    """(commune, type, annee, cote, archive_url, image_url) of rows with a commune and a picture. rows: (date, analyse, commune, image struct<url>)."""
    url = F.col("image.url")
    return rows.where((T.strip("commune") != "") & (url != "")).select(
        T.strip("commune").alias("commune"), P.classify("analyse", "open_data")["type"].alias("type"), P.parse_year("date", "modern").alias("annee"), P.parse_cote_free("analyse").alias("cote"), url.alias("archive_url"), url.alias("image_url"))


def opendata_92(rows: DataFrame) -> DataFrame:
    """Sections of department 92 that have a calibrated file and a five-digit code."""
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    good = F.col("nom_fichier_georef_homogeneise.url")
    code = T.strip("code_insee")
    return rows.where((good != "") & code.rlike(r"^\d{5}$")).select(
        code.alias("insee"), F.lit(P.SECTION).alias("type"), some("code_section").alias("section_lettre"), F.when(F.col("num_feuille").rlike(r"^\d+$"), F.col("num_feuille").try_cast("int")).alias("feuille_num"),
        P.parse_year("date", "modern").alias("annee"), some("cote").alias("cote"), good.alias("archive_url"), F.col("nom_fichier_source_homogeneise.url").alias("image_url"))


def _shapes(data: bytes) -> list[tuple[float, ...] | None]:
    """Extents of polygons, None for null shapes; other kinds have no row."""
    out, at = [], 100
    while at + 12 <= len(data):
        (words,) = struct.unpack(">i", data[at + 4 : at + 8])
        (kind,) = struct.unpack("<i", data[at + 8 : at + 12])
        if kind == 5:
            out.append(struct.unpack("<4d", data[at + 12 : at + 44]))
        elif kind == 0:
            out.append(None)
        at += 8 + 2 * words
    return out


def dbf_layout(described: bytes) -> tuple[list[str], struct.Struct]:
    """Names and record layout of a dBASE table from its field descriptions: 32 bytes each up to a carriage return; a record is a mark and the fields, each of fixed width."""
    described = described[: described.index(b"\r")]
    fields = list(struct.iter_unpack("<11s5xB15x", described[: len(described) // 32 * 32]))
    names = [name.partition(b"\0")[0].decode("latin-1") for name, _ in fields]
    return names, struct.Struct("x" + "".join(f"{width}s" for _, width in fields))


def _records(data: bytes) -> list[dict[str, str]]:
    count, head, _ = struct.unpack_from("<IHH", data, 4)
    names, layout = dbf_layout(data[32:])
    rows = layout.iter_unpack(data[head : head + count * layout.size])
    return [dict(zip(names, (v.decode("latin-1").strip() for v in row), strict=True)) for row in rows]


def shapefile_bboxes(files: DataFrame, key: str = r"(\w+)\.\w+$", name: str = "fichier") -> DataFrame:
    """(file_id, xmin, ymin, xmax, ymax) of pairs of files (stem, dbf, shp): records and shapes go by position, their counts must agree."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for dbf, shp in zip(pdf["dbf"], pdf["shp"], strict=True):
                records, shapes = _records(bytes(dbf)), _shapes(bytes(shp))
                if len(records) != len(shapes):
                    raise ValueError(f"{len(records)} records but {len(shapes)} shapes")
                for r, s in zip(records, shapes, strict=True):
                    m = re.search(key, r.get(name, ""))
                    if s and m:
                        rows.append((m.group(1), *s))
            yield pd.DataFrame(rows, columns=["file_id", "xmin", "ymin", "xmax", "ymax"])

    return files.select("dbf", "shp").mapInPandas(run, "file_id string, xmin double, ymin double, xmax double, ymax double")


def read_shapefiles(spark: SparkSession, folder: str) -> DataFrame:
    """(stem, dbf, shp) of a folder's shapefiles."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.{dbf,shp}").load(folder)
    f = f.select(F.regexp_extract("path", r"([^/]+)\.\w+$", 1).alias("stem"), F.regexp_extract("path", r"\.(\w+)$", 1).alias("kind"), "content")
    return f.groupBy("stem").agg(F.first(F.when(F.col("kind") == "dbf", F.col("content")), True).alias("dbf"), F.first(F.when(F.col("kind") == "shp", F.col("content")), True).alias("shp"))


_INSERT = re.compile(r"insert\s+into\s+document\s*\(([^)]*)\)\s*values\s*\(", re.I)
_VALUE = re.compile(r"\s*(?:'((?:[^']|'')*)'|([^,()']+))\s*([,)])", re.S)


def seed_rows(files: DataFrame, columns: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """Rows of seed files (value: a whole file) with the given columns, as text or (types: column -> int, boolean, ...) typed where the value is unquoted and readable so. Quoted values stay text, `''` is a quote, null is null; the first statement's columns hold for all; another count of values is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["value"]:
                names = None
                for m in _INSERT.finditer(text):
                    names = names or [c.strip() for c in m.group(1).split(",")]
                    at, values = m.end(), []
                    while True:
                        v = _VALUE.match(text, at)
                        if not v:
                            raise ValueError(f"unreadable values near {text[at : at + 40]!r}")
                        bare = (v.group(2) or "").strip()
                        values.append(v.group(1).replace("''", "'") if v.group(1) is not None else None if bare.lower() == "null" else bare)
                        at = v.end()
                        if v.group(3) == ")":
                            break
                    if len(values) != len(names):
                        raise ValueError(f"{len(values)} values for {len(names)} columns")
                    row = dict(zip(names, values, strict=True))
                    rows.append([row.get(c) for c in columns])
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    out = files.select("value").mapInPandas(run, ", ".join(f"`{c}` string" for c in columns))
    return out.select(*(F.col(c).try_cast((types or {})[c]).alias(c) if c in (types or {}) else F.col(c) for c in columns))


def parse_toc(pages: DataFrame) -> DataFrame:
    """(page_id, pos, node_id, title) of a contents page's links showEntry(N); blank titles are dropped. pages: (page_id, html)."""
    form = r"showEntry\((\d+)\)'[^>]*>([^<]+)</a>"
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(form), 1).alias("node_id"), F.regexp_extract_all("html", F.lit(form), 2).alias("title"))
    out = pages.select("page_id", F.posexplode(pairs).alias("pos", "x")).select("page_id", "pos", "x.node_id", T.strip("x.title").alias("title"))
    return out.where("title <> ''")


def parse_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, label) of a page's plain links, by the same means as parse_toc."""
    form = r'<a href="([^"]*)">([^<]*)</a>'
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(form), 1).alias("href"), F.regexp_extract_all("html", F.lit(form), 2).alias("label"))
    return pages.select("page_id", F.posexplode(pairs).alias("pos", "x")).select("page_id", "pos", "x.href", "x.label")


def parse_item_blocks(pages: DataFrame, details: bool = False) -> DataFrame:
    """(page_id, item, title, cote, date, image_id, data_src) of blocks <div id="item_N">; a title and a picture are needed.

    details: also a source is needed, and mark and date are read from the part id="detailn_N" only.
    """
    blocks = T.once(F.split(F.concat(F.lit(" "), "html"), r'(?=<div id="item_\d+">)'), lambda x: F.slice(x, F.lit(2), F.size(x)))
    b = pages.select("page_id", F.explode(blocks).alias("b"))
    tail = F.when(F.col("b").rlike(r'id="detailn_\d+"'), F.regexp_extract("b", r'(?s)id="detailn_\d+"(.*)$', 1)).otherwise(F.lit("") if details else F.col("b"))
    source = tail if details else F.col("b")
    span = lambda k: T.strip(T.extract(source, rf'(?s)class="{k}"[^>]*>.*?<span[^>]*>([^<]*)</span>'))
    out = b.select("page_id", T.extract("b", r'<div id="item_(\d+)">').alias("item"), T.strip(T.extract("b", r'class="titres">\s*<span[^>]*>([^<]*)</span>')).alias("title"), span("cotes").alias("cote"), span("dates").alias("date"),
                   T.extract("b", r"lienImage\((\d+)\)").alias("image_id"), T.extract("b", r'data-src="([^"]+)"').alias("data_src"))
    out = out.where("title is not null and title <> '' and image_id is not null")
    return out.where("data_src is not null") if details else out


def select_plan_groups(toc: DataFrame) -> DataFrame:
    """Entries that are plans; textual series are skipped even if they also match."""
    return toc.where(F.col("title").rlike(r"(?iU)plan|cadastre\s+napo") & ~F.col("title").rlike(r"(?iU)état|matrice|table\s+de\s+corresp"))


def portal_tree(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a portal's JSON answers in `value`: lists of {id, title, dataType, data: {url, children}}, one level deep each; ids end at `_`."""
    child = "struct<id:string,title:string,dataType:string,data:struct<url:string>>"
    e = lines.select(F.explode(F.from_json("value", f"array<struct<id:string,title:string,dataType:string,data:struct<url:string,children:array<{child}>>>>")).alias("n"))
    own = lambda c: F.split(F.col(c), "_")[0]
    kids = e.select(own("n.id").alias("parent_id"), F.posexplode("n.data.children").alias("pos", "c"))
    node = lambda f, p: f.select(own(f"{p}.id").alias("id"), T.strip(f"{p}.title").alias("title"), (F.col(f"{p}.dataType") == "branch").alias("branch"), F.col(f"{p}.data.url").alias("url"))
    return node(e, "n").union(node(kids, "c")).dropDuplicates(["id"]), kids.select("parent_id", own("c.id").alias("child_id"), "pos")


def read_alias(lines: DataFrame) -> DataFrame:
    """(dept, name, code) of an alias file {dept: {name: code}} in `value`; keys that begin with _ are comments."""
    d = lines.select(F.explode(F.from_json("value", "map<string,string>")).alias("dept", "m")).where(~F.startswith("dept", F.lit("_")))
    n = d.select("dept", F.explode(F.from_json("m", "map<string,string>")).alias("name", "code"))
    return n.where(~F.startswith("name", F.lit("_")))


def portal_config(rows: DataFrame, codes: list[str]) -> DataFrame:
    """The portals of these codes; an unknown code, or one without portal or authority, is an error."""
    own = rows.where(F.col("code").isin(codes))
    bad = set(codes) - {r["code"] for r in own.where("portail <> '' and naan <> ''").select("code").distinct().collect()}
    if bad:
        raise ValueError(f"unknown or incomplete portals: {', '.join(sorted(bad))}")
    return own


#: Rows of a batch that a reader of whole texts hands on.
_ROWS = 4096

_RICO, _RDF, _DC = "{https://www.ica.org/standards/RiC/ontology#}", "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}", "{http://purl.org/dc/terms/}"
_CHILD = _RICO + "includesOrIncluded"


def _clean_manifest(url: str) -> str:
    """Without fragment and double slashes; the scheme's slashes are put back (for http too)."""
    return re.sub(r"^(https?):/", r"\1://", re.sub("/+", "/", url.split("#")[0]))


#: Columns of a finding aid's node.
RDF_NODE = "id string, title string, begin_year int, end_year int, manifest string, image string, service_uri string, children array<string>, location_ids array<string>"


def _last_part(uri: str) -> str:
    return uri.rstrip("/").split("/")[-1]


def rdf_descriptions(stream: IO[bytes]) -> Iterator[tuple[str, Iterator[tuple[str, str]]]]:
    """(address, its properties as (tag, value)) of each description of an RDF/XML stream that has an address.

    A property is let go when it has been handed on, so neither a file nor a description of any number of links is held. Properties
    that the caller leaves are passed over.
    """
    parsed = ElementTree.iterparse(stream, ("start", "end"))
    _, root = next(parsed)

    def properties(node: ElementTree.Element) -> Iterator[tuple[str, str]]:
        depth = 0
        for event, x in parsed:
            if event == "start":
                depth += 1
            elif x is node:
                return
            else:
                depth -= 1
                if not depth:
                    yield x.tag, x.text or x.get(_RDF + "resource") or ""
                    del node[:]

    for event, node in parsed:
        if event == "start":  # what is left of a description has been read: this is the next one
            own = properties(node)
            uri = node.get(_RDF + "about") or ""
            if uri:
                yield uri, own
            for _ in own:
                pass
            root.clear()


def rdf_rows(stream: IO[bytes], links: bool = True) -> Iterator[tuple]:
    """The values of RDF_NODE of an RDF/XML stream's descriptions with an address. Years are first four characters if digits. links: without them children and location_ids are null, and of no size."""
    for uri, properties in rdf_descriptions(stream):
        first: dict[str, str] = {}
        manifest = image = None
        children, places = [], []
        for tag, value in properties:
            if tag == _CHILD:
                if links:
                    children.append(_last_part(value))
            elif tag == _RICO + "hasInstantiation":
                if manifest is None and "/manifest" in value:
                    manifest = _clean_manifest(value)
            elif tag == _DC + "source":
                if ("daoloc" in value or "daogrp" in value) and "vignette" not in value:
                    image = value
            elif tag == _RICO + "hasSubject":
                if links and "/location/" in value:
                    places.append(_last_part(value))
            else:
                first.setdefault(tag, value)
        begin, end = ((int(t[:4]) if (t := first.get(_RICO + tag, ""))[:4].isdecimal() else None) for tag in ("beginningDate", "endDate"))
        yield _last_part(uri), first.get(_RICO + "title", ""), begin, end, manifest, image, first.get(_RICO + "heldBy"), children if links else None, places if links else None


def rdf_links(stream: IO[bytes]) -> Iterator[tuple[str, str, int]]:
    """(parent_id, child_id, pos) of an RDF/XML stream, a link at a time."""
    for uri, properties in rdf_descriptions(stream):
        parent, pos = _last_part(uri), 0
        for tag, value in properties:
            if tag == _CHILD:
                yield parent, _last_part(value), pos
                pos += 1


def rdf_nodes(files: DataFrame) -> DataFrame:
    """RDF_NODE of RDF/XML files in `value`. Large files are better read as a stream, by the source `rdf_nodes` of sources.files."""
    names = [c.split()[0] for c in RDF_NODE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = (row for text in pdf["value"] for row in rdf_rows(io.BytesIO(text.encode())))
            while some := list(islice(rows, _ROWS)):
                yield pd.DataFrame(some, columns=names).astype({"begin_year": "Int32", "end_year": "Int32"})

    return files.select("value").mapInPandas(run, RDF_NODE)


def rdf_edges(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("id").alias("parent_id"), F.posexplode("children").alias("pos", "child_id")).select("parent_id", "child_id", "pos")


def jpeg_size(data: bytes | None) -> tuple[int, int]:
    data, at = bytes(data or b"")[:65536], 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 1 if marker == 0xFF else 2 if marker == 1 or 0xD0 <= marker <= 0xD8 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return 8000, 6000


def image_dimensions(content) -> F.Column:
    """struct(width, height) from a JPEG's first 64 KB; 8000 x 6000 where no frame header is found."""

    @F.pandas_udf("width int, height int")
    def run(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([jpeg_size(c) for c in contents], columns=["width", "height"])

    return run(T.col(content))


