"""IIIF manifests: reading them as VARIANT, building them as JSON, rewriting their image services."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from folioworks.functions import text as T

#: Size of a thumbnail, as an image service's size parameter.
THUMB = "200,"


def parse(manifest) -> Column:
    """A manifest's JSON as VARIANT, null when it can't be read."""
    return F.try_parse_json(T.col(manifest))


def _get(v: Column, path: str) -> Column:
    return F.nullif(F.try_variant_get(v, path, "string"), F.lit(""))


def meta(v: Column, labels: list[str], last: bool = False) -> Column:
    """Value of the first (or last) metadata entry, in the document's order, whose label is one of `labels`."""
    entries = F.try_variant_get(v, "$.metadata", "array<variant>")
    hit = F.filter(entries, lambda e: F.try_variant_get(e, "$.label", "string").isin(labels))
    return F.try_variant_get(F.try_element_at(hit, F.lit(-1 if last else 1)), "$.value", "string")


def image_service(v: Column) -> Column:
    """The id of the first image's service at its fixed place: a single one or the first of a list; it must be an image service's."""
    at = "$.sequences[0].canvases[0].images[0].resource.service"
    found = F.coalesce(*(_get(v, f"{at}{i}{k}") for i in ("[0]", "") for k in ("['@id']", ".id")))
    return T.once(found, lambda x: F.when(F.contains(x, F.lit("/iiif/")), x))


def dimensions(v: Column) -> Column:
    at = "$.sequences[0].canvases[0]"
    return F.struct(F.try_variant_get(v, f"{at}.width", "int").alias("width"), F.try_variant_get(v, f"{at}.height", "int").alias("height"))


def thumbnail(v: Column) -> Column:
    """URL of a small picture: the manifest's own, then the first canvas's service or picture, version 3 before version 2."""
    explicit = [_get(v, p) for p in ("$.thumbnail['@id']", "$.thumbnail[0].id", "$.thumbnail[0]['@id']")]
    # A string under `thumbnail` is one only if it isn't an object or array turned to text.
    plain = F.when(F.startswith(F.schema_of_variant(F.try_variant_get(v, "$.thumbnail", "variant")), F.lit("STRING")), _get(v, "$.thumbnail"))

    def sized(*paths: str) -> Column:
        own = F.coalesce(*(_get(v, p) for p in paths))
        return F.concat(F.regexp_replace(F.regexp_replace(own, r"/info\.json$", ""), "/$", ""), F.lit(f"/full/{THUMB}/0/default.jpg"))

    v3, v2 = "$.items[0].items[0].items[0].body.service", "$.sequences[0].canvases[0].images[0].resource.service"
    canvas2 = "$.sequences[0].canvases[0]"
    plain2 = F.when(F.startswith(F.schema_of_variant(F.try_variant_get(v, f"{canvas2}.thumbnail", "variant")), F.lit("STRING")), _get(v, f"{canvas2}.thumbnail"))
    return F.coalesce(
        plain, *explicit, sized(f"{v3}[0].id", f"{v3}[0]['@id']", f"{v3}.id", f"{v3}['@id']"), _get(v, "$.items[0].thumbnail[0].id"),
        sized(f"{v2}[0]['@id']", f"{v2}[0].id", f"{v2}['@id']", f"{v2}.id"), plain2, _get(v, f"{canvas2}.thumbnail['@id']"), _get(v, f"{canvas2}.images[0].resource['@id']"))


def _per_text(f: Callable[[str | None], str | None]):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action=None)

    return run


def _loaded(text: str | None):
    """The JSON value of a text; None if it can't be read, or is nested deeper than the parser goes."""
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def _id(service) -> str | None:
    """A service's id: itself, if it is text, or its `@id`, else its `id`; only text counts."""
    if isinstance(service, dict):
        service = next((x for x in (service.get("@id"), service.get("id")) if isinstance(x, str) and x), None)
    return service if isinstance(service, str) else None


def first_service_deep(manifest, needle: str) -> Column:
    """The first service id, in document order, that contains `needle`, wherever it stands. Ids that aren't text are passed over."""

    def one(text):
        waiting = [_loaded(text)]
        while waiting:
            node = waiting.pop()
            if isinstance(node, dict):
                services = node.get("service")
                found = next((x for x in map(_id, services if isinstance(services, list) else [services]) if x and needle in x), None)
                if found:
                    return found
            inner = list(node.values()) if isinstance(node, dict) else node if isinstance(node, list) else ()
            waiting.extend(reversed(inner))
        return None

    return _per_text(one)(T.col(manifest))


#: What the declaration of an image service holds: the API's address in context or profile, or the service's type.
_IMAGE_SERVICE = re.compile(r'api/image|"ImageService', re.I)


def _image_services(doc) -> Iterator[tuple[dict, str]]:
    """A manifest's image services that have a text as id, and the ids: values of a key `service` or, in a list there, its items. What declares a service is looked at only there."""
    waiting = [(doc, False)]
    while waiting:
        node, here = waiting.pop()
        if isinstance(node, dict):
            waiting.extend((v, k == "service") for k, v in node.items() if isinstance(v, dict | list))
            uri = _id(node) if here else None
            if uri and _IMAGE_SERVICE.search(json.dumps([node.get(k) for k in ("@context", "profile", "type", "@type")])):
                yield node, uri
        elif isinstance(node, list):
            waiting.extend((v, here and isinstance(v, dict)) for v in node if isinstance(v, dict | list))


def rewrite_image_services(manifest, prefix: str) -> Column:
    """The manifest with every image service's id as prefix/iiif/<encoded id>; other services and the keys' names stay."""

    def one(text):
        doc = _loaded(text)
        for service, uri in list(_image_services(doc)):
            service["@id" if "@id" in service else "id"] = f"{prefix}/iiif/{quote(uri, safe='')}"
        return None if doc is None else json.dumps(doc, ensure_ascii=False)

    return _per_text(one)(T.col(manifest))


def html_unescape(x) -> Column:
    import html

    return _per_text(lambda t: None if t is None else html.unescape(t))(T.col(x))


def _object(**fields) -> Column:
    """A struct whose names may hold @, which keyword names write as at_."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*(value(v).alias("@" + k[3:] if k.startswith("at_") else k) for k, v in fields.items()))


def _manifest(ident: Column, label: Column, canvas_label: Column, image: Column, service: Column, width: Column, height: Column, level: int, **more) -> Column:
    canvas_id = F.concat(ident, F.lit("/canvas/1"))
    resource = _object(at_id=image, at_type="dctypes:Image", format="image/jpeg", width=width, height=height,
                       service=_object(at_context="http://iiif.io/api/image/2/context.json", at_id=service, profile=f"http://iiif.io/api/image/2/level{level}.json"))
    picture = _object(at_type="oa:Annotation", motivation="sc:painting", resource=resource, on=canvas_id)
    canvas = _object(at_id=canvas_id, at_type="sc:Canvas", label=canvas_label, width=width, height=height, images=F.array(picture))
    return F.to_json(_object(at_context="http://iiif.io/api/presentation/2/context.json", at_id=ident, at_type="sc:Manifest", label=label, **more, sequences=F.array(_object(at_type="sc:Sequence", canvases=F.array(canvas)))))


def static_manifest(title, cote, date, image_id, data_src, pages: str, archive: str, proxy: str, mount: str, attribution: str) -> Column:
    """A manifest (version 2) of one scanned plan: `title — cote (date)`, its cached picture and its image service."""
    some = lambda x: T.col(x).isNotNull() & (T.col(x) != "")
    label = F.concat(T.col(title), F.when(some(cote), F.concat(F.lit(" — "), cote)).otherwise(""), F.when(some(date), F.concat(F.lit(" ("), date, F.lit(")"))).otherwise(""))
    original = F.concat(F.lit(mount), T.col(data_src))
    cached = F.replace(F.replace(F.substr(original, F.lit(2)), F.lit("/"), F.lit("_")), F.lit(".jpg"), F.lit("_4000_4000_0_0_0_0_img.jpg"))
    entry = lambda k, v: F.struct(F.lit(k).alias("label"), T.col(v).alias("value"))
    return _manifest(F.concat(F.lit(f"{pages}/"), image_id, F.lit(".json")), label, T.col(title), F.concat(F.lit(f"{archive}/cache/"), cached), F.concat(F.lit(f"{proxy}/static-iiif/"), T.url_quote(original)),
                     F.lit(8000), F.lit(6000), 2, metadata=F.array(entry("Cote", cote), entry("Date", date)), attribution=F.lit(attribution))


def jpeg_manifest(url, width, height, origin: str) -> Column:
    """A manifest of one JPEG: the label is the decoded last part of its URL."""
    u = T.col(url)
    label = F.coalesce(F.nullif(F.url_decode(F.replace(F.element_at(F.split(u, "/"), -1), F.lit("+"), F.lit("%2B"))), F.lit("")), F.lit("plan"))
    return _manifest(F.concat(F.lit(f"{origin}/static-manifest?u="), T.url_quote(u)), label, label, u, F.concat(F.lit(f"{origin}/static-iiif/"), T.url_quote(u)), T.col(width), T.col(height), 0)


def read_manifests(lines: DataFrame, figures: Observation | None = None) -> DataFrame:
    """(ark, manifest) of JSON objects {ark: manifest or null} in `value`; a null manifest is unreadable: it is counted and left out.

    The object is a map of VARIANTs, so each manifest is parsed once. figures: gets `read`, `unreadable` and `lost` (lines
    that aren't such objects) from the pass that uses the manifests, without one of its own.
    """
    each = lines.select(F.explode_outer(F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>")).alias("ark", "v"))
    lost = F.col("ark").isNull()
    if figures is not None:
        each = each.observe(figures, F.count_if(~lost & ~F.is_variant_null("v")).alias("read"), F.count_if(~lost & F.is_variant_null("v")).alias("unreadable"), F.count_if(lost).alias("lost"))
    return each.where(~lost & ~F.is_variant_null("v")).select("ark", F.to_json("v").alias("manifest"))
