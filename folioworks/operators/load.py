"""Loading the catalogue: merges, updates, seed files, annotation refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.functions import parse as P
from folioworks.functions import text as T
from folioworks.operators.compare import where_they_differ
from folioworks.operators.shared import first_wins
from folioworks.sources import files

SEED_COLUMNS = ("insee", "type", "section_lettre", "feuille_num", "annee", "cote", "archive_url", "iiif_manifest", "image_url", "licence_overlay_ok")
# Sources of rows that were loaded without one, by department.
SOURCES = {
    "25": ("Archives départementales du Doubs", "https://portail-archives.doubs.fr"),
    "39": ("Archives départementales du Jura", "https://archives39.fr"),
    "31": ("Archives départementales de la Haute-Garonne", "https://archives.haute-garonne.fr"),
    "21": ("Archives départementales de la Côte-d'Or", "https://archives.cotedor.fr"),
}


def _literal(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind in ("boolean", "int", "bigint", "smallint", "double"):
        return F.coalesce(c.cast("string"), F.lit("null"))
    return F.when(c.isNull() | (c == ""), "null").otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")))


def _insert(docs: DataFrame, columns: tuple[str, ...]) -> Column:
    kinds = dict(docs.dtypes)
    values = F.concat_ws(", ", *(_literal(c, kinds[c]) for c in columns))
    return F.concat(F.lit(f"insert into document ({', '.join(columns)}) values ("), values, F.lit(");"))


def seed_sql(docs: DataFrame, columns: tuple[str, ...] = SEED_COLUMNS) -> DataFrame:
    """(value): one INSERT for each row with a code; strings are quoted, the empty one is null."""
    return docs.where("insee is not null").select(_insert(docs, columns).alias("value"))


def write_seed_sql(docs: DataFrame, path: str, columns: tuple[str, ...] = SEED_COLUMNS) -> None:
    """The INSERT lines as text files, with `header.txt` giving the rows written and those without a code; both from one pass over `docs`. Nothing is there before the job commits."""
    files.register(docs.sparkSession)
    line = F.when(F.col("insee").isNotNull(), _insert(docs, columns))
    docs.select(line.alias("value")).write.format("counted_lines").mode("append").option("header", "-- rows: {written}; without a code: {without}").save(path)


def write_files(rows: DataFrame, name: Column | str, content: Column | str, path: str) -> None:
    """A file for each row, as static manifests are served: all of them when the job commits, none if it fails. `_counts.json` has their number."""
    files.register(rows.sparkSession)
    rows.select(T.col(name).alias("name"), T.col(content).alias("content")).write.format("file_per_row").mode("append").save(path)


def write_files_in_parts(rows: DataFrame, path: str, before: str = "", after: str = "") -> None:
    """A file for each name of `rows` (name, content), its rows together in one task and in the order they are to be written; a file of any size is never one row."""
    files.register(rows.sparkSession)
    rows.select("name", "content").write.format("file_in_parts").mode("append").option("before", before).option("after", after).save(path)


def upsert_ignore(existing: DataFrame, batch: DataFrame, key: str = "archive_url", rank: str = "ingest_rank") -> DataFrame:
    """existing and those rows of the batch whose key it lacks; within the batch the first by rank."""
    new = first_wins(batch, [key], rank).join(existing.select(key).distinct(), key, "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def replace_department(existing: DataFrame, batch: DataFrame, dept: str) -> DataFrame:
    """existing without the department's rows, and the batch."""
    return existing.where(~F.coalesce(T.department("insee") == dept, F.lit(False))).unionByName(batch.select(*existing.columns))


def write_department(batch: DataFrame, path: str) -> None:
    """Overwrites only the departments that the batch holds."""
    batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dept").parquet(path)


def write_jdbc(docs: DataFrame, url: str, table: str, properties: dict[str, str] | None = None, batch_rows: int = 500) -> None:
    docs.write.option("batchsize", batch_rows).jdbc(url, table, mode="append", properties=properties or {})


def update_by_key(docs: DataFrame, updates: DataFrame, key: str, columns: list[str], rank: str = "rank") -> DataFrame:
    """docs with the columns set where a key matches, by the first update for each key; others are untouched."""
    u = first_wins(updates, [key], rank).select(F.col(key).alias("k_"), *(F.col(c).alias(f"{c}_new") for c in columns))
    out = docs.join(u, F.col(key) == F.col("k_"), "left")
    return out.select(*(F.when(F.col("k_").isNotNull(), F.col(f"{c}_new")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in docs.columns))


def fill_source_by_dept(docs: DataFrame, sources: dict[str, tuple[str, str]] = SOURCES) -> DataFrame:
    """source and source_url by department, only where the source is null."""
    table = F.create_map(*(x for d, (s, u) in sources.items() for x in (F.lit(d), F.struct(F.lit(s).alias("source"), F.lit(u).alias("source_url")))))
    own, empty = F.try_element_at(table, T.department("insee")), F.col("source").isNull()
    out = docs.withColumn("own_", own)
    for c in ("source_url", "source"):
        out = out.withColumn(c, F.when(empty, F.col(f"own_.{c}")).otherwise(F.col(c)))
    return out.drop("own_")


def manifest_join(notices: DataFrame, manifests: DataFrame, unreadable: str = "skip") -> DataFrame:
    """notices with their manifest by ark. unreadable: skip drops notices without one, fallback keeps them."""
    return notices.join(manifests, "ark", "inner" if unreadable == "skip" else "left")


def georef_status(docs: DataFrame, annotations: DataFrame, base: str) -> DataFrame:
    """docs with annotation_id, fetched and found_url: the annotation's URL where it has items and could be read."""
    a = annotations.select(F.col("id").alias("id_"), "items", "fetch_ok").dropDuplicates(["id_"])
    out = docs.withColumn("annotation_id", T.annotation_id("iiif_manifest")).join(a, F.col("annotation_id") == F.col("id_"), "left")
    fetched = F.coalesce("fetch_ok", F.lit(True))
    url = F.when(fetched & (F.col("items") > 0), F.concat(F.lit(base), "annotation_id"))
    return out.withColumn("fetched", fetched).withColumn("found_url", url).drop("id_", "items", "fetch_ok")


def diff_georef(docs: DataFrame, annotations: DataFrame, base: str = "https://annotations.example/images/", strict: bool = True) -> DataFrame:
    """(archive_url, georef_url): only the overviews with a manifest whose state changed; null clears it.

    strict: a failed fetch counts as no annotation; otherwise it leaves the row as it is.
    """
    own = georef_status(docs.where((F.col("type") == P.TABLEAU) & F.col("iiif_manifest").isNotNull()), annotations, base)
    changed = ~F.col("found_url").eqNullSafe(F.col("georef_url"))
    if not strict:
        changed = changed & F.col("fetched")
    return own.where(changed).select("archive_url", F.col("found_url").alias("georef_url"))


def apply_georef(docs: DataFrame, diff: DataFrame) -> DataFrame:
    return update_by_key(docs, diff.withColumn("rank", F.lit(0)), "archive_url", ["georef_url"])


def annotation_collection(docs: DataFrame, pages: DataFrame, dept: str | None = None) -> DataFrame:
    """(annotation_id, item): the items of all georeferenced rows' annotation pages. Only a full run may write it.

    pages: (id, items) with items an array of JSON strings.
    """
    if dept is not None:
        raise ValueError("the collection is written by a full run only, not for one department")
    ids = docs.where("georef_url is not null and iiif_manifest is not null").select(T.annotation_id("iiif_manifest").alias("annotation_id")).distinct()
    return ids.join(pages, F.col("annotation_id") == F.col("id")).select("annotation_id", F.explode("items").alias("item"))


def write_annotation_collection(docs: DataFrame, pages: DataFrame, path: str, dept: str | None = None) -> None:
    """One item in each line, in as many files as there are tasks."""
    annotation_collection(docs, pages, dept).select("item").write.text(path)


def changed_nodes(old: DataFrame, new: DataFrame, key: str = "id", etag: str = "etag") -> DataFrame:
    """(id, change): new, changed or removed nodes between two indexes; only parts whose digests differ are joined."""
    old, new = where_they_differ(old, new, [key, etag], [key])
    a, b = old.select(F.col(key).alias("k"), F.col(etag).alias("a"), F.lit(True).alias("in_a")), new.select(F.col(key).alias("k"), F.col(etag).alias("b"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "new").when(F.col("in_b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, "k", "full").select(F.col("k").alias(key), change.alias("change")).where("change is not null")
