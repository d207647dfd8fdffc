"""Spans of text as Spark values: (kind, start, end) in code points, end exclusive."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.common import keep, new_names

SPAN = "struct<kind:string,start:int,end:int>"
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def in_order(spans: str, kinds: tuple[str, ...]):
    """The spans by start, then by the order of `kinds` (others after them, by name)."""
    place = F.create_map(*(F.lit(x) for pair in zip(kinds, range(len(kinds)), strict=True) for x in pair))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), F.coalesce(F.try_element_at(place, s["kind"]), F.lit(len(kinds))).alias("b"),
                                                  s["kind"].alias("kind"), s["end"].alias("end")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["a"].alias("start"), s["end"].alias("end")))


def joined(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def cut_out(text: str, spans, mark: str = ""):
    """`text` with each of the ordered `spans` replaced by [mark]; an overlapping part is cut once."""
    step = lambda acc, s: F.struct(
        F.concat(acc["out"], F.when(s["start"] >= acc["at"], F.concat(F.substr(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))).alias("out"),
        F.greatest(acc["at"], s["end"]).alias("at"),
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(F.col(text), acc["at"] + 1)))


def replace_spans(docs: DataFrame, found: DataFrame, mark: str, id_col: str, text_col: str) -> DataFrame:
    """`docs` with the spans of `found` (id, print, spans) replaced; rows meet by id and the text's hash, so repeated ids may differ in text."""
    of_id, of_print, spans = new_names(docs, "_id", "_print", "_spans")
    found = found.where("size(spans) > 0").select(F.col(id_col).alias(of_id), F.col("print").alias(of_print), F.col("spans").alias(spans))
    found = keep(found.dropDuplicates([of_id, of_print]), "spans-found")
    out = docs.join(found, F.col(id_col).eqNullSafe(F.col(of_id)) & (F.xxhash64(text_col) == F.col(of_print)), "left")
    text = F.when(F.col(spans).isNotNull(), cut_out(text_col, F.col(spans), mark)).otherwise(F.col(text_col))
    out = out.withColumn(text_col, text).drop(of_id, of_print, spans)
    return out.withColumn("n_chars", F.coalesce(F.length(text_col), F.lit(0)).cast("long")) if "n_chars" in docs.columns else out
