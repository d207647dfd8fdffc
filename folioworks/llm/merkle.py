"""Document fingerprints: a Merkle tree over a text's pieces, paragraphs and sections, by Spark's own functions only.

A text's opening (its first `OPENING` code points) is a paragraph that falls into words, so short texts can be compared
too; of the rest each line with its line feed is a paragraph. It falls into pieces, which end after a sentence end or
after `PIECE` code points. A paragraph closes a section when its hash says so (one in eight), so an edit moves the borders of sections
only near it. A piece's hash is of its text, every other node's hash is of its children's, so two texts are equal when
their roots are, and where they differ only the branches that differ need to be looked at.

A fingerprint is a string: the root's hash, then for each section `/`, 16 digits of its hash, `:` and its paragraphs
(parted by `.`), each with 8 digits of its pieces' hashes and their lengths in two digits. `likeness` of two fingerprints is
the share of their code points that stand in pieces that both have (Dice, each distinct piece once); it takes sections
that both have whole and looks into the others only. `edits` gives the stretches of a text that the other doesn't have.

Defined cases: a null text is empty; an empty text has no sections and is like no text but an empty one; texts of any
length are taken whole; a stretch without sentence ends is cut every `PIECE` code points, so after an insertion into it
its pieces agree again from the next sentence end or line on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioworks.llm.common import free, keep, new_names

#: The longest piece, in code points; two digits hold its length.
PIECE = 64
OPENING = 160
WORDS = rf"[^ \n]{{1,{PIECE - 1}}}[ \n]?|[ \n]"
PARAGRAPHS = r"[^\n]*\n|[^\n]+"
PIECES = rf"[^\n]{{0,{PIECE - 2}}}?(?:[.!?…] |\n)|[^\n]{{1,{PIECE}}}"
#: Last hexadecimal digits of a paragraph's hash that close a section.
CLOSING = "01"


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def pack(**fields: Column) -> Column:
    """A struct of the fields; unlike aliases, its names hold inside `let`."""
    return F.named_struct(*(x for name, value in fields.items() for x in (F.lit(name), value)))


def _paragraph(text: Column, pieces: str = PIECES) -> Column:
    """(hash, tokens) of a paragraph: the hash of its pieces' hashes; 8 digits and the length of each piece."""
    each = F.transform(F.regexp_extract_all(text, F.lit(pieces), F.lit(0)), lambda p: F.concat(F.sha2(p, 256), F.lpad(F.length(p).cast("string"), 2, "0")))
    short = lambda ps: F.array_join(F.transform(ps, lambda p: F.concat(F.substring(p, 1, 8), F.substring(p, 65, 2))), "")
    return let(each, lambda ps: pack(hash=F.sha2(F.array_join(ps, ""), 256), tokens=short(ps)))


def _section(paragraphs: Column) -> Column:
    whole = F.sha2(F.array_join(paragraphs["hash"], ""), 256)
    return let(whole, lambda h: pack(hash=h, line=F.concat(F.substring(h, 1, 16), F.lit(":"), F.array_join(paragraphs["tokens"], "."))))


def _sections(paragraphs: Column) -> Column:
    """The paragraphs in runs; a run ends after one that closes a section."""
    last = F.size(paragraphs)
    closes = lambda i: F.substring(F.element_at(paragraphs, i)["hash"], 64, 1).isin(*CLOSING) | (i == last)
    ends = F.when(last > 0, F.filter(F.sequence(F.lit(1), last), closes)).otherwise(F.array().cast("array<int>"))
    before = lambda e, k: F.when(k == 0, F.lit(0)).otherwise(F.get(e, k - 1))
    return let(ends, lambda e: F.transform(e, lambda end, k: _section(F.slice(paragraphs, before(e, k) + 1, end - before(e, k)))))


def fingerprint(text: Column | str) -> Column:
    """The text's fingerprint as a string; its first 64 characters are the root."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    opening = F.filter(F.array(F.substring(text, 1, OPENING)), lambda t: t != "")
    rest = F.regexp_extract_all(F.substring(text, OPENING + 1, 2**31 - 1), F.lit(PARAGRAPHS), F.lit(0))
    paragraphs = F.concat(F.transform(opening, lambda t: _paragraph(t, WORDS)), F.transform(rest, lambda t: _paragraph(t)))
    line = lambda s: F.concat(F.sha2(F.array_join(s["hash"], ""), 256), F.array_join(F.transform(s["line"], lambda x: F.concat(F.lit("/"), x)), ""))
    return let(paragraphs, lambda p: let(_sections(p), line))


def _tokens(sections: Column) -> Column:
    """The distinct pieces of some sections' lines."""
    return F.array_distinct(F.flatten(F.transform(sections, lambda s: F.regexp_extract_all(F.substring(s, 18, 2**31 - 1), F.lit("[0-9a-f]{10}"), F.lit(0)))))


def _length(tokens: Column) -> Column:
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda n, t: n + F.substring(t, 9, 2).cast("long"))


def likeness(a: Column | str, b: Column | str) -> Column:
    """The share, 0 to 1, of two fingerprints' code points in pieces that both have; 1 if and only if the roots are equal or all pieces are shared."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    lines = lambda x: F.array_remove(F.split(F.substring(x, 66, 2**31 - 1), "/"), "")

    def compared(s: Column) -> Column:
        both = _tokens(F.array_intersect(s["a"], s["b"]))
        own = lambda x, y, w: F.array_except(_tokens(F.array_except(x, y)), w)
        return let(both, lambda w: let(pack(a=own(s["a"], s["b"], w), b=own(s["b"], s["a"], w), n=_length(w)), _dice))

    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.lit(1.0)).otherwise(let(pack(a=lines(a), b=lines(b)), compared))


def _dice(t: Column) -> Column:
    shared = 2 * (t["n"] + _length(F.array_intersect(t["a"], t["b"])))
    return shared.cast("double") / (2 * t["n"] + _length(t["a"]) + _length(t["b"])).cast("double")


def edits(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """(key, section, start, end): stretches of a text (fingerprint `a`) in pieces that the other (`b`) doesn't have, by code point, neighbours joined.

    Sections that both have are passed over whole; only pieces of the others become rows. `key` tells the pairs apart.
    """
    lines = lambda x: F.array_remove(F.split(F.substring(x, 66, 2**31 - 1), "/"), "")
    each = pairs.select(F.col(key).alias("key_"), lines(F.col(a)).alias("a_"), lines(F.col(b)).alias("b_"))
    each = each.withColumn("had_", _tokens(F.array_except("b_", "a_"))).withColumn("same_", F.array_intersect("a_", "b_"))
    rows = each.select("key_", "same_", "had_", F.posexplode("a_").alias("section", "line_"))
    whole = F.array_contains("same_", F.col("line_"))
    sized = F.aggregate(F.regexp_extract_all(F.substring("line_", 18, 2**31 - 1), F.lit("[0-9a-f]{10}"), F.lit(0)), F.lit(0).cast("long"), lambda n, t: n + F.substring(t, 9, 2).cast("long"))
    before = F.sum("size_").over(Window.partitionBy("key_").orderBy("section").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.select("key_", "section", "had_", "line_", whole.alias("whole_"), sized.alias("size_")).withColumn("at_", F.coalesce(before, F.lit(0))).where("not whole_")
    piece = rows.select("key_", "section", "at_", "had_", F.posexplode(F.regexp_extract_all(F.substring("line_", 18, 2**31 - 1), F.lit("[0-9a-f]{10}"), F.lit(0))).alias("i_", "piece_"))
    n = F.substring("piece_", 9, 2).cast("long")
    order = Window.partitionBy("key_", "section").orderBy("i_")
    end = F.col("at_") + F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, 0))
    new = piece.withColumn("end", end).withColumn("start", F.col("end") - n).where(~F.array_contains("had_", F.col("piece_"))).select("key_", "section", "start", "end", "i_")
    run = F.col("i_") - F.row_number().over(Window.partitionBy("key_", "section").orderBy("i_"))
    joined = new.withColumn("run_", run).groupBy("key_", "section", "run_").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return joined.select(F.col("key_").alias(key), "section", "start", "end")


def following(keys: DataFrame, order: list[Column], carried: list[str]) -> DataFrame:
    """`keys` with the struct `before` of `carried` columns of the row before each in the cyclic order of `order`.

    Rows are dealt to tasks by ranges of the order; a range's first row takes the last of the range before, of which
    there are as many as ranges.
    """
    ranged = keep(keys.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "merkle-ranges")
    own = F.struct(*carried)
    place = F.struct(*(c for c in carried))
    at = Window.partitionBy("range_").orderBy(*order)
    seen = ranged.withColumn("before", F.lag(own).over(at)).withColumn("last_", F.lead(F.lit(1)).over(at).isNull())
    ends = seen.where("last_").select("range_", place.alias("end_"))  # a row for each range
    ring = Window.orderBy("range_")
    ends = ends.withColumn("final_", F.last("end_").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = ends.select("range_", F.coalesce(F.lag("end_").over(ring), "final_").alias("end_"))
    out = seen.join(F.broadcast(ends), "range_").withColumn("before", F.coalesce("before", "end_")).drop("range_", "last_", "end_")
    out = keep(out, "merkle-order")
    free(ranged)
    return out


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint, its edited text's, and their likeness to each other and to the next document's.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id). The edited text has its
    last third replaced by the beginning of the next document; the next is that with the next smaller id, after the last the first.
    Ids that are null come last; rows with one id follow by a hash of the text; rows equal in id and text are one document
    and all get its result; a lone document is its own next.

    Texts cross the network once, by a hash of id and text, beginnings and fingerprints once more to the document
    before; the order is found from ids, hashes and lengths alone.
    """
    (copies,) = new_names(docs, "copies")
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    hashed = docs.withColumns({"k1": F.xxhash64(F.lit(1), "id", F.col("id").isNull(), "text"), "k2": F.xxhash64(F.lit(2), "text", F.col("id").isNull(), "id")})
    one = hashed.groupBy("k1", "k2").agg(F.first("id").alias("id"), F.first("text").alias("text"), F.count("*").alias(copies))
    keys = hashed.select("k1", "k2", "id", F.length("text").alias("n")).distinct()
    links = following(keys, [F.col("id").desc_nulls_last(), F.col("k1"), F.col("k2")], ["k1", "k2", "n"])
    links = links.select("k1", "k2", "before")
    linked = one.join(links, ["k1", "k2"])
    third = lambda n: F.floor(n / 3).cast("int")
    given = linked.where(F.col(copies) > 0).select(
        F.col("before.k1").alias("k1"), F.col("before.k2").alias("k2"), F.substring(F.col("text"), F.lit(1), third(F.col("before.n"))).alias("given"), F.col("id").alias("next_id"), fingerprint("text").alias("next_print"))
    out = linked.where(F.col(copies) > 0).join(given, ["k1", "k2"]).withColumn("n", F.length("text"))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n") - third(F.col("n"))), "given")
    out = out.select("id", copies, F.col("n").cast("long").alias("n_chars"), fingerprint("text").alias("fingerprint"), edited.alias("edited"), "next_id", "next_print")
    out = out.withColumn("edited_fingerprint", fingerprint("edited"))
    out = out.select(F.explode(F.sequence(F.lit(1), F.col(copies))).alias("copy"), F.col("id").alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                     likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_print").alias("near_next"), "next_id")
    return out.drop("copy")
