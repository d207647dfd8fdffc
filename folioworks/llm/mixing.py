"""Mixing sources to target weights by Sainte-Laguë apportionment.

Equal blocks of words are seats. Sources win seats by their targets, sections of a source win the source's seats by
their words, shards of a section the section's, and each shard then takes its seats from a seeded order of its
documents. All of it is arithmetic on positions: no block becomes a row. The table of sources, one row each, is worked
on by one task (that holds for some millions of sources); so is a source's table of sections, one row for each two
million documents, and a section's table of shards, SECTION rows; documents never are.

Input: any frame with an id, a text and a source column; other columns are ignored.
Defined cases: null or blank text has size 0 and is taken 0 times; a null source is a source of its own, last in
order; repeated rows are separate documents; rows equal in id, source and text are taken in the order of their other columns; an empty table gives an empty result; a source never takes more than
`most` times its words, nor a document more than `most` times its own.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.llm.common import WORD, keep, new_names

#: Documents of a shard, about, and shards of a section: a shard's documents are ordered by one task (with spilling),
#: a section's shards are apportioned by one.
SHARD_DOCS, SECTION = 2000, 1024


def word_count(text) -> F.Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sainte_lague(votes: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotient votes / (2 k + 1), ties to the first; none beyond its cap.

    A divisor found by halving gives all but the last few seats; those are given one by one.
    """
    votes, caps = np.asarray(votes, float), np.asarray(caps, np.int64)
    out = np.zeros(len(votes), np.int64)
    seats = int(min(seats, caps[votes > 0].sum() if len(votes) else 0))
    if seats <= 0:
        return out
    given = lambda d: np.minimum(np.floor(votes / d + 0.5), caps).astype(np.int64)
    low, high = 1e-12, float(votes.max()) * 4
    for _ in range(200):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if given(mid).sum() > seats else (low, mid)
    out = given(high)
    heap = [(-v / (2 * n + 1), i) for i, (v, n, c) in enumerate(zip(votes, out, caps, strict=True)) if v > 0 and n < c]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def row_print(id_col: str, text_col: str, source_col: str) -> F.Column:
    """A hash of a row's id, source and text, nulls told from values."""
    return F.xxhash64(F.col(id_col), F.col(source_col).isNull(), F.col(source_col), F.col(text_col))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size, n_docs, rank, target) per source.

    Weights repeat over the sources by code point, null last. A target stops at `most` times the source's words and
    the excess is shared again by weight: the water level is found from sums over sources in the order in which they
    fill up. The table has one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") - 1) % len(weights) + 1))
    full = (F.lit(float(most)) * F.col("source_size")).alias("full")
    per = per.select("*", full).withColumn("at", F.col("full") / F.col("weight"))
    order = Window.orderBy("at", "rank")
    before = F.coalesce(F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(everything) - before) / left)
    open_ = F.when(F.col("at") >= F.col("level"), F.struct("at", "rank", "level"))
    per = per.withColumn("level", F.coalesce(F.min(open_).over(everything)["level"], F.lit(0.0)))
    target = F.least("full", F.col("level") * F.col("weight"))
    return per.select("source", "source_size", "n_docs", "rank", target.alias("target"))


def _apportion(votes: str, block: int, most: int, seats: str | None):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(rows.columns)).reset_index(drop=True)
        caps = np.ceil(most * rows["words"].to_numpy(float) / block)  # the last block may be a part of one
        total = int(rows[seats].iloc[0]) if seats else int(round(rows[votes].sum() / block))
        rows["quota"] = sainte_lague(rows[votes].to_numpy(float), total, caps.astype(np.int64))
        return rows

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = 16, seed: int = 7,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken, print): how many words of each document the mix takes, repeats counted.

    print: a hash of id, source and text, by which `take` finds the row again.

    weights: shares of the sources, repeated over them in order; together the targets make up all words.
    block_words: words of a block, the unit of a quota; a source's taken words differ from its target by a block or so.
    seed: another one gives another order of documents and other first blocks.
    """
    s = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("turn"), row_print(id_col, text_col, source_col).alias("print"),
    )
    s = keep(s, "mix-sizes")
    sources = source_targets(s, weights, most)
    quota = sources.select("rank", "target", F.col("source_size").alias("words")).groupBy(F.lit(0).alias("all"))
    quota = quota.applyInPandas(
        lambda rows: _apportion("target", block_words, most, None)(rows[["rank", "target", "words"]]),
        "rank int, target double, words long, quota long",
    ).select("rank", "quota")
    n_shards = F.ceil(F.col("n_docs") / SHARD_DOCS).cast("long")
    sources = keep(sources.join(quota, "rank").withColumn("n_shards", n_shards), "mix-sources")

    s = s.withColumn("source_", F.col("source")).drop("source")
    s = s.join(sources, F.col("source_").eqNullSafe(F.col("source"))).drop("source", "source_")
    s = s.withColumn("shard", F.pmod(F.shiftright("turn", 17), F.col("n_shards")))
    shards = s.groupBy("rank", "shard", F.col("quota").alias("seats")).agg(F.sum("size").alias("words"))
    shards = keep(shards.withColumn("section", F.floor(F.col("shard") / SECTION)), "mix-shards")
    sections = shards.groupBy("rank", "section", "seats").agg(F.sum("words").alias("words")).groupBy("rank").applyInPandas(
        lambda rows: _apportion("words", block_words, most, "seats")(rows),
        "rank int, section long, seats long, words long, quota long",
    )
    shards = shards.drop("seats").join(sections.select("rank", "section", F.col("quota").alias("seats")), ["rank", "section"])
    shards = shards.select("rank", "section", "shard", "seats", "words").groupBy("rank", "section").applyInPandas(
        lambda rows: _apportion("words", block_words, most, "seats")(rows),
        "rank int, section long, shard long, seats long, words long, quota long",
    ).select("rank", "shard", F.col("words").alias("length"), F.col("quota").alias("blocks"))
    s = s.join(shards, ["rank", "shard"])

    line = Window.partitionBy("rank", "shard").orderBy("turn", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("end", F.sum("size").over(line))
    # The shard's documents lie on a ring of `length` words. Whole rounds take every document; the rest is a run of
    # blocks from a seeded block on, which may pass the ring's end.
    want = F.least(F.col("blocks") * block_words, F.col("length") * most)
    some = F.col("length") > 0
    length = F.greatest("length", F.lit(1))
    rounds = F.floor(want / length)
    rest = want - rounds * length
    first = F.pmod(F.xxhash64(F.lit(seed), "rank", "shard"), F.greatest(F.floor(length / block_words), F.lit(1))) * block_words
    start = F.col("end") - F.col("size")
    overlap = lambda lo, hi: F.greatest(F.lit(0), F.least("end", hi) - F.greatest(start, lo))
    part = overlap(first, first + rest) + overlap(first - length, first + rest - length)
    taken = F.when(some, rounds * F.col("size") + part).otherwise(F.lit(0)).cast("long")
    return s.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), "print")


def take(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed corpus, with the columns of `docs`: a document's text becomes the words that the mix takes.

    A document that the mix takes none of is left out. One taken more than once keeps one row: its text repeats, a
    line feed between, and the last turn stops at the words taken. A document taken exactly once is unchanged.
    Rows meet their plans by id (null too), source and text; rows equal in all three share out their plans one by one, in the order of their columns' JSON.
    """
    of_id, of_print, size, taken, more, mine, place = new_names(docs, "_id", "_print", "_size", "_taken", "_again", "_mine", "_place")
    plan = mixed.where("size > 0").select(F.col(id_col).alias(of_id), F.col("print").alias(of_print), F.col("size").alias(size), F.col("taken").alias(taken))
    plan = keep(plan, "mix-plan")
    again = keep(plan.groupBy(F.col(of_print).alias(more)).count().where("count > 1").select(more), "mix-again")
    own = row_print(id_col, text_col, source_col)
    same = F.col(id_col).eqNullSafe(F.col(of_id)) & (own == F.col(of_print))
    if again.isEmpty():
        out = docs.join(plan.where(F.col(taken) > 0), same).drop(of_print)
    else:
        once = plan.join(again, F.col(of_print) == F.col(more), "left_anti").where(F.col(taken) > 0)
        out = docs.join(once, same).drop(of_print)
        number = lambda of, by: F.row_number().over(Window.partitionBy(of).orderBy(by))
        in_order = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
        twice = plan.join(again, F.col(of_print) == F.col(more), "left_semi").withColumn(place, number(of_print, F.desc(taken))).where(F.col(taken) > 0)
        rows = docs.join(again, own == F.col(more), "left_semi").withColumn(mine, own).withColumn(more, number(mine, in_order))
        met = F.col(id_col).eqNullSafe(F.col(of_id)) & (F.col(mine) == F.col(of_print)) & (F.col(more) == F.col(place))
        out = out.union(rows.join(twice, met).drop(mine, more, of_print, place))
    whole = F.floor(F.col(taken) / F.col(size)).cast("int")
    rest = (F.col(taken) - whole * F.col(size)).cast("int")
    head = F.array_join(F.slice(F.regexp_extract_all(text_col, F.lit(f"({WORD})"), 1), F.lit(1), rest), " ")
    turns = F.array_repeat(F.col(text_col), whole)
    parts = F.when(rest > 0, F.array_append(turns, head)).otherwise(turns)
    text = F.when((whole == 1) & (rest == 0), F.col(text_col)).otherwise(F.array_join(parts, "\n"))
    out = out.withColumn(text_col, text).drop(of_id, size, taken)
    return out.withColumn("n_chars", F.length(text_col).cast("long")) if "n_chars" in docs.columns else out
