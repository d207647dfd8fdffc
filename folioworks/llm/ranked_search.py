"""Ranked lexical search with buckets by vector length, as LEMP has them: exact top k of all documents for each item.

A document's impact vector holds, for each term that some item has, the integer that the term adds to a score: its
weight times its saturated frequency. An item's vector holds 1 for each of its terms, so a score is an inner product.
Vectors are ordered by their length: tasks take ranges of that order and meet them in buckets, the longest first. Per
bucket and item

* by Cauchy-Schwarz no score in the bucket exceeds the item's length times the bucket's longest vector; an item whose
  k-th best score so far is beyond that passes the bucket over;
* each coordinate's maximum in the bucket bounds what a term can add; an item whose terms can't add up to its k-th best
  score passes the bucket over as well, and of the others only documents are looked at that hold one of the terms
  without which the k-th best score is out of reach;
* documents that still may reach it are scored exactly, in integers.

The k-th best scores start from the longest `seed_rows` vectors (about), so every task prunes from its first bucket on.

Terms are maximal runs of ASCII letters and digits and of all other characters above ASCII, A to Z lower-cased. Items
are taken in slices of at most about `slice_bytes` of text; a slice's terms and weights go to every task.

Defined cases: a null text has no terms; documents without terms don't count; rows count each, also with one id; rows
of items with one id are one item with the terms of all of them, a null id is an id like others; equal scores rank by
id, null ids last; an item without terms that occur gets no rows; texts of any length are taken whole; empty tables give
an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.llm.common import free, keep

#: Bytes of UTF-8 as a term has them: A to Z lower-cased, all that parts terms a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: A bound is widened by more than its rounding error.
WIDE = 1 + 1e-9


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def weight(n: int, df: int) -> int:
    """A term's weight, of n documents with terms and df that hold it."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, words: int, of: np.ndarray, n: int, total: int) -> np.ndarray:
    """What terms with frequencies tf and weights `of` add to the score of a document of so many words; total: the words of all n documents."""
    m = 10 + (90 * int(words) * n) // total
    return of * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _counted(places: dict[bytes, int]):
    """Each document's terms that items have, with their frequencies; a batch's first row also has the batch's document frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ids, tfs, df = [], [], [], Counter()
            for text in batch.column(1):
                own = terms(text.as_py())
                count = Counter(map(places.get, own))
                count.pop(None, None)
                words.append(len(own))
                place = np.sort(np.fromiter(count, np.int32, len(count)))
                ids.append(place.tobytes())
                tfs.append(np.fromiter(map(count.__getitem__, place.tolist()), np.int32, len(place)).tobytes())
                df.update(count.keys())
            stats = [[{"term": t, "df": n} for t, n in df.items()], *[None] * (batch.num_rows - 1)][: batch.num_rows]
            kind = pa.list_(pa.struct([("term", pa.int32()), ("df", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(ids, pa.binary()), pa.array(tfs, pa.binary()), pa.array(stats, kind)], ["doc_id", "words", "ids", "tfs", "stats"])

    return run


def _lengths(of: np.ndarray, n: int, total: int):
    """Adds the length of each impact vector; documents whose terms all weigh nothing go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = []
            for words, ids, tfs in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                u = impacts(np.frombuffer(tfs.as_buffer(), np.int32).astype(np.int64), words, of[np.frombuffer(ids.as_buffer(), np.int32)], n, total)
                length.append(math.sqrt(float((u.astype(float) ** 2).sum())))
            length = pa.array(length, pa.float64())
            out = pa.RecordBatch.from_arrays([*batch.columns[:4], length], ["doc_id", "words", "ids", "tfs", "length"])
            yield out.filter(pa.array(np.asarray(length) > 0))

    return run


class Best:
    """Each item's k best (score, id) so far; ids that are null rank last among equal scores."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floors = k, floors.copy()
        self.scores = [np.empty(0, np.int64) for _ in floors]
        self.ids = [np.empty(0, np.int64) for _ in floors]
        self.nulls = [np.empty(0, bool) for _ in floors]

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        s, i, z = np.concatenate([self.scores[item], scores]), np.concatenate([self.ids[item], ids]), np.concatenate([self.nulls[item], nulls])
        use = np.lexsort((i, z, -s))[: self.k]
        self.scores[item], self.ids[item], self.nulls[item] = s[use], i[use], z[use]
        if len(use) == self.k:
            self.floors[item] = max(self.floors[item], int(s[use[-1]]))


class Bucket:
    """Documents' impact vectors, the longest first."""

    def __init__(self, rows: list[tuple[int | None, int, np.ndarray, np.ndarray]], longest: float, size: int):
        self.longest = longest
        self.nulls = np.array([r[0] is None for r in rows])
        self.ids = np.array([r[0] or 0 for r in rows], np.int64)
        term = np.concatenate([r[2] for r in rows])
        doc = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        order = np.argsort(term, kind="stable")
        self.docs, self.adds = doc[order], np.concatenate([r[3] for r in rows])[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=size))])
        self.most = np.zeros(size, np.int64)
        held = np.flatnonzero(np.diff(self.starts))
        self.most[held] = np.maximum.reduceat(self.adds, self.starts[held]) if len(held) else 0

    def meet(self, items: tuple[np.ndarray, np.ndarray], best: Best) -> None:
        flat, starts = items
        reach = np.zeros(len(starts) - 1, np.int64)
        some = np.flatnonzero(np.diff(starts))
        reach[some] = np.add.reduceat(self.most[flat], starts[some]) if len(some) else 0
        by_length = np.sqrt(np.diff(starts).astype(float)) * self.longest * WIDE
        for item in np.flatnonzero((by_length >= best.floors) & (reach >= best.floors) & (reach > 0)):
            self._one(int(item), flat[starts[item] : starts[item + 1]], best)

    def _one(self, item: int, own: np.ndarray, best: Best) -> None:
        own = own[self.most[own] > 0]
        own = own[np.argsort(self.most[own], kind="stable")]
        upto = np.cumsum(self.most[own])
        spare = int(np.searchsorted(upto, best.floors[item], "left"))  # terms that alone stay below the floor
        spare = min(spare, len(own) - 1)
        rest = int(upto[spare - 1]) if spare else 0
        ranges = [(self.starts[t], self.starts[t + 1]) for t in own[spare:]]
        docs = np.concatenate([self.docs[a:b] for a, b in ranges])
        score = np.zeros(len(self.ids), np.int64)
        if int(upto[-1]) < 2**53:
            score[:] = np.bincount(docs, np.concatenate([self.adds[a:b] for a, b in ranges]), len(score))  # whole numbers, exact in doubles
        else:
            np.add.at(score, docs, np.concatenate([self.adds[a:b] for a, b in ranges]))
        left = np.flatnonzero((score > 0) & (score + rest >= best.floors[item]))
        score = score[left]
        for t in own[:spare]:
            docs, adds = self.docs[self.starts[t] : self.starts[t + 1]], self.adds[self.starts[t] : self.starts[t + 1]]
            at = np.minimum(np.searchsorted(docs, left), len(docs) - 1)
            score += np.where(docs[at] == left, adds[at], 0)
        use = score >= best.floors[item]
        if use.any():
            best.add(item, score[use], self.ids[left[use]], self.nulls[left[use]])


def _search(items: tuple[np.ndarray, np.ndarray], floors: np.ndarray, of: np.ndarray, n: int, total: int, k: int, rows: int, entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, waiting, held, longest = Best(floors, k), [], 0, 0.0

        def close() -> None:
            nonlocal waiting, held, longest
            if waiting:
                Bucket(waiting, longest, len(of)).meet(items, best)
            waiting, held, longest = [], 0, 0.0

        for batch in batches:
            for doc, words, ids, tfs, length in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                ids = np.frombuffer(ids, np.int32)
                waiting.append((doc, words, ids, impacts(np.frombuffer(tfs, np.int32).astype(np.int64), words, of[ids], n, total)))
                held, longest = held + len(ids), max(longest, length)
                if len(waiting) >= rows or held >= entries:
                    close()
        close()
        found = [np.repeat(np.arange(len(floors)), [len(s) for s in best.scores])]
        found += [np.concatenate(x) if len(x) else np.empty(0, np.int64) for x in (best.ids, best.scores)]
        nulls = np.concatenate(best.nulls) if len(floors) else np.empty(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int32()), pa.array(found[1], pa.int64(), mask=nulls), pa.array(found[2], pa.int64())], ["item", "doc_id", "score"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, slice_bytes: int = 32 << 20, seed_rows: int = 4096, bucket_rows: int = 8192, bucket_entries: int = 1 << 20,
                  id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item id, rank, id, score): each item's k best documents with a score above 0.

    slice_bytes: text of the items that are looked up in one pass over the documents. bucket_rows, bucket_entries: a
    bucket's documents and vector entries at most, so that a task's memory has a bound.
    """
    spark = docs.sparkSession
    one = items.agg(F.sum(F.octet_length(text_col)).alias("bytes"), F.max(F.octet_length(text_col)).alias("most")).first()
    slices = max(1, -(-(one["bytes"] or 0) // slice_bytes))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = []
    for s in range(slices):
        rows = items.where(F.pmod(F.xxhash64(item_col), F.lit(slices)) == s).select(item_col, text_col).collect()  # about slice_bytes
        of_item: dict = {}
        for r in rows:
            of_item.setdefault(r[0], set()).update(terms(r[1]))
        names = sorted({t for own in of_item.values() for t in own})
        if names:
            parts.append(_slice(source, of_item, {t: i for i, t in enumerate(names)}, k, seed_rows, bucket_rows, bucket_entries, items.schema[item_col].dataType.simpleString(), item_col))
    kind = f"{item_col} {items.schema[item_col].dataType.simpleString()}, rank int, {id_col} long, score long"
    out = reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], kind)
    return out.toDF(item_col, "rank", id_col, "score")


def _slice(source: DataFrame, of_item: dict, places: dict[bytes, int], k: int, seed_rows: int, bucket_rows: int, bucket_entries: int, item_kind: str, item_col: str) -> DataFrame:
    spark = source.sparkSession
    counted = keep(source.mapInArrow(_counted(places), "doc_id long, words long, ids binary, tfs binary, stats array<struct<term:int,df:long>>"), "lemp-counted")
    one = counted.agg(F.count_if(F.col("words") > 0).alias("n"), F.sum("words").alias("total")).first()
    n, total = one["n"], one["total"] or 0
    held = counted.select(F.explode("stats").alias("s")).groupBy("s.term").agg(F.sum("s.df").alias("df")).collect()  # a row for each term of the slice
    if not held:
        free(counted)
        return spark.createDataFrame([], f"{item_col} {item_kind}, rank int, doc_id long, score long")
    of = np.zeros(len(places), np.int64)
    for r in held:
        of[r["term"]] = weight(n, r["df"])
    known = list(of_item)
    ids = [np.array(sorted(places[t] for t in of_item[i]), np.int32) for i in known]
    query = np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    vectors = keep(counted.select("doc_id", "words", "ids", "tfs").mapInArrow(_lengths(of, n, total), "doc_id long, words long, ids binary, tfs binary, length double"), "lemp-vectors")
    free(counted)
    shape = "item int, doc_id long, score long"
    search = lambda floors: _search(query, floors, of, n, total, k, bucket_rows, bucket_entries)
    floors = np.ones(len(known), np.int64)
    rows = vectors.agg(F.count("*").alias("n"), F.percentile_approx("length", F.array(F.lit(0.0), F.lit(0.5), F.lit(0.9), F.lit(0.99), F.lit(0.999)), F.lit(2000)).alias("p")).first()
    if rows["n"] > 4 * seed_rows:
        cuts = [p for p, share in zip(rows["p"], (1.0, 0.5, 0.1, 0.01, 0.001), strict=True) if share * rows["n"] >= seed_rows]
        first = _top(vectors.where(F.col("length") >= cuts[-1]).mapInArrow(search(floors), shape), k)
        for r in first.where(F.col("rank") == k).collect():  # a row for each item of the slice
            floors[r["item"]] = r["score"]
    ordered = vectors.repartitionByRange(F.desc("length"), F.xxhash64("doc_id")).sortWithinPartitions(F.desc("length"))
    best = _top(ordered.mapInArrow(search(floors), shape), k)
    names = spark.createDataFrame(list(enumerate(known)), f"item int, name {item_kind}")
    return best.join(F.broadcast(names), "item").select(F.col("name").alias(item_col), "rank", "doc_id", "score")
