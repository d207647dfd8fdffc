"""URL filter: path rules and a cascade of Bloom filters, in DataFrame functions only.

A URL's key is host + path. Rules name a host (with all its subdomains) and a path prefix. The listed keys - those
whose longest rule blocks, and any in `listed` - are encoded by a cascade: level 0 holds the listed keys, level 1 the
unlisted keys that level 0 takes for listed, level 2 the listed keys that level 1 takes for unlisted, and so on until
a level makes no mistake on the corpus's complete set of keys. A key of the corpus is listed exactly if the first
level that lacks it is an odd one, so the filter is exact without a join by key.

Bits are set by an aggregation (bit_or by 64-bit word). A cascade of up to `most_bits` is a scalar to each task; a
larger one is cut into segments by key and joined by segment, in which case a hot segment can be split like any join.

Defined cases: null, and no `://`: host and path are empty, no rule, allow. Repeated URLs get equal rows; an empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.common import keep

#: (verdict, host, path prefix).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
HASHES = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[F.Column, F.Column]:
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.col(url).substr(at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def longest_rule(host, path, rules) -> F.Column:
    """struct(verdict, rule) of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def _places(key: str, level: int, bits: int) -> list[F.Column]:
    """Bit numbers of a key in a filter of `bits` bits: double hashing with seeds of the level's own."""
    a, b = (F.pmod(F.xxhash64(F.lit(2 * level + i), key), F.lit(bits)) for i in (0, 1))
    return [F.pmod(a + F.lit(i) * b, F.lit(bits)) for i in range(HASHES)]


def _encode(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """(segment, words): each segment's filter as an array of 64-bit words. Zeros fill the words that no key sets."""
    at = keys.select("segment", F.explode(F.array(*_places("key", level, bits))).alias("at"))
    one = at.select("segment", F.floor(F.col("at") / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("b"))
    zero = keys.select("segment").distinct().select(
        "segment", F.explode(F.sequence(F.lit(0), F.lit(bits // 64 - 1))).alias("w"), F.lit(0).cast("long").alias("b")
    )
    words = one.groupBy("segment", "w").agg(F.bit_or("b").alias("b")).union(zero).groupBy("segment", "w").agg(F.bit_or("b").alias("b"))
    row = F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"])
    return keep(words.groupBy("segment").agg(row.alias("words")), f"bloom-{level}")


class Cascade:
    """The levels of a built cascade; `listed(frame)` adds the column `listed` to a frame with `key` and `segment`."""

    def __init__(self, segments: int, scalar: bool):
        self.segments, self.scalar, self.levels = segments, scalar, []

    def segment(self, key: str) -> F.Column:
        return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(self.segments)).cast("int")

    def add(self, keys: DataFrame, n: int, bits_per_key: int) -> None:
        bits = 64 * max(1, -(-n * bits_per_key // (64 * self.segments)))
        self.levels.append((_encode(keys, len(self.levels), bits), bits))

    def _words(self, level: int) -> F.Column:
        if not self.scalar:
            return F.col(f"words_{level}")
        table = self.levels[level][0]
        by_segment = table.agg(F.map_from_entries(F.collect_list(F.struct("segment", "words"))).alias("m")).scalar()
        return F.element_at(by_segment, F.col("segment"))

    def _attach(self, frame: DataFrame, levels: range) -> DataFrame:
        if not self.scalar:
            for i in levels:
                frame = frame.join(self.levels[i][0].withColumnRenamed("words", f"words_{i}"), "segment", "left")
        return frame

    def _has(self, level: int) -> F.Column:
        bits = self.levels[level][1]
        words = self._words(level)
        on = (F.getbit(F.get(words, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1 for p in _places("key", level, bits))
        return F.coalesce(reduce(lambda x, y: x & y, on), F.lit(False))

    def mistaken(self, keys: DataFrame) -> DataFrame:
        """Those of `keys` that the last level takes for its own."""
        last = len(self.levels) - 1
        return self._attach(keys, range(last, last + 1)).where(self._has(last)).select("key", "segment")

    def listed(self, frame: DataFrame) -> DataFrame:
        out = F.lit(len(self.levels) % 2 == 1)  # in each level: what the last one encodes
        for i in reversed(range(len(self.levels))):
            out = F.when(~self._has(i), F.lit(i % 2 == 1)).otherwise(out)
        frame = self._attach(frame, range(len(self.levels)))
        return frame.withColumn("listed", out).drop(*(f"words_{i}" for i in range(len(self.levels))))


def build_cascade(universe: DataFrame, bits_per_key: int = 10, most_bits: int = 1 << 26, segment_bits: int = 1 << 22,
                  most_levels: int = 40) -> Cascade:
    """A cascade that is exact on `universe`, (key, listed) with distinct keys.

    most_bits: up to this size of the first level (8 MB) each task holds the filters; beyond it they are joined by
    segment, each of about segment_bits.
    """
    n = universe.where("listed").count()
    segments = max(1, -(-n * bits_per_key // segment_bits))
    cascade = Cascade(segments, n * bits_per_key <= most_bits)
    universe = universe.withColumn("segment", cascade.segment("key"))
    own, other = universe.where("listed"), universe.where("not listed")
    while n:
        if len(cascade.levels) == most_levels:
            raise RuntimeError(f"the cascade still errs after {most_levels} levels")
        cascade.add(own, n, bits_per_key)
        wrong = keep(cascade.mistaken(other), "bloom-mistaken")
        own, other, n = wrong, own, wrong.count()
    return cascade


def filter_urls(pages: DataFrame, rules=RULES, listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", **sizes) -> DataFrame:
    """(id, host, path, rule, verdict, listed) of every row of `pages`.

    listed: more keys to block, a frame with a column `key` (host + path); a rule that allows still wins.
    verdict: the rule's, else block for a listed key, else allow. Both kinds of block come from the cascade.
    """
    url = pages.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url_"))
    host, path = host_and_path("url_")
    url = url.select(id_col, host.alias("host"), path.alias("path"))
    url = url.withColumn("key", F.concat("host", "path")).withColumn("hit", longest_rule(F.col("host"), F.col("path"), rules))
    universe = url.groupBy("key").agg(F.coalesce(F.max(F.col("hit.verdict")), F.lit("none")).alias("said"))
    extra = F.lit(False)
    if listed is not None:
        universe = universe.join(listed.select("key").distinct().withColumn("extra", F.lit(True)), "key", "left")
        extra = F.col("extra").isNotNull() & (F.col("said") == "none")
    universe = keep(universe.select("key", ((F.col("said") == "block") | extra).alias("listed")), "url-keys")
    cascade = build_cascade(universe, **sizes)
    out = cascade.listed(url.withColumn("segment", cascade.segment("key")))
    verdict = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select(id_col, "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "listed")
