"""Secret scan: known forms, and a battery of randomness tests under false-discovery control.

Known forms: an assignment to a secret-like name, an access key id, a long hexadecimal run. Beyond them, each long
token is a candidate; one that lies within known spans isn't. Its encoding is inferred from its characters, and three
tests ask how well it agrees with characters drawn at random from that alphabet: chi-squared uniformity, runs above and
below the alphabet's middle, and serial correlation; Fisher's method combines them to one figure, near 0 for text and
anywhere from 0 to 1 for random characters.

The null hypothesis is "text": each STEP characters of each document give one text-like string, its words joined to a
length from LEAST to 10 LEAST, whose figure is taken alike. A candidate's p-value is the share of such strings of its
encoding and length (of its length alone, where text has fewer than FEW of its encoding) that look as random as it does. One
Benjamini-Hochberg over the p-values of all strata rejects at `rate`, and the rejected are reported as `random`: so of
the reports about that share at most is text. Each distinct token is one finding, however many copies of its document
there are. A p-value is at least one over the number of text-like strings, so where text is too scarce to show that a
token is rare, nothing is reported.

Figures are counted in bins by stratum, tables of bounded size, so the control sees every candidate and all documents.

Defined cases: null text is empty; repeated rows are scanned each, their tokens count once; a table without text-like
strings reports no `random` span; texts of any length take time in proportion to it; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.common import keep
from folioworks.llm.spans import SPAN, SPANS, count, in_order, joined, merged, replace_spans

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Characters of a candidate at least, and of text for each text-like string.
LEAST, STEP = 16, 800
TOKEN = re.compile(f"[A-Za-z0-9+/_-]{{{LEAST},}}={{0,2}}")
_TEXT_WORD = re.compile(r"[A-Za-z]{1,15}|[0-9]{1,4}")
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the narrowest to the widest, by alphabet.
ALPHABETS = (
    ("hex", "0123456789abcdef"), ("HEX", "0123456789ABCDEF"), ("base32", _UPPER + "234567"), ("base36", _DIGITS + _LOWER), ("BASE36", _DIGITS + _UPPER),
    ("base62", _UPPER + _LOWER + _DIGITS), ("base64", _UPPER + _LOWER + _DIGITS + "+/"), ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
    ("mixed", _UPPER + _LOWER + _DIGITS + "+/-_"),
)
_SETS = [frozenset(a) for _, a in ALPHABETS]
_PLACES = [{c: i for i, c in enumerate(a)} for _, a in ALPHABETS]
#: Lengths from which a new stratum begins, and bins of a figure's logarithm to base 10.
LENGTHS, BIN, MOST_BIN = (20, 28, 40, 64, 128), 20, 400
#: Text-like strings that a stratum needs for a null of its own.
FEW = 1000


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if ":" in text or "=" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _chi_tail(x: float, k: int) -> float:
    """P(chi-squared with k degrees of freedom >= x), by the Wilson-Hilferty cube root."""
    z = ((max(x, 1e-9) / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def randomness(token: str) -> tuple[int, float]:
    """(stratum, combined p-value of `the characters are drawn at random from the token's alphabet`); a stratum is 10 times the encoding plus the length class."""
    body = token.rstrip("=").replace("=", "")
    kind = next(i for i, s in enumerate(_SETS) if s.issuperset(body))
    size, n = len(ALPHABETS[kind][1]), len(body)
    v = np.fromiter(map(_PLACES[kind].__getitem__, body), np.int64, n)
    counts = np.bincount(v, minlength=size)
    uniform = _chi_tail(float(((counts - n / size) ** 2).sum() * size / n), size - 1)
    above = v >= size // 2
    up = int(above.sum())
    if 0 < up < n:
        mean = 2 * up * (n - up) / n + 1
        deviation = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
        runs = math.erfc(abs(1 + int((above[1:] != above[:-1]).sum()) - mean) / deviation / math.sqrt(2))
    else:
        runs = 2.0 ** (1 - n)
    c = v - (size - 1) / 2
    spread = float((c * c).sum())
    serial = math.erfc(abs(float((c[1:] * c[:-1]).sum()) / spread) * math.sqrt(n) / math.sqrt(2)) if spread else 0.0
    fisher = -2 * sum(math.log(max(p, 1e-300)) for p in (uniform, runs, serial))
    half = fisher / 2
    p = math.exp(-half) * (1 + half + half * half / 2)
    length = sum(len(token) >= x for x in LENGTHS)
    return kind * 10 + length, p


def bin_of(p: float) -> int:
    return min(int(-math.log10(max(p, 1e-300)) * BIN), MOST_BIN)


def candidates(text: str, known: list[tuple[str, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, bin) of each long token that isn't within known spans."""
    out = []
    spans = merged([(a, b) for _, a, b in known])
    ends = [b for _, b in spans]
    for m in TOKEN.finditer(text):
        k = bisect_right(ends, m.start())
        if k < len(spans) and spans[k][0] <= m.start() and m.end() <= ends[k]:
            continue
        if m.group().rstrip("="):
            stratum, p = randomness(m.group())
            out.append((m.start(), m.end(), stratum, bin_of(p)))
    return out


def text_like(text: str) -> list[tuple[int, int]]:
    """(stratum, bin) of strings made of the text's own words, one for each STEP characters."""
    out = []
    for at in range(0, len(text), STEP):
        mark = zlib.crc32(text[at : at + 40].encode("utf-8", "surrogatepass"))
        size, sep = int(LEAST * 10 ** (mark % 997 / 997)), ("", "", "-", "_", "/")[mark % 5]
        words = [w for w in (x.strip(".,;:!?()\"'") for x in text[at : at + 3 * size + 40].split()[1:-1]) if _TEXT_WORD.fullmatch(w)]
        token = sep.join(words)[:size]
        if len(token) >= LEAST:
            stratum, p = randomness(token)
            out.append((stratum, bin_of(p)))
    return out


_CANDIDATES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("stratum", pa.int32()), ("bin", pa.int32()), ("token", pa.int64())]))
_LIKE = pa.list_(pa.struct([("stratum", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())]))


def _token_id(token: str) -> int:
    return int.from_bytes(blake2b(token.encode(), digest_size=8).digest(), "little", signed=True)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans and candidates of each row; the batch's first row also has the counts of all its text-like strings."""
    for batch in batches:
        base, more, like = [], [], Counter()
        for text in batch.column(1):
            text = text.as_py() or ""
            known = base_spans(text)
            base.append([{"kind": k, "start": a, "end": b} for k, a, b in known])
            more.append([{"start": a, "end": b, "stratum": s, "bin": x, "token": _token_id(text[a:b])} for a, b, s, x in candidates(text, known)])
            like.update(text_like(text))
        likes = [[{"stratum": s, "bin": x, "n": n} for (s, x), n in like.items()], *[None] * (batch.num_rows - 1)][: batch.num_rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(base, SPANS), pa.array(more, _CANDIDATES), pa.array(likes, _LIKE)], ["id", "print", "base", "more", "like"])


def last_bins(found: Counter, like: Counter, rate: float) -> dict[int, int]:
    """stratum -> the last bin (the least random look) that Benjamini-Hochberg rejects at `rate` over all strata; found, like: (stratum, bin) -> count of distinct candidates, of text-like strings."""
    own: dict[int, Counter] = defaultdict(Counter)
    by_length: dict[int, Counter] = defaultdict(Counter)
    for (stratum, x), n in like.items():
        own[stratum][x] += n
        by_length[stratum % 10][x] += n
    p = {}
    for stratum in {s for s, _ in found}:
        null = own[stratum] if own[stratum].total() >= FEW else by_length[stratum % 10]
        below, total = 0, null.total()
        for x in range(MOST_BIN + 1):  # bin 0 looks most random
            below += null[x]
            p[stratum, x] = (1 + below) / (1 + total)
    least, seen, total = -1.0, 0, found.total()
    for key in sorted(found, key=p.__getitem__):
        seen += found[key]
        if p[key] <= rate * seen / total:
            least = p[key]
    out: dict[int, int] = {}
    for (stratum, x), value in p.items():
        if value <= least:
            out[stratum] = max(x, out.get(stratum, x))
    return out


def scan(docs: DataFrame, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print, base, spans) for each row: the text's hash, spans of known forms, and all spans with the `random` ones, in order."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("print"))
    kind = f"id {docs.schema['id'].dataType.simpleString()}, print long, base array<{SPAN}>"
    kind += ", more array<struct<start:int,end:int,stratum:int,bin:int,token:long>>, like array<struct<stratum:int,bin:int,n:long>>"
    found = keep(docs.mapInArrow(_scan, kind), "secret-candidates")
    each = found.select(F.explode("more").alias("c")).select("c.stratum", "c.bin", "c.token").distinct()
    of = lambda rows: Counter({(r["stratum"], r["bin"]): r["n"] for r in rows.collect()})  # noqa: E731  strata times bins at most
    counts = of(each.groupBy("stratum", "bin").agg(F.count("*").alias("n")))
    likes = of(found.select(F.explode("like").alias("c")).groupBy("c.stratum", "c.bin").agg(F.sum("c.n").alias("n")))
    last = last_bins(counts, likes, rate)
    table = F.create_map(*(F.lit(x) for pair in (last or {-1: -1}).items() for x in pair))
    random = F.filter("more", lambda c: c["bin"] <= F.coalesce(F.try_element_at(table, c["stratum"]), F.lit(-1)))
    random = F.transform(random, lambda c: F.struct(F.lit("random").alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    base = in_order("base", KINDS)
    return found.select(F.col("id").alias(id_col), "print", base.alias("base"), F.concat(base, random).alias("all")).select(
        id_col, "print", "base", in_order("all", KINDS).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    counts = [count("base", k).alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """`docs` with each secret replaced by `mark`; all rows and columns stay. Rows without secrets are untouched."""
    return replace_spans(docs, scan(docs, id_col=id_col, text_col=text_col, **kwargs), mark, id_col, text_col)
