"""Licence scan by patience alignment.

A stretch of a document and a notice are aligned as patience sorting does it: words that occur once in both are
anchors, the longest increasing subsequence of anchors is kept, and the gaps between anchors are aligned in the same
way. The share of the notice's words that are aligned is its coverage. Beside the coverage, the phrases that tell a
notice from its relatives (name, version, NC, SA; MARKS) must stand whole and in their place, so that another licence in
the same sentence, or one with a word more ('Lesser'), isn't taken for it.

Where to align: for each notice, so many of its (longest) words are key words that a stretch without any of them can't
reach the coverage asked for. Each key word found in a document proposes the place where the notice would then begin,
give or take a quarter of its length. So no stretch that can match is missed, whole texts are read, and documents
without key words cost one pass of a multi-pattern automaton.

Defined cases: null text is empty; repeated rows are scanned each; a notice that occurs more than once is reported
each time; of overlapping finds the one with more aligned words stays, of such the shorter notice's, the shorter stretch and the first; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.license_texts import MARKS, NOTICES

WORDS = re.compile(r"[^\W_]+")


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (i, j), rising in both: equal ends first, then unique anchors, then the gaps between them."""
    out, work = [], [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if nb[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if na[w] == 1 and w in place]
        tails: list[int] = []
        heads: list[int] = []
        back: list[int] = []
        for n, (_, j) in enumerate(anchors):
            k = bisect_left(tails, j)
            back.append(heads[k - 1] if k else -1)
            tails[k : k + 1], heads[k : k + 1] = [j], [n]
        chain, n = [], heads[-1] if heads else -1
        while n >= 0:
            chain.append(anchors[n])
            n = back[n]
        chain.reverse()
        out += chain
        if chain:
            edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
            work += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def _place(words: list[str], phrase: list[str]) -> int | None:
    """Where `phrase` first stands in `words`, word after word."""
    return next((i for i in range(len(words) - len(phrase) + 1) if words[i] == phrase[0] and words[i : i + len(phrase)] == phrase), None)


class Notice:
    def __init__(self, name: str, text: str, coverage: float, marks: tuple[str, ...] = ()):
        self.name = name
        self.words = [w.lower() for w in WORDS.findall(text)]
        self.least = -int(-coverage * len(self.words) // 1)
        # Key words: without any of them, fewer than `least` words can be aligned.
        count, total, self.keys = Counter(self.words), 0, set()
        for w in sorted(count, key=lambda w: (-len(w), w)):
            if total > len(self.words) - self.least:
                break
            self.keys.add(w)
            total += count[w]
        self.at = {w: [i for i, x in enumerate(self.words) if x == w] for w in self.keys}
        self.room = len(self.words) // 4 + 2
        self.marks = [(_place(self.words, m), m) for m in ([w.lower() for w in WORDS.findall(m)] for m in marks)]
        if any(i is None for i, _ in self.marks):
            raise ValueError(f"a mark of {name} isn't in its text")

    def hold(self, pairs: list[tuple[int, int]], words: list[str]) -> list[tuple[int, int]] | None:
        """The alignment with each mark aligned word by word to its place in `words`; None if one doesn't stand there."""
        for i, m in self.marks:
            before, after = [p for p in pairs if p[0] < i], [p for p in pairs if p[0] >= i + len(m)]
            lo = before[-1][1] + 1 if before else 0
            at = _place(words[lo : after[0][1] if after else len(words)], m)
            if at is None:
                return None
            pairs = [*before, *((i + x, lo + at + x) for x in range(len(m))), *after]
        return pairs

    def find(self, words: list[str], hits: dict[str, list[int]]) -> list[tuple[int, int, int]]:
        """(aligned words, first word, end word) of stretches that reach the coverage."""
        starts = sorted({p - i for w in self.keys for p in hits.get(w, ()) for i in self.at[w]})
        out, last = [], None
        for s in starts:
            if last is not None and s - last <= self.room // 2:
                continue
            last = s
            # With room on both sides for changed copies; without, so that a neighbouring copy repeats no word.
            for lo, hi in ((max(0, s - self.room), s + len(self.words) + 2 * self.room), (max(0, s), s + len(self.words))):
                pairs = patience(self.words, words[lo:hi])
                if len(pairs) >= self.least and (pairs := self.hold(pairs, words[lo:hi])):
                    out.append((len(pairs), lo + pairs[0][1], lo + pairs[-1][1] + 1))
        return out


def find_notices(text: str, notices: list[Notice], wanted: set[str]) -> list[tuple[str, int, int, float]]:
    """(notice, start, end, coverage) in code points, without overlap, by start."""
    spots = [(m.start(), m.end()) for m in WORDS.finditer(text)]
    words = [text[a:b].lower() for a, b in spots]
    hits: dict[str, list[int]] = {}
    for p, w in enumerate(words):
        if w in wanted:
            hits.setdefault(w, []).append(p)
    if not hits:
        return []
    found = [(n, -len(t.words), t, a, b) for t in notices for n, a, b in t.find(words, hits)]
    taken: list[tuple[str, int, int, float]] = []
    used: list[tuple[int, int]] = []  # by place, apart from one another
    for n, _, t, a, b in sorted(found, key=lambda x: (-x[0], -x[1], x[4] - x[3], x[3])):
        at = bisect_left(used, (a, b))
        if (at == 0 or used[at - 1][1] <= a) and (at == len(used) or b <= used[at][0]):
            used.insert(at, (a, b))
            taken.append((t.name, spots[a][0], spots[b - 1][1], n / len(t.words)))
    return sorted(taken, key=lambda x: x[1])


_FOUND = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("coverage", pa.float64())]))


def _scan(texts: dict[str, str], marks: dict[str, tuple[str, ...]], coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        notices = [Notice(n, t, coverage, marks.get(n, ())) for n, t in texts.items()]
        wanted = set().union(*(t.keys for t in notices))
        automaton = ahocorasick.Automaton()
        for w in wanted:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for batch in batches:
            found = []
            for text in batch.column(1):
                text = text.as_py() or ""
                some = next(automaton.iter(text.lower()), None) if wanted else None
                found.append([dict(zip(("license", "start", "end", "coverage"), x, strict=True)) for x in find_notices(text, notices, wanted)] if some else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _FOUND)], ["id", "licenses"])

    return run


def scan(docs: DataFrame, texts: dict[str, str] | None = None, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
         marks: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(id, licenses) for each row; licenses: array of (license, start, end, coverage) by start.

    texts: notices by name, by default NOTICES. coverage: the least share of a notice's words. marks: by notice, the
    phrases that must stand whole, by default MARKS for NOTICES and none for other texts.
    """
    if marks is None:
        marks = {} if texts else MARKS
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = f"id {docs.schema['id'].dataType.simpleString()}, licenses array<struct<license:string,start:int,end:int,coverage:double>>"
    return docs.mapInArrow(_scan(texts or NOTICES, marks, coverage), kind).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_licenses, licenses, coverage, spans): names by code point and without repeats, the best coverage, and license:start:end by start."""
    names = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"])))
    spans = F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select(id_col, F.size("licenses").cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"),
                        F.round(F.coalesce(F.array_max(F.transform("licenses", lambda x: x["coverage"])), F.lit(0.0)), 6).alias("coverage"), F.array_join(spans, ",").alias("spans"))
