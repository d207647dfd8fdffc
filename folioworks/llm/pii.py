"""Personal data by a semi-Markov conditional random field over whole spans.

Known forms (e-mail, IP, card, phone) are found by rule. Beyond them, stretches of text with digits or `@` are cut into
tokens (runs of letters, runs of digits, single other characters), and a semi-Markov conditional random field gives a
probability to each segmentation of a stretch into entities of at most `MOST_TOKENS` tokens and single tokens outside
of them. Its features are of whole segments: digit groups, separators, letters, the word before; label transitions tie
neighbouring segments together. Sums over all segmentations (forward-backward) give the likelihood and its gradient
for the fit, and the probability of each segment; the best segmentation (Viterbi) chooses boundaries and types jointly.
A segment of the best segmentation is added if its probability is `least` or more and it touches no known span.

What it learns from: known forms in a bounded sample of stretches and some made up; changed copies of both, as people
write them (no `+`, other separators, brackets around a dot or an `@`); and stretches without entities - the sample's,
but for those that hold separators and groups as the changed copies have them, and everyday numbers (dates, prices, versions, ranges).

Defined cases: null text is empty; repeated rows are scanned each; stretches of any length are decoded whole, in time
proportional to their length; only decimal digits (of any script) are digits to the model, ASCII ones to the known
forms; a part of an IP may have any number of leading zeros; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.common import keep, some_rows
from folioworks.llm.spans import SPAN, SPANS, count, in_order, joined, merged, replace_spans

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_CHAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match that starts within a run of digits would also start at the run's first digit.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9@]")
_STRETCH = re.compile(r"\S*(?:\x20\S*[0-9@]\S*)*")
_WORD = re.compile(r"\S*")
_TOKEN = re.compile(r"[^\W\d_]+|\d+|.", re.DOTALL)
#: Of a segment.
MOST_TOKENS, MOST_DIGITS, MOST_GROUPS = 24, 20, 8


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    """Whether a run of digits is a number up to 255; leading zeros may be any number."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _digits(token: str) -> bool:
    """Whether a token is a run of decimal digits; superscripts, circled digits and the like count as letters."""
    return token[0].isdecimal()


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _EMAIL_CHAR:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Known forms, leftmost and without overlap for each kind."""
    if not _DIGIT.search(text):
        return []
    out = list(_emails(text))
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(_byte, m.group().split(".")))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def stretches(text: str) -> list[tuple[int, str, str]]:
    """(start, stretch, word before) of each run of words with digits or `@`; an `@` between spaces takes in the words beside it."""
    out, end = [], 0
    for m in _DIGIT.finditer(text):
        at = m.start()
        if at < end:
            continue
        start = end
        for gap in (" ", "\n", "\t"):
            start = max(start, text.rfind(gap, end, at) + 1)
        if text[at] == "@" and start == at and at > end + 1 and text[at - 1] == " ":
            start = max(text.rfind(gap, end, at - 1) + 1 for gap in (" ", "\n", "\t")) or end
        end = max(_STRETCH.match(text, start).end(), at + 1)
        if text[end - 1] == "@" and text[end : end + 1] == " ":
            end = _WORD.match(text, end + 1).end()
        before = text[max(0, start - 24) : start].split()
        out.append((start, text[start:end], before[-1].lower().strip(":.,;") if before else ""))
    return out


def segments(tokens: list[str], before: str) -> list[tuple[int, int, list[str]]]:
    """(first token, end token, features) of each segment that can be an entity: it stands between non-alphanumeric tokens, holds an `@` or 4 to 20 digits in up to 8 groups, and letters only with an `@`."""
    out, n = [], len(tokens)
    mails = "@" in tokens
    for i, first in enumerate(tokens):
        if not (first[0].isalnum() or first in "+([") or i and (tokens[i - 1][0].isalnum() or tokens[i - 1] in "+_@"):
            continue
        digits = letters = groups = 0
        mail = False
        for j in range(i + 1, min(n, i + MOST_TOKENS) + 1):
            t = tokens[j - 1]
            if _digits(t):
                digits, groups = digits + len(t), groups + 1
                if not mails and (digits > MOST_DIGITS or groups > MOST_GROUPS):
                    break
            elif t[0].isalnum():
                letters += 1
                if not mails:
                    break
            elif t == "@":
                mail = True
            elif t in "\n\t":
                break
            if not (t[0].isalnum() or t in ")]") or j < n and (tokens[j][0].isalnum() or tokens[j] in "@_%"):
                continue
            if mail or digits >= 4 and not letters:
                out.append((i, j, [*_features(tokens[i:j], before, mail, digits), f"left={tokens[i - 1].strip() if i else ''}", f"right={tokens[j].strip() if j < n else ''}"]))
    return out


def _features(part: list[str], before: str, mail: bool, digits: int) -> list[str]:
    groups = [t for t in part if _digits(t)]
    between = "".join(sorted({t for t in part if not t[0].isalnum()}))
    out = ["bias", f"sep={between}", f"mail={mail}", f"before={before}", f"first={part[0] if not part[0][0].isalnum() else ''}", f"end={part[-1] if not part[-1][0].isalnum() else ''}"]
    if mail:
        at = part.index("@")
        after = [t for t in part[at + 1 :] if t[0].isalnum()]
        return [*out, f"local={any(t[0].isalnum() for t in part[:at])}", f"dots={min(part[at:].count('.'), 3)}", f"top={after[-1].isalpha() and len(after[-1]) > 1 if after else None}",
                f"ats={min(part.count('@'), 2)}", f"spaces={min(part.count(' '), 3)}"]
    whole = "".join(groups)
    return [*out, f"digits={min(digits, 20)}", f"groups={min(len(groups), 6)}", f"digits,groups={min(digits, 20)},{min(len(groups), 6)}", "shape=" + ",".join(str(min(len(g), 5)) for g in groups[:5]),
            f"luhn={12 <= digits <= 19 and whole.isascii() and luhn(whole)}", f"bytes={len(groups) == 4 and all(map(_byte, groups))}", f"year={len(groups[0]) == 4 and groups[0][:2] in ('18', '19', '20')}"]


def _sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Field:
    """A semi-Markov conditional random field. Labels: 0 is outside, 1 and so on are KINDS.

    A segmentation's score adds up weights[feature, kind] over its entities' features, and moves[label, next label]
    over its segments, from outside at the start.
    """

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.names, self.weights, self.moves = names, weights, moves

    def score(self, features: list[str]) -> np.ndarray:
        own = [self.names[f] for f in features if f in self.names]
        return self.weights[own].sum(axis=0)

    def sums(self, n: int, parts: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """(forward, start, backward, log of the sum over all segmentations) of n tokens; parts: (first, end, score by kind).

        forward[j, y]: all that ends at j with label y; start[i, y]: all up to i and the move to y; backward[i, y]: all
        after i, y being the label before.
        """
        size = len(self.moves)
        forward, start, backward = np.full((n + 1, size), -np.inf), np.full((n + 1, size), -np.inf), np.zeros((n + 1, size))
        ends, begins = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for i, j, v in parts:
            ends[j].append((i, v))
            begins[i].append((j, v))
        forward[0, 0] = 0
        start[0] = self.moves[0]
        for j in range(1, n + 1):
            forward[j, 0] = start[j - 1, 0]
            if ends[j]:
                forward[j, 1:] = _sum(np.array([start[i, 1:] + v for i, v in ends[j]]), 0)
                start[j] = _sum(forward[j][:, None] + self.moves, 0)
            else:
                start[j] = forward[j, 0] + self.moves[0]
        for i in range(n - 1, -1, -1):
            out = np.full(size, -np.inf)
            out[0] = backward[i + 1, 0]
            if begins[i]:
                out[1:] = _sum(np.array([v + backward[j, 1:] for j, v in begins[i]]), 0)
                backward[i] = _sum(self.moves + out, 1)
            else:
                backward[i] = self.moves[:, 0] + out[0]
        return forward, start, backward, float(backward[0, 0])

    def best(self, n: int, parts: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, int]]:
        """(first, end, label) of the entities of the best segmentation."""
        size = len(self.moves)
        value, back = np.full((n + 1, size), -np.inf), {}
        value[0, 0] = 0
        ends = [[] for _ in range(n + 1)]
        for i, j, v in parts:
            ends[j].append((i, v))
        for j in range(1, n + 1):
            for i, v in [(j - 1, None), *ends[j]]:
                come = value[i][:, None] + self.moves
                if v is None:
                    y = int(come[:, 0].argmax())
                    value[j, 0], back[j, 0] = come[y, 0], (i, y)
                else:
                    top = come.max(axis=0)[1:] + v
                    for k in np.flatnonzero(top > value[j, 1:]):
                        value[j, k + 1], back[j, k + 1] = top[k], (i, int(come[:, k + 1].argmax()))
        out, j, y = [], n, int(value[n].argmax())
        while j:
            i, before = back[j, y]
            if y:
                out.append((i, j, y))
            j, y = i, before
        return out[::-1]

    def entities(self, tokens: list[str], before: str) -> list[tuple[int, int, str, float]]:
        """(first token, end token, kind, probability) of the entities of the best segmentation."""
        parts = [(i, j, self.score(f)) for i, j, f in segments(tokens, before)]
        if not parts:
            return []
        chosen = self.best(len(tokens), parts)
        if not chosen:
            return []
        _, start, backward, total = self.sums(len(tokens), parts)
        at = {(i, j): v for i, j, v in parts}
        return [(i, j, KINDS[y - 1], float(np.exp(start[i, y] + at[i, j][y - 1] + backward[j, y] - total))) for i, j, y in chosen]


def gradient(field: Field, n: int, parts: list[tuple[int, int, list[int]]], gold: set[tuple[int, int, int]]) -> tuple[float, np.ndarray, list[tuple[list[int], np.ndarray]], np.ndarray]:
    """(log-likelihood of the gold segmentation, each part's probability by kind, (features, gold less expected by kind) of each part, gold less expected moves); parts hold feature numbers."""
    scored = [(i, j, field.weights[f].sum(axis=0)) for i, j, f in parts]
    forward, start, backward, total = field.sums(n, scored)
    moves = np.zeros_like(field.moves)
    out, chance = [], []
    leave = np.full((n + 1, len(moves)), -np.inf)
    leave[:n, 0] = backward[1:, 0]
    value = 0.0
    for (i, j, f), (_, _, v) in zip(parts, scored, strict=True):
        p = np.exp(start[i, 1:] + v + backward[j, 1:] - total)
        chance.append(p)
        step = -p
        leave[i, 1:] = np.logaddexp(leave[i, 1:], v + backward[j, 1:])
        for y in range(1, len(moves)):
            if (i, j, y) in gold:
                step[y - 1] += 1
                value += v[y - 1]
        out.append((f, step))
    with np.errstate(over="ignore"):
        for i in range(n):
            moves -= np.exp(forward[i][:, None] + field.moves + leave[i] - total)
    at, y = 0, 0
    begin = {i: (j, k) for i, j, k in gold}
    while at < n:
        at, now = begin.get(at, (at + 1, 0))
        moves[y, now] += 1
        value += field.moves[y, now]
        y = now
    return value - total, np.array(chance), out, moves


def changed(kind: str, text: str, rng: random.Random) -> str:
    """A form that people use for the same thing, but that the rules don't know."""
    if kind == "email":
        how = rng.randrange(4)
        return text.replace("@", (" @ ", "(@)", "[@]", "@")[how]) if how < 3 else text.replace(".", "[.]")
    if kind == "ip":
        return text.replace(".", rng.choice(("-", "[.]", " . ")))
    if kind == "card":
        digits, sep = re.sub("[ -]", "", text), rng.choice((".", "/", "_", "  "))
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    groups = re.findall("[0-9]+", text)
    if len(groups) > 2 and rng.random() < 0.5:
        groups = groups[1:]
    elif rng.random() < 0.3:
        groups[0] = "00" + groups[0]
    if len(groups) > 1 and rng.random() < 0.4:
        return f"({groups[0]}) " + rng.choice("-. ").join(groups[1:])
    return rng.choice("-. ").join(groups)


def made_up(rng: random.Random) -> list[tuple[str, str]]:
    """(kind, text) of known forms; kind "" for everyday numbers."""
    n = lambda a, b: str(rng.randrange(a, b))
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    card = digits(15)
    card += next(c for c in "0123456789" if luhn(card + c))
    phone = f"+{n(1, 99)}" + rng.choice((f" ({n(200, 999)}) {n(200, 999)}-{digits(4)}", f" {n(10, 99)} {digits(4)} {digits(4)}", f"-{n(200, 999)}-{n(200, 999)}-{digits(4)}", f" {n(100, 999)} {digits(3)} {digits(3)}"))
    everyday = rng.choice((n(1500, 2100), f"{n(1900, 2100)}-{n(1, 13)}-{n(1, 32)}", f"{n(1, 32)}/{n(1, 13)}/{n(1900, 2100)}", f"{n(1, 32)}.{n(1, 13)}.{n(1900, 2100)}", f"{n(1, 99)},{digits(3)}", f"{n(1, 99)},{digits(3)}.{digits(2)}",
                           f"{n(1, 99)} {digits(3)} {digits(3)}", f"{n(0, 99)}.{digits(4)}", f"{n(1000, 2000)}-{n(1000, 2000)}", f"{n(0, 24)}:{digits(2)}:{digits(2)}", digits(rng.randrange(4, 9)), f"{n(0, 30)}.{n(0, 30)}.{digits(4)}",
                           f"{digits(4)} {digits(4)}", " ".join(n(0, 100) for _ in range(rng.randrange(4, 10))), rng.choice((" ", ", ")).join(n(0, 2000) for _ in range(rng.randrange(4, 10))), f"{n(1, 99)}-{digits(4)}", f"978-{n(0, 10)}-{digits(2)}-{digits(6)}-{n(0, 10)}"))
    return [("email", f"{word()}{rng.choice(('', '.', '_', n(1, 99)))}{word()}@{word()}.{rng.choice(('com', 'org', 'net', 'de', 'co.uk', 'example.com'))}"), ("ip", ".".join(n(0, 256) for _ in range(4))),
            ("card", rng.choice(("", " ", "-")).join(card[i : i + 4] for i in range(0, 16, 4))), ("phone", phone), ("", everyday)]


def _example(text: str, before: str, gold: list[tuple[str, int, int]]) -> tuple[int, list[tuple[int, int, tuple[str, ...]]], set[tuple[int, int, int]]] | None:
    """(tokens, segments, gold segments as token places), or None if a gold span isn't among the segments."""
    tokens, starts, at = _TOKEN.findall(text), {}, 0
    for x, t in enumerate(tokens):
        starts[at] = x
        at += len(t)
    starts[at] = len(tokens)
    parts = [(i, j, tuple(f)) for i, j, f in segments(tokens, before)]
    places = {(i, j) for i, j, _ in parts}
    found = {(starts.get(a), starts.get(b), KINDS.index(k) + 1) for k, a, b in gold}
    return (len(tokens), parts, found) if all((i, j) in places for i, j, _ in found) else None


def _kin(features: tuple[str, ...]) -> tuple[str, ...]:
    """What changed copies of a form have in common: separators and, without an `@`, groups and about how many digits."""
    own = dict(f.split("=", 1) for f in features if "=" in f)
    return own["sep"], own.get("groups", "@"), str(sum(int(own.get("digits", 0)) >= x for x in (7, 9, 14)))


def examples(sample: list[tuple[str, str]], rng: random.Random, made: int = 60) -> Counter:
    """Training examples with their counts, from the sample's stretches (text, word before) and made-up ones."""
    out, plain, shapes = Counter(), [], set()

    def add(x) -> None:
        if x and x[1]:
            out[x[0], tuple(x[1]), frozenset(x[2])] += 1

    common = {w for w, n in Counter(before for _, before in sample).items() if n >= 5}
    rows = [(text, before if before in common else "", base_spans(text)) for text, before in sample]
    rows += [(text, "", base_spans(text) if kind else []) for _ in range(made) for kind, text in made_up(rng)]
    for text, before, gold in rows:
        if not gold:
            plain.append((text, before))
            continue
        add(_example(text, before, gold))
        for _ in range(3 if len(gold) == 1 else 0):
            kind, a, b = gold[0]
            new = changed(kind, text[a:b], rng)
            if base_spans(new) or not (x := _example(text[:a] + new + text[b:], before, [(kind, a, a + len(new))])):
                continue
            add(x)
            shapes |= {_kin(f) for i, j, f in x[1] if (i, j) in {g[:2] for g in x[2]}}
    for k, (text, before) in enumerate(plain):
        x = _example(text, before, [])
        if x and (k >= len(plain) - made or not any(_kin(f) in shapes for _, _, f in x[1])):
            add(x)
    return out


def learn(sample: list[tuple[str, str]], epochs: int = 7, rate: float = 0.2, decay: float = 3e-4, seed: int = 3) -> Field:
    """Weights by stochastic ascent (Adam) on the conditional log-likelihood of the examples, with a quadratic penalty. Each distinct example counts with the logarithm of its count."""
    rng = random.Random(seed)
    data = sorted(examples(sample, rng).items(), key=repr)
    names: dict[str, int] = {}
    for (_, parts, _), _ in data:
        for _, _, f in parts:
            for x in f:
                names.setdefault(x, len(names))
    coded = [(n, [(i, j, [names[x] for x in f]) for i, j, f in parts], set(gold), float(np.log1p(count))) for (n, parts, gold), count in data]
    size = len(KINDS) + 1
    field = Field(names, np.zeros((len(names), size - 1)), np.zeros((size, size)))
    mean, square, step = np.zeros((len(names) + size + 2, size)), np.zeros((len(names) + size + 2, size)), 0
    for _ in range(epochs):
        rng.shuffle(coded)
        for a in range(0, len(coded), 32):
            g, gm = np.zeros_like(field.weights), np.zeros_like(field.moves)
            batch = coded[a : a + 32]
            for n, parts, gold, weight in batch:
                _, _, steps, moves = gradient(field, n, parts, gold)
                gm += weight * moves
                for f, up in steps:
                    g[f] += weight * up
            step += 1
            for w, up, m, v in ((field.weights, g / len(batch), mean[: len(names), 1:], square[: len(names), 1:]), (field.moves, gm / len(batch), mean[len(names) : len(names) + size], square[len(names) : len(names) + size])):
                up = up - decay * w
                m += 0.1 * (up - m)
                v += 0.01 * (up * up - v)
                w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return field


_STRETCHES = pa.list_(pa.struct([("start", pa.int32()), ("text", pa.string()), ("before", pa.string())]))


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, near = [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            known = base_spans(text)
            base.append([{"kind": k, "start": a, "end": b} for k, a, b in known])
            near.append([{"start": a, "text": t, "before": w} for a, t, w in stretches(text)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(base, SPANS), pa.array(near, _STRETCHES)], ["id", "print", "base", "near"])


def added(field: Field, least: float, base: list[tuple[int, int]], near: list[tuple[int, str, str]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what the field adds to a text's known spans `base`; near: its stretches. Known spans are found by bisection."""
    base, found = merged(base), []
    ends = [b for _, b in base]
    for start, text, before in near:
        rest, at = [], start
        k = bisect_right(ends, start)
        while k < len(base) and base[k][0] < start + len(text):
            rest.append(text[at - start : max(at, base[k][0]) - start])
            at = base[k][1]
            k += 1
        if not any(map(_DIGIT.search, [*rest, text[at - start :]])):
            continue  # all of it is known
        tokens = _TOKEN.findall(text)
        places = list(accumulate(map(len, tokens), initial=start))
        for i, j, kind, p in field.entities(tokens, before):
            k = bisect_right(ends, places[i])
            if p >= least and not (k < len(base) and base[k][0] < places[j]):
                found.append((kind, places[i], places[j]))
    return found


def _decode(field: Field, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = []
            for base, near in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found = added(field, least, [(x["start"], x["end"]) for x in base], [(s["start"], s["text"], s["before"]) for s in near])
                more.append([{"kind": kind, "start": a, "end": b} for kind, a, b in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(more, SPANS)], ["id", "print", "base", "more"])

    return run


def scan(docs: DataFrame, sample: int = 3000, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print, base, spans) for each row: the text's hash, spans of known forms, and all spans with those the model adds, in order.

    sample: stretches that the model is learnt from, chosen by hash. least: the probability that an added span needs.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("print"))
    kind = docs.schema["id"].dataType.simpleString()
    found = keep(docs.mapInArrow(_find, f"id {kind}, print long, base array<{SPAN}>, near array<struct<start:int,text:string,before:string>>"), "pii-stretches")
    one = found.select("print", F.explode("near").alias("s")).select("print", "s.start", "s.text", "s.before")
    short = one.where(F.length("text") <= 200)  # longer ones teach nothing more
    rows = some_rows(short, sample, "print", "start", "text").collect()
    field = learn([(r["text"], r["before"]) for r in rows])
    decoded = found.mapInArrow(_decode(field, least), f"id {kind}, print long, base array<{SPAN}>, more array<{SPAN}>")
    out = decoded.select(F.col("id").alias(id_col), "print", "base", F.concat("base", "more").alias("all"))
    return out.select(id_col, "print", in_order("base", KINDS).alias("base"), in_order("all", KINDS).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    counts = [count("base", k).alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[PII]", id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """`docs` with each span replaced by `mark`; all rows and columns stay."""
    return replace_spans(docs, scan(docs, id_col=id_col, text_col=text_col, **kwargs), mark, id_col, text_col)
