"""N-gram Jaccard join by PartEnum signatures, with connected components.

A document's set holds its distinct word shingles. Two documents link when the Jaccard similarity of their sets is at
least `percent` / 100.

PartEnum. Sizes fall into bands. Sets that link differ in at most k elements, k known from the band's largest size.
The domain of hashes is cut into n1 partitions, so many that two such sets differ in at most k2 elements in some
partition; each partition is cut into n2 parts, so n2 - k2 of its parts agree in full. A set therefore has
n1 * C(n2, k2) signatures for a band, one for each partition and choice of parts, and linked sets share one. A set
close enough to the next band's sizes also signs for that band. Nothing is sampled or capped.

Choices of parts that hold no element, or only elements that many sets hold (a passage that goes round), would be
shared by unrelated sets. There are `slack` partitions more than needed, so linked sets agree in more than `slack`
partitions; a set in which at most `slack` partitions have such a hollow choice leaves its hollow ones out, any other
set signs them too. Equal choices are hollow alike, so linked sets still share a signature, whichever elements count as
frequent: those come from a bounded sample of classes and change the work, never the result.

Equal sets form a class and are joined once. Signatures are made and met in `passes` rounds, each with its own share of
the partitions, so that only that share is on disk at a time. Most signatures belong to one class alone and end there; a
bucket is what several classes share, and buckets of the same members count once.

In a bucket, classes first meet a few leaders; classes that are then in one component need no further comparison; all
others that share a bucket meet. Each class has a parity sketch, whose length grows with its size: each bit is the
parity of the elements that fall on it. Sketches differ in no more bits than sets in elements, so a pair whose sketches
differ in too many can't link. In the last round the sketches, folded to a length that the bucket's band sets, meet in
groups of bounded size. A pair that may link shares many buckets, and a family just below the limit has as many such
pairs as the square of its size; so a group gives only a forest of them, fewer rows than it has members. The components
of the forests are neighbourhoods: each pair that may link lies in one. There the sets themselves meet, each once
however many buckets it is in, and a group again gives a forest, of true links. No bucket holds more than one signature
of a set, so of a crowd's rows it has a share of one in as many as a set has signatures.

Defined cases: null and blank text has an empty set, 0 shingles, and links with nothing; with fewer words than
`words` the whole sequence is one shingle; repeated rows each get a row; a null id belongs to the class of its text but
carries no link. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioworks.llm.common import connected_components, free, keep, new_names, some_rows
from folioworks.llm.wordhash import mix, shingles, slices, words as words_of

#: A band reaches from its least size l to l * 4 // 3.
BAND = (4, 3)
#: Ids up to this number go to each task as a broadcast (16 MB); more are joined with a shuffle.
BROADCAST_IDS = 1 << 20
#: Classes, by hash, from which frequent shingles are learnt, in how many of them a frequent one occurs, and the share
#: of a usual set's shingles that are not frequent (it sets the slack).
SAMPLE_CLASSES, FREQUENT, RARE = 4096, 4, 0.85
#: Frequent shingles that tasks are told of, 8 MB; leaving some out costs work only.
MOST_FREQUENT = 1 << 20
#: 64-bit words of the smallest parity sketch.
LEAST = 8
#: Members of a bucket that meet in one group, about; a larger bucket is dealt over several groups.
BLOCK = 4096
#: Elements of the members of such a block, about, where whole sets meet (16 MB).
ELEMENTS = 1 << 21
#: A signature's low bits hold its band.
BAND_BITS = 7


def bands(most: int) -> np.ndarray:
    """Least sizes of the bands, up to past `most`."""
    out = [1]
    while out[-1] <= most:
        out.append(max(out[-1], out[-1] * BAND[0] // BAND[1]) + 1)
    return np.array(out + [out[-1] * 2], np.int64)


def differences(size: np.ndarray, percent: int) -> np.ndarray:
    """Most elements in which two sets of at most `size` elements differ when they link."""
    return 2 * size * (100 - percent) // (100 + percent)


def plan(low: np.ndarray, high: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n1, n2, k2, slack) for bands of sizes low to high; n1 is 0 where linked sets are equal."""
    k = differences(high, percent)
    small = k <= 40
    n2, k2 = np.where(small, 5, 3), np.where(small, 2, 1)
    n1 = np.where(k > 0, k // (k2 + 1) + 1, 0)
    some = np.maximum(n1, 1)
    empty = some * np.where(small, 10, 3) * np.exp(-RARE * low * (n2 - k2) / n2 / some)
    slack = np.where((n1 >= 8) & (empty > 0.01), np.ceil(empty + 3 * np.sqrt(empty)), 0).astype(np.int64)
    return n1 + slack, n2, k2, slack


def signatures(s: np.ndarray, d: np.ndarray, n_docs: int, percent: int, frequent: np.ndarray | None = None, passes: int = 1, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(signature, document) for the sets given as (element, document) sorted by document; frequent: sorted elements.

    Those of partitions number turn, turn + passes, turn + 2 passes and so on; a signature's low bits are its band.
    Bands in which linked sets can't differ have no signatures: their sets link when they are equal.
    """
    size = np.bincount(d, minlength=n_docs)
    low = bands(int(size.max(initial=1)))
    n1_of, n2_of, k2_of, slack_of = (np.append(x, 0) for x in plan(low[:-1], low[1:] - 1, percent))
    own = np.searchsorted(low, size, "right") - 1
    rare = np.ones(len(s), bool)
    if frequent is not None and len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)] != s
    all_sigs, all_docs = [], []
    for step in (0, 1):
        band = own + step
        takes = (size > 0) & (n1_of[band] > 0)
        if step:
            takes &= 100 * size >= percent * low[band]
        for parts, differ in ((5, 2), (3, 1)):
            n1 = np.where(takes & (n2_of[band] == parts), n1_of[band], 0)
            if not n1.any():
                continue
            base = np.cumsum(n1) - n1
            use = n1[d] > 0
            e, w = s[use], d[use]
            # The seed belongs to the band: both sets of a pair are cut alike.
            h = mix(e ^ mix(band[w].astype(np.uint64) + np.uint64(1)))
            at = parts * base[w] + ((h >> np.uint64(11)) % (parts * n1[w]).astype(np.uint64)).astype(np.int64)
            v = mix(h + np.uint64(0x51ED270B))
            total = parts * int(n1.sum())
            halves = [np.bincount(at, weights=(v >> np.uint64(x) & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=total) for x in (0, 32)]
            sums = (halves[0].astype(np.uint64) + mix(halves[1].astype(np.uint64))).reshape(-1, parts)
            held = np.bincount(at[rare[use]], minlength=total).reshape(-1, parts)
            doc = np.repeat(np.arange(n_docs), n1)
            f = np.arange(len(doc)) - base[doc]
            tag = mix(band[doc].astype(np.uint64) * np.uint64(1 << 32) + f.astype(np.uint64) * np.uint64(4))
            chosen = list(combinations(range(parts), parts - differ))
            full = np.column_stack([held[:, c].sum(axis=1) > 0 for c in map(list, chosen)])
            holes = np.bincount(doc[~full.all(axis=1)], minlength=n_docs)
            sign_holes = (holes > slack_of[band])[doc]
            now = f % passes == turn
            tag, sums, doc, full, sign_holes = tag[now], sums[now], doc[now], full[now], sign_holes[now]
            mark = band[doc].astype(np.uint64)
            for x, c in enumerate(chosen):
                g = tag + np.uint64(x + 1)
                for part in c:
                    g = mix(g * np.uint64(3) + sums[:, part])
                keep_ = full[:, x] | sign_holes
                all_sigs.append((g >> np.uint64(BAND_BITS) << np.uint64(BAND_BITS) | mark)[keep_])
                all_docs.append(doc[keep_])
    if not all_sigs:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(all_sigs), np.concatenate(all_docs)


def wide_sketches(s: np.ndarray, d: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of all documents in a row, words of each): parity sketches of four bits or more for each element and LEAST words or more, a power of two.

    A sketch of twice the length folds into one of the length: its halves are added bit by bit.
    """
    size = np.bincount(d, minlength=n_docs)
    bits = np.where(size > 0, np.maximum(64 * LEAST, 4 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)), 0)
    base = np.cumsum(bits) - bits
    at = base[d] + ((mix(s ^ np.uint64(0x7FB5D329728EA185)) >> np.uint64(13)) & (bits[d] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(bits.sum())) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64), bits // 64


def _lists(values: np.ndarray, count: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(count) + 1, np.int32)
    np.cumsum(count, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _measure(size: int):
    """Rows of (id, size, two set fingerprints, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                n = j - i
                h, doc, _, _ = words_of(data, offsets)
                s, d = shingles(h, doc, n, size)
                count = np.bincount(d, minlength=n)
                prints = [pa.array(c.view(np.int64)) for c in _prints(s, count)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(count.astype(np.int64)), *prints, _lists(*wide_sketches(s, d, n))], ["id", "n", "f1", "f2", "wide"])

    return run


def _prints(s: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Two fingerprints of each set."""
    out, some = [], np.flatnonzero(count)
    for seed in (1, 2):
        v, total = mix(s * np.uint64(2 * seed + 1) + np.uint64(seed)), np.zeros(len(count), np.uint64)
        if len(some):
            total[some] = np.add.reduceat(v, (np.cumsum(count) - count)[some])
        out.append(mix(total + count.astype(np.uint64)))
    return out


def _sign(size: int, percent: int, frequent, passes: int, turn: int):
    """Rows of (signature, set fingerprint). In a task only the first of equal sets signs. frequent: a broadcast array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(0)):
                n = j - i
                h, doc, _, _ = words_of(data, offsets)
                s, d = shingles(h, doc, n, size)
                count = np.bincount(d, minlength=n)
                print_ = _prints(s, count)[0]
                fresh = np.zeros(n, bool)
                for x in np.flatnonzero(count):
                    key = int(print_[x])
                    if key not in seen:
                        seen.add(key)
                        fresh[x] = True
                use = fresh[d]
                sigs, sd = signatures(s[use], d[use], n, percent, frequent.value, passes, turn)
                yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(print_[sd].view(np.int64))], ["sig", "f1"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a stream sorted by (sig, f1), without repeats, the rows whose sig occurs with several f1. One row is held back between batches."""
    sig, f1, used = np.empty(0, np.int64), np.empty(0, np.int64), False  # the last row, and whether the one before it has its sig

    def rows(sig: np.ndarray, f1: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(f1)], ["sig", "f1"])

    for batch in batches:
        sig, f1 = (np.concatenate([x, np.asarray(batch.column(i))]) for i, x in ((0, sig), (1, f1)))
        if not len(sig):
            continue
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (f1[1:] != f1[:-1])
        sig, f1 = sig[new], f1[new]
        like = sig[1:] == sig[:-1]
        before = np.append(used, like)
        several = before.copy()
        several[:-1] |= like
        use = several[:-1]
        yield rows(sig[:-1][use], f1[:-1][use])
        used, sig, f1 = bool(before[-1]), sig[-1:], f1[-1:]
    if used:
        yield rows(sig, f1)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(1)):
                h, doc, _, _ = words_of(data, offsets)
                s, d = shingles(h, doc, j - i, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _lists(s, np.bincount(d, minlength=j - i))], ["id", "set"])

    return run


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of `docs` whose id is in `ids` (distinct): the ids go to the tasks while they are few, else both are shuffled."""
    ids = ids.select(F.col("id").alias("id_"))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, F.col("id") == F.col("id_"), "left_semi")


def _apart(x: str, y: str) -> F.Column:
    """Bits in which two wide sketches differ, the longer one folded."""
    fold = lambda v, w: F.when(
        F.size(v) > F.size(w), F.zip_with(F.slice(v, F.lit(1), F.size(w)), F.slice(v, F.size(w) + 1, F.size(w)), lambda a, b: a.bitwiseXOR(b))).otherwise(F.col(v))
    return F.aggregate(F.zip_with(fold(x, y), fold(y, x), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, v: n + v)


def _verify(pairs: DataFrame, measured: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sets link: wide sketches rule out nearly all others, then the sets themselves decide. A kept table."""
    w = measured.select("id", "n", "wide").where("n > 0")
    side = lambda k: w.select(F.col("id").alias(k), F.col("n").alias(f"{k}n"), F.col("wide").alias(f"{k}w"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    close = 100 * F.least("an", "bn") >= percent * F.greatest("an", "bn")
    near = both.where(close).where((100 + percent) * _apart("aw", "bw") <= (100 - percent) * (F.col("an") + F.col("bn")))
    near = keep(near.select("a", "b"), "jaccard-near")
    ids = keep(near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), "jaccard-ids")
    kind = f"id {docs.schema['id'].dataType.simpleString()}, set array<long>"
    sets = keep(_only(docs, ids).mapInArrow(_sets(words), kind), "jaccard-sets")
    a = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    linked = near.join(b, "b").join(a, "a").where(100 * common >= percent * (F.size("sa") + F.size("sb") - common))
    out = keep(linked.select("a", "b"), "jaccard-links")
    free(near, ids, sets)
    return out


def _folded(most: int, percent: int) -> F.Column:
    """The sketch `wide` folded to the length that `band` sets; each set that signs for the band has as many words."""
    least = percent * bands(most)[: 1 << BAND_BITS] // 100
    count = np.maximum(LEAST, 1 << np.floor(np.log2(np.maximum(4 * least // 64, 1))).astype(np.int64))
    own = F.element_at(F.array(*(F.lit(int(x)) for x in count)), F.col("band") + 1)
    turns = F.sequence(F.lit(0), (F.size("wide") / own).cast("int") - 1)
    word = lambda i: F.aggregate(turns, F.lit(0).cast("long"), lambda sum_, k: sum_.bitwiseXOR(F.get("wide", i + k * own)))
    return F.transform(F.sequence(F.lit(0), own - 1), word)


def _dealt(now: DataFrame, size: F.Column) -> DataFrame:
    """`now` (key, band, id, label) with the groups (i, j) in which a member meets others, its side there, and whether only the sides meet (two).

    A block has at most BLOCK members, and fewer where they are of such a `size` that they would hold more than ELEMENTS.
    A bucket of one block is one group. In a larger one the members of the commonest label and the others
    (strangers) lie in blocks; each block of strangers meets each block. So a crowd that is linked already doesn't
    meet itself, and no group holds more than about two blocks.
    """
    often = now.groupBy("key", "band", "label").agg(F.count("*").alias("count"), F.max(size).alias("size"))
    often = often.groupBy("key", "band").agg(F.sum("count").alias("all"), F.max(F.struct("count", "label")).alias("top"), F.max("size").alias("size"))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(ELEMENTS) / F.col("size"))))
    often = often.select("key", "band", "all", F.col("top.count").alias("crowd"), F.col("top.label").alias("common"), block.alias("block"))
    now = now.join(often, ["key", "band"])
    blocks = lambda n: F.ceil(n / F.col("block")).cast("int")
    crowd, strangers = blocks(F.col("crowd")), blocks(F.col("all") - F.col("crowd"))
    stranger = F.col("label") != F.col("common")
    mine = F.pmod(F.xxhash64("id"), F.when(stranger, strangers).otherwise(crowd)).cast("int")
    group = lambda i, j, side, two: F.struct(i.alias("i"), j.alias("j"), side.cast("int").alias("side"), two.alias("two"))
    up_to = lambda n: F.sequence(F.lit(0), n - 1)
    whole = F.array(group(F.lit(0), F.lit(0), F.lit(0), F.lit(False)))
    met = F.transform(up_to(crowd), lambda c: group(mine, c, F.lit(0), F.lit(True)))
    among = F.transform(up_to(strangers), lambda t: group(F.least(mine, t), crowd + F.greatest(mine, t), (mine > t).cast("int"), mine != t))
    other = F.transform(up_to(strangers), lambda t: group(t, mine, F.lit(1), F.lit(True)))
    groups = F.when(F.col("all") <= F.col("block"), whole).when(stranger, F.concat(met, among)).otherwise(other)
    return now.select("key", "band", "id", "label", F.inline(groups))


#: What a group of _dealt is.
GROUP = ["key", "band", "i", "j"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups of a stream sorted by GROUP."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        last = tuple(t.column(c)[-1].as_py() for c in GROUP)
        same = np.all([np.asarray(t.column(c)) == x for c, x in zip(GROUP, last, strict=True)], axis=0)
        a = int(np.flatnonzero(same)[0])  # sorted: the last group's rows stand together
        if a:
            yield t.slice(0, a)
        held = t.slice(a)
    if held is not None:
        yield held


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, length of each list)."""
    lists = lists.combine_chunks()
    return np.asarray(lists.flatten()).view(np.uint64), np.asarray(lists.value_lengths()).astype(np.int64)


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (a, b) that join what `root` (each row's least joined row) has apart, a forest; `root` follows in place."""
    used = [np.empty((2, 0), np.int64)]
    while len(a):
        lo, hi = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = np.flatnonzero(lo != hi)
        a, b, lo, hi = (x[apart] for x in (a, b, lo, hi))
        hi, one = np.unique(hi, return_index=True)  # each root goes below one smaller root, so no ring arises
        root[hi] = lo[one]
        used.append(np.stack([a[one], b[one]]))
        while np.any((up := root[root]) != root):
            root[:] = up
    return tuple(np.concatenate(used, axis=1))


def _close(t: pa.Table, percent: int, n: np.ndarray, word: np.ndarray, length: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of rows of whole groups that may link: labels differ, sizes and sketches (word, length) are close.

    They come in turns; those that the caller has joined in `root` by then are left out.
    """
    at = np.arange(t.num_rows)
    new = np.ones(t.num_rows, bool)
    new[1:] = np.any([(x := np.asarray(t.column(c)))[1:] != x[:-1] for c in GROUP], axis=0)
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(at))[np.cumsum(new) - 1]
    label = np.asarray(t.column("label").combine_chunks().dictionary_encode().indices)
    side, two = (np.asarray(t.column(c)) for c in ("side", "two"))
    start = np.cumsum(length) - length

    def folded(own: np.ndarray, many: int) -> np.ndarray:
        out = np.zeros((len(own), many), np.uint64)
        for long in np.unique(length[own]):
            some = np.flatnonzero(length[own] == long)
            out[some] = np.bitwise_xor.reduce(word[start[own[some]][:, None] + np.arange(long)].reshape(len(some), -1, many), axis=1)
        return out

    short = folded(at, LEAST)
    near = lambda p, q, a, b: (100 + percent) * np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64) <= (100 - percent) * (n[a] + n[b])
    step = 1
    while len(at := at[at + step < end[at]]):
        b = at + step
        use = (root[at] != root[b]) & (label[at] != label[b]) & (100 * np.minimum(n[at], n[b]) >= percent * np.maximum(n[at], n[b])) & (~two[at] | (side[at] != side[b]))
        a, b = at[use], b[use]
        use = near(short[a], short[b], a, b)
        a, b = a[use], b[use]
        least = np.minimum(length[a], length[b])
        for many in np.unique(least):
            if many > LEAST:
                for own in np.array_split(some := np.flatnonzero(least == many), len(some) * many // (1 << 20) + 1):
                    far = ~near(folded(a[own], many), folded(b[own], many), a[own], b[own])
                    a[own[far]] = -1
        yield a[a >= 0], b[a >= 0]
        step += 1


def _forest(t: pa.Table, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = np.concatenate([np.empty((2, 0), np.int64), *pairs], axis=1)
    ids = t.column("id").combine_chunks()
    return pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], ["x", "y"])


def _meet(percent: int):
    """A forest (x, y) of the pairs that may link within each group of a stream sorted by GROUP; members of one tree need no further look at each other here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            root = np.arange(t.num_rows)
            yield _forest(t, [_joined(root, a, b) for a, b in _close(t, percent, np.asarray(t.column("n")), *_flat(t.column("w")), root)])

    return run


def _link(percent: int):
    """A forest (x, y) of the links within each group of a stream sorted by GROUP: it joins the labels that the group's links join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches):
            s, n = _flat(t.column("set"))
            start = np.cumsum(n) - n
            element = np.unique(s, return_inverse=True)[1]
            many = int(element.max(initial=0)) + 1

            def spread(own: np.ndarray) -> np.ndarray:
                """The elements of rows `own`, each with its place there."""
                count = n[own]
                return np.repeat(np.arange(len(own)), count) * many + element[np.repeat(start[own] - np.cumsum(count) + count, count) + np.arange(count.sum())]

            def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                both = np.sort(np.concatenate([spread(a), spread(b)]))
                common = np.bincount(both[1:][both[1:] == both[:-1]] // many, minlength=len(a))
                return 100 * common >= percent * (n[a] + n[b] - common)

            root = np.arange(t.num_rows)
            found = []
            for a, b in _close(t, percent, n, *wide_sketches(s, np.repeat(root, n), len(n)), root):
                for own in np.array_split(np.arange(len(a)), int((n[a] + n[b]).sum()) >> 22 or 1) if len(a) else []:
                    ok = own[linked(a[own], b[own])]
                    found.append(_joined(root, a[ok], b[ok]))
            yield _forest(t, found)

    return run


def _last_links(now: DataFrame, measured: DataFrame, docs: DataFrame, words: int, percent: int, id_type: str) -> DataFrame:
    """Links (a, b) between the labels of `now` (key, band, id, label) that join all that its buckets' links join. A kept table."""
    most = measured.agg(F.max("n")).first()[0] or 1
    sketched = measured.where("n > 0").select("id", "n", "wide").join(now.select("id", "band").distinct(), "id")
    sketched = keep(sketched.select("id", "band", "n", _folded(most, percent).alias("w")).dropDuplicates(["id", "band"]), "jaccard-sketched")
    in_groups = lambda rows: rows.repartition(*GROUP).sortWithinPartitions(*GROUP)
    met = in_groups(_dealt(now, F.lit(1)).join(sketched, ["id", "band"]).select(*GROUP, "side", "two", "id", "label", "n", "w"))
    near = met.mapInArrow(_meet(percent), f"x {id_type}, y {id_type}").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    near = keep(near.distinct(), "jaccard-near")
    around = connected_components(near)
    kind = f"id {docs.schema['id'].dataType.simpleString()}, set array<long>"
    sets = keep(_only(docs, around.select(F.col("node").alias("id"))).mapInArrow(_sets(words), kind).distinct(), "jaccard-sets")
    sizes = sets.groupBy("id").agg(F.max(F.size("set")).alias("n"))
    now = around.select(F.col("component").alias("key"), F.lit(0).alias("band"), F.col("node").alias("id")).join(now.select("id", "label").distinct(), "id").join(sizes, "id")
    whole = in_groups(_dealt(now, F.col("n")).join(sets, "id").select(*GROUP, "side", "two", "id", "label", "set"))
    out = keep(whole.mapInArrow(_link(percent), f"a {id_type}, b {id_type}"), "jaccard-links")
    free(sketched, near, around, sets)
    return out


def _buckets(docs: DataFrame, classes: DataFrame, words: int, percent: int, passes: int, id_type: str) -> DataFrame:
    """(key, band, id): the members of each bucket, pass by pass; buckets of a band with the same members have one key. A kept table."""
    sample = keep(some_rows(classes, SAMPLE_CLASSES, "rep").select(F.col("rep").alias("id")), "jaccard-sample")
    seen = _only(docs, sample).dropDuplicates(["id"]).mapInArrow(_sets(words), f"id {id_type}, set array<long>")
    often = seen.select(F.explode("set").alias("x")).groupBy("x").agg(F.count("*").alias("c")).where(F.col("c") >= FREQUENT).select("x").limit(MOST_FREQUENT).toPandas()
    frequent = docs.sparkSession.sparkContext.broadcast(np.sort(often["x"].to_numpy(np.int64).view(np.uint64)))
    free(sample)
    parts, band = [], F.col("sig").bitwiseAND((1 << BAND_BITS) - 1)
    for turn in range(passes):
        sigs = docs.select("text").mapInArrow(_sign(words, percent, frequent, passes, turn), "sig long, f1 long")
        shared = sigs.repartition("sig").sortWithinPartitions("sig", "f1").mapInArrow(_shared, "sig long, f1 long")
        content = F.bit_xor(F.xxhash64("f1")).over(Window.partitionBy("sig"))
        part = shared.select(content.alias("key"), band.cast("int").alias("band"), "f1").distinct()
        parts.append(keep(part, "jaccard-shared"))
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    out = every.join(classes.select("f1", "rep"), "f1").select("key", "band", F.col("rep").alias("id")).distinct()
    out = keep(out, "jaccard-buckets")
    free(*parts)
    return out


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, leaders: int = 2, passes: int = 4,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row of `docs`.

    leaders: rounds in which a bucket's members meet one leader; what then still lies apart is compared in full.
    passes: shares in which the signatures are made; more passes need less disk and more work.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = docs.schema["id"].dataType.simpleString()
    measured = keep(docs.mapInArrow(_measure(words), f"id {id_type}, n long, f1 long, f2 long, wide array<long>"), "jaccard-measured")

    of_class = ["f1", "f2", "n"]
    classes = measured.where("n > 0").groupBy(of_class).agg(F.min("id").alias("rep"))
    classes = keep(classes.where("rep is not null"), "jaccard-classes")
    members = _buckets(docs, classes, words, percent, passes, id_type)
    bucket = Window.partitionBy("key", "band")

    done, links, parts = None, None, None
    for turn in range(leaders + 1):
        if turn:
            free(parts)
            parts = connected_components(links)
            now = members.join(parts.withColumnRenamed("node", "id"), "id", "left").select("key", "band", "id", F.coalesce("component", "id").alias("label"))
            # Buckets within one component are done with, and so are those of two members: one has led the other.
            now = now.withColumn("lo", F.min("label").over(bucket)).withColumn("hi", F.max("label").over(bucket)).withColumn("all", F.count("*").over(bucket))
            now = now.where("lo != hi and all > 2")
            was, members = members, keep(now.select("key", "band", "id"), "jaccard-apart")
            free(was)
            now = members.join(parts.withColumnRenamed("node", "id"), "id", "left").select("key", "band", "id", F.coalesce("component", "id").alias("label"))
        else:
            now = members.withColumn("label", F.col("id"))
        if turn == leaders:
            found = _last_links(now, measured, docs, words, percent, id_type)
        else:
            first = F.col("id") if not turn else F.xxhash64(F.lit(turn), "id")
            lead = F.min(F.struct(first.alias("x"), "id", "label")).over(bucket)
            met = now.withColumn("lead", lead).where("label != lead.label").select(F.col("lead.id").alias("x"), F.col("id").alias("y"))
            pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
            if done is not None:
                pairs = pairs.join(done, ["a", "b"], "left_anti")
            pairs = keep(pairs, "jaccard-pairs")
            found = _verify(pairs, measured, docs, words, percent)
            done = pairs if done is None else done.union(pairs)
        links = found if links is None else links.union(found)
    free(parts, members)
    parts = connected_components(links)
    named = classes.join(parts, F.col("rep") == F.col("node"), "left").select(*of_class, F.coalesce("component", "rep").alias("component"))
    out = measured.select("id", "n", "f1", "f2").join(named, of_class, "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """`docs` with one row of each component, that of the smallest id (null last); all columns stay.

    Rows are told apart by a hash of id and text, so repeated and null ids are compared as any others are, and of rows
    that are equal in both one stays. Rows without shingles all stay.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    parts = jaccard_components(docs.select(key.alias("_key"), F.col(text_col).alias("_text")), id_col="_key", text_col="_text", **kwargs)
    parts = parts.where("n_shingles > 0").groupBy("_key").agg(F.min("component_id").alias("component"), F.count("*").alias("rows"))
    parts = keep(parts, "jaccard-rows")
    many = parts.where(F.col("_key") != F.col("component"))
    many = many.select("_key", "component").union(many.select(F.col("component").alias("_key"), "component").distinct())
    named = docs.select(key.alias("_key"), F.col(id_col).alias("_id")).distinct().join(many, "_key")
    named = keep(named.withColumn("place", F.struct(F.col("_id").isNull(), "_id", "_key")), "jaccard-named")
    gone, more = new_names(docs, "_drop", "_again")
    first = named.groupBy("component").agg(F.min("place")["_key"].alias(gone))
    drop = named.select(F.col("_key").alias(gone)).join(first.select(gone), gone, "left_anti").distinct()
    out = docs.join(keep(drop, "jaccard-drop"), key == F.col(gone), "left_anti")
    again = keep(parts.where("rows > 1").select(F.col("_key").alias(more)), "jaccard-again")
    free(parts, named)
    if again.isEmpty():
        return out
    equal = out.join(again, key == F.col(more), "left_semi").withColumn(more, key).dropDuplicates([more]).drop(more)
    return out.join(again, key == F.col(more), "left_anti").union(equal)
