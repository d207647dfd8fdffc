"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of the whole text (how letters, capitals, digits and marks are shared out, how words repeat, how lines are
built) are standardised and mapped to cosines of random directions, which approximates a Gaussian kernel. Ridge
weights come from normal equations: each task adds up its rows' X'X and X'y, the sums are added by matrix row in
Spark, and one (features + 1) square system is solved. A part of the labelled rows that the fit doesn't see, counted
in bins of the raw score, gives the isotonic curve from raw scores to the chance of label 1.

Only the text counts: language, source, id and labels are no inputs of a score.

Defined cases: null text is empty and is scored as such; rows of `labels` with a null id or label are ignored, repeated
ones count as often as they occur; without labelled rows every score is 0.5; with labels of one kind all scores are
that kind's share. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioworks.llm.common import free, keep
from folioworks.llm.wordhash import slices, words

STATISTICS = ("letters", "capitals", "digits", "spaces", "marks", "symbols", "wide", "lines", "word_length", "word_spread", "distinct", "pair_distinct",
              "repeats", "top_word", "shouted", "marked_words", "lone_marks", "size", "line_words", "exclaim")
_CLASS = np.full(256, 5)  # symbols
for _chars, _k in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t\v\f\r\n", 3), (".,;:'\"!?()-", 4)):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _k
_CLASS[128:] = 6


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text."""
    out = [np.zeros((0, len(STATISTICS)))]
    for i, j, data, offsets in slices(texts):
        n, size = j - i, np.maximum(np.diff(offsets), 1).astype(float)
        kind = _CLASS[data]
        doc_of = np.repeat(np.arange(n), np.diff(offsets))
        per = np.bincount(doc_of * 7 + kind, minlength=7 * n).reshape(n, 7) / size[:, None]
        count_of = lambda mask: np.bincount(doc_of[mask], minlength=n).astype(float)
        newline, exclaim = count_of(data == 10), count_of((data == 33) | (data == 63))
        h, doc, start, end = words(data, offsets)
        n_words = np.bincount(doc, minlength=n).astype(float)
        some = np.maximum(n_words, 1)
        length = (end - start).astype(float)
        mean = np.bincount(doc, weights=length, minlength=n) / some
        spread = np.sqrt(np.maximum(np.bincount(doc, weights=length**2, minlength=n) / some - mean**2, 0))
        order = np.lexsort((h, doc))
        sd, sh = doc[order], h[order]
        new = np.ones(len(sd), bool)
        new[1:] = (sd[1:] != sd[:-1]) | (sh[1:] != sh[:-1])
        first = np.flatnonzero(new)
        run = np.diff(np.append(first, len(sd)))
        top = np.zeros(n)
        np.maximum.at(top, sd[first], run)
        same = doc[1:] == doc[:-1]
        repeat = np.bincount(doc[1:][same & (h[1:] == h[:-1])], minlength=n)
        pair = (h[1:] * np.uint64(31) + h[:-1])[same]
        pd_ = doc[1:][same]
        order = np.lexsort((pair, pd_))
        pp, dd = pair[order], pd_[order]
        new_pair = np.ones(len(pp), bool)
        new_pair[1:] = (pp[1:] != pp[:-1]) | (dd[1:] != dd[:-1])
        pairs = np.maximum(np.bincount(pd_, minlength=n), 1)
        caps = np.concatenate([[0], np.cumsum(kind == 1)])
        low = np.concatenate([[0], np.cumsum(kind == 0)])
        marks = np.concatenate([[0], np.cumsum((kind == 4) | (kind == 5))])
        inside = lambda c: c[end] - c[start]
        shouted = np.bincount(doc, weights=(inside(caps) > 1) & (inside(low) == 0), minlength=n)
        marked = np.bincount(doc, weights=inside(marks) >= 2, minlength=n)
        lone = np.bincount(doc, weights=inside(marks) == end - start, minlength=n)
        out.append(np.column_stack([
            per[:, 0], per[:, 1], per[:, 2], per[:, 3], per[:, 4], per[:, 5], per[:, 6], newline / size, np.log1p(mean), np.log1p(spread),
            np.bincount(sd[new], minlength=n) / some, np.bincount(dd[new_pair], minlength=n) / pairs, repeat / some, top / some,
            shouted / some, marked / some, lone / some, np.log1p(n_words), np.log1p(n_words / (newline + 1)), exclaim / size,
        ]))
    return np.concatenate(out)


class Fourier:
    """Cosines of random directions: exp(-|x - y|^2 / (2 width^2)) is about the dot product of two rows."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, n: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.centre, self.scale = centre, scale
        self.w, self.b = rng.normal(0, 1 / width, (len(centre), n)), rng.uniform(0, 2 * np.pi, n)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.column_stack([np.cos(x @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones(len(x))])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(len(column), -1) if len(column) else np.zeros((0, len(STATISTICS)))


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising curve nearest to (x, y) by weighted squares: pool adjacent violators, a knot at each pool's mean x."""
    pools: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


class Model:
    def __init__(self, fourier: Fourier | None, weights: np.ndarray | None, knots: tuple[np.ndarray, np.ndarray]):
        self.fourier, self.weights, self.knots = fourier, weights, knots

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fourier is None:
            return np.full(len(x), self.knots[1][0])
        raw = self.raw(x)
        # A little of the raw score keeps the order within the curve's flat parts.
        return np.clip(0.998 * np.interp(raw, *self.knots) + 0.002 * np.clip(raw, 0, 1), 0, 1)


def _sums(fourier: Fourier):
    """A task's X'X and X'y, by matrix row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            z = fourier(_matrix(batch.column(0)))
            part = z.T @ np.column_stack([z, np.asarray(batch.column(1), float)])
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "row"])

    return run


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"i": rows["i"].iloc[:1], "row": [np.sum(rows["row"].tolist(), axis=0)]})


def fit(labelled: DataFrame, features: int = 256, ridge: float = 1e-3, width: float = 3.0, bins: int = 1000, seed: int = 11) -> Model:
    """A model from rows (x, y, fits): those with `fits` give the weights, the others the isotonic curve.

    features: random directions. ridge: penalty by row. width: of the kernel, in standard deviations. bins: of the raw score.
    """
    one = labelled.agg(F.count("*").alias("n"), F.avg("y").alias("mean"),
                       *(f(F.col("x")[i]).alias(f"{k}{i}") for i in range(len(STATISTICS)) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    if not one["n"]:
        return Model(None, None, (np.zeros(1), np.array([0.5])))
    centre = np.array([one[f"m{i}"] for i in range(len(STATISTICS))])
    scale = np.maximum([one[f"s{i}"] for i in range(len(STATISTICS))], 1e-6)
    fourier = Fourier(centre, scale, features, width, seed)
    sums = labelled.where("fits").select("x", "y").mapInArrow(_sums(fourier), "i int, row array<double>")
    rows = sums.groupBy("i").applyInPandas(_add, "i int, row array<double>").orderBy("i").collect()  # features + 1 rows
    if not rows or one["mean"] in (0.0, 1.0):
        return Model(None, None, (np.zeros(1), np.array([one["mean"]])))
    total = np.array([r["row"] for r in rows])
    n = max(total[-1, -2], 1)
    weights = np.linalg.solve(total[:, :-1] + ridge * n * np.eye(len(total)) * np.append(np.ones(features), 1e-6), total[:, -1])
    model = Model(fourier, weights, (np.zeros(1), np.zeros(1)))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(_matrix(batch.column(0)))), batch.column(1)], ["raw", "y"])

    held = labelled.where("not fits").select("x", "y").mapInArrow(raw, "raw double, y double")
    at = F.round(F.least(F.greatest("raw", F.lit(-1.0)), F.lit(2.0)) * (bins / 3))
    curve = held.groupBy(at.alias("bin")).agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("x").collect()
    if not curve:
        return Model(fourier, weights, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    model.knots = isotonic(*(np.array([r[k] for r in curve], float) for k in ("x", "y", "n")))
    return model


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = statistics(batch.column(1)).astype(np.float32)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(STATISTICS)), pa.int32()), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), rows], ["id", "x"])


def _fold(folds: int) -> F.Column:
    return F.crc32(F.col("id").cast("string").cast("binary")) % folds


def _learn(measured: DataFrame, labels: DataFrame, held_out_fold: int, folds: int, curve_fold: int, id_col: str, label_col: str, **fitting) -> Model:
    """A model from the labelled rows of `measured` (id, x) outside the held-out fold."""
    labels = labels.select(F.col(id_col).alias("id_"), F.col(label_col).cast("double").alias("y")).where("id_ is not null and y is not null")
    labelled = measured.withColumn("fold", _fold(folds)).where(F.col("fold") != held_out_fold).join(labels, F.col("id") == F.col("id_"))
    labelled = keep(labelled.select("x", "y", (F.col("fold") != curve_fold).alias("fits")), "quality-labelled")
    model = fit(labelled, **fitting)
    free(labelled)
    return model


def _measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return keep(docs.mapInArrow(_measure, f"id {docs.schema['id'].dataType.simpleString()}, x array<float>"), "quality-measured")


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out_fold: int = 2, folds: int = 4, curve_fold: int = 3,
                    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **fitting) -> DataFrame:
    """(id, held_out, score, predicted) for each row of `docs`.

    A row's fold is crc32(id as text) mod `folds`. Labels of `held_out_fold` are never read, those of `curve_fold`
    calibrate, the others fit.
    """
    measured = _measured(docs, id_col, text_col)
    model = _learn(measured, labels, held_out_fold, folds, curve_fold, id_col, label_col, **fitting)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], ["id", "score"])

    scored = measured.mapInArrow(run, f"id {measured.schema['id'].dataType.simpleString()}, score double")
    out = F.coalesce(_fold(folds) == held_out_fold, F.lit(False))
    return scored.select(F.col("id").alias(id_col), out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held_out_fold: int = 2, folds: int = 4, curve_fold: int = 3,
              id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **fitting) -> DataFrame:
    """The rows of `docs` whose score reaches `threshold`, with all columns.

    Each row is judged where it is read, by its own text, so rows with null or repeated ids need no care and no text is
    shuffled; the fit has read the statistics before.
    """
    measured = _measured(docs, id_col, text_col)
    model = _learn(measured, labels, held_out_fold, folds, curve_fold, id_col, label_col, **fitting)
    free(measured)

    def score(text: pa.Array) -> pa.Array:
        return pa.array(model.score(statistics(text).astype(np.float32).astype(float)))

    # Only the text goes to Python; the rows stay where they are.
    return docs.where(F.arrow_udf(score, "double")(F.col(text_col)) >= threshold)
