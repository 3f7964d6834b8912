"""Quality classifier by positive-unlabelled learning.

Trusted positives are the learnable rows labelled 1; every document is unlabelled text.  Labels of 0 are not used.

1. One pass over all texts makes dense features (shares of character classes, word statistics, repetition).
2. A linear model on quantile bins of the features tells positives from unlabelled text; histograms of its score over
   the positives kept for calibration (fold 3, never fitted on, plus the fitted ones with the weight of ``VIRTUAL`` rows in
   all, at every size) and over all documents give the class prior: the least ratio of the share of all documents above
   a score to that of the positives.
3. The same kind of model minimises the non-negative unbiased risk
   ``pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))`` with logistic loss.
4. Its value becomes a probability by the same two histograms: the ratio of positives to documents per cell, made
   non-decreasing, times the prior that they imply, which is the share of positives among documents of that value.

The models are fitted on at most ``SAMPLE`` positives and as many unlabelled rows (those with the smallest hashes of
their ids, ties by id); histograms cover every row.  Null and empty texts are scored alike.  Without any positives every
score is the neutral 0.5.  A score depends on the text alone, so repeated rows and copies score the same; of an id with
several label rows the larger label counts.  Texts of any length are measured whole, one slice of about 8 MB (or one text)
at a time.  Every input row gives one output row, an empty table none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .labelled import bounded, held_out, learnable

SAMPLE, BINS, STEPS, RATE, RIDGE, THRESHOLD = 12000, 12, 200, 0.1, 0.5, 0.7
#: Scores per histogram, and the least share of positives above a score that is used for the prior.
CELLS, LEAST_ABOVE, VIRTUAL = 512, 0.2, 20


def classes() -> np.ndarray:
    """256 x 8: upper, lower, digit, space, newline, sentence mark, other ASCII mark, other byte."""
    out = np.zeros((256, 8))
    for c in range(256):
        ch = chr(c)
        kind = 7 if c > 127 else 0 if "A" <= ch <= "Z" else 1 if "a" <= ch <= "z" else 2 if ch.isdigit() else 4 if ch == "\n" else 3 if ch in " \t\r\v\f" else 5 if ch in ".,;:'\"-()" else 6
        out[c, kind] = 1
    return out


CLASSES = classes()
MARK = (CLASSES[:, 5] + CLASSES[:, 6]).astype(bool)
NAMES = ("upper", "lower", "digit", "space", "newline", "sentence_mark", "other_mark", "high", "log_bytes", "log_words", "word_length", "word_length_spread", "distinct", "top_word", "capitalised", "ends_in_mark", "doubled_marks", "line_repeats", "stops")


def features(text: bytes | None) -> list[float]:
    """The dense features NAMES of a text."""
    if not text:
        return [0.0] * len(NAMES)
    raw = np.frombuffer(text, np.uint8)
    shares = np.bincount(raw, minlength=256) @ CLASSES / len(raw)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    n = max(1, len(words))
    space = CLASSES[raw, 3] + CLASSES[raw, 4] > 0
    doubled = float(np.mean((raw[1:] == raw[:-1]) & MARK[raw[1:]])) if len(raw) > 1 else 0.0
    starts = np.flatnonzero(np.r_[True, space[:-1]] & ~space)
    ends = np.flatnonzero(np.r_[space[1:], True] & ~space)
    size = ends - starts + 1 if len(starts) == len(ends) and len(starts) else np.zeros(1)
    counts = Counter(words)
    top = counts.most_common(1)[0][1] if counts else 0
    first, last = raw[starts] if len(starts) else raw[:0], raw[ends] if len(ends) else raw[:0]
    return [
        *shares.tolist(),
        float(np.log1p(len(raw))),
        float(np.log1p(len(words))),
        float(size.mean()),
        float(size.std()),
        len(counts) / n,
        top / n,
        float((CLASSES[first, 0] > 0).mean()) if len(first) else 0.0,
        float(MARK[last].mean()) if len(last) else 0.0,
        doubled,
        1 - len(set(lines)) / max(1, len(lines)),
        text.count(b". ") / n,
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and features of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.byte_slices(batches, "text"):
            rows = np.array([features(t) for t in shared.raw_texts(b.column("text"))], np.float32)
            flat = pa.array(rows.ravel())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(NAMES), pa.int32()), flat)], names=["doc_id", "x"])

    return docs.mapInArrow(run, "doc_id long, x array<float>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


class Additive:
    """A weight per quantile bin of each feature."""

    def __init__(self, sample: np.ndarray):
        self.ridge = RIDGE / max(1, len(sample))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in sample.T]
        self.start = np.concatenate([[0], np.cumsum([len(e) + 1 for e in self.edges])])
        self.weights, self.bias = np.zeros(self.start[-1]), 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") + s for e, c, s in zip(self.edges, x.T, self.start, strict=False)], axis=1)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[bins].sum(1) + self.bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30)))

    def descend(self, parts: list[np.ndarray], slopes) -> None:
        """Adam on ``slopes(values of each part)``, the derivatives of the risk by them."""
        first, second = np.zeros(len(self.weights) + 1), np.zeros(len(self.weights) + 1)
        for step in range(1, STEPS + 1):
            g = np.zeros(len(self.weights) + 1)
            for b, s in zip(parts, slopes([self.raw(b) for b in parts]), strict=True):
                g[:-1] += np.bincount(b.ravel(), np.repeat(s, b.shape[1]), len(self.weights))
                g[-1] += s.sum()
            g[:-1] += self.ridge * self.weights
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            self.weights -= move[:-1]
            self.bias -= move[-1]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_separator(p: np.ndarray, u: np.ndarray) -> Additive:
    """Positives against unlabelled rows, both sides weighing the same."""
    model = Additive(np.concatenate([p, u]))
    model.descend([model.bins(p), model.bins(u)], lambda z: [(sigmoid(z[0]) - 1) / len(p), sigmoid(z[1]) / len(u)])
    return model


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float) -> Additive:
    """Non-negative unbiased risk with logistic loss; where the negative part falls below 0, the descent takes it back up."""
    model = Additive(np.concatenate([p, u]))

    def slopes(z: list[np.ndarray]) -> list[np.ndarray]:
        zp, zu = z
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        down_p, down_u = -prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
        if negative < 0:
            return [-down_p, -down_u]
        return [prior * (sigmoid(zp) - 1) / len(zp) + down_p, down_u]

    model.descend([model.bins(p), model.bins(u)], slopes)
    return model


def cells_of(score: np.ndarray) -> np.ndarray:
    return np.minimum((score * CELLS).astype(int), CELLS - 1)


def histogram(rows: DataFrame, model: Additive) -> np.ndarray:
    """How many rows have each score, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(cells_of(model.score(matrix(b.column("x")))), minlength=CELLS)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells])], names=["cell", "n"])

    out = np.zeros(CELLS)
    for r in rows.select("x").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of the shares above a score, for scores that enough positives exceed."""
    above_p, above_u = (np.cumsum(h[::-1])[::-1] / max(1, h.sum()) for h in (positive, unlabelled))
    usable = above_p >= LEAST_ABOVE
    return float(np.clip((above_u[usable] / above_p[usable]).min(), 0.05, 0.98)) if usable.any() else 0.5


def curve_of(positive: np.ndarray, unlabelled: np.ndarray) -> np.ndarray:
    """Probability of a positive by cell of the score: a non-decreasing ratio of the histograms, times the prior."""
    p, u, blocks = positive / max(1, positive.sum()), unlabelled / max(1, unlabelled.sum()), []
    for i in range(CELLS):
        blocks.append([p[i], u[i], 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last, strict=True)]
    ratio = np.concatenate([np.full(n, a / b if b else 0.0) for a, b, n in blocks])
    return np.clip(np.maximum.accumulate(ratio) * prior_of(positive, unlabelled), 0, 1)


def train(rows: DataFrame, labels: DataFrame):
    """Scores of a feature matrix; rows: doc_id, x."""
    trusted = learnable(labels, "quality").where("y = 1")
    positives = rows.join(trusted.select("doc_id", "fold"), "doc_id")
    fitted = positives.where("fold <> 3")
    others = rows.join(trusted.where("fold <> 3").select("doc_id"), "doc_id", "left_anti")
    p, u = (np.array([r["x"] for r in bounded(part, SAMPLE).collect()]).reshape(-1, len(NAMES)) for part in (fitted, others))
    if not len(p) or not len(u):
        return lambda x: np.full(len(x), 0.5)
    kept = positives.where("fold = 3")

    def histograms(model: Additive) -> tuple[np.ndarray, np.ndarray]:
        fit = histogram(fitted, model)
        return histogram(kept, model) + VIRTUAL * fit / fit.sum(), histogram(others, model)

    model = fit_nnpu(p, u, prior_of(*histograms(fit_separator(p, u))))
    curve = curve_of(*histograms(model))
    # Within a cell the model's own order is kept, below any step of the curve.
    return lambda x: np.clip(0.99 * curve[cells_of(s := model.score(x))] + 0.01 * s, 0, 1) if len(x) else np.zeros(0)


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scratch = shared.Scratch(docs.sparkSession)
    rows = scratch.keep(measured(shared.keyed_text(docs, id_col, text_col)), "features")
    score = train(rows, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score(matrix(b.column("x"))))], names=["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score THRESHOLD or more, whole and in place: texts are read twice rather than shuffled."""
    scratch = shared.Scratch(docs.sparkSession)
    score = train(scratch.keep(measured(shared.keyed_text(docs, id_col, text_col)), "features"), labels)
    scratch.drop("features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.byte_slices(batches, text_col):
            x = np.array([features(t) for t in shared.raw_texts(b.column(text_col))], np.float32).astype(np.float64)
            yield b.filter(pa.array(score(x) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
