"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

1. The lexicon is learned: words and word beginnings of four and five characters, with their document frequencies in
   toxic and in other labelled texts (of whole-text copies with one label, the one with the smallest id); those far more
   frequent in toxic ones stay, all of them: odds of ``ODDS`` to 1 and a log-likelihood of ``EVIDENCE`` or more, tested where
   the counts are, so only terms that pass reach the driver.
2. Dense features per text: densities and counts of lexicon words, densest stretch, nearness to the second person,
   capitals, punctuation, obfuscated words (digits or marks inside a word) and lexicon words found only after
   undoing the obfuscation.
3. Boosted trees on quantile bins (logistic loss, Newton steps), then isotonic regression.  Training features and the
   values to calibrate on are cross-fitted: a row's lexicon and trees come from the other half of the rows.

All learning is on at most ``SAMPLE`` labelled rows outside the held-out part (those with the smallest hashes of their
ids).  Null texts are scored as empty ones; without toxic or without other labelled rows every score is the
share of toxic ones (0 without any).  A score depends on the text alone, so repeated rows and copies score the same; of an
id with several label rows the larger label counts; of a labelled id's rows each different text is a training row.  Texts of any
length are read whole, one slice of about 8 MB (or one text) at a time.  Every input row gives one output row, an empty
table none; other columns are ignored, whatever their names.  No step depends on the order or the partitions of the rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .labelled import bounded, held_out, learnable
from .quality import CLASSES

SAMPLE, THRESHOLD, EVIDENCE, ODDS = 16000, 0.3, 10.0, 30.0
TREES, DEPTH, RATE, CELLS, LEAST_LEAF, RIDGE = 60, 3, 0.2, 64, 5, 1.0
#: Second-person words of the four languages (fixed values).
SECOND_PERSON = "you your yours yourself u ur tú tu tus te ti usted ustedes vosotros vous votre vos toi du dich dir dein deine ihr euch euer".split()
#: Stand-ins that obfuscated words use (fixed values).
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", "_": "", "-": "", ".": ""}
INSIDE = re.compile(r"\w[^\w\s'’]+\w|[^\W\d_]\d|\d[^\W\d_]")
EDGE = ".,;:!?\"'()[]{}«»“”¡¿…|"
NAMES = ("hits", "log_hits", "densest", "near_second", "second", "capitals", "capital_words", "marks", "exclamations", "obfuscated", "hidden_hits", "log_words")


def terms(word: str) -> list[str]:
    """What a lexicon may list of a word."""
    return ["=" + word] + [word[:n] + "-" for n in (4, 5) if len(word) >= n]


def clean(word: str) -> str:
    return word.lower().strip(EDGE)


class Reader(dict):
    """Word -> bits: 1 in the lexicon, 2 second person, 4 obfuscated, 8 in the lexicon once undone."""

    def __init__(self, lexicon: frozenset[str]):
        super().__init__()
        self.lexicon, self.second = lexicon, frozenset(SECOND_PERSON)

    def __missing__(self, raw: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        word = clean(raw.decode("utf-8", "replace"))
        bits = (not self.lexicon.isdisjoint(terms(word))) | 2 * (word in self.second)
        if INSIDE.search(word):
            bits |= 4
            plain = "".join(STAND_INS.get(c, c) for c in word)
            if not bits & 1 and not self.lexicon.isdisjoint(terms(plain)):
                bits |= 8
        self[raw] = bits
        return bits

    def features(self, text: bytes | None) -> list[float]:
        words = text.split() if text else []
        if not words:
            return [0.0] * len(NAMES)
        raw = np.frombuffer(text, np.uint8)
        shares = np.bincount(raw, minlength=256) @ CLASSES / len(raw)
        bits = np.fromiter(map(self.__getitem__, words), np.uint8, len(words))
        hit, second = np.flatnonzero(bits & 9), np.flatnonzero(bits & 2)
        near = 0
        if len(hit) and len(second):
            at = np.searchsorted(second, hit)
            gap = np.minimum(np.abs(second[np.minimum(at, len(second) - 1)] - hit), np.abs(second[np.maximum(at - 1, 0)] - hit))
            near = int((gap <= 5).sum())
        ends = np.searchsorted(hit, hit + 50)
        n = len(words)
        return [len(hit) / n, float(np.log1p(len(hit))), float((ends - np.arange(len(hit))).max()) if len(hit) else 0.0, near / n, len(second) / n, shares[0], sum(map(bytes.isupper, words)) / n, shares[5] + shares[6], text.count(b"!") / n, float((bits & 4 > 0).mean()), float((bits & 8 > 0).mean()), float(np.log1p(n))]


def term_counts(rows: DataFrame) -> DataFrame:
    """term, half, toxic, other: document frequencies; rows: text, y, half. Counted in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.byte_slices(batches, "text"):
            counts: dict[tuple[str, int], list[int]] = {}
            for text, y, half in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), b.column("half").to_pylist(), strict=True):
                for t in {t for w in set((text or "").split()) for t in terms(clean(w))}:
                    counts.setdefault((t, half), [0, 0])[1 - y] += 1
            if counts:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts], pa.int32()), pa.array([v[0] for v in counts.values()], pa.int64()), pa.array([v[1] for v in counts.values()], pa.int64())], names=["term", "half", "toxic", "other"])

    return rows.mapInArrow(run, "term string, half int, toxic long, other long").groupBy("term").agg(*[F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for h in (0, 1) for c in ("toxic", "other")])


def telling(a: Column, b: Column, n_toxic: int, n_other: int) -> Column:
    """Does a term of ``a`` toxic and ``b`` other texts have ODDS times smoothed odds, with EVIDENCE beyond chance?"""
    share = n_toxic / max(1, n_toxic + n_other)
    odds = (a + 0.5) / (n_toxic + 1) >= ODDS * (b + 0.1) / (n_other + 1)
    return (a > 0) & odds & (a * F.log(a / (a + b) / share) >= EVIDENCE) if share else F.lit(False)


class Boosted:
    """Additive regression trees on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, CELLS + 1)[1:-1])) for c in x.T]
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base, self.trees = float(np.log(mean / (1 - mean))), []
        cells = self.cells(x)
        z = np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-z))
            tree = self.grow(cells, p - y, p * (1 - p))
            self.trees.append(tree)
            z += RATE * self.leaf(tree, cells)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def grow(self, cells: np.ndarray, g: np.ndarray, h: np.ndarray) -> list[tuple[int, int, float]]:
        """(feature, cell, value) in heap order; a feature of -1 marks a leaf."""
        size = 2 ** (DEPTH + 1) - 1
        tree, node = [(-1, 0, 0.0)] * size, np.zeros(len(g), int)
        for k in range(size):
            own = np.flatnonzero(node == k)
            if not len(own):
                continue
            total_g, total_h = g[own].sum(), h[own].sum()
            tree[k] = (-1, 0, float(-total_g / (total_h + RIDGE)))
            if 2 * k + 2 >= size:
                continue
            best = (1e-6, -1, 0)
            for f in range(cells.shape[1]):
                c = cells[own, f]
                lg, lh, n = (np.cumsum(np.bincount(c, w, CELLS + 1)) for w in (g[own], h[own], None))
                gain = lg**2 / (lh + RIDGE) + (total_g - lg) ** 2 / (total_h - lh + RIDGE) - total_g**2 / (total_h + RIDGE)
                gain[(n < LEAST_LEAF) | (len(own) - n < LEAST_LEAF)] = -1
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (float(gain[at]), f, at)
            if best[1] >= 0:
                tree[k] = (best[1], best[2], tree[k][2])
                node[own] = 2 * k + 1 + (cells[own, best[1]] > best[2])
        return tree

    def leaf(self, tree: list, cells: np.ndarray) -> np.ndarray:
        node = np.zeros(len(cells), int)
        feature, cut, value = (np.array(v) for v in zip(*tree, strict=True))
        rows = np.arange(len(cells))
        for _ in range(DEPTH):
            inner = feature[node] >= 0
            node = np.where(inner, 2 * node + 1 + (cells[rows, np.maximum(feature[node], 0)] > cut[node]), node)
        return value[node]

    def raw(self, x: np.ndarray) -> np.ndarray:
        cells = self.cells(x)
        return self.base + RATE * sum(self.leaf(t, cells) for t in self.trees)


def isotonic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and values of the non-decreasing fit of y on z (pool adjacent violators); equal z are pooled first."""
    knots, inverse = np.unique(z, return_inverse=True)
    n, s = np.bincount(inverse).astype(float), np.bincount(inverse, y)
    blocks: list[list[float]] = []  # sum, count, first knot
    for i in range(len(knots)):
        blocks.append([s[i], n[i], i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1][0] += last[0]
            blocks[-1][1] += last[1]
    first = [int(b[2]) for b in blocks] + [len(knots)]
    value = [(b[0] + 0.02) / (b[1] + 0.04) if b[1] else 0.0 for b in blocks]
    xs, ys = [], []
    for a, b, v in zip(first, first[1:], value, strict=False):
        xs += [knots[a], knots[b - 1]]
        ys += [v, v]
    return np.array(xs), np.maximum.accumulate(np.array(ys))


class Model:
    def __init__(self, lexicon: frozenset[str], trees: Boosted | None, curve: tuple[np.ndarray, np.ndarray] | None, share: float):
        self.lexicon, self.trees, self.curve, self.share = lexicon, trees, curve, share

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.share)
        z = self.trees.raw(x)
        return np.interp(z, *self.curve) if self.curve else 1 / (1 + np.exp(-z))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text."""
    scratch = shared.Scratch(docs.sparkSession)
    chosen = bounded(learnable(labels, "toxic"), SAMPLE).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int"))
    rows = scratch.keep(docs.join(chosen, "doc_id").select("doc_id", "text", "y", "half").dropDuplicates(["doc_id", "text"]), "sample")
    sizes = {(r["half"], r["y"]): r["n"] for r in rows.groupBy("half", "y").agg(F.count("*").alias("n")).collect()}
    n = [[sizes.get((h, y), 0) for y in (0, 1)] for h in (0, 1)]
    toxic, other = n[0][1] + n[1][1], n[0][0] + n[1][0]
    if not toxic or not other:
        return Model(frozenset(), None, None, 1.0 if toxic else 0.0)
    first = F.min(F.struct("doc_id", "half")).alias("first")
    texts = scratch.keep(rows.groupBy(F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("copy"), "y").agg(first).select(F.col("first.doc_id").alias("_id"), F.col("first.half").alias("_half"), F.col("y").alias("_y"), "copy"), "texts")
    distinct = {(r["_half"], r["_y"]): r["n"] for r in texts.groupBy("_half", "_y").agg(F.count("*").alias("n")).collect()}
    m = [[distinct.get((h, y), 0) for y in (0, 1)] for h in (0, 1)]
    m_toxic, m_other = m[0][1] + m[1][1], m[0][0] + m[1][0]
    single = rows.withColumn("_copy", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)).join(texts, (F.col("doc_id") == F.col("_id")) & (F.col("y") == F.col("_y")) & (F.col("_copy") == F.col("copy"))).dropDuplicates(["copy", "y"]).select("text", "y", "half")
    # A half's training features use terms that tell in the other half, unseen of its own counts.
    c = {name: F.col(name) for h in (0, 1) for name in (f"toxic{h}", f"other{h}")}
    tests = [telling(c["toxic0"] + c["toxic1"], c["other0"] + c["other1"], m_toxic, m_other), telling(c["toxic1"], c["other1"], m[1][1], m[1][0]), telling(c["toxic0"], c["other0"], m[0][1], m[0][0])]
    counts = term_counts(single).select("term", *[t.alias(f"t{k}") for k, t in enumerate(tests)]).where("t0 or t1 or t2").collect()
    whole, *apart = (frozenset(r["term"] for r in counts if r[f"t{k}"]) for k in range(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(x) for x in apart]
        for b in shared.byte_slices(batches, "text"):
            half = b.column("half").to_pylist()
            x = [readers[h].features(t) for h, t in zip(half, shared.raw_texts(b.column("text")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("half"), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "y", "half", "x"])

    data = rows.mapInArrow(run, "doc_id long, y int, half int, x array<float>").orderBy("doc_id", "y", "half").collect()  # at most SAMPLE ids
    x, y, half = np.array([r["x"] for r in data]), np.array([r["y"] for r in data], float), np.array([r["half"] for r in data])
    scratch.drop("sample", "texts")
    trees, z, halves = Boosted(x, y), np.zeros(len(y)), [h for h in (0, 1) if len(set(y[half != h])) == 2 and (half == h).any()]
    for h in halves:
        z[half == h] = Boosted(x[half != h], y[half != h]).raw(x[half == h])
    known = np.isin(half, halves)
    return Model(whole, trees, isotonic(z[known], y[known]) if known.any() else None, toxic / (toxic + other))


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    docs = shared.keyed_text(docs, id_col, text_col)
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.lexicon)
        for b in shared.byte_slices(batches, "text"):
            x = np.array([reader.features(t) for t in shared.raw_texts(b.column("text"))]).reshape(-1, len(NAMES)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x.astype(float)), pa.float64())], names=["doc_id", "score"])

    out = docs.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
