"""Benchmark decontamination: BM25 over an inverted index of test items, by block-max WAND.

The index holds the test items.  Every training document is cut into overlapping passages of twice the longest item's
words, so that each item, wherever it stands, lies within one passage; every passage is a query.  A posting's
weight is its term's BM25 weight in the item, divided by the item's weight against itself: a score is the share of the
item that the passage explains, from 0 to 1, and ``THRESHOLD`` means the same for every item.  All items at or above it
are retrieved by block-max WAND (pivot by the lists' largest weights, then by the largest weights of the blocks at the
pivot).  Before that, passages that can't reach the threshold are passed over by an upper bound: the longest lists are
non-essential as long as no item owes them more than half the threshold in all, and the essential lists' postings are
summed by passage and item, repeats included.

Retrieved pairs are verified on word n-grams: the item's question (all but its last sentence) and its answer (the last
sentence, or the last fifth of a single one) must each stand in the passage to ``OVERLAP``.  A pair counts once a document,
with its best passage.

Equal items (id and text) count once.  Items are indexed in shards of about ``SHARD_ITEMS`` items and ``SHARD_BYTES`` of
text (a single longer item makes a shard of its own size), with document frequencies of the whole benchmark, counted by the
same function for any number of shards: scores don't depend on sharding.  ``TOGETHER`` shards are sent to the executors at
once and every text is split into words once for all of them, so documents are read once for as many items.

Null, empty or wordless items and texts match nothing.  Items and documents with null ids are compared like others; rows
that share an id give one row per pair of ids, with the best passage (of equal scores the first).  Texts of any length are
matched whole.  An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

K1, B, THRESHOLD, OVERLAP, GRAM, BLOCK = 1.2, 0.75, 0.5, 0.6, 3, 64
SHARD_ITEMS, SHARD_BYTES, TOGETHER = 4000, 4 << 20, 4
#: A-Z to a-z, ASCII punctuation to a space.
FOLD = bytes(ord(chr(c).lower()) if chr(c).isalpha() and c < 128 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def halves(text: str) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item, as words."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+|\n+", text) if terms_of(p.encode())]
    if len(parts) > 1:
        return terms_of(" ".join(parts[:-1]).encode()), terms_of(parts[-1].encode())
    words = terms_of(text.encode())
    cut = len(words) - max(1, len(words) // 5)
    return words[:cut], words[cut:]


def overlap(part: list[bytes], grams: dict[int, set]) -> float:
    """Share of the n-grams of ``part`` (n: GRAM or its own length, if that is less) among ``grams`` by length."""
    n = min(GRAM, len(part))
    if not n:
        return 1.0
    own = [tuple(part[i : i + n]) for i in range(len(part) - n + 1)]
    return sum(g in grams[n] for g in own) / len(own)


class Index:
    """Postings by term with the largest weight of each list and of each block of items."""

    def __init__(self, items: list[tuple[int | None, str]], df: dict[bytes, int], n: int, average: float):
        self.ids = [i for i, _ in items]
        self.parts = [halves(t) for _, t in items]
        self.words = [terms_of(t.encode()) for _, t in items]
        self.longest = max(map(len, self.words), default=1)
        postings: dict[bytes, list[tuple[int, float]]] = {}
        for k, words in enumerate(self.words):
            tf: dict[bytes, int] = {}
            for w in words:
                tf[w] = tf.get(w, 0) + 1
            weight = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(words) / average)) for w, f in tf.items()}
            whole = sum(weight.values())
            for w, x in weight.items():
                postings.setdefault(w, []).append((k, x / whole))
        self.term = {w: t for t, w in enumerate(postings)}
        self.items = [[k for k, _ in p] for p in postings.values()]
        self.weights = [[x for _, x in p] for p in postings.values()]
        self.most = np.array([max(x) for x in self.weights] + [0.0])
        self.blocks = []
        for ks, xs in zip(self.items, self.weights, strict=True):
            top: dict[int, float] = {}
            for k, x in zip(ks, xs, strict=True):
                top[k // BLOCK] = max(top.get(k // BLOCK, 0.0), x)
            self.blocks.append(top)

        self.inessential(THRESHOLD)

    def inessential(self, threshold: float) -> None:
        """Split the lists: ``owed`` bounds what an item owes to the non-essential ones; the others are laid out flat."""
        owed, essential = np.zeros(len(self.ids)), np.ones(len(self.items) + 1, bool)
        essential[-1] = False
        for t in sorted(range(len(self.items)), key=lambda t: -len(self.items[t])):
            more = owed.copy()
            more[self.items[t]] += self.weights[t]
            if more.max() > threshold / 2:
                break
            owed, essential[t] = more, False
        self.threshold, self.owed, self.essential = threshold, owed, essential
        self.sizes = np.array([len(x) for x in self.items] + [0])
        self.first = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.flat_items = np.array([k for x in self.items for k in x], np.int64)
        self.flat_weights = np.array([w for x in self.weights for w in x])

    def hopeful(self, ids: np.ndarray, half: int) -> list[int]:
        """Which passages (two halves each) may reach the threshold for some item."""
        out, step = [], 256
        places = np.flatnonzero(self.essential[ids])
        if not len(places):
            return [k for k in range(-(-len(ids) // half)) if self.owed.max() >= self.threshold]
        for start in range(0, -(-len(ids) // half), step):
            own = places[np.searchsorted(places, start * half) : np.searchsorted(places, (start + step + 1) * half)]
            n = self.sizes[ids[own]]
            at = np.repeat(self.first[ids[own]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(own) else np.zeros(0, np.int64)
            key = np.repeat(own // half - start, n) * len(self.ids) + self.flat_items[at]
            sums = np.bincount(key, self.flat_weights[at], (step + 2) * len(self.ids) if len(ids) > step * half else (-(-len(ids) // half) + 1) * len(self.ids)).reshape(-1, len(self.ids))
            best = (sums[:-1] + sums[1:] + self.owed).max(1)[:step]
            out += (np.flatnonzero(best >= self.threshold - 1e-9) + start).tolist()
        return out

    def retrieve(self, query: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items that score ``threshold`` or more for the distinct terms of ``query``, by block-max WAND."""
        found, most = [], self.most
        lists = [[self.items[t][0], 0, t] for t in query]  # current item, place in the list, term
        end = len(self.ids)
        slack = threshold - 1e-9

        def seek(entry: list, item: int) -> None:
            ks, at = self.items[entry[2]], entry[1]
            while at < len(ks) and ks[at] < item:
                at += 1
            entry[0], entry[1] = (ks[at] if at < len(ks) else end), at

        while True:
            lists.sort()
            bound, pivot = 0.0, -1
            for i, entry in enumerate(lists):
                if entry[0] >= end:
                    break
                bound += most[entry[2]]
                if bound >= slack:
                    pivot = i
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            if sum(self.blocks[e[2]].get(block, 0.0) for e in lists[: pivot + 1]) >= slack:
                if lists[0][0] == item:
                    score = 0.0
                    for e in lists[: pivot + 1]:
                        score += self.weights[e[2]][e[1]]
                        seek(e, item + 1)
                    if score >= slack:
                        found.append((item, score))
                else:
                    for e in lists[:pivot]:
                        if e[0] < item:
                            seek(e, item)
            else:  # nothing before the end of the block, or before the next list begins, can reach the threshold
                after = min((block + 1) * BLOCK, lists[pivot + 1][0] if pivot + 1 < len(lists) else end)
                for e in lists[: pivot + 1]:
                    seek(e, after)

    def passages(self, n: int) -> list[tuple[int, int]]:
        """(first word, end) of the passages of a text of ``n`` words; each begins in the middle of the one before."""
        half = max(self.longest, 16)
        return [(a, min(n, a + 2 * half)) for a in range(0, n, half)]

    def match(self, words: list[bytes], threshold: float, least: float) -> dict[int, tuple[float, int, float, float]]:
        """item -> score, first word of the passage, overlap of question and of answer, for verified items of a document."""
        found: dict[int, tuple[float, int, float, float]] = {}
        ids = np.fromiter(map(self.term.get, words, repeat(-1)), np.int64, len(words))
        if threshold != self.threshold:
            self.inessential(threshold)
        bounds = self.passages(len(words))
        for a, b in [bounds[k] for k in self.hopeful(ids, max(self.longest, 16))]:
            query = np.unique(ids[a:b])
            query = query[query >= 0]
            hits, grams = self.retrieve(query.tolist(), threshold), None
            for item, score in hits:
                if grams is None:
                    p = words[a:b]
                    grams = {n: set(zip(*[p[i:] for i in range(n)], strict=False)) for n in range(1, GRAM + 1)}
                question, answer = (overlap(x, grams) for x in self.parts[item])
                if question >= least and answer >= least and (item not in found or found[item][0] < score):
                    found[item] = (score, a, question, answer)
        return found


def words_of(items: DataFrame) -> DataFrame:
    """item_id, text, shard -> w, shard for each distinct word of each item, and one row with a null w and the item's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.byte_slices(batches, "text"):
            words, shard, size = [], [], []
            for text, k in zip(shared.raw_texts(b.column("text")), b.column("shard").to_pylist(), strict=True):
                if found := terms_of(text):
                    own = [None, *sorted(set(found))]
                    words += own
                    shard += [k] * len(own)
                    size += [len(found)] + [0] * (len(own) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(shard, pa.int64()), pa.array(size, pa.int64())], names=["w", "shard", "size"])

    return items.mapInArrow(run, "w binary, shard long, size long")


def shards(items: DataFrame, scratch: shared.Scratch) -> Iterator[Index]:
    """Indexes that together hold all items; one at a time is on the driver."""
    items = items.distinct()
    size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n = max(1, -(-size[0] // SHARD_ITEMS), -(-(size[1] or 0) // SHARD_BYTES))
    items = scratch.keep(items.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n))), "items")
    words = scratch.keep(words_of(items), "item_words")
    whole = words.where("w is null").agg(F.count("*"), F.avg("size")).first()
    frequencies = scratch.keep(words.where("w is not null").groupBy("w").agg(F.count("*").alias("n")), "frequencies")
    for k in range(n):
        rows = [(r["item_id"], r["text"]) for r in items.where(F.col("shard") == k).orderBy("item_id", "text").collect()]
        rows = [(i, t) for i, t in rows if terms_of(t.encode())]
        if rows:
            own = words.where((F.col("shard") == k) & F.col("w").isNotNull()).select("w").distinct()
            yield Index(rows, {bytes(r["w"]): r["n"] for r in frequencies.join(own, "w").collect()}, whole[0], whole[1])


HITS = "doc_id long, item_id long, score double, passage_start long, question_overlap double, answer_overlap double"


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, least: float = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per verified pair of document and test item."""
    docs = shared.keyed_text(docs, id_col, text_col)
    items = shared.keyed_text(items, "item_id", "text").select(F.col("doc_id").alias("item_id"), "text").where("text is not null")
    found, indexes = None, shards(items, shared.Scratch(docs.sparkSession))
    while batch := list(islice(indexes, TOGETHER)):
        hits = docs.mapInArrow(searcher(batch, threshold, least), HITS)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], HITS)
    best = F.max(F.struct("score", (-F.col("passage_start")).alias("p"), "question_overlap", "answer_overlap")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.score", (-F.col("m.p")).alias("passage_start"), "m.question_overlap", "m.answer_overlap")


def searcher(indexes: list[Index], threshold: float, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.byte_slices(batches, "text"):
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), shared.raw_texts(b.column("text")), strict=True):
                words = terms_of(text)
                for index in indexes:
                    for item, hit in index.match(words, threshold, least).items():
                        out.append((doc_id, index.ids[item], *hit))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "item_id", "score", "passage_start", "question_overlap", "answer_overlap"])

    return run
