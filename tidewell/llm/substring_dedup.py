"""Substring deduplication with difference-cover anchors.

A window is ``window`` consecutive words of one document.  Every word covered by a window whose words also stand, as
a window, in a document with a smaller id is removed; all windows are judged on the input.

A difference cover D modulo v holds, for any two positions i and j, a shift d < v with both ``i + d`` and ``j + d`` in D
modulo v.  So two equal windows share an *anchor*, a run of ``window - v + 1`` words that starts at a cover
position in both documents, and only 3 of 7 positions (window 13: runs of 7 words) need to be looked up.

1. Documents are laid down in blocks of about ``BLOCK_BYTES`` of text, once; all later passes read these blocks.
2. Each block sends the distinct hashes of its anchors to buckets by hash, one bit saying whether two of its
   documents have it.  A bucket answers each block with one bit per hash: is it in two documents anywhere?
3. Windows that touch a shared anchor are extended to their full length: their hashes go to buckets with the
   smallest id that has them in the block; the answer is whether a smaller one exists elsewhere.

Anchors only propose, so 63 bits of hash do.  Windows decide: they are told apart by 127 bits, two independent hashes over
all their words (themselves told apart by 64 bits), so that 10^14 different windows hold no false match but for a chance of
10^-9.

A very common passage counts once per block, however often it occurs, and a block gets bits, not lists of partners.
Buckets and the partitions of all shuffles follow the amount of text, so each bucket stays at about ``BUCKET_BYTES`` of text and
each task at ``shared.PARTITION_BYTES``; a block is cut by the buckets that it
has hashes for, so the rows sent never outnumber the hashes.

Null texts have no words.  A null id counts as the largest id there can be.  Rows that share an id are one document as far
as "smaller id" goes: they don't remove each other's words, so repeated rows stay equal.  Texts of any length are judged
whole; one over ``BLOCK_BYTES`` is a block of its own.  Every input row gives one output row, an empty table none; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

WINDOW, BLOCK_BYTES, BUCKET_BYTES = 13, 4 << 20, 16 << 20
#: Answers are a bit a hash, so they take less than this part of the text.
ANSWER_SHARE = 16
#: Perfect difference covers: period, residues (fixed values of combinatorics).
COVERS = ((3, (0, 1)), (7, (0, 1, 3)), (13, (0, 1, 3, 9)), (21, (0, 1, 4, 14, 16)), (31, (0, 1, 3, 8, 12, 18)))
LAST_ID = np.iinfo(np.int64).max


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period whose anchors still have more than half the window's words."""
    fitting = [c for c in COVERS if 2 * (window - c[0] + 1) > window]
    return fitting[-1] if fitting else (1, (0,))


def lay_down(docs: DataFrame) -> DataFrame:
    """Blocks: id, ids, tags and byte lengths (-1: null) of the documents as 64-bit arrays, which ids are null, and the texts, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        part, made, pack = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=3)
        held: list[tuple[int | None, int, bytes | None]] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids, tags, texts = zip(*held, strict=True)
            data = pack.compress(b"".join(t or b"" for t in texts))
            known = [LAST_ID if i is None else i for i in ids]
            arrays = [np.array(x, np.int64).tobytes() for x in (known, tags, [-1 if t is None else len(t) for t in texts])]
            nulls = np.packbits([i is None for i in ids]).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | made], pa.int64()), *[pa.array([x], pa.binary()) for x in (*arrays, nulls, data)], pa.array([size], pa.int64())], names=["block", "ids", "tags", "lengths", "nulls", "data", "bytes"])

        for b in batches:
            for doc_id, tag, text in zip(b.column("doc_id").to_pylist(), b.column("tag").to_pylist(), shared.raw_texts(b.column("text")), strict=True):
                held.append((doc_id, tag, text))
                size += len(text or b"") + 64
                if size >= BLOCK_BYTES:
                    yield block()
                    held, size, made = [], 0, made + 1
        if held:
            yield block()

    return docs.mapInArrow(run, "block long, ids binary, tags binary, lengths binary, nulls binary, data binary, bytes long")


class Block:
    """One block's documents as word hashes, and the hashes of its anchors and candidate windows."""

    def __init__(self, row: dict, hashes: shared.WordHashes, window: int, keep_words: bool = False):
        import zstandard

        self.id, self.window = row["block"], window
        self.ids, self.tags, lengths = (np.frombuffer(row[c], np.int64) for c in ("ids", "tags", "lengths"))
        self.nulls = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=len(self.ids)).astype(bool)
        data, at = zstandard.ZstdDecompressor().decompress(row["data"]), 0
        self.hashes, self.words = [], []
        for n in np.maximum(lengths, 0).tolist():
            words = data[at : at + n].split()
            at += n
            self.words.append(words if keep_words else len(words))
            self.hashes.append(hashes.of(words))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Hashes of all anchors, the document of each, and their positions by document."""
        period, cover = cover_for(self.window)
        width, found, places = self.window - period + 1, [], []
        on = np.isin(np.arange(period), cover)
        for h in self.hashes:
            n = len(h) - width + 1 if len(h) >= self.window else 0
            at = np.flatnonzero(np.resize(on, n)) if n > 0 else np.zeros(0, np.int64)
            places.append(at)
            found.append(shared.ngram_hashes(h, width)[at] if n > 0 else np.zeros(0, np.uint64))
        return np.concatenate(found), np.repeat(np.arange(len(places)), [len(p) for p in places]), places

    def candidates(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """Two hashes of all windows that touch a shared anchor, the document of each, and their starts by document; ``bits``: the answers for the distinct anchors."""
        period, _ = cover_for(self.window)
        hashes, _, places = self.anchors()
        _, code = np.unique(hashes >> np.uint64(1), return_inverse=True)
        shared_anchor, at = bits[code] if len(code) else np.zeros(0, bool), 0
        found, second, starts = [], [], []
        for h, p in zip(self.hashes, places, strict=True):
            hit = p[shared_anchor[at : at + len(p)]]
            at += len(p)
            if len(hit):
                near = np.zeros(len(h) + 1, np.int64)
                near[hit + 1] = 1
                near = np.cumsum(near)
                n = len(h) - self.window + 1
                first = np.arange(n)
                first = first[near[np.minimum(first + period, len(h))] > near[first]]
                starts.append(first)
                one, two = window_hashes(h, first, self.window)
                found.append(one)
                second.append(two)
            else:
                starts.append(np.zeros(0, np.int64))
        none = [np.zeros(0, np.uint64)]
        return np.concatenate(found or none) >> np.uint64(1), np.concatenate(second or none), np.repeat(np.arange(len(starts)), [len(s) for s in starts]), starts


_FACTORS = np.array([0x9E3779B97F4A7C15, 0xD1342543DE82EF95], np.uint64)


def window_hashes(h: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of the windows at ``starts``, from the words' hashes."""
    one = two = np.zeros(len(starts), np.uint64)
    for k in range(window):
        word = h[starts + k]
        one, two = shared.mix64((one ^ _FACTORS[0]) * _FACTORS[0] + word), (two + word) * _FACTORS[1]
        two ^= two >> np.uint64(32)
    return one, shared.mix64(two)


def lowest(hashes: np.ndarray, second: np.ndarray | None, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of ``hashes`` and ``second`` (None: 0), sorted, with the smallest and the largest owner of each, and each row's place among them."""
    order = np.lexsort((owner, hashes))
    if second is not None and ((hashes[order][1:] == hashes[order][:-1]) & (second[order][1:] != second[order][:-1])).any():
        order = np.lexsort((owner, second, hashes))  # only where the first hash alone doesn't tell them apart
    h, o = hashes[order], owner[order]
    s = np.zeros(len(h), np.uint64) if second is None else second[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (s[1:] != s[:-1])] if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(h)] - 1 if len(h) else first
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    return h[first], s[first], o[first], o[last], place


def slices(values: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of sorted 63-bit values, dealt by their upper bits (``buckets`` is a power of 2); only buckets that have values."""
    if not len(values):
        return []
    bucket = (values >> np.uint64(63 - buckets.bit_length() + 1)).astype(np.int64)
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(values)]
    return list(zip(bucket[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def unpacked(answers: list[dict] | None, n: int) -> np.ndarray:
    """The answers for a block's distinct hashes, in order; False where there was none."""
    parts = [np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["n"]).astype(bool) for a in sorted(answers or [], key=lambda a: a["bucket"])]
    return np.concatenate(parts) if parts else np.zeros(n, bool)


ASKED = "block long, bucket int, hashes binary, second binary, ids binary"
ANSWER = "block long, bucket int, n int, bits binary"


def ask(rows: DataFrame, buckets: int, window: int, extend: bool) -> DataFrame:
    """The distinct hashes of anchors (``extend``: of candidate windows) of each block, dealt into buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shared.WordHashes()
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                block = Block(row, hashes, window)
                if extend:
                    h, second, doc, _ = block.candidates(unpacked(row["shared"], 0))
                else:
                    h, doc, _ = block.anchors()
                    h, second = h >> np.uint64(1), None
                h, second, least, most, _ = lowest(h, second, block.ids[doc])
                sent = slices(h, buckets)
                if not extend:
                    h = h << np.uint64(1) | (least != most).astype(np.uint64)
                if sent:
                    parts = [pa.array([x[a:b].tobytes() if wanted else None for _, a, b in sent], pa.binary()) for x, wanted in ((h, True), (second, extend), (least, extend))]
                    yield pa.RecordBatch.from_arrays([pa.array([block.id] * len(sent), pa.int64()), pa.array([k for k, _, _ in sent], pa.int32()), *parts], names=["block", "bucket", "hashes", "second", "ids"])

    return rows.mapInArrow(run, ASKED)


def answer(asked: DataFrame, total: int, extend: bool) -> DataFrame:
    """One bit per hash asked for: is it shared (``extend``: has it a smaller id elsewhere)? ``total``: bytes of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in shared.whole_groups(batches, "bucket"):
            buckets = whole.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1), whole.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                g = whole.slice(a, b - a)
                blobs = [np.frombuffer(x, np.uint64) for x in g.column("hashes").to_pylist()]
                h, sizes = np.concatenate(blobs), [len(x) for x in blobs]
                if extend:
                    ids = np.concatenate([np.frombuffer(x, np.int64) for x in g.column("ids").to_pylist()])
                    _, _, least, _, place = lowest(h, np.concatenate([np.frombuffer(x, np.uint64) for x in g.column("second").to_pylist()]), ids)
                    bit = least[place] < ids
                else:
                    key, multi = h >> np.uint64(1), (h & np.uint64(1)).astype(bool)
                    order = np.argsort(key, kind="stable")
                    k = key[order]
                    run_of = np.cumsum(np.r_[True, k[1:] != k[:-1]]) - 1
                    many = (np.bincount(run_of) > 1) | (np.bincount(run_of, weights=multi[order]) > 0)
                    bit = np.zeros(len(h), bool)
                    bit[order] = many[run_of]
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([g.column("block"), g.column("bucket"), pa.array(sizes, pa.int32()), pa.array([np.packbits(bit[e - n : e]).tobytes() for n, e in zip(sizes, ends, strict=True)], pa.binary())], names=["block", "bucket", "n", "bits"])

    return shared.spread(asked, total, "bucket").sortWithinPartitions("bucket").mapInArrow(run, ANSWER)


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of ``n`` words stand in a window that begins at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:n]) > 0


def cut(rows: DataFrame, window: int, with_text: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shared.WordHashes()
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                block = Block(row, hashes, window, True)
                h, second, doc, starts = block.candidates(unpacked(row["shared"], 0))
                _, _, least, _, place = lowest(h, second, block.ids[doc])
                gone = unpacked(row["earlier"], 0)[place] | (least[place] < block.ids[doc]) if len(h) else np.zeros(0, bool)
                at, out = 0, []
                for k, (words, first) in enumerate(zip(block.words, starts, strict=True)):
                    first = first[gone[at : at + len(first)]]
                    at += len(starts[k])
                    if len(first):
                        drop = covered(len(words), first, window)
                        kept = [w for w, d in zip(words, drop.tolist(), strict=True) if not d]
                    else:
                        kept = words
                    joined = b" ".join(kept)
                    out.append((None if block.nulls[k] else int(block.ids[k]), int(block.tags[k]), len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined if with_text else None))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=False)] + [pa.array(cols[5], pa.binary()).cast(pa.string())], names=["doc_id", "tag", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return rows.mapInArrow(run, "doc_id long, tag long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def deduplicate(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, tag (xxhash64 of the text), n_words, n_removed, kept_sha256, kept_text (null unless asked for) for every row."""
    scratch = shared.Scratch(docs.sparkSession)
    docs = shared.keyed_text(docs, id_col, text_col).withColumn("tag", F.xxhash64("text"))
    blocks = scratch.keep(lay_down(docs), "blocks")
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    buckets = 1 << max(4, (total // BUCKET_BYTES).bit_length())

    def told(asked: DataFrame, extend: bool, name: str) -> DataFrame:
        answers = shared.spread(answer(asked, total, extend), total // ANSWER_SHARE, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias(name))
        return scratch.keep(answers.withColumnRenamed("block", "_block"), name)

    def beside(rows: DataFrame, answers: DataFrame) -> DataFrame:
        if shared.parts_for(rows.sparkSession, total):
            rows, answers = shared.spread(rows, total, "block"), shared.spread(answers, total, "_block")
        return rows.join(answers, F.col("block") == F.col("_block"), "left").drop("_block")

    with_shared = beside(blocks, told(ask(blocks, buckets, window, False), False, "shared"))
    earlier = told(ask(with_shared, buckets, window, True), True, "earlier")
    return cut(beside(with_shared, earlier), window, with_text)
