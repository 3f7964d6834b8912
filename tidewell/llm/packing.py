"""Best-fit packing by minimum bin slack.

Documents become token ids plus an end id; those longer than a sequence are cut into
full pieces, of which the first may be shorter.  Packing only depends on how many pieces
there are of each length, so the plan is made on a histogram of at most ``capacity``
numbers, whatever the size of the corpus: per bin, a bitset subset-sum over the available
lengths finds the fullest combination that holds the longest one, and the combination is
taken as often as the histogram allows.  Pieces then find their place by arithmetic on
their rank among the pieces of their length; the rank is (pieces of that length in earlier
partitions) + (rank in the partition), so no length is ever gathered into one task.

Null texts count as empty (one end id); rows with a null id are packed like any other;
repeated rows are packed once each; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared

CAPACITY, END_ID, VOCABULARY = 1024, 2, "byte_bpe_50k.json"
#: The pre-tokenizer's own expression for byte-level vocabularies (fixed value).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[str, object] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use: visible Latin-1 bytes stand for themselves, the others follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def encoder(path: str):
    """text -> uint32 ids, as the tokenizer file at ``path`` gives them without special tokens added.

    The ids come from a rank-table encoder built from the file's own vocabulary, several times
    faster; texts that spell a special token, and files for which both differ on a probe, go to
    the tokenizers library itself.
    """
    if path in _encoders:
        return _encoders[path]
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    slow = lambda text: np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)
    encode = slow
    try:
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        fast = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        probe = "Probe: it's 3.14éß 世界\t\n  x!!! abño \U0001f642 of%%%  \r\n"
        if fast.encode_ordinary(probe) == slow(probe).tolist():

            def encode(text: str) -> np.ndarray:
                if any(s in text for s in special):
                    return slow(text)
                return np.asarray(fast.encode_to_numpy(text, disallowed_special=()) if hasattr(fast, "encode_to_numpy") else fast.encode_ordinary(text), dtype=np.uint32)
    except (KeyError, ValueError):
        pass
    _encoders[path] = encode
    return encode


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECES = "doc_id long, part int, piece int, start long, length int, ids_crc32 long, local_rank long"


def cut(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document, with the rank of each among equal lengths in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary_path(vocabulary))
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in shared.byte_slices(batches, "text"):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    out.append((doc_id, part, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), int(seen[b - a])))
                    seen[b - a] += 1
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "part", "piece", "start", "length", "ids_crc32", "local_rank"])

    return shared.keyed_text(docs).mapInArrow(run, PIECES)


def fullest(counts: list[int], room: int) -> dict[int, int]:
    """length -> copies of the fullest combination of available lengths that fits ``room``.

    Of combinations that fill it, one or two pieces come before more, so that short pieces last; otherwise longer lengths are tried first.
    """
    if room < len(counts) and counts[room]:
        return {room: 1}
    for length in range(min(room, len(counts) - 1), room // 2 - (room % 2 == 0), -1):
        rest = room - length
        if rest and counts[length] and counts[rest] > (rest == length):
            return {length: 2} if rest == length else {length: 1, rest: 1}
    reach, steps, goal = 1, [], (1 << (room + 1)) - 1
    for length in range(min(room, len(counts) - 1), 0, -1):
        left, many = min(counts[length], room // length), 1
        while left:
            take = min(many, left)
            grown = (reach | reach << (length * take)) & goal
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left, many = left - take, many * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(combination, bins that get it), until no piece is left."""
    counts = [0] * (capacity + 1)
    for length, n in histogram.items():
        counts[length] = n
    out, top = [], capacity
    while True:
        while top and not counts[top]:
            top -= 1
        if not top:
            return out
        counts[top] -= 1
        chosen = fullest(counts, capacity - top)
        counts[top] += 1
        chosen[top] = chosen.get(top, 0) + 1
        times = min(counts[length] // c for length, c in chosen.items())
        for length, c in chosen.items():
            counts[length] -= c * times
        out.append((chosen, times))


def places(bins: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """A row per combination and length: length, first rank, copies a bin, first bin, offset in the bin; sorted by length and rank."""
    rank: dict[int, int] = {}
    rows, first = [], 0
    for chosen, times in bins:
        offset = 0
        for length, c in sorted(chosen.items(), reverse=True):
            rows.append((length, rank.get(length, 0), c, first, offset))
            rank[length] = rank.get(length, 0) + c * times
            offset += length * c
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    scratch = shared.Scratch(docs.sparkSession)
    pieces = scratch.keep(cut(docs, vocabulary, capacity, end_id), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = places(plan(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select(F.col("part").alias("_part"), F.col("length").alias("_length"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(base, (pieces.part == base["_part"]) & (pieces.length == base["_length"])).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table[:, 0] << 48) + table[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            at = table[np.searchsorted(keys, (length << 48) + rank, side="right") - 1] if b.num_rows else np.zeros((0, 5), np.int64)
            within = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(at[:, 3] + within // at[:, 2] if b.num_rows else within), pa.array(at[:, 4] + within % at[:, 2] * length if b.num_rows else within)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
