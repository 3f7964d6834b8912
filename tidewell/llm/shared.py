"""Helpers that the operators of this subpackage have in common.

Text rules.  A *word* is a maximal run of characters other than ``\\x20`` and
``\\x09``-``\\x0D``; :meth:`bytes.split` without arguments cuts UTF-8 at exactly these
bytes and :meth:`bytes.lower` lower-cases exactly A-Z, so Python stages work on bytes.

Intermediate tables.  :class:`Scratch` writes them as Parquet below
``spark.checkpoint.dir``, the one folder that the driver and all executors share, and
reads them again: that cuts lineage, survives the loss of an executor and fixes the
rows for every later pass.  A result reads some of them when it is computed, so what an operator hasn't dropped itself
stays as long as the application; its end removes all.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as SQL sees them (the complement of the six separators).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(column):
    """Lower-case A-Z only."""
    return F.translate(column, UPPER, LOWER)


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that matter, under names of our own; other columns can't clash."""
    reachable(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def reachable(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package from where the driver has it (clusters get it by --py-files)."""
    environment = spark.sparkContext.environment
    here = str(Path(__file__).resolve().parents[2])
    if here not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [here, environment.get("PYTHONPATH", "")]))


#: Text behind one shuffle partition, at most, where a shuffle carries about as much as the text.
PARTITION_BYTES = 1 << 30


def parts_for(spark: SparkSession, size: int) -> int | None:
    """Partitions that ``size`` bytes need; None if the session's shuffle partitions do."""
    needed = -(-size // PARTITION_BYTES)
    return needed if needed > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame, size: int, *columns: str) -> DataFrame:
    """``df`` dealt by ``columns`` into as many partitions as ``size`` bytes need, the session's number at least."""
    parts = parts_for(df.sparkSession, size)
    return df.repartition(parts, *columns) if parts else df.repartition(*columns)  # without a number, small partitions may be joined


class Scratch:
    """Parquet tables in the shared checkpoint folder; ``drop`` removes those no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
            root = tempfile.mkdtemp(prefix="tidewell-")
            if spark.sparkContext.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        self.root = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        if jvm := getattr(spark, "_jvm", None):
            where = jvm.org.apache.hadoop.fs.Path(self.root)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            if path := self.paths.pop(name, None):
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of ``column``, so that memory doesn't follow text length."""
    for batch in batches:
        col = batch.column(column)
        if batch.num_rows == 0:
            continue
        sizes = np.array(pc.fill_null(pc.binary_length(col), 0).cast("int64"))
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def raw_texts(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """Word bytes -> 64-bit hash, remembered up to ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        from xxhash import xxh3_64_intdigest

        super().__init__()
        self.limit, self.digest = limit, xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = h = self.digest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, from the words' hashes; order matters."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = mix64(h[: len(h) - n + 1])
    for k in range(1, n):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches cut at group borders, from rows sorted by ``key``: no group is split between two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(key)
        last = keys[batch.num_rows - 1]
        same = pc.equal(keys, last).to_numpy(zero_copy_only=False)
        border = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if border == 0 and (not held or held[-1].column(key)[held[-1].num_rows - 1].equals(last)):
            held.append(batch)
            continue
        if border == 0:
            yield joined(held)
            held = [batch]
            continue
        yield joined([*held, batch.slice(0, border)])
        held = [batch.slice(border)]
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(batches) == 1:
        return batches[0]
    table = pa.Table.from_batches(batches).combine_chunks()
    return table.to_batches()[0]


class Forest:
    """Union-find over integers; the smaller root wins."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        top = x
        while up.get(top, top) != top:
            top = up[top]
        while up.get(x, x) != top:
            up[x], x = top, up[x]
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def tables(spark: SparkSession, sf_dir: str, *names: str):
    out = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
    return out[0] if len(out) == 1 else out
