"""Cosine retrieval over array columns, label search, and hashed n-gram encoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..settings import Vectors


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def topk(rows: DataFrame, queries: DataFrame, k: int, keep: Column | None = None, place: str = "id", vector: str = "embedding") -> DataFrame:
    """query_id, id, score, rank; ``queries``: query_id, qvec and whatever ``keep``, the pre-filter, refers to."""
    pairs = rows.join(F.broadcast(queries), keep if keep is not None else F.lit(True))
    scored = pairs.select("query_id", F.col(place).alias("id"), F.round(dot(F.col("qvec"), F.col(vector)), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Queries and rows of a tile at most, on average; scores of a tile that are held at once.
TILE_QUERIES, TILE_ROWS, TILE_SCORES = 16_384, 16_384, 1 << 22


def nearest(rows: DataFrame, queries: DataFrame, k: int, place: str = "id", vector: str = "embedding", tile: tuple[int, int] = (TILE_QUERIES, TILE_ROWS)) -> DataFrame:
    """What :func:`topk` gives for every query against all rows but itself, for many queries; ids are longs, without copies.

    Queries and rows are dealt into tiles by hash. A task holds one tile and sends on the best k of each query in it, so neither
    a broadcast nor the shuffle of scores grows with the number of pairs.
    """

    def dealt(df: DataFrame, key: str, size: int) -> tuple[Column, Column]:
        n = df.agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1))).scalar()  # a subquery: nothing runs yet
        return F.pmod(F.xxhash64(key), n), F.explode(F.sequence(F.lit(0).cast("long"), n - 1))

    queries = queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), "qvec")
    rows = rows.where(F.col(place).isNotNull()).select(F.col(place).cast("long").alias("id"), F.col(vector).alias("vec"))
    (shard, shards), (block, blocks) = dealt(queries, "query_id", tile[0]), dealt(rows, "id", tile[1])
    left = rows.select("id", "vec", block.alias("block"), shards.alias("shard")).groupBy("block", "shard")
    right = queries.select("query_id", "qvec", blocks.alias("block"), shard.alias("shard")).groupBy("block", "shard")
    best = left.cogroup(right).applyInArrow(lambda r, q: best_of_tile(r, q, k), "query_id long, id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def by_length(vectors: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> (places, matrix) of the vectors without gaps; all others score null with anything."""
    lists = vectors.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    n, flat, ends = len(lists), lists.values, lists.offsets.to_numpy()
    starts, sizes = ends[:-1], np.diff(ends)
    gap = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    whole = lists.is_valid().to_numpy(zero_copy_only=False) & (gap[starts + sizes] == gap[starts])
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return {int(size): (at, values[starts[at][:, None] + np.arange(size)]) for size in np.unique(sizes[whole]) for at in [np.flatnonzero(whole & (sizes == size))]} if n else {}


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Rounded as Spark does it: half up, by the shortest decimal form."""
    scale = 10.0**digits
    with np.errstate(invalid="ignore", over="ignore"):
        y = np.abs(x) * scale
        out = np.where(y < 2**52, np.copysign(np.floor(y + 0.5), x) / scale + 0.0, x)
        close = np.flatnonzero((y < 2**52) & (np.abs(y - np.floor(y) - 0.5) <= 1e-9 * np.maximum(y, 1.0)))
    for i in close:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) + 0.0
    return out


def best_of_tile(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """query_id, id, score: the best k of each query in a tile by (-score, id), itself left out.

    A matrix product finds who can be among them; their scores are added up again in the order of the vectors, as :func:`dot` does.
    """
    rows = rows.sort_by("id")
    ids, asked = rows["id"].to_numpy(), queries["query_id"].to_numpy()
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))]  # the last: score is null
    mine, theirs = by_length(queries["qvec"]), by_length(rows["vec"])
    none, short = (np.zeros(0, np.int64), None), np.full(len(asked), True)
    for size, (at, q) in mine.items():
        where, r = theirs.get(size, none)
        if not len(where):
            continue
        own, qt, rt = ids[where], np.ascontiguousarray(q.T), np.ascontiguousarray(r.T)
        short[at] = len(own) - np.isin(asked[at], own) < k
        step = max(1, TILE_SCORES // len(own))
        for a in range(0, len(at), step):
            given = asked[at[a : a + step]]
            s = np.nan_to_num(q[a : a + step] @ rt, copy=False, nan=np.inf, posinf=np.inf, neginf=-np.inf)
            self = np.minimum(np.searchsorted(own, given), len(own) - 1)
            same = np.flatnonzero(own[self] == given)
            s[same, self[same]] = -np.inf
            least = np.partition(s, len(own) - k, axis=1)[:, len(own) - k] if len(own) > k else np.full(len(given), -np.inf)
            slack = np.where(np.isfinite(least), 2e-6 + 1e-9 * np.abs(least), 0.0)
            i, j = np.nonzero(s >= (least - slack)[:, None])
            other = own[j] != given[i]
            i, j = i[other], j[other]
            exact = np.zeros(len(i))
            for d in range(size):
                exact += qt[d, a + i] * rt[d, j]
            exact = rounded(exact)
            order = np.lexsort((j, -np.nan_to_num(exact, nan=np.inf), i))
            i, j, exact = i[order], j[order], exact[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            out.append((given[i[first]], own[j[first]], exact[first], np.zeros(int(first.sum()), bool)))
    for at in np.flatnonzero(short):  # fewer than k with a score: the others follow by id
        size = next((n for n, (places, _) in mine.items() if at in places), None)
        rest = np.delete(ids, theirs.get(size, none)[0])
        rest = rest[rest != asked[at]][:k]
        out.append((np.full(len(rest), asked[at]), rest, np.zeros(len(rest)), np.ones(len(rest), bool)))
    given, found, score, unknown = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"query_id": pa.array(given, pa.int64()), "id": pa.array(found, pa.int64()), "score": pa.array(score, pa.float64(), mask=unknown)})


def prefilter(place: str = "p", conf: Vectors = Vectors()) -> Column:
    """City and district, where given, must be equal; the category one of the plan's, or else of those with enough weight."""
    heavy = F.map_keys(F.map_filter("plan.category_weights", lambda _, w: w >= conf.least_weight))
    names = F.when(F.size("plan.categories") > 0, F.col("plan.categories")).otherwise(heavy)
    eq = lambda f: F.col(f"plan.{f}").isNull() | (F.col(f) == F.col(f"plan.{f}"))
    return eq("city") & eq("district") & ((F.size(names) == 0) | F.array_contains(names, F.col("category")))


def centroids(rows: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, lvec: the normalised mean vector of each label."""
    mean = rows.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    vec = mean.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return vec.select(label, F.transform("v", lambda x: x / norm).alias("lvec"))


def label_scores(queries: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """query_id, label, score of every query with every label; labels are few."""
    return queries.join(F.broadcast(labels)).select("query_id", label, *[c for c in labels.columns if c not in (label, "lvec")], F.round(dot(F.col("qvec"), F.col("lvec")), 6).alias("score"))


def label_radius(queries: DataFrame, labels: DataFrame, threshold: float, most: int = 2) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "label")
    return label_scores(queries, labels).where(F.col("score") >= threshold).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def label_argmax(queries: DataFrame, labels: DataFrame) -> DataFrame:
    best = F.max_by("label", F.struct("score", -F.col("label")))
    return label_scores(queries, labels).groupBy("query_id").agg(best.alias("label"), F.max("score").alias("score"))


def joint_weights(queries: DataFrame, labels: DataFrame, floor: float, most: int = 2) -> DataFrame:
    """query_id, namespace, label, weight: the best labels of each namespace above a noise floor, stretched to [0, 1]."""
    w = Window.partitionBy("query_id", "namespace").orderBy(F.desc("score"), "label")
    best = label_scores(queries, labels).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    weight = F.greatest(F.lit(0.0), (F.col("score") - floor) / (1 - floor))
    return best.withColumn("weight", F.round(weight, 6)).where("weight > 0").select("query_id", "namespace", "label", "weight")


def merge_weights(a: Column, b: Column) -> Column:
    """Per key the larger of two maps' weights."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(x, y))


#: Characters that are hashed at once.
RUN = 1 << 16


def hashed_ngrams(dim: int = 256, n: int = 3) -> Callable[[str], np.ndarray]:
    """The offline encoder: character n-grams hashed into ``dim`` places, unit length."""

    def encode(text: str) -> np.ndarray:
        codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        size, out = max(1, len(codes) - n + 1), np.zeros(dim, np.int64)
        for a in range(0, size, RUN):  # in runs, so that memory doesn't follow the text
            h = np.zeros(min(RUN, size - a), np.uint64)
            for k in range(min(n, len(codes))):
                h = (h + codes[a + k : a + k + len(h)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out += np.bincount((h >> np.uint64(40)) % np.uint64(dim), minlength=dim)
        out = out.astype(np.float32)
        return out / np.linalg.norm(out)

    return encode


def encoder(make: Callable[[], Callable[[str], np.ndarray]] = hashed_ngrams, prefix: str = ""):
    """A column function text -> vector; ``make`` runs once per Python worker, so a model is loaded there once."""

    @F.arrow_udf("array<float>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = make()
        for texts in batches:
            vectors = [np.nan_to_num(np.asarray(run(prefix + (t.as_py() or "")), np.float32)) for t in texts]  # one text at a time is held as a string
            ends = np.concatenate([[0], np.cumsum([len(v) for v in vectors])]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*vectors, np.zeros(0, np.float32)])))

    return encode


class VectorStore:
    """Vectors of texts by the texts' hash, as Parquet in a shared folder; batches of new ones are appended."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """digest, embedding."""
        return self.spark.read.schema("digest string, embedding array<float>").parquet(self.path)

    def recreate(self, corpus: DataFrame, encode: Callable[[Column], Column], text_col: str = "text") -> None:
        """All texts anew; each different text is encoded once."""
        self._encoded(corpus, encode, text_col).write.mode("overwrite").parquet(self.path)

    def append(self, corpus: DataFrame, encode: Callable[[Column], Column], text_col: str = "text") -> None:
        """Vectors of the texts that have none yet."""
        self._encoded(missing_vectors(corpus, self.read(), text_col), encode, text_col).write.mode("append").parquet(self.path)

    @staticmethod
    def _encoded(corpus: DataFrame, encode: Callable[[Column], Column], text_col: str) -> DataFrame:
        text = F.coalesce(F.col(text_col), F.lit(""))
        each = corpus.groupBy(F.sha2(text, 256).alias("digest")).agg(F.min(text).alias("t"))
        return each.select("digest", encode(F.col("t")).alias("embedding"))

    def attach(self, corpus: DataFrame, text_col: str = "text") -> DataFrame:
        """``corpus`` with its vectors."""
        return corpus.withColumn("_d", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).join(self.read(), F.col("_d") == F.col("digest"), "left").drop("_d", "digest")


def missing_vectors(corpus: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows whose text has no vector yet, by the text's hash; ``known``: digest."""
    return corpus.withColumn("digest", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).join(known.select("digest").distinct(), "digest", "left_anti")
