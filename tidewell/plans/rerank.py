"""Hybrid search: candidate pools, weighted signals, superlative order, limits."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.text import fold
from ..operators import lexical, pool, vector
from ..settings import WEIGHTS, Settings
from ..sources import shared
from . import constraints, rewrite, signals, understand
from .lexicon import Lexicon, from_corpus


def override(plan: Column) -> Column:
    """Leading sort key (ascending) of a superlative; 0 without one. An unknown price or rating comes last."""
    level, rating = F.col("price_level").cast("double"), F.col("rating")
    by, up = plan["sort_by"], plan["sort_order"] == "asc"
    unknown = lambda c: F.when(c == 0, 999.0).otherwise(c)
    return F.when(by == "price", F.when(up, unknown(level)).otherwise(-level)).when(by == "rating", F.when(up, unknown(rating)).otherwise(-rating)).otherwise(0.0)


#: From places, plans and a number of candidates to query_id, id, rank and, if the channel has one, score.
Retriever = Callable[[DataFrame, DataFrame, int], DataFrame]


def weights_of(profile: str | dict[str, float]) -> dict[str, float]:
    return WEIGHTS[profile] if isinstance(profile, str) else profile


def weighted(rows: DataFrame, profile: str | dict[str, float], now: int = 720, extra: dict | None = None) -> DataFrame:
    """``rows`` (plan, place columns, normalised scores n_… of channels) plus a column per signal and ``total``, added in the profile's order."""
    place = F.struct(*[F.col(c) for c in ("category", "attributes", "city", "district", "rating", "popularity", "name", "brand", "lat", "lon", "price_level", "opening_hours")])
    known = signals.registry(now) | (extra or {})
    parts = weights_of(profile)
    for n in parts:
        rows = rows.withColumn(f"s_{n}", F.col(f"n_{n}") if f"n_{n}" in rows.columns else known[n](F.col("plan"), place))
    total = reduce(lambda a, b: a + b, [F.lit(w) * F.col(f"s_{n}") for n, w in parts.items()])
    return rows.withColumn("total", F.round(total, 6))


def ordered(rows: DataFrame) -> DataFrame:
    return pool.ranked(rows, override(F.col("plan")), F.desc("total"), F.col("poi_id"))


def with_user(plans: DataFrame, lat: float, lon: float) -> DataFrame:
    """The user's position stands in where a query names no place."""
    here = F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
    return plans.withColumn("plan", F.col("plan").withField("resolved_coord", F.coalesce(F.col("plan.resolved_coord"), here)))


def retrievers(vectors: DataFrame, conf: Settings = Settings()) -> dict[str, Retriever]:
    """The two channels of hybrid search; vectors: vec_id, embedding."""

    def words(corpus: DataFrame, plans: DataFrame, k: int) -> DataFrame:
        return lexical.bm25_topk(corpus, plans.select("query_id", "query"), "poi_id", "description", k, conf.bm25)

    def dense(corpus: DataFrame, plans: DataFrame, k: int) -> DataFrame:
        embedded = corpus.join(vectors.select("vec_id", "embedding"), "vec_id").select("poi_id", "city", "district", "category", "embedding")
        return vector.topk(embedded, plans.select("query_id", "plan", "qvec"), k, vector.prefilter(conf=conf.vectors), place="poi_id")

    return {"bm25": words, "dense": dense}


def hybrid(corpus: DataFrame, vectors: DataFrame, plans: DataFrame, profile: str | dict[str, float] = "with_dense", conf: Settings = Settings(), now: int = 720, channels: dict[str, Retriever] | None = None) -> DataFrame:
    """All candidates with signals, total and rank; corpus: places, vectors: vec_id, embedding, plans: query_id, query, plan, qvec.

    ``channels`` stand in for the usual two; a profile weighs them by name. One that gives ranks only scores by rank.
    """
    given = {n: find(corpus, plans, conf.search.pool) for n, find in (channels or retrievers(vectors, conf)).items()}
    given = {n: rows if "score" in rows.columns else rows.withColumn("score", pool.rank_score(F.col("rank"))) for n, rows in given.items()}
    found = pool.union(given, conf.search.pool)
    for n in given:
        found = found.withColumn(f"n_{n}", pool.normalised(F.col(n)))
    rows = found.join(corpus.drop("description"), F.col("id") == F.col("poi_id")).join(F.broadcast(plans.select("query_id", "plan")), "query_id")
    return ordered(weighted(rows, profile, now))


def lexical_only(corpus: DataFrame, plans: DataFrame, profile: str = "with_distance", conf: Settings = Settings(), now: int = 720, found: DataFrame | None = None) -> DataFrame:
    """Without vectors: the first candidates by BM25, their score divided by the best one's; ``found``: those, or more, if they are there already."""
    lex = found.where(F.col("rank") <= conf.search.candidates) if found is not None else lexical.bm25_topk(corpus, plans.select("query_id", "query"), "poi_id", "description", conf.search.candidates, conf.bm25)
    best = F.max("score").over(Window.partitionBy("query_id"))
    lex = lex.withColumn("n_bm25", F.col("score") / F.coalesce(F.nullif(best, F.lit(0.0)), F.lit(1.0))).select("query_id", "id", "n_bm25")
    rows = lex.join(corpus.drop("description"), F.col("id") == F.col("poi_id")).join(F.broadcast(plans.select("query_id", "plan")), "query_id")
    return ordered(weighted(rows, profile, now))


def displayed(profile: str | dict[str, float]) -> Column:
    """Score between 0 and 1: the total over the sum of weights."""
    return F.round(F.col("total") / F.lit(sum(weights_of(profile).values())), 4)


def search(corpus: DataFrame, vectors: DataFrame, plans: DataFrame, limit: int | None = None, category: str | None = None, box: tuple[float, float, float, float] | None = None, near: tuple[float, float, float] | None = None, profile: str | dict[str, float] = "with_dense", conf: Settings = Settings(), now: int = 720, channels: dict[str, Retriever] | None = None) -> DataFrame:
    """The API's results: filters work on the ranked list (they don't change ranks of what stays), then the limit.

    ``near``: latitude, longitude, metres.
    """
    s = conf.search
    most = min(limit or s.default_limit, s.most)
    if most < 1:
        raise ValueError("a limit is at least 1")
    rows = hybrid(corpus, vectors, plans, profile, conf, now, channels).where(F.col("rank") <= max(most, s.internal))
    if category:
        rows = rows.where(fold(F.col("category")) == fold(F.lit(category)))
    if box:
        rows = rows.where(geo.in_box(F.col("lat"), F.col("lon"), box))
    if near:
        rows = rows.where(geo.haversine_km(F.lit(near[0]), F.lit(near[1]), F.col("lat"), F.col("lon")) * 1000 <= near[2])
    w = Window.partitionBy("query_id").orderBy("rank")
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).withColumn("score", displayed(profile))


class Engine:
    """Search from text: lexicon and vocabulary from the corpus, plans from the queries, results from :func:`search`.

    ``places``: as :func:`tidewell.sources.corpus.places` gives them (without a ``document`` column, ``description`` is searched).
    ``encode`` makes vectors of texts; ``store``: where those of places are kept, else they are made once, when first asked for.
    """

    def __init__(self, places: DataFrame, base: Lexicon | None = None, encode=None, store: vector.VectorStore | None = None, conf: Settings = Settings()):
        self.conf, self.encode = conf, encode or vector.encoder()
        self.lexicon = from_corpus(places, base)
        self.vocabulary = rewrite.of_corpus(places, self.lexicon, conf.rewrite).kept()
        text = "document" if "document" in places.columns else "description"
        corpus = places.drop("vec_id").withColumn("description", F.col(text)).withColumn("vec_id", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
        self.corpus, self.store = corpus, store

    @cached_property
    def vectors(self) -> DataFrame:
        """vec_id, embedding of the places; plans and searches by words don't need them."""
        spark = self.corpus.sparkSession
        if self.store is None:
            self.store = vector.VectorStore(spark, f"{shared.folder(spark)}/vectors")
            self.store.recreate(self.corpus, lambda t: self.encode(F.concat(F.lit("passage: "), t)), "description")
        return self.store.read().withColumnRenamed("digest", "vec_id")

    def plans(self, queries: DataFrame, user: tuple[float, float] | None = None, **options) -> DataFrame:
        """query_id, query, plan, qvec of (query_id, query)."""
        found = understand.plans(queries, self.lexicon, self.conf, self.vocabulary, **options)
        found = with_user(found, *user) if user else found
        found = found.withColumn("query", F.col("plan.query"))
        accented = rewrite.restored(found.select("query_id", F.col("query").alias("text")), self.vocabulary.forms, self.conf.rewrite)
        found = found.join(accented, "query_id").withColumn("qvec", self.encode(F.concat(F.lit("query: "), "text"))).drop("text")
        return shared.kept(found, f"{shared.folder(queries.sparkSession)}/plans")

    def search(self, queries: DataFrame, limit: int | None = None, user: tuple[float, float] | None = None, now: int = 720, profile: str | dict[str, float] = "with_dense", filters: dict | None = None, channels: dict[str, Retriever] | None = None, **options) -> DataFrame:
        """The best places of each query with place, score, signals and constraints met and relaxed."""
        rows = search(self.corpus, self.vectors, self.plans(queries, user, **options), limit, profile=profile, conf=self.conf, now=now, channels=channels, **(filters or {}))
        return constraints.annotate(rows, now, conf=self.conf.constraints)


def ladder(corpus: DataFrame, vectors: DataFrame, plans: DataFrame, k: int = 10, conf: Settings = Settings(), now: int = 720) -> dict[str, DataFrame]:
    """Rankings (query_id, id, rank) of the steps of an ablation: words only, with rules, with distance, with vectors."""
    most = max(k, conf.search.candidates, conf.search.pool)
    found = lexical.bm25_topk(corpus, plans.select("query_id", "query"), "poi_id", "description", most, conf.bm25)
    found = shared.kept(found, f"{shared.folder(corpus.sparkSession)}/words")  # the best few hold for every smaller number
    words = found.where(F.col("rank") <= k).select("query_id", "id", "rank")
    top = lambda rows: rows.where(F.col("rank") <= k).select("query_id", F.col("poi_id").alias("id"), "rank")
    channels = retrievers(vectors, conf) | {"bm25": lambda _corpus, _plans, n: found.where(F.col("rank") <= n)}
    return {"bm25": words, "rules": top(lexical_only(corpus, plans, "default", conf, now, found)), "distance": top(lexical_only(corpus, plans, "with_distance", conf, now, found)), "dense": top(hybrid(corpus, vectors, plans, "with_dense", conf, now, channels))}
