"""Query rewriting in DataFrame steps: abbreviations, accents, typos.

Each step takes and gives (query_id, text).  What is looked up are tables made from the phrases of a lexicon or of a whole
corpus (:class:`Vocabulary`); a query only meets the entries that its own words or their deletion variants select, by joins, so
no dictionary is held in memory.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold, fold_text, has_marks, letter_words, ngrams, once
from ..operators.joins import edit1_pairs
from ..settings import Rewrite
from ..sources import shared
from .lexicon import GRAMMAR, STOP_WORDS, Lexicon, accent_votes, first_wins

#: Marks that may stand at the edges of a word.
EDGE = re.escape(".,;:!?()\"'")
NO_WORD_AROUND = (r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])")


@dataclass(frozen=True)
class Vocabulary:
    """forms: key, value (folded words and phrases with their usual accented form); targets: key, value (first form of each folded
    word); accented: value; known: key (words that are no typos); pairs: left, right (folded neighbours within phrases)."""

    forms: DataFrame
    targets: DataFrame
    accented: DataFrame
    known: DataFrame
    pairs: DataFrame

    def kept(self) -> Vocabulary:
        """The same tables, written: many joins read them, and none should make them again."""
        root = shared.folder(self.forms.sparkSession)
        return Vocabulary(**{f.name: shared.kept(getattr(self, f.name), f"{root}/{f.name}") for f in fields(self)})


def vocabulary(phrases: DataFrame, also_known: DataFrame | None = None, conf: Rewrite = Rewrite()) -> Vocabulary:
    """Tables from phrases (o: their order, phrase); ``also_known``: word, in any form."""
    rows = phrases.select("o", F.lower("phrase").alias("phrase"), letter_words(F.lower(F.col("phrase"))).alias("w"))
    words = rows.select("o", F.posexplode("w").alias("i", "value")).withColumn("key", fold(F.col("value"))).withColumn("at", F.struct("o", "i"))
    whole = rows.where(F.size("w").between(2, conf.max_gram)).select("o", F.array_join("w", " ").alias("value"))
    whole = whole.groupBy("value").agg(F.count("*").alias("n"), F.min("o").alias("o")).withColumn("key", fold(F.col("value")))
    best = whole.groupBy("key").agg(F.min_by("value", F.struct(-F.col("n"), "o")).alias("value"))
    forms = accent_votes(phrases, "phrase", "o").select("key", "value").unionByName(best)
    targets = first_wins(words, "key", "value", "at")
    extra = phrases.sparkSession.createDataFrame([(w,) for w in sorted({fold_text(w) for w in [*GRAMMAR, *STOP_WORDS]})], "key string")
    known = targets.select("key").unionByName(extra)
    if also_known is not None:
        known = known.unionByName(also_known.select(fold(F.col("word")).alias("key")))
    pairs = rows.select(F.explode(ngrams(F.transform("w", fold), 2)).alias("g")).distinct().select(F.split("g", " ")[0].alias("left"), F.split("g", " ")[1].alias("right"))
    return Vocabulary(forms, targets, words.select("value").distinct(), known.distinct(), pairs)


def of_lexicon(spark: SparkSession, lexicon: Lexicon | None = None, conf: Rewrite = Rewrite()) -> Vocabulary:
    rows = list(enumerate((lexicon or Lexicon()).phrases()))
    return vocabulary(spark.createDataFrame(rows, "o long, phrase string"), conf=conf)


def of_corpus(places: DataFrame, lexicon: Lexicon, conf: Rewrite = Rewrite()) -> Vocabulary:
    """The phrases of a lexicon first, then names, categories, districts, cities and attributes of the corpus; words of descriptions are known."""
    own = places.sparkSession.createDataFrame([("", k, p) for k, p in enumerate(lexicon.phrases())], "id string, k int, phrase string")
    parts = F.concat(F.array(*[F.coalesce(c, F.lit("")) for c in ("name", "category", "district", "city")]), "attributes")
    theirs = places.select(F.col("poi_id").alias("id"), F.posexplode(parts).alias("k", "phrase"))
    both = own.unionByName(theirs).where("phrase <> ''")
    phrases = both.select(F.concat_ws(":", "id", F.lpad(F.col("k").cast("string"), 9, "0")).alias("o"), "phrase")  # the lexicon's sort first
    return vocabulary(phrases, places.select(F.explode(letter_words(F.col("description"))).alias("word")).distinct(), conf)


def expanded(text: Column, abbreviations: dict[str, str]) -> Column:
    """q1 to q99 as districts, then every abbreviation that stands alone, in any case."""
    before, after = NO_WORD_AROUND
    out = F.regexp_replace(text, before + r"[qQ](\d{1,2})" + after, "quận $1")
    for short, full in abbreviations.items():
        out = F.regexp_replace(out, f"(?iu){before}\\Q{short}\\E{after}", full)
    return out


def restored(queries: DataFrame, forms: DataFrame, conf: Rewrite = Rewrite()) -> DataFrame:
    """Accents for texts without any: from left to right the longest known phrase, else the word's usual form.

    A text stays as it is if fewer than ``min_coverage`` of its words would change.  Each different text is walked once; only texts
    that change are joined with the queries.
    """
    bare = (F.trim("text") != "") & ~has_marks(F.col("text"))
    rows = queries.select("text").distinct().select("text", F.when(bare, folded_words(F.col("text"))).alias("w"))  # a filter would go below the distinct
    grams = rows.select("text", F.explode(F.array_distinct(F.concat(*[ngrams(F.col("w"), n) for n in range(1, conf.max_gram + 1)]))).alias("key"))
    found = grams.join(forms, "key").groupBy("text").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("forms"))
    new = once(folded_words(F.col("text")), lambda w: walked(w, F.col("forms"), conf))
    changed = found.select("text", new.alias("new")).where("new is not null")
    return queries.join(changed, "text", "left").select("query_id", F.coalesce("new", "text").alias("text"))


def folded_words(text: Column) -> Column:
    return F.split(F.trim(fold(text)), r"\s+")


def walked(w: Column, forms: Column, conf: Rewrite) -> Column:
    """The words with accents, from left to right, or null if too few of them change; forms: a map."""

    def at(i: Column, n: int) -> Column:
        run = F.slice(w, i + 1, n)
        changed = lambda value: F.size(F.filter(F.zip_with(F.split(value, " "), run, lambda a, b: a != b), lambda x: x))
        hit = lambda value: F.when(value.isNotNull(), F.struct(F.lit(n).alias("n"), value.alias("value"), changed(value).alias("changed")))
        return F.when(i + n <= F.size(w), once(F.try_element_at(forms, F.array_join(run, " ")), hit))

    def step(acc: Column, i: Column) -> Column:
        as_is = F.struct(F.lit(1).alias("n"), F.get(w, i).alias("value"), F.lit(0).alias("changed"))
        taken = lambda hit: F.struct((hit["n"] - 1).alias("skip"), F.concat(acc["out"], F.array(hit["value"])).alias("out"), (acc["changed"] + hit["changed"]).alias("changed"))
        passed = F.struct((acc["skip"] - 1).alias("skip"), acc["out"].alias("out"), acc["changed"].alias("changed"))
        return F.when(acc["skip"] > 0, passed).otherwise(once(F.coalesce(*[at(i, n) for n in range(conf.max_gram, 0, -1)], as_is), taken))

    start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("out"), F.lit(0).alias("changed"))
    letters = F.greatest(F.size(F.filter(w, lambda x: x.rlike(r"^\p{L}+$"))), F.lit(1))
    enough = lambda end: F.when(end["changed"] / letters >= conf.min_coverage, F.array_join(end["out"], " "))
    return F.aggregate(F.sequence(F.lit(0), F.size(w) - 1), start, step, enough)


def resolved(rows: DataFrame, v: Vocabulary) -> DataFrame:
    """query_id, pos, fixed: the one word an edit away from ``core`` (accented words among accented ones, others among folded ones).

    Of several, the one that forms a known pair with a neighbour; without a single one left, no row.
    """
    rows = rows.withColumn("marked", has_marks(F.col("core"))).withColumn("token", F.when(F.col("marked"), F.lower("core")).otherwise(fold(F.col("core"))))
    exact = edit1_pairs(rows.where("marked").select("token"), v.accented.select(F.col("value").alias("candidate"))).select("token", F.col("candidate").alias("value"), F.lit(True).alias("marked"))
    loose = edit1_pairs(rows.where("not marked").select("token"), v.targets.select(F.col("key").alias("candidate"))).join(v.targets, F.col("candidate") == F.col("key")).select("token", "value", F.lit(False).alias("marked"))
    found = rows.join(exact.unionByName(loose), ["token", "marked"]).select("query_id", "pos", "before", "after", "value").distinct().withColumn("key", fold(F.col("value")))
    left, right = v.pairs.select(F.col("left").alias("before"), F.col("right").alias("key"), F.lit(True).alias("follows")), v.pairs.select(F.col("left").alias("key"), F.col("right").alias("after"), F.lit(True).alias("leads"))
    found = found.join(left, ["before", "key"], "left").join(right, ["key", "after"], "left").withColumn("fits", F.coalesce("follows", "leads", F.lit(False)))
    one = found.groupBy("query_id", "pos").agg(F.count("*").alias("n"), F.min("value").alias("any"), F.count_if("fits").alias("n_fit"), F.min(F.when(F.col("fits"), F.col("value"))).alias("fit"))
    return one.select("query_id", "pos", F.when(F.col("n") == 1, F.col("any")).when(F.col("n_fit") == 1, F.col("fit")).alias("fixed")).where("fixed is not null")


def corrected(queries: DataFrame, v: Vocabulary, conf: Rewrite = Rewrite()) -> DataFrame:
    """Single typos mended; a trailing letter that no syllable ends in may be dropped first. Known, short and other than letter words stay."""
    if not conf.typo_fix:
        return queries.select("query_id", "text")
    words = queries.select("query_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "token"))
    words = words.withColumn("core", F.regexp_replace("token", f"^[{EDGE}]+|[{EDGE}]+$", "")).withColumn("key", fold(F.col("core")))
    order = Window.partitionBy("query_id").orderBy("pos")
    words = words.withColumn("before", F.lag("key").over(order)).withColumn("after", F.lead("key").over(order))
    odd = words.where((F.char_length("core") >= conf.min_token) & F.col("core").rlike(r"^\p{L}+$")).join(v.known, "key", "left_anti")
    one = resolved(odd, v)
    last = F.lower(F.expr("right(core, 1)"))
    longer = odd.join(one, ["query_id", "pos"], "left_anti").where((F.char_length("core") >= conf.junk_min_token) & last.isin(*conf.junk))
    cut = longer.withColumn("core", F.expr("left(core, char_length(core) - 1)")).withColumn("key", fold(F.col("core")))
    plain = cut.join(v.known, "key").join(v.targets, "key", "left").select("query_id", "pos", F.coalesce("value", "core").alias("fixed"))
    fixes = one.unionByName(plain).unionByName(resolved(cut.join(v.known, "key", "left_anti"), v))
    out = words.join(fixes, ["query_id", "pos"], "left").withColumn("token", F.when(F.col("fixed").isNotNull(), F.replace("token", "core", "fixed")).otherwise(F.col("token")))
    return out.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("text"))


def preprocess(queries: DataFrame, v: Vocabulary, abbreviations: dict[str, str], conf: Rewrite = Rewrite()) -> DataFrame:
    """All three steps, once for each different text; null texts stay null. Accented texts are written, as the typo step reads them several times."""
    root = shared.folder(queries.sparkSession)
    # Written, as filters of the steps would otherwise rewrite every row before copies are left out.
    texts = shared.kept(queries.where("text is not null").select(F.col("text").alias("query_id")).distinct(), f"{root}/texts")
    full = texts.select("query_id", expanded(F.col("query_id"), abbreviations).alias("text"))
    accented = shared.kept(restored(full, v.forms, conf), f"{root}/accented")
    new = corrected(accented, v, conf).select(F.col("query_id").alias("_given"), F.col("text").alias("_new"))
    return queries.join(new, F.col("text") == F.col("_given"), "left").select("query_id", F.col("_new").alias("text"))
