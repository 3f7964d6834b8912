"""Language identification by Bayesian evidence fusion.

For each row the log-likelihoods of four sources add up:

* text: byte-trigram multinomials per language, hashed into ``BUCKETS``, trained on at most ``SAMPLE`` documents per
  language (those with the smallest hashes of their ids); evidence of long texts is scaled to ``EVIDENCE`` trigrams, as
  neighbouring trigrams aren't independent;
* declared markup language: right with a probability that is estimated over all rows that have both a declaration and a text;
* address suffix: the suffix is the top level of a hierarchy of priors; a suffix that is itself a language's country code
  also counts as a weak declaration;
* host: priors from grouped aggregation over all rows, smoothed from suffix to domain to host (each level adds its counts
  to ``STRENGTH`` virtual rows of the level above, the suffix to those of the whole table).  A row's own evidence is taken out of
  the counts of all four levels first, so that it counts once.

Hosts are aggregated in the tasks that read them.  Those with more than ``HEAVY`` of all rows (at most 1 / HEAVY hosts)
are joined by broadcast, all others by key, so a host with a third of all rows makes no task of its own.
Every language that occurs in the training table is a class; over ``MOST_CLASSES`` values raise an error.

Rows without text (white space only counts as none), declaration or host use what they have; one without anything gets the
table's prior.  Of equally likely languages the alphabetically first wins.  Rows are judged one by one, so repeated rows
get equal answers, each counting once for its host.  Texts and pages of any length are read whole.  Every input row gives one
output row; an empty training table gives null languages, an empty input an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .winnowing import let

BUCKETS, SAMPLE, EVIDENCE, STRENGTH, HEAVY = 1 << 15, 400, 60.0, 5.0, 1e-3
#: More values of documents.lang than this are an error, never a cut (ISO 639-1 has fewer codes).
MOST_CLASSES = 256
#: Country suffixes that go with a language (fixed values).
COUNTRY = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}


def trigrams(text: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text, digits and ASCII marks taken as spaces."""
    raw = np.frombuffer(b" " + text.lower().translate(FOLD) + b" ", np.uint8).astype(np.uint32)
    code = raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(17)


FOLD = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def train(documents: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and log-probabilities (languages x BUCKETS); documents: doc_id, text, lang."""
    known = documents.where("lang is not null and text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if len(langs) > MOST_CLASSES:
        raise ValueError(f"documents.lang has {len(langs)} values; the model holds at most {MOST_CLASSES} languages, and none is left out silently")
    counts = np.full((len(langs), BUCKETS), 0.05)
    # A cut-off on the hash leaves little more than SAMPLE ids of each language to rank, whatever its share of the rows.
    rank, most = F.xxhash64("doc_id"), F.lit(1 << 40)
    for lang, n in sizes.items():
        most = F.when(F.col("lang") == lang, F.lit(math.ceil(min(1.0, 2 * SAMPLE / n) * (1 << 40)))).otherwise(most)
    few = known.where(F.shiftrightunsigned(rank.bitwiseXOR(F.lit(-(2**63))), 24) < most).select("lang", "doc_id").distinct()
    order = Window.partitionBy("lang").orderBy(rank, "doc_id")
    sample = few.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE).drop("r")
    place = {lang: k for k, lang in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shared.byte_slices(batches, "text"):
            codes = [place[x] * BUCKETS + trigrams(t).astype(np.int64) for x, t in zip(b.column("lang").to_pylist(), shared.raw_texts(b.column("text")), strict=True)]
            if codes:
                at, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["at", "n"])

    rows = known.join(F.broadcast(sample), ["doc_id", "lang"]).select("lang", "text").mapInArrow(run, "at long, n long")
    found = rows.groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows a language
    counts.reshape(-1)[found.column("at").to_numpy()] += found.column("n").to_numpy()
    return langs, np.log(counts / counts.sum(1, keepdims=True)) if langs else counts


def likelihoods(rows: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """``rows`` with ll: the scaled log-likelihood of the text by language, zeros without a text."""
    kept = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.ascontiguousarray(model.T)
        for b in shared.byte_slices(batches, "text"):
            out = np.zeros((b.num_rows, len(langs)))
            for i, t in enumerate(shared.raw_texts(b.column("text"))):
                if t and t.strip():
                    found = trigrams(t)
                    out[i] = np.bincount(found, minlength=BUCKETS) @ table * min(1.0, EVIDENCE / len(found))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * len(langs), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), flat], names=[*kept, "ll"])

    schema = rows.select(*kept).withColumn("ll", F.array(F.lit(0.0))).schema
    return rows.mapInArrow(run, schema)


def text_of(html: Column) -> Column:
    """Visible text of a page: without scripts, styles, comments and tags."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(out, r"&[#A-Za-z0-9]+;", " ")


def declared_of(html: Column) -> Column:
    """Primary subtag of the html element's own lang attribute (not data-lang, xml:lang or a part of a value), lower-cased."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?is)<html(?=\s)(?:\s+(?!lang[\s=])[^\s=>]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>"']+))?)*\s+lang\s*=\s*["']?\s*([A-Za-z]{2,3})(?![A-Za-z])""", 1)), F.lit(""))


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    powers = F.transform(values, lambda v: F.exp(v - top))
    return F.transform(powers, lambda v: v / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


LEVELS = ("suffix", "domain", "host")


def host_counts(rows: DataFrame, n: int, scratch: shared.Scratch) -> DataFrame:
    """suffix, domain, host, rows and the sums of p over each of the three levels (s1, s2, s3); one row per host."""
    at = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(n)])
    hosts = scratch.keep(rows.groupBy(*LEVELS).agg(F.count("*").alias("rows"), at("p").alias("s3")), "hosts")
    for depth in (2, 1):
        keys = LEVELS[:depth]
        above = hosts.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(at("s3").alias(f"s{depth}"))
        hosts = hosts.join(above, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys])
    return scratch.keep(hosts.withColumnsRenamed({k: f"_{k}" for k in LEVELS}), "counts")


def without_own(sums: Column, p: Column, prior: Column, strength: float) -> Column:
    """Shares from ``sums`` without the row's own ``p``, smoothed by ``strength`` virtual rows of ``prior``."""
    own = F.zip_with(sums, p, lambda s, x: F.greatest(s - x, F.lit(0.0)))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
    return let(own, lambda o: F.zip_with(o, prior, lambda s, x: (s + strength * x) / (total(o) + strength)))


def fused(rows: DataFrame, langs: list[str], scratch: shared.Scratch) -> DataFrame:
    """``rows`` (with ll, declared, suffix, domain, host) plus lang, confidence, text_lang."""
    lang = F.array(*[F.lit(x) for x in langs])
    n = float(len(langs))
    best = lambda v: F.element_at(lang, F.array_position(v, F.array_max(v)).cast("int"))
    both = rows.where("has_text and declared is not null").agg(F.sum((F.col("declared") == best(F.col("ll"))).cast("double")).alias("k"), F.count("*").alias("n")).first()
    right = min(0.99, max(0.5, ((both["k"] or 0.0) + 3.0) / (both["n"] + 4.0)))

    def said(c: Column, p: float) -> Column:
        wrong = float(np.log((1 - p) / max(1.0, n - 1)))
        return F.transform(lang, lambda x: F.when(c.isNull() | ~F.array_contains(lang, c), 0.0).when(x == c, float(np.log(p))).otherwise(wrong))

    country = F.lit(None).cast("string")
    for suffix, x in COUNTRY.items():
        country = F.when(F.col("suffix") == suffix, F.lit(x)).otherwise(country)
    evidence = F.zip_with(F.zip_with("ll", said(F.col("declared"), right), lambda a, b: a + b), said(country, 0.6), lambda a, b: a + b)
    rows = rows.withColumn("evidence", evidence).withColumn("p", softmax(F.col("evidence")))
    counts = host_counts(rows, len(langs), scratch)
    whole = counts.agg(F.sum("rows").alias("rows"), *[F.sum(F.col("s3")[i]).alias(f"s{i}") for i in range(len(langs))]).first()
    even = F.array(*[F.lit(1.0 / n) for _ in langs])
    everything = F.array(*[F.lit(float(whole[f"s{i}"] or 0.0)) for i in range(len(langs))])
    heavy = counts.where(F.col("rows") > HEAVY * (whole["rows"] or 0))  # at most 1 / HEAVY rows
    rest = counts.join(F.broadcast(heavy.select(*[F.col(f"_{k}").alias(f"h_{k}") for k in LEVELS])), [F.col(f"_{k}").eqNullSafe(F.col(f"h_{k}")) for k in LEVELS], "left_anti")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in LEVELS]
    out = rows.join(F.broadcast(heavy), on).unionByName(rows.join(F.broadcast(heavy), on, "left_anti").join(rest, on))
    prior = without_own(everything, F.col("p"), even, n)
    for depth in (1, 2, 3):
        out = out.withColumn(f"prior{depth}", without_own(F.col(f"s{depth}"), F.col("p"), prior, STRENGTH))
        prior = F.col(f"prior{depth}")
    out = out.withColumn("q", softmax(F.zip_with("evidence", prior, lambda a, b: a + F.log(b))))
    return out.withColumn("lang", best(F.col("q"))).withColumn("confidence", F.array_max("q")).withColumn("text_lang", F.when(F.col("has_text"), best(F.col("ll"))))


def identify(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id or page_id, lang, confidence, text_lang, declared for every page and every document (which has no markup; its source stands for the host)."""
    shared.reachable(documents.sparkSession)
    scratch = shared.Scratch(documents.sparkSession)
    langs, model = train(documents)
    host = F.nullif(shared.ascii_lower(F.regexp_extract(F.col("url").cast("string"), r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))
    null = F.lit(None)
    of_pages = pages.select(null.cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id"), text_of(F.col("html")).alias("text"), declared_of(F.col("html")).alias("declared"), F.element_at(F.split(host, r"\."), -1).alias("suffix"), F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+|[^.]+\.[^.]+|[^.]+)$", 1).alias("domain"), host.alias("host"))
    of_documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), null.cast("long").alias("page_id"), F.col("text").cast("string").alias("text"), null.cast("string").alias("declared"), null.cast("string").alias("suffix"), null.cast("string").alias("domain"), F.col("source").cast("string").alias("host"))
    rows = of_documents.unionByName(of_pages).withColumn("has_text", F.coalesce(F.col("text").rlike(shared.WORD_PATTERN), F.lit(False)))
    columns = ["doc_id", "page_id", "lang", "confidence", "text_lang", "declared"]
    if not langs:
        return rows.select("doc_id", "page_id", null.cast("string").alias("lang"), null.cast("double").alias("confidence"), null.cast("string").alias("text_lang"), "declared")
    scored = scratch.keep(likelihoods(rows, langs, model), "likelihoods")
    return fused(scored, langs, scratch).select(*columns)
