"""Corpora: place tables from files or a database, derived documents, evaluation sets, lexica."""

from __future__ import annotations

import json
import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_cell, document, fold, is_synthetic, split_list
from ..plans.lexicon import Lexicon
from .xlsx import read_xlsx

STRINGS = ("poi_id", "name", "brand", "category", "sub_category", "city", "district", "address", "opening_hours", "description", "status")
DOUBLES, INTS = ("lat", "lon", "rating", "popularity"), ("review_count", "price_level")
LISTS = ("attributes", "tags")
EVALUATION = ("query_id", "input_query", "query_category", "difficulty", "expected_top_poi_ids", "expected_semantic_requirements", "ranking_signals_to_use")


def read_places(spark: SparkSession, kind: str, where: str, **options) -> DataFrame:
    """Raw places from ``parquet``, ``json``, ``csv`` (with a header), ``xlsx`` (option ``sheet``, else the first) or ``jdbc`` (where: the table)."""
    if kind == "xlsx":
        return read_xlsx(spark, where, [*STRINGS, *DOUBLES, *INTS, *LISTS], **options)
    if kind == "jdbc":
        rows = spark.read.format("jdbc").option("dbtable", where).options(**options).load()
        return rows.orderBy("row_order") if "row_order" in rows.columns else rows
    if kind not in ("parquet", "json", "csv"):
        raise ValueError(f"unknown source: {kind}")
    reader = spark.read.options(**options)
    raw = reader.option("header", True).csv(where) if kind == "csv" else getattr(reader, kind)(where)
    return raw.dropna(how="all")


def places(raw: DataFrame) -> DataFrame:
    """Typed columns (missing text is '', missing numbers 0), lists split at ';', derived document and flags."""
    have = set(raw.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None)
    many = lambda c: F.col(c) if c in have and dict(raw.dtypes)[c].startswith("array") else split_list(col(c).cast("string"), ";")
    out = raw.select(*[clean_cell(col(c).cast("string")).alias(c) for c in STRINGS], *[F.coalesce(col(c).cast("string").try_cast("double"), F.lit(0.0)).alias(c) for c in DOUBLES], *[F.coalesce(col(c).cast("string").try_cast("double").cast("int"), F.lit(0)).alias(c) for c in INTS], many("attributes").alias("attributes"), many("tags").alias("tags"), *([F.col("row_order")] if "row_order" in have else []))
    return with_document(out.withColumn("is_synthetic", is_synthetic(F.col("poi_id"))))


def with_document(rows: DataFrame) -> DataFrame:
    parts = [F.col(c) for c in ("name", "category", "sub_category", "district", "city")] + [F.concat_ws(" ", "attributes"), F.concat_ws(" ", "tags"), F.col("description")]
    return rows.withColumn("document", document(*parts)).withColumn("norm_document", fold(F.col("document")))


def read_evaluation(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Evaluation queries of a CSV file or workbook; expected ids are split at ';', signals at ','."""
    raw = read_xlsx(spark, path, list(EVALUATION), sheet) if path.endswith(".xlsx") else spark.read.option("header", True).csv(path)
    return raw.withColumn("expected_top_poi_ids", split_list(F.col("expected_top_poi_ids"), ";")).withColumn("ranking_signals_to_use", split_list(F.col("ranking_signals_to_use"), ","))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A JSON file of one array or object, or of lines."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """key, surface rows of a YAML or JSON mapping of lists; small by contract, so it is read on the driver."""
    data = read_mapping(path)
    return spark.createDataFrame([(str(k), str(s)) for k, v in data.items() for s in (v if isinstance(v, list) else [v])], "key string, surface string")


def lexicon_of(spark: SparkSession, folder: str, base: Lexicon | None = None) -> Lexicon:
    """``base`` with what the files of a folder say: categories, city_aliases, abbreviations, antonyms, attributes, landmarks (.yaml or .json).

    A category or city maps to surfaces, an abbreviation or antonym to one text, a landmark to [latitude, longitude, city].
    """
    out = base or Lexicon()
    for name, target in (("categories", "categories"), ("city_aliases", "cities"), ("abbreviations", "abbreviations"), ("antonyms", "antonyms"), ("attributes", "attributes"), ("landmarks", "landmarks")):
        for kind in ("yaml", "json"):
            path = f"{folder.rstrip('/')}/{name}.{kind}"
            if os.path.exists(path):
                data = read_mapping(path)
                value = list(data) if target == "attributes" else {str(k): tuple(v) if target == "landmarks" else [str(x) for x in v] if target in ("categories", "cities") else str(v) for k, v in data.items()}
                out = replace(out, **{target: value})
    return out


def read_mapping(path: str):
    """A JSON or YAML file; small by contract, read on the driver."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def poi_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places built from documents, parts and embeddings by key arithmetic (see FIXTURES.md §3)."""
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    d, p, e = t("documents"), t("part"), t("embeddings")
    n_p, n_e = (x.agg(F.count("*")).scalar() for x in (p, e))  # subqueries: nothing runs while the view is built
    rows = d.join(p, p.p_partkey == d.doc_id % n_p, "left").join(e.select("vec_id"), F.col("vec_id") == d.doc_id % n_e, "left")
    i = F.col("doc_id")
    known = i % 97 != 0
    return rows.select(
        F.concat(F.when(i % 3 == 0, "G").otherwise("C"), F.lpad(i.cast("string"), 7, "0")).alias("poi_id"),
        F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"), F.col("lang").alias("city"), F.col("source").alias("district"),
        F.when(known, 10.0 + (i * 37 % 1200) / 100.0).otherwise(0.0).alias("lat"), F.when(known, 102.0 + (i * 53 % 800) / 100.0).otherwise(0.0).alias("lon"),
        ((F.col("p_size") % 50) / 10.0).alias("rating"), F.col("n_chars").alias("review_count"), (i % 101).cast("double").alias("popularity"), (F.col("p_size") % 5).cast("int").alias("price_level"),
        F.element_at(F.array(*[F.lit(x) for x in ("24/7", "08:00-22:00", "18:00-02:00", "7:30-23:00", "")]), (i % 5 + 1).cast("int")).alias("opening_hours"),
        "vec_id", F.col("text").alias("description"), F.split("p_name", " ").alias("attributes"),
    )
