"""Constraints of a plan, how far a place meets them, and what was relaxed. Annotations never reorder results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo, hours
from ..functions.text import fold
from ..settings import Constraints
from .signals import compare, price_level

CONSTRAINT = "array<struct<kind:string,value:string,label:string,priority:int,pos:int>>"


def kind_of(attribute: Column, conf: Constraints = Constraints()) -> Column:
    """time, price or attribute, by folded keywords."""
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: fold(attribute).contains(w))
    return F.when(has(conf.time_keywords), "time").when(has(conf.price_keywords), "price").otherwise("attribute")


def parse(plan: Column, least_weight: float = 0.15, conf: Constraints = Constraints()) -> Column:
    """The plan's constraints in a fixed order: categories, attributes, negations, one location, limits, open now."""

    def one(kind, value: Column, priority: int) -> Column:
        return F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), value.cast("string").alias("value"), value.cast("string").alias("label"), F.lit(priority).alias("priority"), F.lit(0).alias("pos"))

    def many(values: Column, kind, priority: int) -> Column:
        return F.transform(F.array_sort(values), lambda v: one(kind(v) if callable(kind) else kind, v, priority))

    def maybe(condition: Column, kind: str, value: Column, priority: int) -> Column:
        return F.when(condition, F.array(one(kind, value, priority))).otherwise(F.array().cast("array<struct<kind:string,value:string,label:string,priority:int,pos:int>>"))

    heavy = lambda w: F.map_keys(F.map_filter(w, lambda _, v: v >= least_weight))
    either = lambda names, w: F.when(F.size(names) > 0, names).otherwise(heavy(w))
    place = F.coalesce(plan["landmark"], plan["district"], plan["city"])
    location = F.when(plan["landmark"].isNotNull(), "near").when(plan["district"].isNotNull(), "district").otherwise("city")
    at = F.when(place.isNotNull(), F.array(one(location, place, 2))).otherwise(F.array().cast(CONSTRAINT))
    parts = [
        many(either(plan["categories"], plan["category_weights"]), "category", 2),
        many(either(plan["attr_concepts"], plan["attribute_weights"]), lambda v: kind_of(v, conf), 1),
        many(either(plan["neg_concepts"], plan["negated_attribute_weights"]), "not_attribute", 1),
        at,
        maybe(plan["price_limit"].isNotNull(), "price_limit", plan["price_limit"], 1),
        maybe(plan["rating_limit"].isNotNull(), "rating_limit", plan["rating_limit"], 1),
        maybe(plan["time_limit_minutes"].isNotNull(), "time_limit", plan["time_limit_minutes"], 1),
        maybe(plan["current_time_open"], "open_now", F.lit("now"), 1),
    ]
    return F.transform(F.concat(*[p.cast(CONSTRAINT) for p in parts]), lambda c, i: c.withField("pos", i))


def score(kind: Column, value: Column, plan: Column, place: Column, now: int, parity: bool = True, conf: Constraints = Constraints()) -> Column:
    """How far a place meets one constraint. ``parity``: a price limit is compared with the level as it stands; otherwise as a level."""
    has = F.exists(place["attributes"], lambda a: fold(a) == fold(value))
    as_number = F.when(has, 1.0).otherwise(0.0)
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    opens, closes, late = hours.opening(place["opening_hours"]), hours.closing(place["opening_hours"]), hours.late_closing(place["opening_hours"])
    round_the_clock, overnight = place["opening_hours"] == "24/7", closes <= opens
    all_day = fold(value).contains("24/7")
    time = F.when(all_day, yes(round_the_clock | has)).when(has, 1.0).when(late.isNull(), 0.0).when(round_the_clock | overnight | (closes >= conf.late_full), 1.0).when(closes >= conf.late_partial, conf.time_partial).otherwise(0.0)
    level = place["price_level"]
    most = F.lit(None).cast("int")
    for word, v in reversed(conf.price_levels):
        most = F.when(fold(value).contains(word), v).otherwise(most)
    price = F.when(has, 1.0).when(most.isNull(), as_number).when(level == 0, 0.0).otherwise(yes(level <= most))
    coord = plan["resolved_coord"]
    km = geo.haversine_km(coord["lat"], coord["lon"], place["lat"], place["lon"])
    same_city = place["city"] == plan["city"]
    near = F.when(coord.isNull() | ((place["lat"] == 0) & (place["lon"] == 0)), F.when(same_city, conf.same_city).otherwise(0.0)).when(km <= conf.near_km, 1.0).when(km <= conf.far_km, conf.near_partial).when(same_city, conf.same_city).otherwise(0.0)
    district = F.when(place["district"] == plan["district"], 1.0).when(same_city, conf.city_fallback).otherwise(0.0)
    limit = plan["price_limit"] if parity else price_level(plan["price_limit"]).cast("double")
    price_limit = F.when(level == 0, 0.0).otherwise(yes(compare(level.cast("double"), limit, plan["price_op"])))
    rating = F.when(place["rating"] == 0, 0.0).otherwise(yes(F.when(plan["rating_op"] == "eq", place["rating"] == plan["rating_limit"]).otherwise(compare(place["rating"], plan["rating_limit"], plan["rating_op"]))))
    minutes = plan["time_limit_minutes"]
    time_limit = F.when(plan["time_op"] == "le", yes(opens <= minutes)).when(plan["time_op"] == "ge", yes(round_the_clock | overnight | (closes >= minutes))).otherwise(0.0)
    return (
        F.when(kind == "category", yes(place["category"] == value)).when(kind == "attribute", as_number).when(kind == "not_attribute", 1.0 - as_number).when(kind == "time", time).when(kind == "price", price)
        .when(kind == "near", near).when(kind == "district", district).when(kind == "city", yes(place["city"] == value)).when(kind == "price_limit", price_limit).when(kind == "rating_limit", rating)
        .when(kind == "time_limit", time_limit).when(kind == "open_now", yes(hours.is_open(place["opening_hours"], now)))
    )


def annotate(rows: DataFrame, now: int, parity: bool = True, conf: Constraints = Constraints()) -> DataFrame:
    """``rows`` (plan and place columns) plus n_constraints, satisfied, detail and relaxed (unmet ones, by priority, then in order); null without constraints."""
    place = F.struct(*[F.col(c) for c in ("category", "attributes", "city", "district", "rating", "lat", "lon", "price_level", "opening_hours")])
    plan = F.col("plan")
    detail = F.transform(F.col("_c"), lambda c: F.struct(c["kind"].alias("kind"), c["value"].alias("value"), F.round(score(c["kind"], c["value"], plan, place, now, parity, conf), 2).alias("score"), c["priority"].alias("priority"), c["pos"].alias("pos")))
    out = rows.withColumn("_c", parse(plan, conf=conf)).withColumn("detail", F.when(F.size("_c") > 0, detail)).drop("_c")
    unmet = F.filter("detail", lambda d: d["score"] < conf.satisfied)
    relaxed = F.transform(F.array_sort(F.transform(unmet, lambda d: F.struct(d["priority"].alias("p"), d["pos"].alias("i"), F.concat(d["kind"], F.lit(":"), d["value"]).alias("t")))), lambda s: s["t"])
    return out.withColumn("n_constraints", F.when(F.col("detail").isNotNull(), F.size("detail"))).withColumn("satisfied", F.when(F.col("detail").isNotNull(), F.size("detail") - F.size(unmet))).withColumn("relaxed", relaxed)
