"""Ranking signals: Column builders of (plan, place) with values in [0, 1]; what isn't known is neutral.

A plan is a struct with the fields of :mod:`tidewell.plans.query_plan`, a place a struct of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geo, hours
from ..functions.text import contains_word, fold, once

NEUTRAL = 0.5
Signal = Callable[[Column, Column], Column]


def yes(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def compare(value: Column, limit: Column, op: Column) -> Column:
    """value <= limit, >= or equal within 0.01, by op; an unknown op is "le"."""
    return F.when(op == "ge", value >= limit).when(op == "eq", F.abs(value - limit) < 0.01).otherwise(value <= limit)


def price_level(amount: Column) -> Column:
    """Level of an amount: up to 50, 150 and 300 thousand are 1, 2 and 3."""
    return F.when(amount <= 50_000, 1).when(amount <= 150_000, 2).when(amount <= 300_000, 3).otherwise(4)


def weight_of(weights: Column, key: Column) -> Column:
    return F.coalesce(F.try_element_at(weights, key), F.lit(0.0))


def has_name(own: Column, name: Column) -> Column:
    """Is the folded name among folded ones?"""
    return F.array_contains(own, fold(name))


def weight_sum(weights: Column, own: Column) -> Column:
    """Weights of the keys that are, folded, among the folded names ``own``."""
    return F.aggregate(F.map_entries(weights), F.lit(0.0), lambda a, e: a + F.when(has_name(own, e["key"]), e["value"]).otherwise(0.0))


def total(weights: Column) -> Column:
    return F.aggregate(F.map_values(weights), F.lit(0.0), lambda a, v: a + v)


def category(plan: Column, place: Column) -> Column:
    weights, names = plan["category_weights"], plan["categories"]
    return F.when(F.size(weights) > 0, weight_of(weights, place["category"])).when(F.size(names) == 0, 1.0).otherwise(yes(F.array_contains(names, place["category"])))


def attr(plan: Column, place: Column) -> Column:
    w, nw = plan["attribute_weights"], plan["negated_attribute_weights"]
    return once(F.transform(place["attributes"], fold), lambda own: _attr(own, w, nw, plan["attr_concepts"], plan["neg_concepts"]))


def _attr(own: Column, w: Column, nw: Column, wanted: Column, banned: Column) -> Column:
    count = lambda names: F.size(F.filter(names, lambda x: has_name(own, x))).cast("double")
    weighted = F.when(total(w) > 0, weight_sum(w, own) / F.nullif(total(w), F.lit(0.0))).otherwise(NEUTRAL) - weight_sum(nw, own) / F.greatest(total(nw), F.lit(1.0))
    plain = F.when(F.size(wanted) > 0, count(wanted) / F.greatest(F.size(wanted), F.lit(1))).otherwise(NEUTRAL) - count(banned) / F.greatest(F.size(wanted), F.lit(1))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when((F.size(w) > 0) | (F.size(nw) > 0), weighted).otherwise(plain)))


def city(plan: Column, place: Column) -> Column:
    return F.when(plan["city"].isNull(), NEUTRAL).otherwise(yes(place["city"] == plan["city"]))


def rating(plan: Column, place: Column) -> Column:
    return place["rating"] / 5.0


def pop(plan: Column, place: Column) -> Column:
    return F.when(plan["want_pop"], place["popularity"] / 100.0).otherwise(NEUTRAL)


def name(plan: Column, place: Column) -> Column:
    return yes(contains_word(plan["query"], place["name"]) | contains_word(plan["query"], place["brand"]))


def distance(plan: Column, place: Column) -> Column:
    coord = plan["resolved_coord"]
    here = (place["district"] == plan["district"]) & (plan["city"].isNull() | (place["city"] == plan["city"]))
    km = geo.haversine_km(coord["lat"], coord["lon"], place["lat"], place["lon"])
    return F.when(plan["district"].isNotNull() & here, 1.0).when(coord.isNull(), NEUTRAL).when((place["lat"] == 0) & (place["lon"] == 0), NEUTRAL).otherwise(1.0 / (1.0 + km))


def price_check(plan: Column, place: Column) -> Column:
    return F.when(plan["price_limit"].isNull(), NEUTRAL).when(place["price_level"] == 0, NEUTRAL).otherwise(yes(compare(place["price_level"], price_level(plan["price_limit"]), plan["price_op"])))


def rating_check(plan: Column, place: Column) -> Column:
    return F.when(plan["rating_limit"].isNull(), NEUTRAL).otherwise(yes(compare(place["rating"], plan["rating_limit"], plan["rating_op"])))


def time_check(plan: Column, place: Column) -> Column:
    close = hours.late_closing(place["opening_hours"])
    return F.when(plan["time_limit_minutes"].isNull(), NEUTRAL).when(close.isNull(), 0.0).otherwise(yes(compare(close, plan["time_limit_minutes"], plan["time_op"])))


def open_now_check(now: int) -> Signal:
    """The minute of the day is a parameter: plans stay repeatable."""
    return lambda plan, place: F.when(~plan["current_time_open"], NEUTRAL).otherwise(yes(hours.is_open(place["opening_hours"], now)))


def registry(now: int = 720) -> dict[str, Signal]:
    """name -> signal; callers may add their own."""
    return {"category": category, "attr": attr, "city": city, "rating": rating, "pop": pop, "name": name, "distance": distance, "price_check": price_check, "rating_check": rating_check, "time_check": time_check, "open_now_check": open_now_check(now)}
