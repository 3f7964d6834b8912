"""The logical plan of a query as a struct column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS: dict[str, str] = {
    "query": "string", "norm_query": "string", "clean_query": "string",
    "categories": "array<string>", "attr_concepts": "array<string>", "neg_concepts": "array<string>",
    "city": "string", "district": "string", "landmark": "string", "want_pop": "boolean", "current_time_open": "boolean",
    "resolved_coord": "struct<lat:double,lon:double>",
    "category_weights": "map<string,double>", "attribute_weights": "map<string,double>", "negated_attribute_weights": "map<string,double>",
    "price_limit": "double", "rating_limit": "double", "time_limit_minutes": "int",
    "price_op": "string", "rating_op": "string", "time_op": "string", "sort_by": "string", "sort_order": "string",
}
SCHEMA = ", ".join(f"{k} {v}" for k, v in FIELDS.items())


def literal(**given) -> Column:
    """A plan with these values and empty ones elsewhere."""

    def value(name: str, kind: str) -> Column:
        v = given.get(name)
        if kind.startswith("array"):
            return (F.array(*[F.lit(x) for x in v]) if v else F.array()).cast(kind)
        if kind.startswith("map"):
            return F.create_map(*[F.lit(x) for kv in (v or {}).items() for x in kv]).cast(kind) if v else F.from_json(F.lit("{}"), kind)
        if kind.startswith("struct"):
            return F.struct(F.lit(float(v[0])).alias("lat"), F.lit(float(v[1])).alias("lon")) if v else F.lit(None).cast(kind)
        if kind == "boolean":
            return F.lit(bool(v))
        return F.lit(v).cast(kind)

    unknown = set(given) - set(FIELDS)
    if unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    return F.struct(*[value(n, k).alias(n) for n, k in FIELDS.items()])
