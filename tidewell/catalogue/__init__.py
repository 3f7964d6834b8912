"""The driver's queries: each name has a Spark query and, where SQL can express it, the same in SQL."""

from . import corpus, joins, ranking, understanding

MODULES = (corpus, joins, ranking, understanding)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
