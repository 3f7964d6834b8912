from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n long, key string, rep string, held_out boolean"


def vocabulary(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(n)]


def texts() -> list[tuple[int | None, str | None]]:
    """Documents with copies, near copies, shared passages, ties, repeated rows, nulls, empty and long texts."""
    r, words = random.Random(7), vocabulary(3, 400)
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    out: list[tuple[int | None, str | None]] = [(i, make(r.randint(30, 120))) for i in range(1, 25)]
    base = make(150)
    out += [(30, base), (31, base), (32, base + " tail words"), (33, base.upper())]
    for i in range(34, 60):  # a group of near copies
        w = base.split()
        w[r.randrange(len(w))] = "edit" + str(i)
        out.append((i, " ".join(w)))
    shared_passage = make(25)
    out += [(70, make(20) + " " + shared_passage + " " + make(10)), (71, shared_passage + "\t" + make(15)), (72, make(5) + "\n" + shared_passage)]
    out += [(80, None), (81, ""), (82, " \t\n "), (83, "one"), (84, "one two"), (85, "ONE two"), (86, "\u00a0nb\u00a0sp é\u0301 \U0001f642"), (None, make(40)), (None, base), (90, make(9000)), (91, "x" * 30000), (5, out[4][1]), (6, make(33))]
    return out


@pytest.fixture(scope="session")
def rows():
    return texts()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names the operators use themselves."""
    full = [(i, t, "en", "src0", len(t or ""), 0.5, 1, "k", "r", False) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
