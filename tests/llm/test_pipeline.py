"""Stages of the pipeline against brute force, on the smallest tables."""

from __future__ import annotations

import zlib

import numpy as np

import corpus_pipeline as pipeline
from tidewell.llm import quality

from .test_pairs import brute_components, brute_removed


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    good = stages["quality"](spark, docs, sf).cache()
    accepted = {r["doc_id"] for r in quality.scored(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == accepted and good.columns == docs.columns
    one = stages["near_duplicates"](spark, good, sf).cache()
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    assert {r["doc_id"] for r in one.collect()} == {i for i, root in brute_components(rows, 5, 80).items() if i == root}
    cut = stages["repeated_passages"](spark, one, sf).cache()
    removed = {i: n for i, _, n, _ in brute_removed([(r["doc_id"], r["text"]) for r in one.collect()], 13)}
    before = {r["doc_id"]: r["text"] for r in one.collect()}
    for r in cut.collect():
        gone = removed[r["doc_id"]]
        assert r["text"] == before[r["doc_id"]] if not gone else len(r["text"].encode().split()) == len(before[r["doc_id"]].encode().split()) - gone
    clean = stages["decontamination"](spark, cut, sf)
    items = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r["doc_id"] for r in clean.collect()}
    for r in cut.collect():
        t = " ".join(r["text"].lower().split())
        assert (r["doc_id"] in left) == (not any(i in t for i in items))
    assert {r["doc_id"] for r in stages["packing"](spark, clean, sf).collect()} == left
    assert clean.columns == docs.columns


def test_null_ids_are_cut_too(spark, sf):
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(1, f"one {passage} end"), (None, f"two {passage} tail"), (None, f"three {passage}"), (None, "nothing shared here"), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(pipeline.STAGES)["repeated_passages"](spark, docs, sf).collect()
    assert sorted(str(r["text"]) for r in got) == sorted(["None", "nothing shared here", f"one {passage} end", "three", "two tail"])
    assert all(r["n_chars"] == len(r["text"] or "") for r in got)


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def odd_rows():
    prose = [f"The {w} of the town was built in the year {k}, and people came from the villages around it to see it. They liked what they saw, and some of them stayed for good." for k, w in enumerate(["bridge", "castle", "market", "harbour", "museum", "library"] * 10)]
    rows = [(i, t) for i, t in enumerate(prose)]
    return [*rows, rows[3], rows[3], (None, prose[5]), (None, None), (200, None), (201, ""), (202, " \n\t"), (203, "word " * 60000), (0, prose[1])]


def test_stages_with_odd_rows(spark, sf):
    """Null ids and texts, repeated rows, a very long text and clashing columns: every stage keeps to its docstring."""
    rows = odd_rows()
    full = [(i, t, "en", "s", len(t or ""), 0.5, True, "x") for i, t in rows]
    docs = spark.createDataFrame(full, COLUMNS + ", score double, kept boolean, _kept string").repartition(3)
    stages = dict(pipeline.STAGES)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == pipeline.COLUMNS, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    good = stages["quality"](spark, docs, sf).collect()
    assert len({r["text"] for r in good} & {rows[3][1]}) in (0, 1)
    one = stages["near_duplicates"](spark, docs, sf).collect()
    want = brute_components(rows, 5, 80)
    assert sorted((r["doc_id"], r["text"]) for r in one if r["doc_id"] is not None and r["text"] is not None) == sorted((i, t) for i, t in rows if i is not None and want[i] == i and t is not None)
    assert sum(r["doc_id"] is None for r in one) == 2
    cut = stages["repeated_passages"](spark, docs, sf).collect()
    assert len(cut) == len(rows) and {r["doc_id"] for r in cut if r["text"] is None} == {None, 200}
    removed = sorted((str(i), n - gone) for i, n, gone, _ in brute_removed(rows, 13))
    assert removed == sorted((str(r["doc_id"]), len((r["text"] or "").encode().split())) for r in cut)
    assert stages["decontamination"](spark, docs, sf).count() == len(rows)
    packed = stages["packing"](spark, docs, sf).where("start = 0").collect()
    assert sorted(str(r["doc_id"]) for r in packed) == sorted(str(i) for i, _ in rows)
    assert stages["packing"](spark, docs.limit(0), sf).count() == 0


def plain_quality(texts, labels):
    """Which of (doc_id, text) pass, by the operator's model fed from plain Python: its own sample, histograms and threshold."""
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i, _ in texts}
    trusted = {i for i, q in labels if q == 1 and fold.get(i, 2) != 2}
    x = {i: np.array(quality.features((t or "").encode()), np.float32).astype(float) for i, t in texts}
    fitted, kept = [np.array([x[i] for i in sorted(trusted) if (fold[i] == 3) == late]) for late in (False, True)]
    others = np.array([x[i] for i in sorted(x) if not (i in trusted and fold[i] != 3)])
    count = lambda m, rows: np.bincount(quality.cells_of(m.score(rows)), minlength=quality.CELLS).astype(float)
    both = lambda m: (count(m, kept) + quality.VIRTUAL * count(m, fitted) / len(fitted), count(m, others))
    model = quality.fit_nnpu(fitted, others, quality.prior_of(*both(quality.fit_separator(fitted, others))))
    curve = quality.curve_of(*both(model))
    s = model.score(np.array([x[i] for i, _ in texts]))
    return {i for (i, _), v in zip(texts, 0.99 * curve[quality.cells_of(s)] + 0.01 * s, strict=True) if v >= quality.THRESHOLD}


def test_quality_stage_equals_a_plain_run(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    want = plain_quality([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["doc_id"], r["quality"]) for r in labels.collect()])
    got = {r["doc_id"] for r in dict(pipeline.STAGES)["quality"](spark, docs, sf).collect()}
    assert len(got ^ want) <= 1  # sums in another order may move a document at the threshold itself
