"""Near duplicates and repeated passages against brute force."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm import components, near_dup, shared, substring_dedup


def sets_of(rows, n):
    out = {}
    for i, t in rows:
        w = t.encode().lower().split() if t else []
        own = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
        out.setdefault(i, []).append(own)
    return out


def brute_components(rows, n, percent):
    sets = sets_of([r for r in rows if r[0] is not None], n)
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("words", "block"), [(2, 1000), (2, 3), (5, 1000)])
def test_near_duplicates(docs, rows, words, block, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", block)
    got = near_dup.near_duplicates(docs, words=words).collect()
    assert len(got) == len(rows)
    want, sets = brute_components(rows, words, 80), sets_of(rows, words)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]]
            assert r["kept"] == (r["component_id"] == r["doc_id"])
        assert r["n_shingles"] in {len(s) for s in sets[r["doc_id"]]}


def test_near_duplicates_empty(empty):
    assert near_dup.near_duplicates(empty).count() == 0


def test_trees_reach_recall():
    assert near_dup.survival(1.0, 0.8, 5) == 1.0
    t = near_dup.trees_for(0.8)
    assert 1 - (1 - near_dup.survival(0.8, 0.8, near_dup.EXPECTED_DEPTH)) ** t >= near_dup.RECALL


def test_trees_follow_the_levels_in_use(docs, monkeypatch):
    """Trees reach the recall at the depth that a corpus needs, sketches' spread included, and are the ones grown."""
    grown, branch = [], near_dup.branch
    monkeypatch.setattr(near_dup, "branch", lambda rows, trees, *more: grown.append(trees) or branch(rows, trees, *more))
    monkeypatch.setattr(near_dup, "levels_for", lambda n: 7)
    near_dup.near_duplicates(docs.where("doc_id between 20 and 72")).count()
    lost = sum(math.comb(128, k) * 0.8**k * 0.2 ** (128 - k) * (1 - near_dup.survival(k / 128, 0.8, 7)) ** grown[0] for k in range(129))
    assert len(set(grown)) == 1 and lost <= 1 - near_dup.RECALL


@pytest.mark.parametrize(("levels", "heavy"), [(2, 1.0), (3, 0.002), (4, 0.05)])
def test_levels_and_heavy_nodes_change_nothing(docs, rows, levels, heavy, monkeypatch):
    """Starting deeper, or sending heavy nodes past the shuffle, finds the same components."""
    monkeypatch.setattr(near_dup, "levels_for", lambda n: levels)
    monkeypatch.setattr(near_dup, "HEAVY", heavy)
    monkeypatch.setattr(near_dup, "SMALL", 4)
    want = brute_components(rows, 2, 80)
    for r in near_dup.near_duplicates(docs, words=2).where("doc_id is not null").collect():
        assert r["component_id"] == want[r["doc_id"]]


def test_repeated_rows_are_one_text(spark, monkeypatch):
    """A row repeated 10,000 times beside a near copy is compared once; an id with several texts joins their groups."""
    base = " ".join(f"w{k}" for k in range(60))
    near = base.replace("w30", "other")
    given_rows = [(7, base)] * 10000 + [(9, near), (5, "alone " + base.upper()), (1, "quite another text of a few words"), (9, "quite another text of a few words")]
    docs = spark.createDataFrame(given_rows, "doc_id long, text string").repartition(4)
    seen, linked = [], near_dup.verify_clusters
    monkeypatch.setattr(near_dup, "verify_clusters", lambda members, *more: seen.append(members.mapInArrow(near_dup.once, members.schema).count()) or linked(members, *more))
    got = near_dup.near_duplicates(docs, words=2).groupBy("doc_id", "component_id").count().collect()
    assert {r["doc_id"]: (r["component_id"], r["count"]) for r in got} == {7: (1, 10000), 9: (1, 2), 5: (1, 1), 1: (1, 1)}
    assert seen[0] <= 4 * 4  # once a task, not 10,000 times


@pytest.mark.parametrize("rounds", [0, 3])
def test_a_long_chain_is_not_compared_with_itself(spark, rounds, monkeypatch):
    """Of a hot cluster that no pivot holds together, texts meet where sketches are near, not in every block; no link is lost."""
    rows = [(k, " ".join(f"w{j}" for j in range(4 * k, 4 * k + 61))) for k in range(300)]
    rows += [(1000 + k, " ".join(f"v{j}" for j in range(4 * k, 4 * k + 61))) for k in range(20)] + [(1005, rows[250][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    frame, met = type(docs), []
    repartition = frame.repartition
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 10)
    monkeypatch.setattr(near_dup, "ROUNDS", rounds, raising=False)
    monkeypatch.setattr(frame, "repartition", lambda self, *to: met.append(self.count() if {"text", "side"} <= set(self.columns) else 0) or repartition(self, *to))
    got = near_dup.near_duplicates(docs, words=2).collect()
    assert {r["component_id"] for r in got} == {0}
    assert sum(met) < (2000 if rounds else 9000)  # 300 documents in 30 blocks gave 18,000 rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=1, max_size=200), st.integers(1, 17), st.booleans(), st.sampled_from([None, 0, 3]))
def test_grouped_streams_like_groups(nodes, size, last, heavy):
    """Links within leaves, and rows or stars of large nodes, however the rows are cut into batches."""
    nodes, fed = sorted(nodes, key=lambda n: (n == heavy, n)), []
    table = pa.table({"rep": range(len(nodes)), "node": nodes, "b0": [0] * len(nodes), "b1": [0] * len(nodes), "heavy": [n == heavy for n in nodes]})

    class Frame:
        def repartition(self, _):
            return self

        sortWithinPartitions = lambda self, *_: self

        def mapInArrow(self, run, _):
            fed.extend(run(iter(table.to_batches(max_chunksize=size))))

    near_dup.grouped(Frame(), 100, last, {heavy: nodes.index(heavy)} if heavy in nodes else {})
    out = pa.Table.from_batches(fed).to_pylist() if fed else []
    large = {n for n in nodes if n == heavy or nodes.count(n) > near_dup.SMALL}
    assert sorted((r["a"], r["b"]) for r in out if not r["link"]) == [(i, n) for i, n in sorted(enumerate(nodes)) if n in large and not last]
    forest = shared.Forest()
    for r in out:
        if r["link"]:
            assert nodes[r["a"]] == nodes[r["b"]]
            forest.join(r["a"], r["b"])
    for n in set(nodes):
        if last or n not in large:
            assert len({forest.root(i) for i, x in enumerate(nodes) if x == n}) == 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 20), min_size=1, max_size=12), min_size=2, max_size=12))
def test_linked_is_exact(groups):
    sets = [np.unique(np.array(g, np.uint64)) for g in groups]
    link = near_dup.linked(sets, None, 80)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            x, y = set(a.tolist()), set(b.tolist())
            assert i == j or link[i, j] == (100 * len(x & y) >= 80 * len(x | y))


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200)] + [(500, x) for x in range(501, 540)]
    got = {r["id"]: r["root"] for r in components.connected(spark.createDataFrame(chain, "a long, b long").repartition(4), shared.Scratch(spark), "t").collect()}
    assert all(got[i] == 0 for i in range(61)) and got[103] == got[101] == 100 and got[539] == 500 and 200 not in got


def brute_removed(rows, window):
    first, last = {}, 1 << 62
    for i, t in rows:
        w = t.encode().split() if t else []
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, last), last if i is None else i)
    out = []
    for i, t in rows:
        w = t.encode().split() if t else []
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < (last if i is None else i):
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("window", "partition"), [(13, 1 << 30), (5, 1 << 30), (50, 1 << 30), (13, 4000)])
def test_substring_dedup(docs, rows, window, partition, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 20000)
    monkeypatch.setattr(shared, "PARTITION_BYTES", partition)
    got = [tuple(r) for r in substring_dedup.deduplicate(docs, window=window).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute_removed(rows, window)


def test_substring_dedup_at_the_ends_of_ids(spark):
    """The largest id stays itself; null counts as that id; repeated rows don't cut each other; two hashes decide."""
    passage = " ".join(f"p{k}" for k in range(15))
    rows = [(2**63 - 1, "a " + passage), (None, "b " + passage), (-(2**63), passage + " c"), (2**63 - 1, "a " + passage), (7, "x y")]
    got = [tuple(r) for r in substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed").collect()]
    assert sorted(got, key=str) == sorted([(2**63 - 1, 16, 15), (None, 16, 15), (-(2**63), 16, 0), (2**63 - 1, 16, 15), (7, 2, 0)], key=str)


def test_partitions_follow_the_size(spark, monkeypatch):
    given = int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(shared, "PARTITION_BYTES", 100)
    assert shared.parts_for(spark, 100 * given) is None and shared.parts_for(spark, 100 * given + 1) == given + 1
    rows = shared.spread(spark.range(50), 100 * (given + 9), "id")
    assert rows.rdd.getNumPartitions() == given + 9 and rows.count() == 50


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1), max_size=60), st.sampled_from([1, 2, 16, 1 << 20]))
def test_slices_cover_values_in_order(values, buckets):
    values = np.array(sorted(values), np.uint64)
    got = substring_dedup.slices(values, buckets)
    assert [v for _, a, b in got for v in values[a:b].tolist()] == values.tolist() and all(b > a for _, a, b in got)
    assert all({v * buckets >> 63 for v in values[a:b].tolist()} == {k} for k, a, b in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2), st.integers(0, 5)), max_size=40))
def test_lowest_by_pairs(rows):
    h, second, owner = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    a, b, least, most, place = substring_dedup.lowest(h, second, owner)
    assert list(zip(a.tolist(), b.tolist(), strict=True)) == sorted({r[:2] for r in rows})
    for k, r in enumerate(rows):
        own = [x[2] for x in rows if x[:2] == r[:2]]
        assert (least[place[k]], most[place[k]]) == (min(own), max(own))


def test_substring_dedup_empty(empty):
    assert substring_dedup.deduplicate(empty).count() == 0


@pytest.mark.parametrize("cover", substring_dedup.COVERS)
def test_covers_are_difference_covers(cover):
    period, residues = cover
    assert {(a - b) % period for a in residues for b in residues} == set(range(period))


def test_no_local_scratch_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Spark:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        shared.Scratch(Spark())
