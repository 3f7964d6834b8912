"""MinHash near-duplicates by a chosen-path set similarity join.

A document's set holds the distinct shingles of ``words`` lower-cased words (with fewer words the whole sequence
as one).  Two documents are linked if the Jaccard index of their sets is ``percent`` / 100 or more; the result
gives each document its connected component.

1. One pass makes each set's size, a 128-bit key of the whole set and 128 minwise tokens.  Equal sets share a
   key and are represented by their smallest id from here on, so copies never meet one another.
2. Chosen paths: every representative starts at the root of each of several independent trees.  A node picks one
   coordinate, in a quarter of the cases two (1 / 0.8 on average), and sends a document to the child named by its
   minwise token there (of 16 bits).  Which coordinates a node picks depends on its path alone, so paths need no node
   table.  Nodes of at most ``SMALL`` documents are leaves, compared exhaustively on 128 one-bit tokens; larger ones branch on, for as many levels as part
   unrelated documents of a corpus of this size.  What is still together then agrees in that many tokens and becomes a
   candidate as a whole, as a star.  The number of trees follows from the wanted recall at the
   greatest depth.  A level is one shuffle by node, read as a stream of groups of which at most ``SMALL`` rows are held.
   Rows of nodes with more than ``HEAVY`` of a level's rows, found on a bounded sample, are dealt by document instead: such
   nodes are large for sure, so nothing is decided there.
3. Candidates form clusters; each cluster's texts meet in one task, where all its links are decided on full sets.
   A cluster over ``BLOCK_SHINGLES`` is dealt into blocks instead: all blocks are compared with a pivot (the member
   nearest to the majority sketch); who is linked with it needs no comparison with others that are.  The rest looks for
   its ``NEAREST`` members of other parts by one-bit tokens and is compared with these, a few times over, which joins most of what belongs
   together.  Then every pair of different parts that sizes and one-bit tokens (at six sigmas) allow is compared, so
   nothing is left out, but texts only go to blocks where they have such a pair.

Equal rows, however many, are one text from step 1 on: classes, members and texts are each aggregated by key in the
tasks that read them, before any shuffle.
Null or blank texts have empty sets and are linked with nothing.  A row with a null id is linked with nothing, has a null
component and counts as kept.  Rows that share an id are one node, with the texts of all of them; every input row gives
one output row.  Texts are taken whole.  An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .components import FOREST_IDS, connected

COORDINATES, SMALL = 128, 16
#: Wanted chance that a pair exactly at the threshold meets in some leaf, however deep; EXPECTED_DEPTH is the least depth
#: allowed for, so that corpora of up to 300 million different texts grow the same trees.
RECALL, EXPECTED_DEPTH = 1 - 1e-6, 5
#: Share of unrelated documents that agree in one token, at most; sets the number of levels that part them.
AGREE = 0.02
BLOCK_SHINGLES, BLOCK_DOCS = 1_500_000, 1000
#: Sketches of a hot cluster that meet in one group, on either side; members that a document is compared with in a round; rounds at most.
SKETCH_DOCS, NEAREST, ROUNDS = 10_000, 2, 3
#: Share of a level's rows from which a node is heavy, and rows looked at to find such nodes (so at most 1 / HEAVY of them).
HEAVY, PROBED_ROWS = 1e-4, 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def survival(similarity: float, threshold: float, depth: int) -> float:
    """Chance that two sets share a node ``depth`` levels down one tree: a branching process with one or two picks a node."""
    two, lost = 1 / threshold - 1, 0.0
    for _ in range(depth):
        one = 1 - similarity + similarity * lost
        lost = (1 - two) * one + two * one * one
    return 1 - lost


def trees_for(threshold: float, recall: float = RECALL, depth: int = EXPECTED_DEPTH) -> int:
    """Trees for that recall, with the spread of the number of coordinates that a pair at the threshold agrees in."""
    agree = [(math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k), 1 - survival(k / COORDINATES, threshold, depth)) for k in range(COORDINATES + 1)]
    trees = 1
    while sum(p * lost**trees for p, lost in agree) > 1 - recall:
        trees += 1
    return trees


def levels_for(documents: int) -> int:
    """Levels after which fewer than one unrelated document is expected beside another."""
    return max(2, math.ceil(math.log(max(2, documents)) / -math.log(AGREE)))


def least_bits(threshold: float, sigmas: float = 5.0) -> int:
    """One-bit tokens that a pair at the threshold shares but for a chance beyond ``sigmas``."""
    p = (1 + threshold) / 2
    return math.floor(COORDINATES * p - sigmas * math.sqrt(COORDINATES * p * (1 - p)))


def shingle_set(text: bytes | None, words: int, hashes: shared.WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    found = text.lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    return np.unique(shared.ngram_hashes(hashes.of(found), min(words, len(found))))


def minwise(sets: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over a set."""
    out = np.full(len(factors), np.iinfo(np.uint64).max)
    for k in range(0, len(sets), 4096):
        np.minimum(out, (sets[k : k + 4096, None] * factors).min(0), out=out)
    return out


def sketches(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        hashes = shared.WordHashes()
        factors = shared.mix64(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
        for b in shared.byte_slices(batches, "text"):
            sizes, keys, sig, bits = [], [], [], np.zeros((b.num_rows, COORDINATES), np.uint8)
            for i, text in enumerate(shared.raw_texts(b.column("text"))):
                s = shingle_set(text, words, hashes)
                m = minwise(s, factors)
                sizes.append(len(s))
                keys.append(xxh3_128_digest(s.tobytes()))
                bits[i] = (m >> np.uint64(20)) & np.uint64(1)
                sig.append((shared.mix64(m) >> np.uint64(48)).astype("<u2").tobytes())
            packed = np.packbits(bits, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(sig, pa.binary()), pa.array(packed[:, 0]), pa.array(packed[:, 1])], names=["doc_id", "n", "key", "sig", "b0", "b1"])

    return docs.mapInArrow(run, "doc_id long, n long, key binary, sig binary, b0 long, b1 long")


def children(sig: np.ndarray, row: np.ndarray, node: np.ndarray, limit: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(row, child) for one or two coordinates of every (row, node); ``sig`` holds the rows' minwise tokens."""
    rows, nodes = [], []
    for pick in (1, 2):
        on = np.ones(len(node), bool) if pick == 1 else shared.mix64(node ^ _ODD) < limit
        r, p = row[on], node[on]
        at = shared.mix64(p + np.uint64(pick)) % np.uint64(COORDINATES)
        token = sig[r, at.astype(np.int64)].astype(np.uint64)
        rows.append(r)
        nodes.append(shared.mix64(p * _ODD + shared.mix64(token << np.uint64(8) | at)))
    return np.concatenate(rows), np.concatenate(nodes)


FRONTIER = "rep long, node long, b0 long, b1 long, heavy boolean"
#: link: the pair (a, b); otherwise document a in the large node b.
LEVEL = "link boolean, a long, b long"


def level_batch(link: bool, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), link)), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["link", "a", "b"])


def branch(rows: DataFrame, trees: int, threshold: float, heavy: np.ndarray | None = None) -> DataFrame:
    """Children of the nodes in ``parents`` (no such column: of the roots of all trees) that each row's document is sent to."""
    limit = np.uint64(int((1 / threshold - 1) * 2**64) if threshold < 1 else 0)
    known = np.zeros(0, np.uint64) if heavy is None else heavy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = shared.mix64(np.arange(1, trees + 1, dtype=np.uint64) * _ODD)
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                b = whole.slice(start, 2000)
                sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(b.num_rows, COORDINATES)
                if "parents" in b.schema.names:
                    lists = b.column("parents")
                    row = np.repeat(np.arange(b.num_rows), np.array(pc.list_value_length(lists)))
                    node = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                else:
                    row, node = np.repeat(np.arange(b.num_rows), trees), np.tile(roots, b.num_rows)
                row, node = children(sig, row, node, limit)
                rep, b0, b1 = (b.column(c).to_numpy()[row] for c in ("rep", "b0", "b1"))
                yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in (rep, node.view(np.int64), b0, b1)], pa.array(np.isin(node, known))], names=["rep", "node", "b0", "b1", "heavy"])

    return rows.mapInArrow(run, FRONTIER)


def leaf_pairs(rep: np.ndarray, b0: np.ndarray, b1: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Pairs of a leaf's documents that differ in at most ``most`` one-bit tokens."""
    x, y = np.triu_indices(len(rep), 1)
    differ = np.bitwise_count(b0[x] ^ b0[y]).astype(np.int64) + np.bitwise_count(b1[x] ^ b1[y])
    near = differ <= most
    return list(zip(rep[x[near]].tolist(), rep[y[near]].tolist(), strict=True))


def grouped(frontier: DataFrame, least: int, last: bool, centres: dict[int, int]) -> DataFrame:
    """One pass over the groups of nodes: links within leaves (as a forest); of larger nodes the rows, or at the ``last`` level a star.

    Of an open group at most ``SMALL`` rows are held.  ``centres`` names a document of each heavy node.
    """
    most = COORDINATES - least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.Forest()
        held, at, centre = None, None, 0  # the open group: its columns (None: it is large), its node, its first document

        def leaf(part, out: list) -> None:
            for x, y in leaf_pairs(part[0], part[2].view(np.uint64), part[3].view(np.uint64), most):
                if forest.join(x, y):
                    out.append((x, y))

        def large(reps: np.ndarray, node: int, star: int) -> pa.RecordBatch:
            if last:
                reps = reps[reps != star]
                return level_batch(True, reps, np.full(len(reps), star))
            return level_batch(False, reps, np.full(len(reps), node))

        def small(out: list) -> pa.RecordBatch:
            return level_batch(True, *(np.array(v, np.int64) for v in zip(*out, strict=True)))

        for batch in batches:
            heavy = batch.column("heavy").to_numpy(zero_copy_only=False)
            if heavy.any():
                rep, node = (batch.column(c).to_numpy()[heavy] for c in ("rep", "node"))
                if last:
                    star = np.array([centres[n] for n in node.tolist()], np.int64)
                    yield level_batch(True, rep[rep != star], star[rep != star])
                else:
                    yield level_batch(False, rep, node)
                batch = batch.filter(pa.array(~heavy))
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in ("rep", "node", "b0", "b1")]
            cuts, out = np.r_[0, np.flatnonzero(np.diff(columns[1])) + 1, batch.num_rows], []
            for k in range(len(cuts) - 1):
                a, b = cuts[k], cuts[k + 1]
                inner = 0 < k < len(cuts) - 2
                if inner and b - a == 1:
                    continue
                part, node = [c[a:b] for c in columns], int(columns[1][a])
                if node != at:
                    if held is not None and len(held[0]) > 1:
                        leaf(held, out)
                    held, at, centre = [c[:0] for c in part], node, int(part[0][0])
                if held is not None and len(held[0]) + b - a > SMALL:
                    yield large(np.concatenate([held[0], part[0]]), node, centre)
                    held = None
                elif held is not None:
                    held = [np.concatenate([h, c]) for h, c in zip(held, part, strict=True)]
                else:
                    yield large(part[0], node, centre)
            if out:
                yield small(out)
            if len(forest.up) > FOREST_IDS:
                forest = shared.Forest()
        if held is not None and len(held[0]) > 1:
            out = []
            leaf(held, out)
            if out:
                yield small(out)

    dealt = frontier.repartition(F.when(F.col("heavy"), F.xxhash64("rep")).otherwise(F.col("node")))
    return dealt.sortWithinPartitions("heavy", "node").mapInArrow(run, LEVEL)


def heavy_nodes(rows: DataFrame, trees: int, threshold: float, documents: int, scratch: shared.Scratch) -> np.ndarray:
    """Nodes with more than HEAVY of the rows of a level, on the documents with the smallest hashes; at most 1 / HEAVY of them."""
    share = min(1.0, PROBED_ROWS / max(1, documents * trees))
    few = rows.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(1 << 40)) < math.ceil(share * (1 << 40)))
    counts = scratch.keep(branch(few, trees, threshold).groupBy("node").agg(F.count("*").alias("n")).where("n > 1"), "probe")
    least = max(SMALL, HEAVY * share * documents * trees)
    found = counts.where(F.col("n") > least).orderBy(F.desc("n"), "node").limit(int(2 / HEAVY)).collect()  # beyond the bound there are none
    scratch.drop("probe")
    return np.array(sorted(r["node"] for r in found), np.int64).view(np.uint64)


def candidates(reps: DataFrame, scratch: shared.Scratch, threshold: float) -> DataFrame:
    """Links (a, b) between representatives that may be similar enough, complete but for the wanted recall."""
    documents = reps.count()
    least, last = least_bits(threshold), levels_for(documents)
    trees = trees_for(threshold, depth=max(EXPECTED_DEPTH, last))
    found, rows = None, reps.select("rep", "sig", "b0", "b1")
    for depth in range(1, last + 1):
        heavy = heavy_nodes(rows, trees, threshold, documents, scratch)
        frontier = branch(rows, trees, threshold, heavy)
        centres = {}
        if depth == last and len(heavy):
            centres = {r["node"]: r["rep"] for r in frontier.where("heavy").groupBy("node").agg(F.min("rep").alias("rep")).collect()}
        level = scratch.keep(grouped(frontier, least, depth == last, centres), f"level_{depth}")
        links = level.where("link").select("a", "b")
        found = links if found is None else found.unionByName(links)
        scratch.drop(f"parents_{depth - 1}")
        if depth < last:
            parents = scratch.keep(level.where("not link").groupBy(F.col("a").alias("rep")).agg(F.collect_set("b").alias("parents")), f"parents_{depth}")
            if parents.isEmpty():
                break
            rows = parents.join(reps.select("rep", "sig", "b0", "b1"), "rep")
    return found


def linked(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """Boolean matrix of links between the sets of a and b (or of a with itself), exact."""
    both = sets_a if sets_b is None else sets_a + sets_b
    sizes = np.array([len(s) for s in both])
    _, code = np.unique(np.concatenate(both), return_inverse=True)
    owner = np.repeat(np.arange(len(both)), sizes)
    df = np.bincount(code)
    shared_code = np.where(df > 1, np.cumsum(df > 1) - 1, -1)[code]
    owner, code = owner[shared_code >= 0], shared_code[shared_code >= 0]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    common, width, n_a = np.zeros((len(sets_a), len(both)), np.float32), 4096, len(sets_a)
    for start in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        lo, hi = np.searchsorted(code, [start, start + width])
        block = np.zeros((len(both), width), np.float32)
        block[owner[lo:hi], code[lo:hi] - start] = 1
        common += block[:n_a] @ block.T
    if sets_b is None:
        other, common = sizes, common
    else:
        other, common = sizes[n_a:], common[:, n_a:]
    common = common.astype(np.int64)
    return 100 * common >= percent * (sizes[:n_a, None] + other - common)


def roots(link: np.ndarray) -> np.ndarray:
    """Smallest index of each row's component in a symmetric matrix of links."""
    label = np.arange(len(link))
    while True:
        near = np.minimum(np.where(link, label, len(link)).min(1), label)
        near = near[near]
        if (near == label).all():
            return label
        label = near


def groups(batch: pa.RecordBatch, key: str) -> Iterator[pa.RecordBatch]:
    values = batch.column(key).to_numpy()
    cuts = np.flatnonzero(np.diff(values)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


def edge_batch(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])


def once(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Without rows whose (rep, tag) was seen before, of the last ``most`` kinds."""
    seen: set[tuple] = set()
    for b in batches:
        keep = []
        for key in zip(b.column("rep").to_pylist(), b.column("tag").to_pylist(), strict=True):
            keep.append(key not in seen)
            seen.add(key)
        if len(seen) > most:
            seen.clear()
        yield b.filter(pa.array(keep, pa.bool_()))


def verify_clusters(members: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, root) for all but the first of each exact component; ``members``: cluster, rep, tag (of the text), text, possibly repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = shared.WordHashes()
        for whole in shared.whole_groups((b for b in once(batches) if b.num_rows), "cluster"):
            out = []
            for g in groups(whole, "cluster"):
                ids = g.column("rep").to_numpy()
                order = np.argsort(ids, kind="stable")
                texts = shared.raw_texts(g.column("text"))
                sets = [shingle_set(texts[i], words, hashes) for i in order]
                ids = ids[order]
                link = linked(sets, None, percent)
                if len(np.unique(ids)) < len(ids):
                    link |= ids[:, None] == ids
                out += sorted({(int(ids[i]), int(ids[r])) for i, r in enumerate(roots(link)) if ids[i] != ids[r]})
            if out:
                yield edge_batch(out)

    early = members.mapInArrow(once, members.schema)  # repeated rows end where they are read
    return early.repartition("cluster").sortWithinPartitions("cluster", "rep", "tag").mapInArrow(run, "a long, b long")


def pivots_of(members: DataFrame) -> DataFrame:
    """(cluster, pivot): the member that agrees most with the majority of each one-bit token; members: cluster, rep, b0, b1."""
    bits = [F.shiftright(F.col(c), k).bitwiseAND(F.lit(1)) for c in ("b0", "b1") for k in range(64)]
    majority = members.groupBy("cluster").agg(F.count("*").alias("m"), *[F.sum(b).alias(f"s{k}") for k, b in enumerate(bits)])
    word = lambda part: F.aggregate(F.array(*[F.when(F.col(f"s{64 * part + k}") * 2 > F.col("m"), F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")) for k in range(64)]), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    centre = majority.select("cluster", word(0).alias("c0"), word(1).alias("c1"))
    far = F.bit_count(F.col("b0").bitwiseXOR(F.col("c0"))) + F.bit_count(F.col("b1").bitwiseXOR(F.col("c1")))
    return members.join(centre, "cluster").groupBy("cluster").agg(F.min(F.struct(far.alias("far"), "rep")).alias("p")).select("cluster", F.col("p.rep").alias("pivot"))


def sketched(loose: DataFrame, members: DataFrame, percent: int, find, schema: str) -> DataFrame:
    """What ``find`` makes of the pairs of a ``loose`` row and a member with another label of its cluster that may be linked.

    Both: cluster, rep, n, b0, b1, several (texts, so that n and the sketch say nothing), label, loose, at.  ``find`` gets columns of both sides, the
    matrix of pairs and that of differing one-bit tokens.
    """
    most = COORDINATES - least_bits(percent / 100, 6.0)
    wide = lambda rows, name: rows.groupBy("cluster").agg(F.ceil(F.count("*") / SKETCH_DOCS).alias(name))
    width = wide(loose, "p").join(wide(members, "q"), "cluster")
    columns = ["cluster", "rep", "n", "b0", "b1", "several", "label", "loose", "at"]

    def deal(rows: DataFrame, own: str, other: str, side: int) -> DataFrame:
        mine, all_others = F.pmod(F.xxhash64("rep", F.lit(5)), F.col(own)), F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        rows = rows.join(width, "cluster").select(*columns, mine.alias(f"my_{own}"), all_others.alias(f"my_{other}"), F.lit(side).alias("side"))
        return rows.select(F.xxhash64("cluster", "my_p", "my_q").alias("group"), *columns, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in shared.whole_groups(batches, "group"):
            for g in groups(whole, "group"):
                side = g.column("side").to_numpy()
                every = {c: g.column(c).to_numpy(zero_copy_only=False) for c in columns}
                own, y = np.flatnonzero(side == 0), {c: v[side == 1] for c, v in every.items()}
                for start in range(0, len(own) if len(y["rep"]) else 0, 100):
                    x = {c: v[own[start : start + 100]] for c, v in every.items()}
                    differ = sum(np.bitwise_count(x[b].view(np.uint64)[:, None] ^ y[b].view(np.uint64)) for b in ("b0", "b1"))
                    n, m = x["n"][:, None], y["n"]
                    near = (differ <= most) & (100 * n >= percent * m) & (100 * m >= percent * n)
                    near |= x["several"][:, None] | y["several"]
                    near &= x["label"][:, None] != y["label"]
                    if near.any():
                        yield find(x, y, near, differ)

    both = deal(loose, "p", "q", 0).unionByName(deal(members, "q", "p", 1))
    return both.repartition("group").sortWithinPartitions("group").mapInArrow(run, schema)


def nearest(x: dict, y: dict, near: np.ndarray, differ: np.ndarray) -> pa.RecordBatch:
    """Of each x its NEAREST y."""
    far = np.where(near, differ.astype(np.int64), 1000)
    at = np.argsort(far, axis=1, kind="stable")[:, :NEAREST]
    row, far = np.repeat(np.arange(len(far)), at.shape[1]), np.take_along_axis(far, at, 1).ravel()
    ok = far < 1000
    row, at, far = row[ok], at.ravel()[ok], far[ok]
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (x["cluster"][row], x["rep"][row], far, y["rep"][at])], names=["cluster", "x", "far", "y"])


def places(x: dict, y: dict, near: np.ndarray, _: np.ndarray) -> pa.RecordBatch:
    """The (part, block) in which each x and each y has a pair; two loose rows meet once."""
    i, j = np.nonzero(near & (~y["loose"] | (x["rep"][:, None] < y["rep"])))
    left = np.unique(np.stack([x["at"][i], y["at"][j], x["rep"][i], x["cluster"][i], np.zeros_like(i)]), axis=1)
    right = np.unique(np.stack([x["at"][i], y["at"][j], y["rep"][j], y["cluster"][j], np.ones_like(i)]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in np.concatenate([left, right], axis=1)], names=["part", "block", "rep", "cluster", "side"])


def verify_hot(members: DataFrame, texts: DataFrame, scratch: shared.Scratch, words: int, percent: int) -> DataFrame:
    """Links in clusters of more than a block: with the pivot, with the nearest, then of all still apart; members: cluster, rep, blocks, n, b0, b1, several."""
    members = scratch.keep(members.select("*", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block")), "hot_members")
    pivots = scratch.keep(pivots_of(members), "hot_pivots")
    sides = members.join(texts, "rep").select("cluster", "block", "rep", "text", F.lit(1).alias("side"))
    size = members.groupBy("cluster").agg(F.max("blocks").alias("blocks"))
    centre = pivots.join(size, "cluster").join(texts, F.col("pivot") == F.col("rep")).select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("pivot").alias("rep"), "text", F.lit(0).alias("side"))

    def meet(rows: DataFrame, columns: list[str]) -> DataFrame:
        """Links between the rows of side 0 and those of side 1 in each group."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = shared.WordHashes()
            for whole in shared.whole_groups(batches, "group"):
                out = []
                for g in groups(whole, "group"):
                    ids, side = g.column("rep").to_numpy(), g.column("side").to_numpy()
                    sets = [shingle_set(t, words, hashes) for t in shared.raw_texts(g.column("text"))]
                    own, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                    if not len(own) or not len(other):
                        continue
                    link = linked([sets[i] for i in own], [sets[i] for i in other], percent)
                    forest = shared.Forest()
                    for i, row in zip(own, link, strict=True):
                        for j in np.flatnonzero(row):
                            a, b = int(ids[i]), int(ids[other[j]])
                            if a != b and forest.join(a, b):
                                out.append((a, b))
                if out:
                    yield edge_batch(out)

        keyed = rows.withColumn("group", F.xxhash64(*columns))
        return keyed.repartition("group").sortWithinPartitions("group").mapInArrow(run, "a long, b long")

    links = scratch.keep(meet(sides.unionByName(centre), ["cluster", "block"]), "hot_star")
    left = None
    for k in range(ROUNDS + 1):
        root = scratch.keep(connected(links, scratch, f"hot_parts_{k}"), f"hot_labels_{k}")
        named = members.join(root, F.col("rep") == F.col("id"), "left").select(*members.columns, F.coalesce("root", "rep").alias("label"))
        main = named.groupBy("cluster", "label").agg(F.count("*").alias("m")).groupBy("cluster").agg(F.max_by("label", F.struct("m", "label")).alias("main"))
        named = scratch.keep(named.join(main, "cluster").select(*named.columns, (F.col("label") != F.col("main")).alias("loose")), f"hot_named_{k}")
        loose = named.where("loose")
        before, left = left, loose.count()
        if not left:
            return links
        if k == ROUNDS or left <= BLOCK_DOCS or before is not None and 2 * left > before:
            break
        near = sketched(loose.withColumn("at", F.lit(0).cast("long")), named.withColumn("at", F.lit(0).cast("long")), percent, nearest, "cluster long, x long, far long, y long")
        near = near.groupBy("cluster", "x").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "y"))), 1, NEAREST).alias("best"))
        near = scratch.keep(near.select("cluster", "x", F.explode("best.y").alias("rep")), f"hot_near_{k}")
        met = near.select("cluster", "x", F.lit(1).alias("side"), "rep").unionByName(near.select("cluster", "x", F.lit(0).alias("side"), F.col("x").alias("rep")).distinct())
        links = links.unionByName(scratch.keep(meet(met.join(texts, "rep"), ["cluster", "x"]), f"hot_found_{k}"))
    parts = loose.groupBy("cluster").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_DOCS)).alias("parts"))
    loose = loose.join(parts, "cluster").withColumn("at", F.pmod(F.xxhash64("rep"), F.col("parts")))
    spots = scratch.keep(sketched(loose, named.withColumn("at", F.col("block")), percent, places, "part long, block long, rep long, cluster long, side long"), "hot_spots")
    rows = spots.distinct().join(texts, "rep")
    return links.unionByName(scratch.keep(meet(rows, ["cluster", "part", "block"]), "hot_links"))


def other_classes(sigs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): ids whose rows have several sets, with the representative of each of these."""
    rows = sigs.where("n > 0 and doc_id is not null").select("doc_id", "key")
    several = rows.groupBy("doc_id").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("doc_id")
    return rows.join(several, "doc_id").distinct().join(classes.select("key", "rep"), "key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    scratch = shared.Scratch(docs.sparkSession)
    docs = shared.keyed_text(docs, id_col, text_col)
    sigs = scratch.keep(sketches(docs, words), "sketches")
    # Rows of one key have one set, hence one sketch; any of them will do.
    classes = scratch.keep(sigs.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "sig", "b0", "b1")]), "classes")
    clusters = scratch.keep(connected(candidates(classes, scratch, percent / 100), scratch, "cluster"), "clusters")
    # An id with several different texts represents several classes, but is one member.
    sized = classes.select("rep", "n", "b0", "b1").join(clusters, F.col("id") == F.col("rep")).groupBy("rep").agg(F.first("root").alias("cluster"), F.sum("n").alias("n"), F.min("b0").alias("b0"), F.min("b1").alias("b1"), (F.count("*") > 1).alias("several"))
    members = scratch.keep(sized, "members")
    sizes = scratch.keep(members.groupBy("cluster").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_DOCS)).alias("blocks")), "sizes")
    sized = members.join(sizes, "cluster")
    own = scratch.keep(sized.where("blocks = 1").select("cluster", "rep"), "own")  # its size is known, so texts are only shuffled if it is large
    exact = verify_clusters(docs.join(own, F.col("doc_id") == F.col("rep")).select("cluster", "rep", F.xxhash64("text").alias("tag"), "text"), words, percent)
    exact = scratch.keep(exact.select(F.col("a").alias("id"), F.col("b").alias("root")), "exact")
    if not sizes.where("blocks > 1").isEmpty():
        hot = scratch.keep(sized.where("blocks > 1"), "hot")
        # The different texts of each member, once each.
        texts = docs.join(hot.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("rep")).agg(F.collect_set("text").alias("texts"))
        texts = scratch.keep(texts.select("rep", F.explode("texts").alias("text")), "hot_texts")  # several joins read them
        exact = exact.unionByName(scratch.keep(connected(verify_hot(hot, texts, scratch, words, percent), scratch, "hot"), "hot_roots"))
    shared_ids = scratch.keep(other_classes(sigs, classes), "shared_ids")
    if not shared_ids.isEmpty():
        edges = exact.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(shared_ids)
        exact = scratch.keep(connected(edges, scratch, "ids"), "by_id")
    named = scratch.keep(classes.select("key", "rep").join(exact, F.col("rep") == F.col("id"), "left").select(F.col("key").alias("k"), F.coalesce("root", "rep").alias("root")), "named")
    scratch.drop(*[n for n in list(scratch.paths) if n not in ("sketches", "named")])
    out = sigs.select("doc_id", "n", "key").join(named, (F.col("key") == F.col("k")) & F.col("doc_id").isNotNull() & (F.col("n") > 0), "left")
    root = F.coalesce("root", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))
