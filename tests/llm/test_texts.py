"""Packing, fingerprints, token counts and leaks against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import zlib

import numpy as np
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm import decontamination, packing, shared, token_counts, winnowing
from tidewell.llm.queries import queries


def test_packing_round_trip(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = collections.Counter()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        bounds = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            want[i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = packing.pack(docs).collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= math.ceil(sum(r["length"] for r in got) / 1024) + 1


def test_packing_empty(empty):
    assert packing.pack(empty).count() == 0


def test_special_token_text_is_encoded_alike():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    for text in ("a<|endoftext|>b", "naïve  \t x\r\n\n", "it's $$$ 12345"):
        assert packing.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), min_size=1, max_size=8))
def test_plan_uses_every_piece(histogram):
    used, bins = collections.Counter(), packing.plan(histogram, 30)
    for chosen, times in bins:
        assert sum(k * c for k, c in chosen.items()) <= 30
        for k, c in chosen.items():
            used[k] += c * times
    assert used == histogram


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=12, max_size=12), st.integers(0, 25))
def test_fullest_is_best(counts, room):
    reachable = {0}
    for k, c in enumerate(counts):
        if k:
            reachable = {r + k * j for r in reachable for j in range(c + 1)}
    best = max(r for r in reachable if r <= room)
    assert sum(k * c for k, c in packing.fullest(counts, room).items()) == best


def long_hash(value: int, seed: int) -> int:
    return xxhash.xxh64_intdigest((value % 2**64).to_bytes(8, "little"), seed=seed)


def signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def brute_winnow(text: str) -> list[int]:
    """Selected (hash, position) values, straight from the definition."""
    words = text.encode().split()
    units = [w.decode()[k : k + 16] for w in words for k in range(0, len(w.decode()), 16)]
    h = [signed(xxhash.xxh64_intdigest(u.encode(), seed=42)) for u in units]
    pair = lambda a, b: signed(long_hash(b, long_hash(a, 42)))
    if len(h) >= 4:
        two = [pair(a, b) for a, b in zip(h, h[1:], strict=False)]
        grams = [pair(a, b) for a, b in zip(two, two[2:], strict=False)]
    elif h:
        seed = 42
        for x in h:
            seed = long_hash(x, seed)
        grams = [signed(seed)]
    else:
        return []
    top = (1 << 30) - 1
    keys = [(g >> 30 << 30) | (top - i) for i, g in enumerate(grams)]
    w = min(16, len(keys))
    out: list[int] = []
    for i in range(len(keys) - w + 1):
        m = min(keys[i : i + w])
        if m not in out:
            out.append(m)
    return out


def jaccard(a: list[int], b: list[int]) -> float:
    x, y = {v >> 30 for v in a}, {v >> 30 for v in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def test_fingerprints(docs, rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = collections.Counter()
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        f, e = brute_winnow(t), brute_winnow(edited)
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(f, e), 9), round(jaccard(f, brute_winnow(after)), 9), len(f), len(e)] += 1
    for n in (7, 2048):
        got = winnowing.fingerprints(docs, n, keys=winnowing.word_keys).collect()
        size = lambda s: len(s.split()) if s else 0
        assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9), size(r["fingerprint"]), size(r["edited_fingerprint"])) for r in got) == want
    prints = {}
    for r in got:
        prints.setdefault(r["doc_id"], r["fingerprint"])
    assert prints[30] == prints[31] != prints[83]


def test_ranges_follow_quantiles_not_values(spark):
    """Dense ids beside an outlier, and ids far apart: no range holds much more than its share."""
    ids = [*range(5000), 10**15, -(2**63), 2**63 - 1, None, None]
    docs = spark.createDataFrame([(i, f"text number {i} of several") for i in ids], "doc_id long, text string").repartition(3)
    lows = winnowing.borders(docs.select("doc_id"), 50, 5003)
    assert 40 <= len(lows) <= 60 and lows == sorted(lows)
    sizes = docs.groupBy(winnowing.range_of(F.col("doc_id"), lows).alias("r")).count().collect()
    assert max(r["count"] for r in sizes) <= 400 and {r["r"] for r in sizes} == set(range(-1, len(lows) + 1))
    got = {r["doc_id"]: r for r in winnowing.fingerprints(docs, 100).collect()}
    text = lambda i: f"text number {i} of several"
    order = sorted([i for i in ids if i is not None], reverse=True)
    for a, b in zip(order, order[1:], strict=False):
        half = len(text(a)) // 2
        assert got[a]["edited_sha256"] == hashlib.sha256((text(a)[: len(text(a)) - half] + text(b)[:half]).encode()).hexdigest()


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text("abé\U0001f642 ", max_size=4).map(lambda t: t or "x"), st.integers(1, 130)), min_size=2, max_size=6))
def test_spliced_equals_a_second_pass(spark, parts):
    """Periodic texts (many ties) and short and long halves: the spliced selection is that of the edited text."""
    docs = spark.createDataFrame([(i, t * n) for i, (t, n) in enumerate(parts)], "doc_id long, text string")
    for r in winnowing.fingerprints(docs).collect():
        i = r["doc_id"]
        text, after = parts[i][0] * parts[i][1], parts[i - 1][0] * parts[i - 1][1]
        edited = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        want = [(v >> 30 & (1 << 34) - 1, (1 << 30) - 1 - (v & (1 << 30) - 1)) for v in brute_char_winnow(edited)]
        assert [(int(x.split("@")[0], 16), int(x.split("@")[1])) for x in r["edited_fingerprint"].split()] == want


def test_fingerprints_empty(empty):
    assert winnowing.fingerprints(empty).count() == 0


def test_shards_count_the_same_terms(spark, monkeypatch):
    """Scores of items with capitals beyond ASCII, and of repeated items, don't depend on the number of shards."""
    given_items = [(i, f"ÉCOLE Ünder Straße word{i} Common-Word École number{i} ÀÉÎ last{i}") for i in range(12)] + [(3, "ÉCOLE repeated ÜBER alles again and again")] * 50
    items = spark.createDataFrame(given_items, "item_id long, text string")
    docs = spark.createDataFrame([(1, given_items[5][1]), (2, given_items[7][1].lower()), (3, "ÉCOLE Ünder Straße word9 Common-Word"), (4, given_items[-1][1])], "doc_id long, text string")
    got = {}
    for size in (4000, 4):
        monkeypatch.setattr(decontamination, "SHARD_ITEMS", size)
        got[size] = sorted(tuple(r) for r in decontamination.leaks(docs, items, 0.2, 0.2).collect())
        indexes = list(decontamination.shards(items.select("item_id", "text"), shared.Scratch(spark)))
        assert sum(len(x.ids) for x in indexes) == 13 and (len(indexes) > 1) == (size == 4)
    assert got[4000] == got[4] and {(1, 5), (4, 3)} <= {r[:2] for r in got[4]}


def test_repeated_items_make_no_shard_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "SHARD_ITEMS", 1000)
    items = spark.createDataFrame([(1, "the very same item of a benchmark")] * 9001, "item_id long, text string")
    assert [len(x.ids) for x in decontamination.shards(items, shared.Scratch(spark))] == [1]


def brute_score(passage, item, all_items):
    """Share of an item's BM25 weight that the words of a passage carry."""
    words = [decontamination.terms_of(t.encode()) for t in all_items]
    average, n, own = sum(map(len, words)) / len(words), len(words), decontamination.terms_of(item.encode())
    weight = {}
    for w in set(own):
        df, f = sum(w in x for x in words), own.count(w)
        weight[w] = math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(own) / average))
    return sum(x for w, x in weight.items() if w in set(passage)) / sum(weight.values())


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from("alpha beta gamma delta eta theta iota kappa".split()), min_size=3, max_size=9), min_size=1, max_size=6, unique_by=tuple), st.lists(st.lists(st.sampled_from("alpha beta gamma delta eta theta iota kappa other".split()), max_size=60), min_size=1, max_size=4))
def test_leaks_equal_scoring_every_passage(spark, items, texts):
    """Every pair above the threshold that is verified, found by scoring all passages against all items."""
    items, texts = [" ".join(x) for x in items], [" ".join(x) for x in texts]
    want, half = {}, max(16, max(len(x.split()) for x in items))
    for d, t in enumerate(texts):
        words = t.encode().split()
        for i, item in enumerate(items):
            question, answer = decontamination.halves(item)
            for a in range(0, len(words), half):
                p = words[a : a + 2 * half]
                grams = {n: {tuple(p[k : k + n]) for k in range(len(p) - n + 1)} for n in (1, 2, 3)}
                score = brute_score(p, item, items)
                if score >= 0.5 - 1e-9 and min(decontamination.overlap(x, grams) for x in (question, answer)) >= 0.6:
                    want[d, i] = max(want.get((d, i), 0.0), score)
    frames = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.leaks(*frames).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def brute_char_winnow(text: str) -> list[int]:
    """As ``brute_winnow``, on runs of 12 characters."""
    grams = [text[i : i + 12] for i in range(len(text) - 11)] or [text] * bool(text)
    keys = [(signed(xxhash.xxh64_intdigest(g.encode(), seed=42)) >> 30 << 30) | ((1 << 30) - 1 - i) for i, g in enumerate(grams)]
    w = min(16, len(keys))
    return list(dict.fromkeys(min(keys[i : i + w]) for i in range(len(keys) - w + 1))) if keys else []


def test_registered_fingerprints_are_of_characters(spark, rows, tmp_path):
    """Short texts with half their words replaced, and text without spaces at another offset, still share hashes."""
    cjk = "".join(chr(0x4E00 + k * 37 % 5000) for k in range(60))
    short = [(1000 + k, " ".join(f"w{k}x{j}" for j in range(18))) for k in range(20)]
    given_rows = [*rows, *short, (2001, "甲" + cjk + "\U0001f642" * 3), (2000, cjk)]
    spark.createDataFrame(given_rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted(given_rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = collections.Counter()
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        f, e = brute_char_winnow(t), brute_char_winnow(t[: len(t) - len(t) // 2] + after[: len(t) // 2])
        want[i, len(t), round(jaccard(f, e), 9), round(jaccard(f, brute_char_winnow(after)), 9), " ".join(str((1 << 30) - 1 - (v & (1 << 30) - 1)) for v in f), len(e)] += 1
    got = queries()["op8_winnowing"](spark, str(tmp_path)).collect()
    places = lambda s: " ".join(x.split("@")[1] for x in s.split())
    assert collections.Counter((r["doc_id"], r["n_chars"], round(r["near_edited"], 9), round(r["near_next"], 9), places(r["fingerprint"]), len(r["edited_fingerprint"].split())) for r in got) == want
    by_id = {r["doc_id"]: r for r in got}
    assert all(by_id[i]["near_edited"] > 0 for i, _ in short) and by_id[2001]["near_next"] > 0.5


def viterbi(word: str, scores: dict[str, float], byte: float) -> int:
    best, longest = [(0.0, 0)], max(map(len, scores))
    for j in range(1, len(word) + 1):
        n = len(word[j - 1].encode())
        options = [(best[j - 1][0] + n * byte, -best[j - 1][1] - n)] + [(best[i][0] + scores[word[i:j]], -best[i][1] - 1) for i in range(max(0, j - longest), j) if word[i:j] in scores]
        top = max(options)
        best.append((top[0], -top[1]))
    return best[-1][1]


def test_token_counts(docs, rows):
    import public_tokenizers

    scores = token_counts.log_probabilities(public_tokenizers.path(token_counts.VOCABULARY))
    trie = token_counts.Trie(scores)
    want = sorted(((i, len((t or "").encode().split()), sum(viterbi("▁" + w.decode(), scores, trie.byte) for w in (t or "").encode().split())) for i, t in rows), key=str)
    assert sorted(map(tuple, token_counts.counted(docs).collect()), key=str) == want


def test_long_words_in_bounded_memory(monkeypatch):
    """Words beyond DEEP, counted as the plain recursion does, without a node for each character."""
    import public_tokenizers

    scores = token_counts.log_probabilities(public_tokenizers.path(token_counts.VOCABULARY))
    monkeypatch.setattr(token_counts, "DEEP", 20)
    trie = token_counts.Trie(scores)
    for word in ("▁" + "internationalisation" * 40, "▁" + "x" * 999, "▁" + "".join(chr(0x4E00 + k * 31 % 3000) for k in range(300)), "▁short", "▁" + "a" * 19):
        assert trie.tokens(word) == viterbi(word, scores, trie.byte)
    assert len(trie.best) <= 1 + 5 * 20


def test_token_counts_empty(empty):
    assert token_counts.counted(empty).count() == 0


def items(rows):
    return [(1, " ".join(rows[0][1].split()[:20]) + ". " + " ".join(rows[0][1].split()[20:28])), (2, "Where is it? Nobody knows the answer to that one today"), (3, None), (4, "..."), (5, rows[2][1]), (None, "")]


def test_leaks(spark, docs, rows, monkeypatch):
    bench = spark.createDataFrame(items(rows), "item_id long, text string")
    planted = spark.createDataFrame([(900, "so " * 40 + "Where is it? Nobody knows the answer to that one today " + "and " * 40), (901, "where is it nobody cares")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(planted)
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(both, bench).collect()}
    assert got == {(1, 1), (3, 5), (900, 2)}
    monkeypatch.setattr(decontamination, "SHARD_ITEMS", 2)
    assert {(r["doc_id"], r["item_id"]) for r in decontamination.leaks(both, bench).collect()} == got


def test_leaks_empty(spark, docs, empty, rows):
    bench = spark.createDataFrame(items(rows), "item_id long, text string")
    assert decontamination.leaks(empty, bench).count() == 0
    assert decontamination.leaks(docs, bench.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefghijkl"), min_size=1, max_size=8), min_size=1, max_size=150), st.lists(st.sampled_from("abcdefghijkl"), min_size=1, max_size=9), st.floats(0.1, 1.0))
def test_wand_equals_scoring_all(texts, query, threshold):
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    df = collections.Counter(w for _, t in rows for w in set(t.encode().split()))
    index = decontamination.Index(rows, df, len(rows), sum(len(t) for t in texts) / len(texts))
    terms = sorted({index.term[w.encode()] for w in query if w.encode() in index.term})
    scores = collections.Counter()
    for t in terms:
        for k, x in zip(index.items[t], index.weights[t], strict=True):
            scores[k] += x
    near = {k for k, v in scores.items() if abs(v - threshold) < 1e-6}
    got = {k for k, _ in index.retrieve(terms, threshold)}
    assert got - near == {k for k, v in scores.items() if v >= threshold} - near
