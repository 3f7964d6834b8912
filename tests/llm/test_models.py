"""Classifiers: held-out accuracy, contracts and edge cases; url rules; languages."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.llm import language_id, quality, toxicity, url_filter
from tidewell.llm.labelled import bounded
from tidewell.llm.queries import queries

from .conftest import vocabulary


@pytest.fixture(scope="module")
def labelled(spark):
    """Good and bad texts, clean and toxic ones."""
    r, words = random.Random(1), vocabulary(5, 300)
    docs, labels = [], []
    for i in range(900):
        w = [r.choice(words) for _ in range(r.randint(20, 80))]
        bad, toxic = i % 5 == 0, i % 4 == 1
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["blargh", "blarghing", "snurfle"]))
        text = " ".join(x.upper() + "!!" for x in w) if bad else " ".join(w) + "."
        docs.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels}


@pytest.mark.parametrize(("model", "at"), [(quality, 0), (toxicity, 1)])
def test_held_out_accuracy(labelled, model, at):
    docs, labels, truth = labelled
    got = model.scored(docs, labels).collect()
    assert len(got) == 900
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["predicted"] == truth[r["doc_id"]][at] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= model.THRESHOLD) for r in got)


@pytest.mark.parametrize("model", [quality, toxicity])
def test_labels_of_the_held_out_part_are_not_used(spark, labelled, model):
    docs, labels, truth = labelled
    turned = spark.createDataFrame([(i, 1 - q, 1 - t) if zlib.crc32(str(i).encode()) % 4 == 2 else (i, q, t) for i, (q, t) in truth.items()], labels.schema)
    one, two = ({r["doc_id"]: r["score"] for r in model.scored(docs, x).collect()} for x in (labels, turned))
    assert max(abs(one[i] - two[i]) for i in one) < 1e-9


@pytest.mark.parametrize("model", [quality, toxicity])
def test_edge_cases(docs, rows, empty, labelled, model):
    labels = labelled[1]
    assert model.scored(docs, labels).count() == len(rows)
    assert model.scored(empty, labels).count() == 0
    assert model.scored(docs, labels.limit(0)).count() == len(rows)


def test_toxicity_behind_a_common_banner(spark, labelled):
    """Texts that begin alike are different texts: their words still enter the lexicon; whole copies count once."""
    docs, labels, truth = labelled
    banner = "this page is served by the archive of a source with a header of more than eighty characters: "
    behind = spark.createDataFrame([(r["doc_id"], banner + r["text"]) for r in docs.collect()], docs.schema)
    lexicon = toxicity.train(behind, labels).lexicon
    assert {"=blargh", "=snurfle"} <= lexicon
    held = [r for r in toxicity.scored(behind, labels).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]][1] for r in held]) >= 0.97
    copies = spark.createDataFrame([(10000 + i, banner + "zork zork") for i in range(200)], docs.schema)
    marked = spark.createDataFrame([(10000 + i, 1, 1) for i in range(200)], labels.schema)
    assert "=zork" not in toxicity.train(behind.unionByName(copies), labels.unionByName(marked)).lexicon


def max_min(values, weights):
    """Non-decreasing weighted least squares, by its max-min formula."""
    n = len(values)
    mean = lambda a, b: np.dot(values[a : b + 1], weights[a : b + 1]) / weights[a : b + 1].sum()
    return [max(min(mean(a, b) for b in range(k, n)) for a in range(k + 1)) for k in range(n)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.booleans()), min_size=2, max_size=40))
def test_isotonic_equals_max_min(pairs):
    z, y = np.array([p[0] for p in pairs], float), np.array([p[1] for p in pairs], float)
    xs, ys = toxicity.isotonic(z, y)
    knots = np.unique(z)
    n = np.array([(z == k).sum() for k in knots], float)
    want = np.array(max_min(np.array([y[z == k].mean() for k in knots]), n))
    got = np.interp(knots, xs, ys)
    assert (np.diff(ys) >= 0).all() and np.abs(got - want).max() <= 0.03  # each block is drawn to one half by 0.04 virtual rows


def test_lexicon_equals_plain_counts(labelled):
    """Every term that passes both tests is listed, counted by hand; no cap."""
    docs, labels, truth = labelled
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    toxic, other, seen = Counter(), Counter(), {}
    for i in sorted(rows):
        seen.setdefault((rows[i], truth[i][1]), i)
    for (text, y), _ in seen.items():
        (toxic if y else other).update({t for w in text.split() for t in toxicity.terms(toxicity.clean(w))})
    n1 = sum(y for _, y in seen)
    n0, share = len(seen) - n1, n1 / len(seen)
    want = {t for t, a in toxic.items() if (a + 0.5) / (n1 + 1) >= toxicity.ODDS * (other[t] + 0.1) / (n0 + 1) and a * np.log(a / (a + other[t]) / share) >= toxicity.EVIDENCE}
    assert toxicity.train(docs, labels).lexicon == want and "=blargh" in want


def test_trees_split_like_a_plain_search():
    """The root's split is the best of all cuts of all features, by gain."""
    r = np.random.default_rng(3)
    x = r.integers(0, 6, (80, 3)).astype(float)
    y = (x[:, 1] + r.normal(0, 0.5, 80) > 2.5).astype(float)
    model = toxicity.Boosted(x, y)
    p = 1 / (1 + np.exp(-model.base))
    g, h = p - y, np.full(80, p * (1 - p))
    best = max((sum(g[m].sum() ** 2 / (h[m].sum() + toxicity.RIDGE) for m in (x[:, f] < c, x[:, f] >= c)), f, c) for f in range(3) for c in range(1, 6) if min((x[:, f] < c).sum(), (x[:, f] >= c).sum()) >= toxicity.LEAST_LEAF)
    feature, cell, _ = model.trees[0][0]
    assert (feature, np.ceil(model.edges[feature][cell])) == best[1:]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=6, max_size=6), st.lists(st.integers(0, 5), min_size=6, max_size=6))
def test_quality_curve_and_prior_equal_plain_ones(positive, unlabelled):
    """Curve: the monotone regression of the ratio of both histograms, times the least ratio of the shares above a score."""
    positive[5] += 1
    p, u = np.zeros(quality.CELLS), np.zeros(quality.CELLS)
    at = np.arange(6) * 80
    p[at], u[at] = positive, np.array(unlabelled) + 1
    ps, us = p[at] / p.sum(), u[at] / u.sum()
    prior = np.clip(min(us[k:].sum() / ps[k:].sum() for k in range(6) if ps[k:].sum() >= quality.LEAST_ABOVE), 0.05, 0.98)
    assert abs(quality.prior_of(p, u) - prior) < 1e-9
    assert np.allclose(quality.curve_of(p, u)[at], np.clip(np.array(max_min(ps / us, us)) * prior, 0, 1), atol=1e-9)


@settings(max_examples=80, deadline=None)
@given(st.text("aZé9 \n\t.,!# ", max_size=60))
def test_quality_features_equal_plain_ones(text):
    raw, words = text.encode(), text.encode().split()
    got = dict(zip(quality.NAMES, quality.features(raw), strict=True))
    if not raw:
        assert not any(got.values())
        return
    share = lambda f: sum(map(f, raw)) / len(raw)
    lines, counts = [x for x in raw.split(b"\n") if x], Counter(words)
    mark = lambda c: 32 < c < 128 and not chr(c).isalnum()
    want = {"upper": share(lambda c: 65 <= c <= 90), "digit": share(lambda c: 48 <= c <= 57), "high": share(lambda c: c > 127), "newline": share(lambda c: c == 10), "distinct": len(counts) / max(1, len(words)), "top_word": max(counts.values(), default=0) / max(1, len(words)), "word_length": np.mean([len(w) for w in words]) if words else 0.0, "word_length_spread": np.std([len(w) for w in words]) if words else 0.0, "line_repeats": 1 - len(set(lines)) / max(1, len(lines)), "capitalised": np.mean([65 <= w[0] <= 90 for w in words]) if words else 0.0, "ends_in_mark": np.mean([mark(w[-1]) for w in words]) if words else 0.0, "doubled_marks": np.mean([a == b and mark(b) for a, b in zip(raw, raw[1:], strict=False)]) if len(raw) > 1 else 0.0, "stops": raw.count(b". ") / max(1, len(words))}
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


@pytest.mark.parametrize("model", [quality, toxicity])
def test_scores_do_not_depend_on_partitions(labelled, model):
    """Another order and other partitions, and every row twice: the same scores."""
    docs, labels, _ = labelled
    one, two, twice = ({(r["doc_id"], r["score"]) for r in model.scored(d, labels).collect()} for d in (docs.coalesce(1), docs.orderBy("text").repartition(7, "text"), docs))
    assert one == two == twice
    rows = model.scored(docs.unionByName(docs), labels).collect()
    assert len(rows) == 1800 and len({(r["doc_id"], r["score"]) for r in rows}) == 900


@pytest.mark.parametrize("n", [0, 3, 1000])
def test_bounded_is_the_smallest_hashes(spark, n):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"))
    want = [r[0] for r in rows.orderBy(F.xxhash64("doc_id")).limit(n).collect()]
    assert [r[0] for r in bounded(rows, n).collect()] == want


def judge_by_hand(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut], rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(r), r) for r, _ in url_filter.RULES if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    return host, path, max(fits)[1] if fits else None


URLS = [None, "", "nothing", "http://", "HTTP://EXAMPLE.org/es/x?q#f", "https://a.example.org/es", "https://a.example.org/en/12", "http://notexample.org/en/1", "http://x.com/fr/1", "http://com/de/", "http://x.com/de/2#a?b", "http://x.com?y=/fr/", "http://É.Com/FR/", "a://b://c/d", "https://online-roulette.test/bonus", "https://www.mountains.example.net/en/2", "http://x.example.net/" + "long/" * 8000, "http://a.net:80/\n/x"]


def test_url_rules(spark):
    rows = spark.createDataFrame([(i, u, "clash", 1.0) for i, u in enumerate([*URLS, URLS[6]])], "page_id long, url string, host string, score double")
    got = {r["page_id"]: r for r in url_filter.judge(rows).collect()}
    assert len(got) == len(URLS) + 1
    for i, u in enumerate(URLS):
        host, path, rule = judge_by_hand(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == (dict(url_filter.RULES)[rule] if rule else "block" if got[i]["score"] >= 0.5 else "allow")
    assert got[14]["verdict"] == "block" and got[15]["verdict"] == "allow"
    assert url_filter.judge(rows.limit(0)).count() == 0


def buckets_by_hand(url):
    """Counts of the hashed n-grams."""
    host, path, _ = judge_by_hand(url)
    out = np.zeros(url_filter.BUCKETS)
    for mark, text in (("^", host), ("~", path)):
        s = mark + text + "$" if text else ""
        for k in range(len(s) - 3 if len(s) >= 4 else bool(s)):
            out[zlib.crc32(s[k : k + 4].encode()) % url_filter.BUCKETS] += 1
    return out


def descend_by_hand(labelled, steps):
    x = np.array([buckets_by_hand(u) for u, _ in labelled])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y, w, b = np.array([v for _, v in labelled], float), np.zeros(url_filter.BUCKETS), 0.0
    for _ in range(steps):
        e = y - 1 / (1 + np.exp(-(x @ w + b)))
        w, b = w * (1 - url_filter.RATE * url_filter.RIDGE) + url_filter.RATE * (e @ x), b + url_filter.RATE / len(y) * e.sum()
    return w, b


def test_url_model_and_scores_equal_plain_ones(spark):
    """The one-row expression against the same descent in Python, on weights instead of coefficients; then every score."""
    weights, bias = url_filter.train(spark, steps=20)
    w, b = descend_by_hand(url_filter.LABELLED, 20)
    assert np.allclose(weights, w, atol=1e-9) and abs(bias - b) < 1e-9
    urls = [*URLS, *[u for u, _ in url_filter.LABELLED]]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    w, b = descend_by_hand(url_filter.LABELLED, url_filter.STEPS)
    for r in url_filter.judge(frame).collect():
        v = buckets_by_hand(urls[r["page_id"]])
        assert abs(r["score"] - 1 / (1 + np.exp(-(b + (v @ w / np.linalg.norm(v) if v.any() else 0.0))))) < 1e-9


def test_url_accuracy_on_urls_left_out():
    """Ten folds of the labelled table: addresses not trained on."""
    right = 0
    for fold in range(10):
        own = [p for k, p in enumerate(url_filter.LABELLED) if k % 10 != fold]
        w, b = descend_by_hand(own, url_filter.STEPS)
        for u, y in (p for k, p in enumerate(url_filter.LABELLED) if k % 10 == fold):
            v = buckets_by_hand(u)
            right += ((b + v @ w / np.linalg.norm(v)) >= 0) == y
    assert right / len(url_filter.LABELLED) >= 0.85


def test_labelled_urls_share_nothing_with_the_pages(spark, sf):
    """No host, and no part of a host, of the labelled table stands in the test tables."""
    part = lambda host: {p for p in host.replace("-", ".").split(".") if len(p) > 3} - {"example", "test"}
    hosts = {judge_by_hand(r["url"])[0] for r in spark.read.parquet(f"{sf}/pages.parquet").select("url").collect()}
    assert not {p for h in hosts for p in part(h)} & {p for u, _ in url_filter.LABELLED for p in part(judge_by_hand(u)[0])}


def test_very_long_urls(spark):
    urls = ["http://a.example/" + "x" * 200000, "http://" + "b." * 60000 + "org/p", "no scheme " * 20000]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(rows).collect()}
    assert len(got[0]["path"]) == 200001 and got[1]["rule"] == "org/" and got[2]["host"] == "" and all(0 <= r["score"] <= 1 for r in got.values())


def test_languages(spark, empty):
    r = random.Random(2)
    vocab = {lang: vocabulary(k, 80) for k, lang in enumerate(("aa", "bb"))}
    rows = [(i, " ".join(r.choice(vocab[lang]) for _ in range(30)), lang, f"s{i % 3}") for i, lang in enumerate(["aa", "bb"] * 40)]
    docs = spark.createDataFrame([*rows, (900, None, None, None), (901, "", None, "s1")], "doc_id long, text string, lang string, source string")
    html = lambda lang, text: f"<html lang='{lang}'><script>var a='{vocab['aa'][0]}';</script><p>{text}</p></html>"
    pages = spark.createDataFrame([(1, "http://x.test/", html("bb", rows[1][1])), (2, "http://x.test/", html("bb", "")), (3, None, None), (4, "http://x.test/", html("aa", rows[3][1]))], "page_id long, url string, html string")
    got = language_id.identify(pages, docs).collect()
    by_doc, by_page = ({r[c]: r for r in got if r[c] is not None} for c in ("doc_id", "page_id"))
    assert len(got) == 86
    assert all(by_doc[i]["lang"] == lang for i, _, lang, _ in rows)
    assert by_page[1]["lang"] == by_page[2]["lang"] == by_page[4]["lang"] == "bb" and by_page[2]["text_lang"] is None
    assert by_page[3]["lang"] in ("aa", "bb") and by_doc[900]["text_lang"] is None
    assert language_id.identify(pages.limit(0), docs.limit(0)).count() == 0


def brute_languages(rows, langs, model):
    """Posterior of every row from the definition: own evidence, and priors from all other rows' evidence by level."""
    evidence = []
    both = [(d, t) for t, d, _ in rows if t and t.strip() and d]
    ll = lambda t: [sum(model[k][g] for g in language_id.trigrams(t.encode())) * min(1.0, language_id.EVIDENCE / (len(t.encode()) )) if t and t.strip() else 0.0 for k in range(len(langs))]
    best = lambda v: langs[int(np.argmax(v))]
    right = min(0.99, max(0.5, (sum(d == best(ll(t)) for d, t in both) + 3) / (len(both) + 4)))
    for t, d, (suffix, _, _) in rows:
        e = np.array(ll(t))
        for said, p in ((d, right), (language_id.COUNTRY.get(suffix), 0.6)):
            if said in langs:
                e += [np.log(p) if x == said else np.log((1 - p) / max(1, len(langs) - 1)) for x in langs]
        evidence.append(e)
    p = [np.exp(e - e.max()) / np.exp(e - e.max()).sum() for e in evidence]
    out = []
    for i, (_, _, place) in enumerate(rows):
        prior = np.full(len(langs), 1 / len(langs))
        for depth, strength in ((0, len(langs)), (1, 5.0), (2, 5.0), (3, 5.0)):
            own = sum((p[j] for j in range(len(rows)) if j != i and rows[j][2][:depth] == place[:depth]), np.zeros(len(langs)))
            prior = (own + strength * prior) / (own.sum() + strength)
        q = p[i] * prior
        out.append(q / q.sum())
    return out


@pytest.mark.parametrize("heavy", [1e-3, 0.2, 2.0])
def test_fusion_equals_brute_force(spark, heavy, monkeypatch):
    """Few rows on hosts of several sizes, with and without text and declarations, heavy hosts or none; a row's own evidence counts once."""
    monkeypatch.setattr(language_id, "HEAVY", heavy)
    r = random.Random(6)
    vocab = {x: vocabulary(20 + k, 60) for k, x in enumerate(("de", "en", "fr"))}
    docs = [(i, " ".join(r.choice(vocab[x]) for _ in range(r.randint(1, 12))), x, f"src{i % 2}") for i, x in enumerate(["de", "en", "fr"] * 8)]
    hosts = ["a.b.co.de", "b.co.de", "x.org", "www.x.org", None]
    pages = []
    for i in range(24):
        x, host = r.choice(list(vocab)), r.choice(hosts)
        text = " ".join(r.choice(vocab[x]) for _ in range(r.choice([0, 1, 2, 5])))
        declared = r.choice(["", f' lang="{r.choice(list(vocab))}"', ' data-lang="fr"'])
        pages.append((i, f"http://{host}/p" if host else None, f"<html{declared}><body>{text}</body></html>"))
    doc_frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    page_frame = spark.createDataFrame([*pages, pages[0]], "page_id long, url string, html string")
    langs, model = language_id.train(doc_frame)
    rows = [(t, None, (None, None, s)) for _, t, _, s in docs]
    for _, url, html in [*pages, pages[0]]:
        host = url.split("/")[2] if url else None
        declared = html.split(' lang="')[1][:2] if ' lang="' in html else None
        rows.append((html.replace("<html" + html.split("<html")[1].split(">")[0] + ">", " ").replace("<body>", " ").replace("</body>", " ").replace("</html>", " "), declared, (host.split(".")[-1], ".".join(host.split(".")[-3:]), host) if host else (None, None, None)))
    want = Counter((langs[int(np.argmax(q))], round(float(q.max()), 6)) for q in brute_languages(rows, langs, model))
    got = language_id.identify(page_frame, doc_frame).collect()
    assert Counter((r["lang"], round(r["confidence"], 6)) for r in got) == want


def test_markup_and_white_space(spark, labelled):
    html = ['<html data-lang="de" lang="en-GB">', "<HTML class='a b' xml:lang=fr\n LANG = es>", '<html title=" lang=de ">', "<html><p lang=fr>", "<htmlx lang=de>", "<html lang='english'>", "<html lang=fr>", None, ""]
    frame = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "i int, h string")
    got = [r[0] for r in frame.orderBy("i").select(language_id.declared_of(F.col("h"))).collect()]
    assert got == ["en", "es", None, None, None, None, "fr", None, None]
    docs = spark.createDataFrame([(1, "some words here", "aa", "s"), (2, "\n\t\n", "bb", "s"), (2, "\n\t\n", "bb", "s"), (3, "\u00a0", "bb", "s"), (4, "other text " * 50000, "bb", "s")], "doc_id long, text string, lang string, source string")
    pages = spark.createDataFrame([(1, "http://a.test", "<html lang=bb>" + "<p>other</p>" * 20000, "clash", 0.5)], "page_id long, url string, html string, lang string, confidence double")
    rows = language_id.identify(pages, docs).collect()
    assert len(rows) == 6 and all(r["text_lang"] is None for r in rows if r["doc_id"] == 2)
    assert {r["lang"] for r in rows if r["doc_id"] == 4 or r["page_id"] == 1} == {"bb"}


def test_every_language_is_a_class(spark):
    langs = [f"{a}{b}" for a in "abcdefg" for b in "abcdefghij"]
    r = random.Random(4)
    rows = []
    for k, lang in enumerate(langs):
        words = vocabulary(100 + k, 30)
        rows += [(10 * k + j, " ".join(r.choice(words) for _ in range(40)), lang, "s") for j in range(2 if k < 64 else 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert language_id.train(docs)[0] == sorted(langs)
    with pytest.MonkeyPatch.context() as m, pytest.raises(ValueError, match="70 values"):
        m.setattr(language_id, "MOST_CLASSES", 69)
        language_id.train(docs)


def test_queries_are_numbered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))
