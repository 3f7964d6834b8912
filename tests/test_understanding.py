"""Golden strings of query rewriting and understanding."""

from __future__ import annotations

import itertools
import json

import pytest
from pyspark.sql import functions as F

from tidewell.functions.text import fold_text
from tidewell.operators.joins import edit1_pairs
from tidewell.plans import rewrite, signals
from tidewell.plans.lexicon import ABBREVIATIONS, Lexicon
from tidewell.plans.understand import Understanding, negated
from tidewell.settings import Rewrite, Settings
from tidewell.sources import corpus

U = Understanding()


@pytest.fixture(scope="module")
def vocabulary(spark):
    return rewrite.of_lexicon(spark).kept()


@pytest.fixture(scope="module")
def step(spark, vocabulary):
    """f(step, texts): what a step of the rewriting makes of texts."""

    def run(name, texts, conf=Rewrite()):
        rows = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "query_id string, text string")
        make = {"abbreviations": lambda: rows.select("query_id", rewrite.expanded(F.col("text"), ABBREVIATIONS).alias("text")), "accents": lambda: rewrite.restored(rows, vocabulary.forms, conf), "typos": lambda: rewrite.corrected(rows, vocabulary, conf), "all": lambda: rewrite.preprocess(rows, vocabulary, ABBREVIATIONS, conf)}
        got = {int(r["query_id"]): r["text"] for r in make[name]().collect()}
        return [got[k] for k in range(len(texts))]

    return run


def test_fold():
    assert fold_text("Đà Nẵng 24/7") == "da nang 24/7"


def test_abbreviations(step):
    assert step("abbreviations", ["bv gần q1", "q1a", "KS ĐN", "xbv bv2", ""]) == ["bệnh viện gần quận 1", "q1a", "khách sạn Đà Nẵng", "xbv bv2", ""]


def test_accents(step):
    texts = ["benh vien da nang", "quán cà phê", "a very long english sentence", "khach san 24/7", "", "  "]
    assert step("accents", texts) == ["bệnh viện đà nẵng", "quán cà phê", "a very long english sentence", "khách sạn 24/7", "", "  "]


def test_words_that_do_not_change_are_no_evidence(spark, step, vocabulary):
    """Words of the lexicon without accents cover nothing: such a text stays, as does one with too few words that change."""
    assert step("accents", ["view hotel coffee park", "hotel park coffee cafe benh vien"]) == ["view hotel coffee park", "hotel park coffee cafe benh vien"]
    assert step("accents", ["hotel benh vien"]) == ["hotel bệnh viện"]


def test_typos(step):
    assert step("typos", ["nhà hàg", "nhà hàng", "ab xyzzyx", "(khách sạnn)!", "ha 123 x1y"]) == ["nhà hàng", "nhà hàng", "ab xyzzyx", "(khách sạn)!", "ha 123 x1y"]
    assert step("typos", ["nhà hàg"], Rewrite(typo_fix=False)) == ["nhà hàg"]


def test_trailing_letters(step):
    assert step("typos", ["nha hangf", "hotelw", "siêu thịj"]) == ["nha hàng", "hotel", "siêu thị"]


def plain_fix(core, before, after, words, pairs, known):
    """One token by the rules, over the whole dictionary."""
    def one(core):
        marked = fold_text(core) != core
        near = lambda a, b: a != b and any(a == v or v2 == b or v == v2 for v in cuts(a) for v2 in cuts(b)) and abs(len(a) - len(b)) <= 1 and distance(a, b) == 1
        found = {w for w in words if near(core, w)} if marked else {words[w] for w in words if near(fold_text(core), fold_text(w))}
        if len(found) > 1:
            found = {w for w in found if (before, fold_text(w)) in pairs or (fold_text(w), after) in pairs}
        return found.pop() if len(found) == 1 else None

    if len(core) < 3 or not core.isalpha() or fold_text(core) in known:
        return core
    fixed = one(core)
    if fixed is None and len(core) >= 4 and core[-1] in "fjzw":
        cut = core[:-1]
        firsts = {fold_text(w): v for w, v in reversed(list(words.items()))}
        fixed = firsts.get(fold_text(cut), cut) if fold_text(cut) in known else one(cut)
    return fixed or core


def cuts(w):
    return {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_typos_equal_a_plain_search(spark):
    """Every one-letter change of words of small phrases, in context, against a search of the whole dictionary."""
    phrases = ["bàn ghế", "bán hàng", "ghe tàu", "hang động", "ban mai"]
    v = rewrite.vocabulary(spark.createDataFrame(list(enumerate(phrases)), "o long, phrase string")).kept()
    known = {r["key"] for r in v.known.collect()}
    firsts = {}
    for p in phrases:
        for w in p.split():
            firsts.setdefault(fold_text(w), w)
    words = {w: firsts[fold_text(w)] for p in phrases for w in p.split()}
    pairs = {(fold_text(a), fold_text(b)) for a, b in (p.split() for p in phrases)}
    texts = []
    for p in phrases:
        a, b = p.split()
        for odd in sorted({*cuts(a), a + "f", a[:-1] + "x", "x" + a, a[:-1] + "fj"} - {""}):
            texts += [f"{odd} {b}", f"{b} {odd}"]
    want = []
    for t in texts:
        t = t.split()
        want.append(" ".join(plain_fix(w, fold_text(t[k - 1]) if k else None, fold_text(t[k + 1]) if k + 1 < len(t) else None, words, pairs, known) for k, w in enumerate(t)))
    rows = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    got = {r["query_id"]: r["text"] for r in rewrite.corrected(rows, v).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_rewriting_is_idempotent(step):
    parts = "bv q1 ca phe khach san nha hang yen tinh hotel 24/7 view đẹp sài gòn".split()
    texts = [" ".join(p) for p in itertools.islice(itertools.permutations(parts, 3), 0, 2000, 37)]
    once = step("all", texts)
    assert step("all", once) == once


def test_edit_distance(spark):
    words = ["".join(p) for n in range(1, 4) for p in itertools.product("ab", repeat=n)]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    got = {tuple(r) for r in edit1_pairs(rows.select(F.col("w").alias("token")), rows.select(F.col("w").alias("candidate"))).collect()}
    assert got == {(a, b) for a in words for b in words if distance(a, b) == 1}


def test_negations():
    assert [x[2:] for x in negated("khong on ao va khong co cho dau xe rong rai")] == [("khong", "on ao"), ("khong co", "dau xe rong")]
    assert negated("khong gian dep") == negated("dung o gan") == negated("khong, on ao") == []
    assert [x[2:] for x in negated("chua, dat khong  qua   dong")] == [("khong qua", "dong")]


def test_blanks_do_not_matter():
    assert [U.plan("khách sạn  đánh   giá  cao  nhất")[k] for k in ("sort_by", "sort_order")] == ["rating", "desc"]
    assert [U.plan("giá   rẻ    nhất")[k] for k in ("sort_by", "sort_order")] == ["price", "asc"]
    assert U.plan("bệnh viện đang   mở  cửa")["current_time_open"]


def test_folded_attributes(spark):
    """Attributes are compared without case and accents."""
    from tidewell.plans import query_plan

    p = query_plan.literal(query="x", attribute_weights={"Yên Tĩnh": 0.5, "view": 0.5})
    q = query_plan.literal(query="x", attr_concepts=["yen tinh", "đẹp"])
    place = F.struct(F.array(F.lit("yên tĩnh"), F.lit("ĐẸP")).alias("attributes"))
    assert tuple(spark.range(1).select(signals.attr(p, place), signals.attr(q, place)).first()) == (0.5, 1.0)


def test_lexicon_and_settings_from_files(tmp_path, spark):
    (tmp_path / "abbreviations.json").write_text(json.dumps({"bx": "bến xe"}))
    (tmp_path / "landmarks.json").write_text(json.dumps({"hồ x": [1.0, 2.0, "Hà Nội"]}))
    lexicon = corpus.lexicon_of(spark, str(tmp_path))
    assert lexicon.abbreviations == {"bx": "bến xe"} and Understanding(lexicon).plan("gần hồ x")["resolved_coord"] == {"lat": 1.0, "lon": 2.0}
    (tmp_path / "s.json").write_text(json.dumps({"search": {"pool": 9}, "batch_limit": 7, "constraints": {"price_levels": [["re", 1]]}}))
    conf = Settings.load({"TIDEWELL_SEARCH_MOST": "15", "TIDEWELL_TYPO_FIX": "no"}, path=str(tmp_path / "s.json"))
    assert (conf.search.pool, conf.search.most, conf.batch_limit, conf.rewrite.typo_fix, conf.constraints.price_levels) == (9, 15, 7, False, (("re", 1),))
    with pytest.raises(ValueError, match="nope"):
        Settings.load({}, path=str((tmp_path / "t.json").write_text('{"search": {"nope": 1}}') and tmp_path / "t.json"))


def test_sort_and_open():
    assert [U.plan("khách sạn rẻ nhất")[k] for k in ("sort_by", "sort_order")] == ["price", "asc"]
    assert [U.plan("quán ăn đánh giá cao nhất")[k] for k in ("sort_by", "sort_order")] == ["rating", "desc"]
    assert U.plan("bệnh viện đang mở cửa")["current_time_open"]


def test_numbers():
    p = U.plan("nhà hàng dưới 200k trên 4 sao sau 22 giờ")
    assert (p["price_limit"], p["price_op"], p["rating_limit"], p["rating_op"], p["time_limit_minutes"], p["time_op"]) == (200000.0, "le", 4.0, "ge", 1320, "ge")
    assert U.plan("siêu thị 24/7")["time_limit_minutes"] is None
    assert U.plan("quận 10 nhà hàng")["price_limit"] is None


def test_places():
    p = U.plan("cà phê gần hồ gươm")
    assert p["landmark"] == "hồ gươm" and p["city"] == "Hà Nội" and p["resolved_coord"]
    assert U.plan("chuyến đi hồ gươm về")["landmark"] is None  # no cue in front
    assert U.plan("khách sạn q1")["district"] == "Quận 1"
    assert U.plan("khách sạn đà nẵng quận 1")["district"] is None  # another city


def test_negation():
    p = U.plan("quán ăn không ồn ào")
    assert p["neg_concepts"] == ["ồn ào"] and p["attribute_weights"].get("yên tĩnh") == 1.0


def test_categories():
    assert U.plan("quán cà phê yên tĩnh")["categories"] == ["Quán cà phê"]
    joint = Understanding(joint=True).plan("quán cà phê yên tĩnh")
    assert joint["category_weights"] and not joint["categories"]


def test_centroid_fallback():
    u = Understanding(Lexicon(centroids={("TP.HCM", "Quận 3"): (10.78, 106.68)}))
    assert u.plan("nhà hàng quận 3")["resolved_coord"] == {"lat": 10.78, "lon": 106.68}


def test_texts_are_rewritten_once_each(spark, vocabulary):
    """Many queries with few texts: what is joined back are the texts that change, without maps of forms; null and copied ids stay."""
    texts = ["benh vien da nang", "quán cà phê", None, "", "zzz"]
    rows = spark.range(400).select((F.col("id") % 200).alias("query_id"), F.get(F.array(*[F.lit(t) for t in texts]), (F.col("id") % 5).cast("int")).alias("text"))
    out = rewrite.restored(rows, vocabulary.forms)
    got = {(r["query_id"], r["text"]) for r in out.collect()}
    assert out.count() == 400 and got == {(k, ["bệnh viện đà nẵng", *texts[1:]][k % 5]) for k in range(200)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("query_id") <= 3  # ids go through the last join only


def test_plans_of_copied_texts(spark):
    """Rules run once for a text; a query without text has the plan of an empty one."""
    from tidewell.plans import understand

    rows = spark.createDataFrame([("1", "nhà hàg q1"), ("2", "nhà hàg q1"), ("3", None), ("4", "")], "query_id string, query string")
    got = {r["query_id"]: r["plan"] for r in understand.plans(rows).collect()}
    assert got["1"] == got["2"] and got["1"]["district"] == "Quận 1" and got["1"]["categories"] == ["Nhà hàng"]
    assert got["3"] == got["4"] and got["3"]["query"] == "" and len(got) == 4
