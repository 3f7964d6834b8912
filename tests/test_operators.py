"""Units of functions, ranking, ingestion and streaming."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewell.functions import geo, hours
from tidewell.functions import text as T
from tidewell.operators import evaluate, lexical, pool, vector
from tidewell.plans import query_plan, rerank, understand
from tidewell.settings import Settings
from tidewell.sources import corpus, ingest
from tidewell.streaming.reload import Served, follow


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_hours(spark):
    h = lambda s: F.lit(s)
    assert one(spark, hours.is_open(h("24/7"), 3))[0] is True
    assert [one(spark, hours.is_open(h("08:00-22:00"), m))[0] for m in (479, 480, 1319, 1320)] == [False, True, True, False]
    assert [one(spark, hours.is_open(h("18:00-02:00"), m))[0] for m in (0, 119, 120, 1080)] == [True, True, False, True]
    assert one(spark, hours.is_open(h("soon"), 3))[0] is False
    assert one(spark, hours.late_closing(h("18:00-02:00")))[0] == 1560
    assert one(spark, hours.late_closing(h("")))[0] is None


def test_geo(spark):
    assert abs(one(spark, geo.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)))[0] - 111.1949) < 1e-3
    assert one(spark, geo.distance_label(F.lit(0.25)))[0] == "250 m"
    with pytest.raises(ValueError):
        geo.in_box(F.lit(1.0), F.lit(1.0), (2.0, 0.0, 1.0, 1.0))


def test_text(spark):
    assert one(spark, T.fold(F.lit("Đường ỐNG 24/7")))[0] == "duong ong 24/7"
    assert one(spark, T.contains_word(F.lit("ăn ở Phở Hòa nhé"), F.lit("phở hoà")))[0] is True
    assert one(spark, T.contains_word(F.lit("phở"), F.lit("phở hoà")))[0] is False
    assert one(spark, T.split_list(F.lit(" a; ;b ;"), ";"))[0] == ["a", "b"]
    assert one(spark, T.document(F.lit("a"), F.lit(""), F.lit(None).cast("string"), F.lit("b")))[0] == "a b"


def test_bm25_folds(spark):
    docs = spark.createDataFrame([(1, "Phở bò Hà Nội"), (2, "bánh mì"), (3, "phở gà"), (4, "cơm"), (5, "trà"), (6, None)], "id int, text string")
    q = spark.createDataFrame([("a", "phở"), ("b", "pho"), ("c", "nothing")], "query_id string, query string")
    got = {}
    for r in lexical.bm25_topk(docs, q, "id", "text", 3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])
    assert got["a"] == got["b"] and set(got["a"][:2]) == {1, 3}
    assert got["c"] == [1, 2, 3]


def test_pool_normalisation(spark):
    rows = spark.createDataFrame([("q", 1, 2.0, None, 7.0), ("q", 2, 4.0, None, 7.0), ("q", 3, None, None, None)], "query_id string, id int, a double, b double, c double")
    got = [tuple(r) for r in rows.select("id", pool.normalised(F.col("a")), pool.normalised(F.col("b")), pool.normalised(F.col("c"))).orderBy("id").collect()]
    assert got == [(1, 0.0, 0.5, 1.0), (2, 1.0, 0.5, 1.0), (3, 0.0, 0.5, 0.0)]


def test_override_puts_unknown_last(spark):
    p = query_plan.literal(query="x", sort_by="price", sort_order="asc")
    rows = spark.createDataFrame([("a", 0, 4.0), ("b", 3, 1.0), ("c", 1, 2.0)], "poi_id string, price_level int, rating double").withColumn("plan", p).withColumn("total", F.lit(1.0)).withColumn("query_id", F.lit("q"))
    assert [r["poi_id"] for r in rerank.ordered(rows).orderBy("rank").collect()] == ["c", "b", "a"]


def test_encoder(spark):
    enc = vector.encoder()
    rows = spark.createDataFrame([("abc",), (None,)], "t string").select(enc("t").alias("v")).collect()
    assert abs(sum(x * x for x in rows[0]["v"]) - 1) < 1e-5


def test_wilson(spark):
    lo, hi = one(spark, *evaluate.wilson(F.lit(8), F.lit(10)))
    assert abs(lo - 0.4902) < 1e-3 and abs(hi - 0.9433) < 1e-3
    assert tuple(one(spark, *evaluate.wilson(F.lit(0), F.lit(0)))) == (0.0, 0.0)


def records(spark, *rows):
    return spark.createDataFrame([(json.dumps(r) if isinstance(r, dict) else r,) for r in rows], "record string")


GOOD = {"poi_id": "C1", "name": "A", "category": "x", "city": "y", "rating": "4.5", "price_level": 2}


def test_validate(spark):
    valid, bad = ingest.validate(records(spark, GOOD, {**GOOD, "poi_id": ""}, {**GOOD, "more": 1}, {**GOOD, "lat": "north"}, "nonsense"))
    assert [(r["poi_id"], r["rating"]) for r in valid.collect()] == [("C1", 4.5)]
    assert sorted(r["errors"][0] for r in bad.collect()) == ["missing: poi_id", "not a JSON object", "not a number: lat", "unknown field: more"]


def test_last_row_of_an_id_counts_and_batch_order_numbers(spark, tmp_path):
    snaps, asked = ingest.Snapshots(spark, str(tmp_path / "s")), str(tmp_path / "asked")
    rows = [{**GOOD, "poi_id": i, "name": n, "address": a} for i, n, a in (("Z", "first", "x"), ("B", "b", "y"), ("Z", "last", "z"), ("A", "a", ""))]

    def client():
        def ask(address):
            with open(asked, "a") as f:
                f.write(address + "\n")
            return (0.9, 0.0, 0.0, "Street") if address == "z" else None

        return ask

    said = ingest.ingest(snaps, records(spark, *rows).coalesce(1), client=client)
    assert (said["accepted"], said["version"], said["unverified_ratio"]) == (4, 1, 0.75)
    got = {r["poi_id"]: (r["name"], r["row_order"], r["status"]) for r in snaps.read().collect()}
    assert got == {"Z": ("last", 0, "verified"), "B": ("b", 1, "unverified"), "A": ("a", 2, "unverified")}
    assert sorted(open(asked).read().split()) == ["x", "y", "z"]  # once each
    ingest.ingest(snaps, records(spark, {**GOOD, "poi_id": "C"}, {**GOOD, "poi_id": "B", "name": "new"}).coalesce(1))
    assert {r["poi_id"]: (r["name"], r["row_order"]) for r in snaps.read().collect()} == {"Z": ("last", 0), "B": ("new", 1), "A": ("a", 2), "C": ("A", 3)}
    assert ingest.backfill_version(snaps, spark.createDataFrame([("A", "active")], "poi_id string, status string")) == 3
    assert {r["poi_id"]: r["status"] for r in snaps.read().collect()}["A"] == "active"


def test_ingest_and_snapshots(spark, tmp_path):
    snaps = ingest.Snapshots(spark, str(tmp_path / "s"))
    served = Served(snaps)
    assert not served.poll()
    said = ingest.ingest(snaps, records(spark, GOOD, {**GOOD, "poi_id": "C2"}, {"poi_id": "C3"}))
    assert (said["accepted"], said["rejected"], said["version"]) == (2, 1, 1)
    assert served.poll() and not served.poll()
    bound = served.current
    said = ingest.ingest(snaps, records(spark, {**GOOD, "name": "B"}, {**GOOD, "poi_id": "C0"}))
    assert said["version"] == 2
    assert {r["poi_id"]: r["name"] for r in bound.collect()} == {"C1": "A", "C2": "A"}
    stream = follow(spark, served, str(tmp_path / "c"))
    stream.awaitTermination()
    assert served.loaded == 2
    now = {r["poi_id"]: (r["name"], r["row_order"]) for r in served.current.collect()}
    assert now["C1"][0] == "B" and now["C0"][1] == 2 and len(now) == 3
    with pytest.raises(RuntimeError):
        snaps.publish(bound, expected=1)
    with pytest.raises(ValueError):
        ingest.guard(501)


def test_upsert_repeated_key(spark):
    old = spark.createDataFrame([("a", 1, 0)], "poi_id string, v int, row_order int")
    batch = spark.createDataFrame([("b", 1, 0), ("b", 2, 1)], "poi_id string, v int, at int")
    got = {r["poi_id"]: (r["v"], r["row_order"]) for r in ingest.upsert(old, batch, position="at").collect()}
    assert got == {"a": (1, 0), "b": (2, 1)}


def test_verify(spark):
    def client():
        calls = {}

        def ask(address):
            calls[address] = calls.get(address, 0) + 1
            if address == "busy" and calls[address] < 3:
                raise ingest.Throttled
            if address == "broken":
                raise OSError
            return None if address == "nowhere" else (0.9, 10.0, 106.0, "Street") if address != "far" else (0.5, 11.0, 106.0, "Region")

        return ask

    rows = spark.createDataFrame([(a, a, 10.0, 106.0) for a in ("busy", "broken", "nowhere", "far", "fine", "")], "poi_id string, address string, lat double, lon double")
    got = {r["poi_id"]: (r["status"], r["reasons"]) for r in ingest.verify(rows, client, sleep=lambda _: None).collect()}
    assert got["fine"] == got["busy"] == ("verified", "")
    assert got["far"] == ("unverified", "low score;too far;place type")
    assert got["nowhere"][1] == "no result" and got[""][1] == "no address" and got["broken"] == ("unverified", "error: OSError")


def test_places_coerce(spark):
    raw = spark.createDataFrame([("G1", " A ", None, "1.5", "a; b;")], "poi_id string, name string, city string, rating string, attributes string")
    r = corpus.places(raw).first()
    assert (r["name"], r["city"], r["rating"], r["lat"], r["attributes"], r["is_synthetic"], r["document"]) == ("A", "", 1.5, 0.0, ["a", "b"], True, "A a b")


def workbook(path, sheets):
    """A workbook from (name, XML of rows); strings a and b are shared."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, (n, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>poi_id</t></si><si><r><t>Phở </t></r><r><t>Hà Nội</t></r><rPh><t>no</t></rPh></si></sst>')
        for i, (_, rows) in enumerate(sheets, 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')


TEXT = '<c r="{}" t="inlineStr"><is><t>{}</t></is></c>'
HEADER = '<row r="1"><c r="A1" t="s"><v>0</v></c>' + TEXT.format("B1", " name ") + TEXT.format("C1", "rating") + TEXT.format("AA1", "attributes") + TEXT.format("AB1", "unknown") + "</row>"


def test_workbooks(spark, tmp_path):
    """Shared, inline, formula and number cells, gaps, rows without cells or known columns, a second sheet and a second file."""
    rows = HEADER + '<row r="2">' + TEXT.format("A2", "G1") + '<c r="B2" t="s"><v>1</v></c><c r="C2"><v>4.5</v></c>' + TEXT.format("AA2", "a; b") + '</row><row r="3"/>'
    rows += '<row r="4"><c r="A4"/>' + TEXT.format("AB4", "x") + '</row><row r="5"><c r="A5" t="str"><f>X</f><v>C2</v></c><c r="C5" t="e"><v>#N/A</v></c></row>'
    (tmp_path / "books").mkdir()
    workbook(tmp_path / "books" / "one.xlsx", [("POI", rows), ("Other", HEADER + '<row r="2">' + TEXT.format("A2", "O1") + "</row>")])
    workbook(tmp_path / "books" / "two.xlsx", [("POI", HEADER)])
    raw = corpus.read_places(spark, "xlsx", str(tmp_path / "books"), sheet="POI")
    got = {r["poi_id"]: r for r in corpus.places(raw).collect()}
    assert set(got) == {"G1", "C2"}
    assert (got["G1"]["name"], got["G1"]["rating"], got["G1"]["attributes"], got["G1"]["is_synthetic"]) == ("Phở Hà Nội", 4.5, ["a", "b"], True)
    assert (got["C2"]["name"], got["C2"]["rating"], got["C2"]["attributes"]) == ("", 0.0, [])
    other = corpus.read_places(spark, "xlsx", str(tmp_path / "books" / "one.xlsx"), sheet="Other")
    assert [r["poi_id"] for r in other.collect()] == ["O1"]
    with pytest.raises(Exception, match="no sheet"):
        corpus.read_places(spark, "xlsx", str(tmp_path / "books" / "one.xlsx"), sheet="None").collect()


def test_evaluation_workbook(spark, tmp_path):
    cells = [("query_id", "q1"), ("input_query", "x y"), ("expected_top_poi_ids", "C1; C2;"), ("ranking_signals_to_use", "bm25, city")]
    rows = "".join(f'<row r="{r + 1}">' + "".join(TEXT.format(f"{'ABCD'[k]}{r + 1}", c[r]) for k, c in enumerate(cells)) + "</row>" for r in (0, 1))
    workbook(tmp_path / "eval.xlsx", [("Eval", rows)])
    r = corpus.read_evaluation(spark, str(tmp_path / "eval.xlsx")).first()
    assert (r["query_id"], r["expected_top_poi_ids"], r["ranking_signals_to_use"], r["difficulty"]) == ("q1", ["C1", "C2"], ["bm25", "city"], None)


def test_bodies(spark):
    """Elements keep their order; a body that is no array is one rejected record."""
    bodies = spark.createDataFrame([(json.dumps([GOOD, {**GOOD, "poi_id": "C2", "name": "é"}]),), ("[]",), ("nonsense",)], "body string").coalesce(1)
    rows = ingest.records(bodies)
    assert [r["position"] for r in rows.orderBy("position").collect()] == [0, 1, 2]
    valid, bad = ingest.validate(rows)
    assert [(r["poi_id"], r["name"]) for r in valid.orderBy("position").collect()] == [("C1", "A"), ("C2", "é")]
    assert [r["errors"] for r in bad.collect()] == [["not a JSON object"]]


def test_channels_can_be_replaced(spark):
    """A channel of ranks only, weighed by its name in a profile of one's own."""
    place = "poi_id string, name string, brand string, category string, city string, district string, attributes array<string>, lat double, lon double, rating double, popularity double, price_level int, opening_hours string, description string"
    places = spark.createDataFrame([(f"C{k}", "n", "", "x", "y", "", [], 0.0, 0.0, 0.0, 0.0, 1, "", "t") for k in range(4)], place)
    plans = spark.range(1).select(F.lit("q").alias("query_id"), F.lit("t").alias("query"), query_plan.literal(query="t").alias("plan"))

    def newest(corpus_, plans_, k):
        best = corpus_.select(F.col("poi_id").alias("id"), (4 - F.substring("poi_id", 2, 1).cast("int")).alias("rank"))
        return best.join(plans_.select("query_id")).where(F.col("rank") <= k)

    rows = rerank.hybrid(places, None, plans, {"newest": 0.5, "rating": 0.5}, channels={"newest": newest}).orderBy("rank").collect()
    assert [r["poi_id"] for r in rows] == ["C3", "C2", "C1", "C0"]
    assert [round(r["total"], 3) for r in rows] == [0.5, 0.333, 0.167, 0.0]


def test_plans_are_rows(spark):
    q = spark.createDataFrame([("1", "quán cà phê gần hồ gươm"), ("2", None)], "query_id string, query string")
    got = {r["query_id"]: r["plan"] for r in understand.plans(q).collect()}
    assert got["1"]["landmark"] == "hồ gươm" and got["2"]["categories"] == []


def test_settings(tmp_path):
    env = tmp_path / "env"
    env.write_text("TIDEWELL_TYPO_FIX=0\n")
    assert not Settings.load({}, str(env)).rewrite.typo_fix
    assert Settings.load({"TIDEWELL_TYPO_FIX": "1"}, str(env)).rewrite.typo_fix


def test_reports(spark, tmp_path):
    import logging

    from tidewell.sources import reports

    text = reports.with_row("| a | b |\n|---|---|\n| x | 1 |\nend", "x", ["2"])
    assert text.split("\n")[2] == "| x | 2 |" and "| y | 3 |" in reports.with_row(text, "y", ["3"])
    record = logging.LogRecord("n", logging.INFO, "f", 1, "said %s", ("này",), None)
    record.fields = {"k": 1}
    assert json.loads(reports.JsonLines().format(record))["message"] == "said này"
    where = reports.report(spark.range(2), str(tmp_path), "Full run", 0.0)
    assert where.endswith("full_run_19700101_000000") and spark.read.json(where).count() == 2
    assert reports.contract_gaps(["id", "name"]) == ["address", "category", "location", "score"]


def test_failed_reload_is_a_warning(spark, tmp_path):
    def fail(_):
        raise OSError

    said = ingest.ingest(ingest.Snapshots(spark, str(tmp_path / "s")), records(spark, GOOD), after=fail)
    assert said["accepted"] == 1 and said["version"] == 1 and "OSError" in said["warning"]


def test_nearest_equals_topk(spark):
    """Tiles of a few rows, ties, gaps, other lengths and missing vectors, against the plain search."""
    vectors = [[float((k * 7 + j * 3) % 5) / 7 - 0.3 for j in range(4)] for k in range(60)]
    vectors += [[0.0] * 4] * 5 + [[0.5e-3, 0.0, 0.0, 1e-3]] * 3 + [None, [1.0, 2.0], [1.0, None, 0.0, 1.0], [], [float("nan"), 0.0, 0.0, 0.0], [1.0, 3.0]]
    rows = spark.createDataFrame(list(enumerate(vectors)), "id long, embedding array<float>")
    queries = rows.where("id % 3 = 0 or id > 60").select(F.col("id").alias("query_id"), F.col("embedding").alias("qvec"))
    want = vector.topk(rows, queries, 7, F.col("query_id") != F.col("id"))
    for tile in ((5, 9), (16_384, 16_384)):
        got = vector.nearest(rows, queries, 7, tile=tile)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_evaluation_keeps_no_pairs(spark, sf):
    """Neither the search nor the gold of the evaluation sends more than k rows of a query through a join or a shuffle of pairs."""
    from tidewell.catalogue import ranking

    plan = ranking._evaluation(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert joins and all("=" in x for x in joins)  # no pairs of all with all
    assert "zip_with" not in plan and "cogroup" in plan.lower()


def test_ngrams_split_a_text_once(spark):
    """The words of a text aren't computed anew for every run of them."""
    text = spark.createDataFrame([("a b c d e f",), ("a",), (None,)], "t string")
    got = [r["g"] for r in text.select(T.ngrams(T.tokens(F.col("t")), 2).alias("g")).collect()]
    assert got == [["a b", "b c", "c d", "d e", "e f"], [], []]
    plan = text.select(F.explode(T.ngrams(T.tokens(F.col("t")), 2)).alias("g"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_copies_of_short_texts_are_scored_once(spark):
    """The same ranks, from the first k of each group of texts with the same words."""
    names = ["red ring", "Ring  red", "red bolt", "old bolt", "", None, "ring ring red"]
    docs = spark.range(140).select("id", F.get(F.array(*[F.lit(n) for n in names]), (F.col("id") % 7).cast("int")).alias("text"))
    q = spark.createDataFrame([("a", "red ring"), ("b", "bolt"), ("c", "nothing"), ("d", "old old ring")], "query_id string, query string")
    cells = lambda df: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in df.collect())
    assert cells(lexical.bm25_topk(docs, q, "id", "text", 5, copies=True)) == cells(lexical.bm25_topk(docs, q, "id", "text", 5))
    assert lexical.bm25_scores(docs, q, "id", "text", copies=5).count() < lexical.bm25_scores(docs, q, "id", "text").count() / 3


def test_plans_and_words_need_no_vectors_of_places(spark):
    """Only a search by vectors encodes the places, once."""
    from tidewell.plans.lexicon import Lexicon

    place = "poi_id string, name string, brand string, category string, city string, district string, attributes array<string>, lat double, lon double, rating double, popularity double, price_level int, opening_hours string, description string, vec_id long"
    places = spark.createDataFrame([(f"C{k}", "n", "", "x", "y", "", ["red"], 0.0, 0.0, 0.0, 0.0, 1, "", "red ring", k) for k in range(3)], place)
    queries = spark.createDataFrame([("1", "red ring")], "query_id string, query string")
    encode = vector.encoder()

    def careful(text):
        return F.when(text.startswith("passage: "), F.raise_error(F.lit("a place was encoded"))).otherwise(encode(text))

    engine = rerank.Engine(places, Lexicon(), careful)
    plans = engine.plans(queries)
    assert plans.first()["plan"]["attr_concepts"] == ["red"] and rerank.lexical_only(engine.corpus, plans).count() == 3
    with pytest.raises(Exception, match="a place was encoded"):
        engine.vectors.count()


def test_long_texts_are_hashed_in_runs(monkeypatch):
    text, short = "aé" * 500 + "xyz", ["", "a", "ab"]
    whole = [vector.hashed_ngrams()(t).tolist() for t in (text, *short)]
    monkeypatch.setattr(vector, "RUN", 7)
    assert [vector.hashed_ngrams()(t).tolist() for t in (text, *short)] == whole


def test_ladder_ranks_words_once(spark, sf, monkeypatch):
    """All steps of the ablation read one ranking by words."""
    from tidewell.catalogue import ranking

    asked, plain = [], lexical.bm25_topk
    monkeypatch.setattr(lexical, "bm25_topk", lambda *a, **k: asked.append(a[4]) or plain(*a, **k))
    assert ranking.ablation_ladder(spark, sf).count() == 12 and asked == [30]
