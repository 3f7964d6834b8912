"""Query understanding on queries made from a table: every row of ``part`` gives one, from lists of phrases by arithmetic on its key.

The SQL knows which phrases were put in, so it says what must be found without repeating any pattern.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import fold, fold_text
from ..plans import rerank, rewrite, understand
from ..plans.lexicon import Lexicon
from .shared import places, table

#: Phrase, category of the built-in lexicon.
SUBJECTS = [("nhà hàng", "Nhà hàng"), ("khách sạn", "Khách sạn"), ("quán cà phê", "Quán cà phê"), ("bệnh viện", "Bệnh viện"), ("công viên", "Công viên"), ("siêu thị", "Siêu thị")]
#: Phrase, column, order.
SUPERLATIVES = [
    ("", None, None), ("rẻ nhất", "price", "asc"), ("giá  rẻ   nhất", "price", "asc"), ("giá đắt nhất", "price", "desc"), ("đánh  giá cao nhất", "rating", "desc"), ("tệ nhất", "rating", "asc"),
    ("ít tiền nhất", "price", "asc"), ("tốt  nhất", "rating", "desc"), ("chi phí thấp nhất", "price", "asc"), ("điểm thấp nhất", "rating", "asc"), ("đánh giá thấp nhất", "rating", "asc"), ("tiền cao nhất", "price", "desc"),
]
OPERATORS = [("dưới", "le"), ("trên", "ge"), ("tầm", "eq"), ("khoảng", "eq"), ("sau", "ge"), ("trước", "le"), ("hơn", "ge"), ("kém", "le"), ("", None)]
UNITS = ["k", " triệu", " sao", " giờ", "h", " tr", "", " tối"]
#: Cue with what follows, cue and target to be found.
NEGATIONS = [
    ("không ồn ào", "khong", "on ao"), ("không có chỗ đậu xe rộng", "khong co", "cho dau xe"), ("không quá đông khách", "khong qua", "dong khach"), ("chưa đắt đỏ và đẹp", "chua", "dat do"),
    ("đừng ở gần chợ", "dung", None), ("không gian đẹp", None, None), ("không   có đông khách", "khong co", "dong khach"), ("sân vườn", None, None),
]
NEGATIONS = [(t, c, "dau xe rong" if c == "khong co" and g == "cho dau xe" else g) for t, c, g in NEGATIONS]
ATTRIBUTES = ["yên tĩnh", "sân vườn", "view đẹp", "đông khách", "mở khuya", "máy lạnh"]
#: As typed, as meant.
TYPED = [("bv", "bệnh viện"), ("nhà hàg", "nhà hàng"), ("khách sạnn", "khách sạn"), ("cà phê", "cà phê"), ("q1", "quận 1"), ("KS", "khách sạn"), ("siêu thịf", "siêu thị"), ("q12a", "q12a"), ("cong vien", "cong vien")]
CITIES = [("", None), ("ở sài gòn", "TP.HCM"), ("tại Hà Nội", "Hà Nội"), ("danang", "Đà Nẵng")]


def _pick(values, every: int):
    """The value of each row, the next one after ``every`` keys."""
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), F.expr(f"cast(div(p_partkey, {every}) % {len(values)} as int)"))


def _pick_sql(values, every: int, kind: str = "varchar") -> str:
    cells = ",".join("null" if v is None else f"{v!r}" if isinstance(v, (int, float)) else f"'{v}'" for v in values)
    return f"([{cells}]::{kind}[])[((p_partkey // {every}) % {len(values)})::int + 1]"


def _queries(spark, d, *parts):
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("query_id"), F.concat_ws(" ", *parts).alias("text"), "p_size")


def _folded(rows):
    return rows.select("query_id", fold(F.col("text")).alias("query"))


SUBJECT = [s for s, _ in SUBJECTS]
KEY = "p_partkey::varchar as query_id"


def sort_intent(spark, d):
    by, order = understand.sort_intent(F.col("query"))
    return _folded(_queries(spark, d, _pick(SUBJECT, 1), _pick([s for s, _, _ in SUPERLATIVES], 6))).select("query_id", by.alias("sort_by"), order.alias("sort_order"))


def query_flags(spark, d):
    rows = _folded(_queries(spark, d, _pick(SUBJECT, 1), _pick(["", "đang  mở cửa", "đang mở"], 1), _pick(["", "nổi tiếng", "ngon", "ngọng", "hotel"], 3)))
    return rows.select("query_id", understand.open_now(F.col("query")).alias("open_now"), understand.popular(F.col("query")).alias("popular"))


def numeric_phrases(spark, d):
    amount = F.concat(_pick([o for o, _ in OPERATORS], 1), F.lit(" "), F.col("p_size"), _pick(UNITS, 9))
    return understand.numbers(_folded(_queries(spark, d, F.lit("nhà hàng số"), F.col("p_size"), F.lit("mở 24/7"), F.trim(amount))))


def negation_cues(spark, d):
    return understand.negations(_folded(_queries(spark, d, _pick(SUBJECT, 1), _pick([n for n, _, _ in NEGATIONS], 6))))


def restore_diacritics(spark, d):
    """Accents for unaccented phrases; accented and English texts stay."""
    rows = _queries(spark, d, _pick(SUBJECT, 1), _pick(ATTRIBUTES, 6))
    k = F.col("query_id").cast("long")
    text = F.when(k % 5 == 0, F.col("text")).when(k % 7 == 0, F.lit("a quiet place near the old lake")).otherwise(fold(F.col("text")))
    return rewrite.restored(rows.select("query_id", text.alias("text")), rewrite.of_lexicon(spark).forms)


def preprocess(spark, d):
    """Abbreviations, single typos and trailing letters, in texts that have accents elsewhere."""
    rows = _queries(spark, d, _pick([t for t, _ in TYPED], 1), F.lit("yên tĩnh"))
    return rewrite.preprocess(rows.select("query_id", "text"), rewrite.of_lexicon(spark), Lexicon().abbreviations)


def query_plans(spark, d):
    """Category, city, limit, order and flags of whole plans from text."""
    amount = F.concat(F.lit("dưới "), F.col("p_size") + 100, F.lit("k"))
    rows = _queries(spark, d, _pick(SUBJECT, 1), _pick([s for s, _, _ in SUPERLATIVES[:6]], 6), amount, _pick([c for c, _ in CITIES], 36), _pick(["", "đang mở cửa"], 2))
    p = understand.plans(rows.select("query_id", F.col("text").alias("query")))
    return p.select("query_id", F.array_join("plan.categories", "|").alias("categories"), "plan.city", "plan.price_limit", "plan.price_op", "plan.sort_by", "plan.sort_order", F.col("plan.current_time_open").alias("open_now"))


#: Queries on the place view: its cities are languages, its districts sources, its categories and attributes words of parts.
TEXT_QUERIES = {"1": "promo red widget en src3", "2": "small bolt es", "3": "red gear rating", "4": "ECONOMY old ring src1 de"}


def text_plans(spark, d):
    """What the engine, with a lexicon from the corpus, understands of queries on it."""
    engine = rerank.Engine(places(spark, d))
    queries = spark.createDataFrame(list(TEXT_QUERIES.items()), "query_id string, query string")
    p = engine.plans(queries).select("query_id", "plan")
    return p.select("query_id", F.array_join("plan.categories", "|").alias("categories"), "plan.city", "plan.district", F.round("plan.resolved_coord.lat", 6).alias("lat"), F.round("plan.resolved_coord.lon", 6).alias("lon"))


def text_search(spark, d):
    """From text to results: words, vectors, signals and constraints of the whole engine."""
    engine = rerank.Engine(places(spark, d))
    queries = spark.createDataFrame(list(TEXT_QUERIES.items()), "query_id string, query string")
    return engine.search(queries, limit=5, now=1200).select("query_id", F.col("place").cast("long").alias("place"), "poi_id", "score", "satisfied", "n_constraints")


_NAMES = "sort_intent query_flags numeric_phrases negation_cues preprocess restore_diacritics query_plans text_plans text_search".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_TEXT = " || ' ' || ".join
SQL = {
    "sort_intent": f"select {KEY}, {_pick_sql([b for _, b, _ in SUPERLATIVES], 6)} sort_by, {_pick_sql([o for _, _, o in SUPERLATIVES], 6)} sort_order from part",
    "query_flags": f"select {KEY}, p_partkey % 3 = 1 open_now, (p_partkey // 3) % 5 in (1, 2) popular from part",
    "numeric_phrases": f"select * from (select {KEY}, {_pick_sql([None if not o else fold_text(o) for o, _ in OPERATORS], 1)} op, p_size::double number, {_pick_sql([fold_text(u).strip() or None for u in UNITS], 9)} unit from part) where op is not null or unit is not null or number >= 10",
    "negation_cues": f"select * from (select {KEY}, {_pick_sql([c if t else None for _, c, t in NEGATIONS], 6)} cue, {_pick_sql([t for _, _, t in NEGATIONS], 6)} target from part) where target is not null",
    "restore_diacritics": f"select {KEY}, case when p_partkey % 5 <> 0 and p_partkey % 7 = 0 then 'a quiet place near the old lake' else {_TEXT([_pick_sql(SUBJECT, 1), _pick_sql(ATTRIBUTES, 6)])} end as text from part",
    "preprocess": f"select {KEY}, {_pick_sql([m for _, m in TYPED], 1)} || ' yên tĩnh' as text from part",
    "query_plans": f"""select {KEY}, {_pick_sql([c for _, c in SUBJECTS], 1)} categories, {_pick_sql([c for _, c in CITIES], 36)} city, (p_size + 100) * 1000.0e0 price_limit, 'le' price_op,
        {_pick_sql([b for _, b, _ in SUPERLATIVES[:6]], 6)} sort_by, {_pick_sql([o for _, _, o in SUPERLATIVES[:6]], 6)} sort_order, (p_partkey // 2) % 2 = 1 open_now from part""",
}
