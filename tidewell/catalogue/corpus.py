"""Scans, text functions, aggregates, lexical and vector retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geo, hours
from ..functions import text as T
from ..operators import lexical, vector
from ..plans import lexicon
from .shared import POI, closes_sql, fold_sql, haversine_sql, opens_sql, places, table, words_sql

SEARCHES = [("q1", "thing ththeron the the"), ("q2", "Ción queasi LAS"), ("q3", "schung der und zzzz")]
Q_SQL = "(values " + ",".join(f"('{a}','{b}')" for a, b in SEARCHES) + ") q(query_id,query)"


def searches(spark):
    return spark.createDataFrame(SEARCHES, "query_id string, query string")


def fold_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


def tokenize_counts(spark, d):
    return table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def letter_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.letter_words(F.col("text"))).cast("long").alias("n_words"), T.has_marks(F.col("text")).alias("marked"))


def bm25_term_stats(spark, d):
    s = lexical.term_stats(table(spark, d, "documents"), "doc_id", "text")
    return s.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, d):
    return lexical.bm25_topk(table(spark, d, "documents"), searches(spark), "doc_id", "text", 10).select("query_id", F.col("id").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


def poi_corpus(spark, d):
    return places(spark, d).drop("description").withColumn("attributes", F.array_join("attributes", ";"))


def poi_document(spark, d):
    p = places(spark, d)
    doc = T.document(F.col("name"), F.col("category"), F.col("district"), F.col("city"), F.array_join("attributes", " "), F.col("opening_hours"))
    return p.select("poi_id", doc.alias("document"), T.fold(doc).alias("norm_document"), T.digest(doc).alias("digest"))


def distinct_attributes(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("attribute")).distinct()


def distinct_categories(spark, d):
    return table(spark, d, "part").select(F.col("p_type").alias("category")).distinct()


def split_list(spark, d):
    p = table(spark, d, "part")
    raw = F.concat(F.col("p_brand"), F.lit("; "), F.regexp_replace("p_name", " ", ";;"), F.lit(" ;"))
    return p.select("p_partkey", F.array_join(T.split_list(raw, ";"), "|").alias("parts"))


def props_json(spark, d):
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.count_if(F.col("k") > 50).alias("k_high"))


def district_centroids(spark, d):
    return lexicon.district_centroids(places(spark, d))


def opening_minutes(spark, d):
    h = F.col("opening_hours")
    return places(spark, d).select("poi_id", *[F.coalesce(v, F.lit(-1)).alias(n) for n, v in (("opens", hours.opening(h)), ("closes", hours.closing(h)), ("late", hours.late_closing(h)))], hours.clock(hours.closing(h)).alias("clock"))


def is_open_at(spark, d):
    h = F.col("opening_hours")
    return places(spark, d).select("poi_id", *[hours.is_open(h, m).alias(f"at_{m}") for m in (60, 720, 1350)])


def haversine_distance(spark, d):
    p = places(spark, d)
    km = geo.haversine_km(F.lit(16.0), F.lit(106.0), F.col("lat"), F.col("lon"))
    return p.select("poi_id", F.round(km, 6).alias("km"), F.round(geo.bearing(F.lit(16.0), F.lit(106.0), F.col("lat"), F.col("lon")), 6).alias("bearing"))


def radius_filter(spark, d):
    return places(spark, d).where(geo.haversine_km(F.lit(16.0), F.lit(106.0), F.col("lat"), F.col("lon")) * 1000 <= 250000).select("poi_id", "lat", "lon")


def bbox_filter(spark, d):
    return places(spark, d).where(geo.in_box(F.col("lat"), F.col("lon"), (103.0, 12.0, 107.0, 18.0))).select("poi_id", "lat", "lon")


def category_filter(spark, d):
    return places(spark, d).where(T.fold(F.col("category")) == T.fold(F.lit("PROMO"))).select("poi_id", "category")


def address_format(spark, d):
    return places(spark, d).select(T.place_id(F.col("poi_id")).alias("id"), T.address_line(F.col("district"), F.col("city")).alias("address"), T.slug(F.col("name")).alias("slug"), T.is_synthetic(F.col("poi_id")).alias("synthetic"))


def accent_votes(spark, d):
    return lexicon.accent_votes(table(spark, d, "documents"), "text", "doc_id").select("key", "value", "n")


def first_wins(spark, d):
    return lexicon.first_wins(table(spark, d, "documents"), "source", "lang", "doc_id")


def ngrams(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", F.explode(T.ngrams(T.tokens(F.col("text")), 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    return e, e.where(F.col("vec_id").isin(1, 2, 3)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))


def cosine_topk(spark, d):
    e, q = _vectors(spark, d)
    return vector.topk(e.withColumnRenamed("vec_id", "id"), q, 10).select("query_id", F.col("id").alias("vec_id"), "score", F.col("rank").cast("long").alias("rank"))


def cosine_prefiltered(spark, d):
    e, q = _vectors(spark, d)
    p = places(spark, d).where("city = 'en' and category in ('PROMO', 'LARGE')").join(e.select("vec_id", "embedding"), "vec_id").select(F.col("poi_id").alias("id"), "embedding")
    return vector.topk(p, q, 10).select("query_id", F.col("id").alias("poi_id"), "score", F.col("rank").cast("long").alias("rank"))


def label_radius(spark, d):
    e, q = _vectors(spark, d)
    return vector.label_radius(q, vector.centroids(e), 0.05).select("query_id", F.col("label").cast("long").alias("label"), "score")


def label_argmax(spark, d):
    e, _ = _vectors(spark, d)
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec"))
    return vector.label_argmax(q, vector.centroids(e)).select("query_id", F.col("label").cast("long").alias("label"), "score")


def label_joint_weights(spark, d):
    e, q = _vectors(spark, d)
    labels = vector.centroids(e).withColumn("namespace", F.when(F.col("label") < 5, "category").otherwise("attribute"))
    return vector.joint_weights(q, labels, 0.02).select("query_id", "namespace", F.col("label").cast("long").alias("label"), "weight")


def incremental_encode_missing(spark, d):
    docs = table(spark, d, "documents")
    known = docs.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("digest"))
    return vector.missing_vectors(docs, known).select("doc_id", "digest")


def dataset_profile(spark, d):
    p = places(spark, d)
    return p.groupBy(F.substring("poi_id", 1, 1).alias("prefix")).agg(F.count("*").alias("n"), F.count_distinct("name").alias("names"), F.count_if((F.col("lat") == 0) & (F.col("lon") == 0)).alias("no_place"), F.count_if(F.col("price_level") == 0).alias("no_price"))


def singletons(spark, d):
    w = table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("term"), "lang").groupBy("lang", "term").agg(F.count("*").alias("n"))
    return w.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("singletons"), F.count("*").alias("terms"))


def price_level_map(spark, d):
    from ..plans.signals import price_level

    return table(spark, d, "orders").groupBy(price_level(F.col("o_totalprice")).alias("level")).agg(F.count("*").alias("n"))


def rank_fallback(spark, d):
    from ..operators.pool import rank_score

    p = places(spark, d).where("rating > 4.5").withColumn("rank", F.row_number().over(Window.partitionBy("city").orderBy(F.desc("popularity"), "poi_id")))
    return p.select("poi_id", "city", F.round(rank_score(F.col("rank"), "city"), 6).alias("score"))


def previous_next(spark, d):
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))


_NAMES = "fold_text tokenize_counts letter_words bm25_term_stats bm25_topk poi_corpus poi_document distinct_attributes distinct_categories split_list props_json district_centroids opening_minutes is_open_at haversine_distance radius_filter bbox_filter category_filter address_format accent_votes first_wins ngrams cosine_topk cosine_prefiltered label_radius label_argmax label_joint_weights incremental_encode_missing dataset_profile singletons price_level_map rank_fallback previous_next".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_TOK = f"t as (select doc_id, {words_sql('text')} w from documents)"
_STATS = f"""{_TOK}, df as materialized (select term, count(*) df from (select doc_id, unnest(list_distinct(w)) term from t) group by term),
r as (select term, df, ln((select count(*) from t)-df+0.5)-ln(df+0.5) raw from df),
st as (select term, df, case when raw<0 then 0.25*(select avg(raw) from r) else raw end idf from r)"""
_CENT = """e as (select vec_id, label, embedding::double[] v from embeddings),
m as (select label, i, avg(x) x from (select label, unnest(v) x, generate_subscripts(v,1) i from e) group by label, i),
c0 as (select label, list(x order by i) v from m group by label),
c as (select label, list_transform(v, lambda x: x/sqrt(list_inner_product(v,v))) lvec from c0)"""
_AT = "coalesce(case when {c}<={o} then ({m}>={o} or {m}<{c}) else ({m}>={o} and {m}<{c}) end, false)"
_BEST = "row_number() over (partition by query_id order by score desc, {t})"

SQL = {
    "fold_text": f"select doc_id, {fold_sql('text')} as folded from documents",
    "tokenize_counts": f"with {_TOK} select term, count(*) n from (select unnest(w) term from t) group by term",
    "letter_words": f"select doc_id, len(regexp_extract_all(text,'\\p{{L}}+'))::bigint n_words, {fold_sql('text')}<>lower(text) marked from documents",
    "bm25_term_stats": f"with {_STATS} select term, df, round(idf,6) idf from st",
    "bm25_topk": f"""with {_STATS}, q as (select * from {Q_SQL}), qt as (select query_id, term, count(*) times from (select query_id, unnest({words_sql('query')}) term from q) group by 1,2),
tf as (select doc_id, len(w) dl, term, count(*) tf from (select doc_id, w, unnest(w) term from t) group by 1,2,3),
s as (select qt.query_id, tf.doc_id, round(sum(times*idf*tf*2.5/(tf+1.5*(1-0.75+0.75*dl/(select avg(len(w)) from t)))),6) score from qt join st using(term) join tf using(term) group by 1,2),
a as (select q.query_id, t.doc_id, coalesce(s.score,0) score from q cross join t left join s on s.query_id=q.query_id and s.doc_id=t.doc_id)
select * from (select query_id, doc_id, score, {_BEST.format(t='doc_id')} as rank from a) where rank<=10""",
    "poi_corpus": POI + " select poi_id,name,brand,category,city,district,lat,lon,rating,review_count,popularity,price_level,opening_hours,vec_id,array_to_string(attributes,';') attributes from poi",
    "poi_document": POI + f", x as (select poi_id, concat_ws(' ',nullif(name,''),nullif(category,''),nullif(district,''),nullif(city,''),nullif(array_to_string(attributes,' '),''),nullif(opening_hours,'')) as doc from poi) select poi_id, doc as document, {fold_sql('doc')} as norm_document, substr(sha256(doc),1,16) as digest from x",
    "distinct_attributes": "select distinct unnest(string_split(p_name,' ')) attribute from part",
    "distinct_categories": "select distinct p_type category from part",
    "split_list": "select p_partkey, p_brand||'|'||replace(p_name,' ','|') parts from part",
    "props_json": "select event_type, sum(k)::bigint k_sum, count(*) filter (k>50) k_high from (select event_type, json_extract_string(props,'$.k')::bigint k from events) group by 1",
    "district_centroids": POI + " select city, district, median(lat) lat, median(lon) lon from poi where lat<>0 or lon<>0 group by 1,2",
    "opening_minutes": POI + f", h as (select poi_id, opening_hours, {opens_sql()} o, {closes_sql()} c from poi) select poi_id, coalesce(o,-1) opens, coalesce(c,-1) closes, coalesce(case when opening_hours='24/7' then 1440 when c<=o then c+1440 else c end,-1) late, printf('%02d:%02d', c//60, c%60) clock from h",
    "is_open_at": POI + f", h as (select poi_id, {opens_sql()} o, {closes_sql()} c from poi) select poi_id, {_AT.format(o='o', c='c', m=60)} at_60, {_AT.format(o='o', c='c', m=720)} at_720, {_AT.format(o='o', c='c', m=1350)} at_1350 from h",
    "haversine_distance": POI + f" select poi_id, round({haversine_sql('16.0e0', '106.0e0', 'lat', 'lon')},6) km, round(atan2(lat-16.0e0,(lon-106.0e0)*cos(radians(16.0e0))),6) bearing from poi",
    "radius_filter": POI + f" select poi_id, lat, lon from poi where {haversine_sql('16.0e0', '106.0e0', 'lat', 'lon')}*1000<=250000",
    "bbox_filter": POI + " select poi_id, lat, lon from poi where lon between 103.0 and 107.0 and lat between 12.0 and 18.0",
    "category_filter": POI + " select poi_id, category from poi where lower(category)='promo'",
    "address_format": POI + " select 'poi:'||poi_id id, case when ends_with(district,city) then district else district||', '||city end address, regexp_replace(lower(name),'[^a-z0-9]+','_','g') slug, starts_with(poi_id,'G') synthetic from poi",
    "accent_votes": f"""with w as (select doc_id o, unnest(list_zip(a, range(len(a)))) z from (select doc_id, regexp_extract_all(lower(text),'\\p{{L}}+') a from documents)),
v as (select z[1] as v0, o, z[2] i from w), g as (select {fold_sql('v0')} k, v0, count(*) n, min(o*10000000+i) f from v group by 1,2)
select k as key, v0 as value, n from (select *, row_number() over (partition by k order by n desc, f) r from g) where r=1""",
    "first_wins": "select source, arg_min(lang, doc_id) lang from documents group by 1",
    "ngrams": f"with t as (select {words_sql('text')} w from conversations), g as (select unnest(list_transform(range(1,len(w)), lambda i: w[i]||' '||w[i+1])) gram from t) select gram, count(*) n from g group by 1 having count(*)>1",
    "cosine_topk": f"with e as (select vec_id, embedding::double[] v from embeddings), s as (select q.vec_id query_id, e.vec_id, round(list_inner_product(q.v,e.v),6) score from e q cross join e where q.vec_id in (1,2,3)) select * from (select *, {_BEST.format(t='vec_id')} as rank from s) where rank<=10",
    "cosine_prefiltered": POI + f", e as (select vec_id, embedding::double[] v from embeddings), s as (select q.vec_id query_id, poi_id, round(list_inner_product(q.v,e.v),6) score from poi join e using(vec_id) cross join e q where q.vec_id in (1,2,3) and city='en' and category in ('PROMO','LARGE')) select * from (select *, {_BEST.format(t='poi_id')} as rank from s) where rank<=10",
    "label_radius": f"with {_CENT}, s as (select vec_id query_id, c.label::bigint as label, round(list_inner_product(e.v,c.lvec),6) score from e cross join c where vec_id in (1,2,3)) select query_id, label, score from (select *, {_BEST.format(t='label')} r from s where score>=0.05) where r<=2",
    "label_argmax": f"with {_CENT}, s as (select vec_id query_id, c.label::bigint as label, round(list_inner_product(e.v,c.lvec),6) score from e cross join c) select query_id, label, score from (select *, {_BEST.format(t='label')} r from s) where r=1",
    "label_joint_weights": f"""with {_CENT}, s as (select vec_id query_id, case when c.label<5 then 'category' else 'attribute' end namespace, c.label::bigint as label, round(list_inner_product(e.v,c.lvec),6) score from e cross join c where vec_id in (1,2,3)),
b as (select *, row_number() over (partition by query_id, namespace order by score desc, label) r from s)
select query_id, namespace, label, round(greatest(0,(score-0.02e0)/(1-0.02e0)),6) weight from b where r<=2 and score>0.02e0""",
    "incremental_encode_missing": "select doc_id, sha256(text) digest from documents where sha256(text) not in (select sha256(text) from documents where doc_id%2=0)",
    "dataset_profile": POI + " select substr(poi_id,1,1) prefix, count(*) n, count(distinct name) names, count(*) filter (lat=0 and lon=0) no_place, count(*) filter (price_level=0) no_price from poi group by 1",
    "singletons": f"with w as (select lang, term, count(*) n from (select lang, unnest({words_sql('text')}) term from documents) group by 1,2) select lang, count(*) filter (n=1) singletons, count(*) terms from w group by 1",
    "price_level_map": "select case when o_totalprice<=50000 then 1 when o_totalprice<=150000 then 2 when o_totalprice<=300000 then 3 else 4 end as level, count(*) n from orders group by 1",
    "rank_fallback": POI + " select poi_id, city, round(1.0e0-(row_number() over (partition by city order by popularity desc, poi_id)-1)/count(*) over (partition by city)::double,6) score from poi where rating>4.5",
    "previous_next": "select conv_id, turn, role, lag(role) over w before, lead(role) over w as after from conversations window w as (partition by conv_id order by turn)",
}
