"""Joins, set operations, ingestion, snapshots and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import ngrams, tokens
from ..operators import evaluate, joins, vector
from ..plans import lexicon
from ..sources import ingest, shared
from ..streaming import windows
from .shared import POI, places, table


def semi_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


def anti_join(spark, d):
    """Customers without a large order."""
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def full_outer_join(spark, d):
    s = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("s_k")).agg(F.count("*").alias("suppliers"))
    c = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("c_k")).agg(F.count("*").alias("customers"))
    return s.join(c, F.col("s_k") == F.col("c_k"), "full_outer").select(F.coalesce("s_k", "c_k").alias("nationkey"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("customers", F.lit(0)).alias("customers"))


def range_join(spark, d):
    boxes = spark.createDataFrame([("a", 10.0, 13.5, 102.0, 105.0), ("b", 12.0, 20.0, 104.0, 109.0), ("c", 0.0, 0.0, 0.0, 0.0)], "box string, lat_lo double, lat_hi double, lon_lo double, lon_hi double")
    return joins.box_join(places(spark, d).select("poi_id", "lat", "lon"), boxes).groupBy("box").agg(F.count("*").alias("n"), F.min("poi_id").alias("first_id"))


def lookup_default(spark, d):
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


def _typos(spark, d):
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("candidate")).distinct()
    return spark.createDataFrame([(w,) for w in ("rin", "blot", "gearr", "cold", "hat", "wodget", "rode", "bolt", "el", "ned")], "token string"), words


def edit1_candidates(spark, d):
    return joins.edit1_pairs(*_typos(spark, d))


def typo_unique(spark, d):
    return joins.unique_candidates(joins.edit1_pairs(*_typos(spark, d)))


def surface_matches(spark, d):
    q = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.lower("p_name").alias("query"))
    lex = spark.createDataFrame([("color", "red"), ("color", "blue"), ("metal", "bolt"), ("metal", "gear"), ("size", "large"), ("none", "ed")], "key string, surface string")
    return joins.surface_matches(q, lex)


def abbreviation_guard(spark, d):
    seed = spark.createDataFrame([("rod", "road"), ("bv", "hospital"), ("hot", "hotel"), ("ks", "guesthouse")], "short string, full string")
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("word"))
    return lexicon.guarded_abbreviations(seed, words)


def bigram_vocabulary(spark, d):
    return table(spark, d, "part").select(F.explode(ngrams(tokens(F.col("p_name")), 2)).alias("bigram")).distinct()


def integrity_intersect(spark, d):
    return table(spark, d, "documents").select("doc_id").intersect(table(spark, d, "labels").where("toxic = 1").select("doc_id"))


def integrity_except(spark, d):
    return table(spark, d, "documents").select("doc_id").exceptAll(table(spark, d, "labels").select("doc_id"))


def contract_check(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.array_join(F.array_sort(F.array_except(F.array(*[F.lit(x) for x in ("k", "name", "zone")]), F.array_sort(F.flatten(F.collect_set(F.json_object_keys("props")))))), ",").alias("missing"))


def word_union(spark, d):
    p = table(spark, d, "part")
    return p.select(F.lower("p_type").alias("word")).union(p.select(F.explode(F.split("p_name", " ")).alias("word"))).distinct()


def _records(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    rec = F.struct(F.when(k % 7 != 0, F.concat(F.lit("S"), k)).alias("poi_id"), F.col("s_name").alias("name"), F.lit("PROMO").alias("category"), F.when(k % 5 != 0, "en").otherwise("").alias("city"), F.when(k % 11 == 0, "x1").otherwise((F.col("s_acctbal") / 1000).cast("string")).alias("rating"), F.when(k % 13 == 0, "?").alias("surplus"))
    return s.select("s_suppkey", F.to_json(rec).alias("record"))


def ingest_validate(spark, d):
    valid, rejected = ingest.validate(_records(spark, d))
    return valid.select("name", F.lit("").alias("errors")).unionByName(rejected.select(F.get_json_object("record", "$.name").alias("name"), F.array_join("errors", "|").alias("errors")))


def ingest_upsert(spark, d):
    """The whole table: three market segments stand, all with money come in a batch (twice, the later row counts); new ones are numbered in its order."""
    c = table(spark, d, "customer")
    key = F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    old = c.where("c_mktsegment in ('BUILDING', 'AUTOMOBILE', 'MACHINERY')").select(key.alias("poi_id"), F.col("c_name").alias("name"), F.col("c_custkey").cast("long").alias("row_order"))
    come = c.where("c_acctbal > 0")
    first = come.select(key.alias("poi_id"), F.lit("early").alias("name"), (2 * F.col("c_custkey")).alias("position"))
    batch = first.unionByName(come.select(key.alias("poi_id"), F.upper("c_name").alias("name"), (2 * F.col("c_custkey") + 1).alias("position")))
    return ingest.upsert(old, batch, position="position")


def seed_order(spark, d):
    """A first version numbers a whole corpus from 0 on, here by falling account balance."""
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_custkey").cast("string").alias("poi_id"), "c_name", (F.lit(10**9) - F.round(F.col("c_acctbal") * 100).cast("long") * 2).alias("position"), "c_custkey")
    snaps = ingest.Snapshots(spark, f"{shared.folder(spark)}/seed")
    ingest.seed(snaps, rows.withColumn("position", F.col("position") * 1_000_000 + F.col("c_custkey")).drop("c_custkey"), "position")
    return snaps.read().select("poi_id", F.col("row_order").cast("long").alias("row_order"))


def vector_store(spark, d):
    """Half the texts are stored, then the rest is appended: every different text has one vector."""
    docs = table(spark, d, "documents")
    store = vector.VectorStore(spark, f"{shared.folder(spark)}/vectors")
    encode = lambda t: F.transform(F.array(F.char_length(t), F.octet_length(t)), lambda n: n.cast("float"))
    store.recreate(docs.where("doc_id % 2 = 0"), encode)
    store.append(docs, encode)
    return store.read().select("digest", F.col("embedding")[0].cast("long").alias("chars"), F.col("embedding")[1].cast("long").alias("bytes"))


def status_backfill(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("poi_id"), F.lit("active").alias("status"))
    return ingest.backfill(c, table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("poi_id"), F.lit("unverified").alias("status")))


def verify_decision(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    status, reasons = ingest.decide(F.when(k % 9 != 0, (k % 10) / 10.0), (k * 37 % 900).cast("double"), F.when(k % 4 == 0, "Region").otherwise("Street"), F.when(k % 8 == 0, "").otherwise("road"))
    return s.select("s_suppkey", status.alias("status"), reasons.alias("reasons"))


def geocode_classify(spark, d):
    k = F.col("s_suppkey")
    kind = evaluate.failure_kind(k % 9 != 0, (k % 10) / 10.0, (k * 37 % 900).cast("double"))
    return table(spark, d, "supplier").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def _micros(rows):
    return rows.withColumn("start", F.unix_micros("start")).withColumn("end", F.unix_micros("end"))


def _events(spark, d):
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def event_windows(spark, d):
    return _micros(windows.tumbling(_events(spark, d), "6 hours", "event_type"))


def event_sliding(spark, d):
    return _micros(windows.sliding(_events(spark, d), "2 hours", "1 hour"))


def event_sessions(spark, d):
    return _micros(windows.sessions(_events(spark, d), "30 minutes", "user_id"))


def event_stream(spark, d):
    """The tumbling windows again, by a stream with a watermark (closed windows only)."""
    root = shared.folder(spark)
    rows = windows.tumbling(windows.source(spark, f"{d}/events.parquet*"), "6 hours", "event_type")
    windows.run_once(rows, f"{root}/sink", f"{root}/state")
    return _micros(spark.read.schema("start timestamp, end timestamp, event_type string, n long, total double").parquet(f"{root}/sink"))


def snapshot_reload(spark, d):
    """Two versions; what was bound to the first one still reads it."""
    from ..streaming.reload import Served

    snaps = ingest.Snapshots(spark, f"{shared.folder(spark)}/snapshots")
    served, n = Served(snaps), table(spark, d, "nation")
    snaps.publish(n.where("n_nationkey < 10").select("n_nationkey", "n_name"))
    served.poll()
    first = served.current
    snaps.publish(n.select("n_nationkey", "n_name"))
    served.poll()
    return first.withColumn("version", F.lit(1)).unionByName(served.current.withColumn("version", F.lit(served.loaded)))


_NAMES = "semi_join anti_join full_outer_join range_join lookup_default edit1_candidates typo_unique surface_matches abbreviation_guard bigram_vocabulary integrity_intersect integrity_except contract_check word_union ingest_validate ingest_upsert seed_order vector_store status_backfill verify_decision geocode_classify event_windows event_sliding event_sessions event_stream snapshot_reload".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_TYPOS = "t as (select unnest(['rin','blot','gearr','cold','hat','wodget','rode','bolt','el','ned']) token), v as (select distinct unnest(string_split(p_name,' ')) candidate from part), p as (select token, candidate from t cross join v where levenshtein(token,candidate)=1)"
_INNER = "select start, start + interval 6 hour as \"end\", event_type, count(*) n, round(sum(value),4) total from (select *, time_bucket(interval 6 hour, ts, timestamp '1970-01-01') start from events) group by 1,2,3"
_OUT = "select epoch_us(start) start, epoch_us(\"end\") as \"end\", * exclude (start, \"end\") from "
_WIN = f"{_OUT}({_INNER})"
SQL = {
    "semi_join": "select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_totalprice>400000)",
    "anti_join": "select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice>300000)",
    "full_outer_join": "select coalesce(a.k,b.k) nationkey, coalesce(suppliers,0) suppliers, coalesce(customers,0) customers from (select s_nationkey k, count(*) suppliers from supplier group by 1) a full join (select c_nationkey k, count(*) customers from customer where c_acctbal>9000 group by 1) b on a.k=b.k",
    "range_join": POI + " select box, count(*) n, min(poi_id) first_id from poi join (values ('a',10.0,13.5,102.0,105.0),('b',12.0,20.0,104.0,109.0),('c',0.0,0.0,0.0,0.0)) b(box,la,lb,oa,ob) on lat between la and lb and lon between oa and ob group by 1",
    "lookup_default": "select c_custkey, coalesce(n,0) n_orders from customer left join (select o_custkey, count(*) n from orders group by 1) on c_custkey=o_custkey",
    "edit1_candidates": f"with {_TYPOS} select * from p",
    "typo_unique": f"with {_TYPOS} select token, min(candidate) candidate from p group by 1 having count(*)=1",
    "surface_matches": "select p_partkey query_id, key, surface from part join (values ('color','red'),('color','blue'),('metal','bolt'),('metal','gear'),('size','large'),('none','ed')) l(key,surface) on list_contains(string_split(lower(p_name),' '),surface)",
    "abbreviation_guard": "select short, \"full\" from (values ('rod','road'),('bv','hospital'),('hot','hotel'),('ks','guesthouse')) s(short,\"full\") where short not in (select unnest(string_split(p_name,' ')) from part)",
    "bigram_vocabulary": "select distinct lower(p_name) bigram from part",
    "integrity_intersect": "select doc_id from documents intersect select doc_id from labels where toxic=1",
    "integrity_except": "select doc_id from documents except select doc_id from labels",
    "contract_check": "select event_type, 'name,zone' missing from events group by 1",
    "word_union": "select lower(p_type) word from part union select unnest(string_split(p_name,' ')) from part",
    "ingest_validate": """with x as (select s_suppkey k, s_name from supplier) select s_name as name, array_to_string(list_filter([case when k%13=0 then 'unknown field: surplus' end, case when k%7=0 then 'missing: poi_id' end, case when k%5=0 then 'missing: city' end, case when k%11=0 then 'not a number: rating' end], lambda e: e is not null),'|') errors from x""",
    "ingest_upsert": """with o as (select c_custkey k, c_name n from customer where c_mktsegment in ('BUILDING','AUTOMOBILE','MACHINERY')), b as (select c_custkey k, upper(c_name) n from customer where c_acctbal>0)
        select 'C'||lpad(k::varchar,9,'0') poi_id, coalesce(b.n,o.n) as name, k::bigint row_order from o left join b using(k)
        union all select 'C'||lpad(k::varchar,9,'0'), n, (select max(k) from o) + row_number() over (order by k) from b where k not in (select k from o)""",
    "seed_order": "select c_custkey::varchar poi_id, row_number() over (order by round(c_acctbal*100)::bigint desc, c_custkey) - 1 row_order from customer",
    "vector_store": "select distinct sha256(text) digest, length(text)::bigint chars, strlen(text)::bigint bytes from documents",
    "status_backfill": "select c_custkey poi_id, case when c_acctbal<0 then 'unverified' else 'active' end status from customer",
    "verify_decision": """with x as (select s_suppkey, case when s_suppkey%8=0 then 'no address' when s_suppkey%9=0 then 'no result' else array_to_string(list_filter([case when (s_suppkey%10)/10.0e0<0.7e0 then 'low score' end, case when s_suppkey*37%900>500 then 'too far' end, case when s_suppkey%4=0 then 'place type' end], lambda e: e is not null),';') end reasons from supplier) select s_suppkey, case when reasons='' then 'verified' else 'unverified' end status, reasons from x""",
    "geocode_classify": "select case when s_suppkey%9=0 then 'no_resolve' when (s_suppkey%10)/10.0e0<0.7e0 then 'score_low' when s_suppkey*37%900>500 then 'coords_off' else 'verified' end kind, count(*) n from supplier group by 1",
    "event_windows": _WIN,
    "event_sliding": f"{_OUT}(with s as (select ts, value, time_bucket(interval 1 hour, ts, timestamp '1970-01-01') h from events), w as (select h start, value from s union all select h - interval 1 hour, value from s) select start, start + interval 2 hour as \"end\", count(*) n, round(sum(value),4) total from w group by 1)",
    "event_sessions": f"{_OUT}(with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) sid from g) select min(ts) start, max(ts) + interval 30 minute as \"end\", user_id, count(*) n, round(sum(value),4) total from s group by user_id, sid)",
    "event_stream": f"{_OUT}({_INNER}) where \"end\" <= (select max(ts) - interval 1 hour from events)",
    "snapshot_reload": "select n_nationkey, n_name, 1 as version from nation where n_nationkey<10 union all select n_nationkey, n_name, 2 from nation",
}
