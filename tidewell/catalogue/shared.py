"""What queries and their SQL have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.corpus import poi_view


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return poi_view(spark, sf_dir)


#: SQL of the place view; other statements follow as further CTEs.
POI = """with n as (select (select count(*) from part) np, (select count(*) from embeddings) ne),
poi as (select concat(case when d.doc_id % 3 = 0 then 'G' else 'C' end, lpad(cast(d.doc_id as varchar), 7, '0')) as poi_id,
 p.p_name as name, p.p_brand as brand, p.p_type as category, d.lang as city, d.source as district,
 case when d.doc_id % 97 = 0 then 0.0e0 else 10.0e0 + (d.doc_id * 37 % 1200) / 100.0e0 end as lat,
 case when d.doc_id % 97 = 0 then 0.0e0 else 102.0e0 + (d.doc_id * 53 % 800) / 100.0e0 end as lon,
 (p.p_size % 50) / 10.0e0 as rating, d.n_chars as review_count, cast(d.doc_id % 101 as double) as popularity, cast(p.p_size % 5 as int) as price_level,
 case d.doc_id % 5 when 0 then '24/7' when 1 then '08:00-22:00' when 2 then '18:00-02:00' when 3 then '7:30-23:00' else '' end as opening_hours,
 e.vec_id, d.text as description, string_split(p.p_name, ' ') as attributes
 from documents d cross join n left join part p on p.p_partkey = d.doc_id % n.np left join embeddings e on e.vec_id = d.doc_id % n.ne)"""


def fold_sql(c: str) -> str:
    return f"replace(strip_accents(lower({c})),'đ','d')"


def words_sql(c: str) -> str:
    return f"list_filter(string_split_regex(trim({fold_sql(c)}), '\\s+'), lambda x: x <> '')"


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"2*6371.0e0*asin(sqrt(pow(sin(radians({lat2}-{lat1})/2),2)+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin(radians({lon2}-{lon1})/2),2)))"


def opens_sql(h: str = "opening_hours") -> str:
    return f"case when {h}='24/7' then 0 else try_cast(nullif(regexp_extract({h},'^(\\d+):(\\d+)-(\\d+):(\\d+)$',1),'') as int)*60+try_cast(nullif(regexp_extract({h},'^(\\d+):(\\d+)-(\\d+):(\\d+)$',2),'') as int) end"


def closes_sql(h: str = "opening_hours") -> str:
    return f"case when {h}='24/7' then 1440 else try_cast(nullif(regexp_extract({h},'^(\\d+):(\\d+)-(\\d+):(\\d+)$',3),'') as int)*60+try_cast(nullif(regexp_extract({h},'^(\\d+):(\\d+)-(\\d+):(\\d+)$',4),'') as int) end"
