"""Batch ingestion: validation, verification, upserts into versioned snapshots."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..settings import Settings, Verify

RECORD = "poi_id string, name string, brand string, category string, sub_category string, city string, district string, address string, lat double, lon double, rating double, review_count int, popularity double, price_level int, opening_hours string, attributes array<string>, tags array<string>, description string"
FIELDS = tuple(f.split()[0] for f in RECORD.split(", "))
REQUIRED = ("poi_id", "name", "category", "city")


def validate(batch: DataFrame, json_col: str = "record") -> tuple[DataFrame, DataFrame]:
    """(valid records, rejects with errors) of JSON texts. Numeric strings count as numbers; unknown fields are errors.

    A column ``position`` of the batch, if there is one, goes along with the valid records.
    """
    number = {f.split()[0]: f.split()[1] for f in RECORD.split(", ") if f.split()[1] in ("double", "int")}
    raw_schema = ", ".join(f"{n} string" if n in number else f for f, n in zip(RECORD.split(", "), FIELDS, strict=True))
    keys = F.json_object_keys(json_col)
    rows = batch.withColumn("_r", F.from_json(json_col, raw_schema)).withColumn("_k", keys)
    unknown = F.transform(F.array_except("_k", F.array(*[F.lit(f) for f in FIELDS])), lambda k: F.concat(F.lit("unknown field: "), k))
    missing = F.array(*[F.when(F.coalesce(F.trim(F.col(f"_r.{f}")), F.lit("")) == "", F.lit(f"missing: {f}")) for f in REQUIRED])
    wrong = F.array(*[F.when(F.col(f"_r.{f}").isNotNull() & F.col(f"_r.{f}").try_cast(t).isNull(), F.lit(f"not a number: {f}")) for f, t in number.items()])
    errors = F.when(F.col("_k").isNull(), F.array(F.lit("not a JSON object"))).otherwise(F.filter(F.concat(unknown, missing, wrong), lambda e: e.isNotNull()))
    rows = rows.withColumn("errors", errors)
    valid = rows.where(F.size("errors") == 0).select(*[F.col(f"_r.{f}").try_cast(number[f]).alias(f) if f in number else F.col(f"_r.{f}").alias(f) for f in FIELDS], *[c for c in ("position",) if c in batch.columns])
    return valid, rows.where(F.size("errors") > 0).select(json_col, "errors")


def records(bodies: DataFrame, body_col: str = "body") -> DataFrame:
    """position, record of every element of request bodies, each the text of a JSON array; another text is taken as one record.

    Positions rise in the order of bodies and elements.
    """
    parsed = F.from_json(body_col, "array<string>")
    rows = bodies.select(F.explode(F.coalesce(parsed, F.array(body_col))).alias("record"))
    return rows.select(F.monotonically_increasing_id().alias("position"), "record")


def guard(n: int, conf: Settings = Settings()) -> None:
    if n > conf.batch_limit:
        raise ValueError(f"a batch holds at most {conf.batch_limit} records")


def decide(score: Column, metres: Column, place_type: Column, address: Column, conf: Verify = Verify()) -> tuple[Column, Column]:
    """(status, reasons joined by ';') of a geocoder's answer; a null score means no result."""
    reasons = F.filter(F.array(F.when(score < conf.match_score, "low score"), F.when(metres > conf.distance_m, "too far"), F.when(~place_type.isin(*conf.place_types), "place type")), lambda r: r.isNotNull())
    reason = F.when(F.coalesce(address, F.lit("")) == "", "no address").when(score.isNull(), "no result").otherwise(F.array_join(reasons, ";"))
    return F.when(reason == "", "verified").otherwise("unverified"), reason


class Throttled(Exception):
    """A geocoder asks to slow down."""


def verify(rows: DataFrame, client: Callable[[], Callable[[str], tuple[float, float, float, str] | None]], conf: Verify = Verify(), sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``rows`` plus status and reasons. ``client()`` makes, once per task, a function address -> (score, lat, lon, type) or None."""
    rows = rows.drop("status", "reasons")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = client()
        for b in batches:
            out = []
            for address in b["address"]:
                found, note = None, None
                for pause in (*conf.retries, None) if address else ():
                    try:
                        found = ask(address)
                        break
                    except Throttled:
                        if pause is None:
                            note = "throttled"
                        else:
                            sleep(pause)
                    except Exception as e:  # one record's failure doesn't fail the batch
                        note = type(e).__name__
                        break
                out.append((*(found or (None, None, None, None)), note))
            extra = pd.DataFrame(out, columns=["g_score", "g_lat", "g_lon", "g_type", "note"], index=b.index)
            yield pd.concat([b["_row"], extra], axis=1)

    # Every row gets its own answer: rows of one id may have different addresses.
    numbered = rows.withColumn("_row", F.to_json(F.struct(*rows.columns)))
    asked = numbered.select("_row", "address").mapInPandas(run, "_row string, g_score double, g_lat double, g_lon double, g_type string, note string")
    asked = asked.withColumn("_r", F.from_json("_row", rows.schema)).select("_r.*", "g_score", "g_lat", "g_lon", "g_type", "note")
    metres = haversine_km(F.col("lat"), F.col("lon"), F.col("g_lat"), F.col("g_lon")) * 1000
    status, reasons = decide(F.col("g_score"), metres, F.col("g_type"), F.col("address"), conf)
    return asked.select(*rows.columns, status.alias("status"), F.coalesce(F.concat(F.lit("error: "), F.col("note")), reasons).alias("reasons"))


#: New rows that one task numbers.
NUMBERED_TOGETHER = 65_536


def upsert(old: DataFrame, batch: DataFrame, key: str = "poi_id", order: str = "row_order", position: str | None = None) -> DataFrame:
    """Old rows with the batch's values where keys agree; new keys get the next orders, in the order of the batch.

    ``position``: the column that says that order (without one, the order in which the batch is read).  Of a key repeated in the
    batch the last row counts; a new one is numbered by its first row.  Positions are cut into stretches of NUMBERED_TOGETHER: a
    count per stretch, then a rank in each, so no task sees all new rows.
    """
    if not position:
        position, batch = "_position", batch.withColumn("_position", F.monotonically_increasing_id())
    values = [c for c in batch.columns if c not in (key, position)]
    batch = batch.groupBy(key).agg(*[F.max_by(F.struct(c), position).alias(f"_n_{c}") for c in values], F.min(position).alias("_first"))
    batch = batch.select(key, *[F.col(f"_n_{c}")[c].alias(f"_n_{c}") for c in values], "_first", F.lit(True).alias("_new"))
    top = old.agg(F.coalesce(F.max(order), F.lit(-1))).scalar()
    merged = old.withColumn("_old", F.lit(True)).join(batch, key, "full_outer")
    pick = lambda c: F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)) if c in values else F.col(c)
    kept = merged.where("_old").select(*[pick(c).alias(c) if c not in (key, order) else F.col(c) for c in old.columns])
    fresh = merged.where("_old is null").select(key, *[F.col(f"_n_{c}").alias(c) for c in values], "_first").withColumn("_part", F.floor(F.col("_first") / NUMBERED_TOGETHER))
    counts = fresh.groupBy("_part").agg(F.count("*").alias("n"))  # a row per stretch
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy("_first", key))
    fresh = fresh.withColumn("_rank", rank).join(before, "_part")
    fresh = fresh.withColumn(order, (top + F.col("_before") + F.col("_rank")).cast(old.schema[order].dataType))
    return kept.unionByName(fresh.select(*[F.col(c) for c in old.columns if c in fresh.columns]), allowMissingColumns=True)


class Snapshots:
    """Immutable versions in a folder of the cluster's file system, and one pointer file per version.

    A version is written whole, then published by creating its pointer under a new name; readers bound to an older one are not
    disturbed.  A failed write leaves no pointer, so the version stays where it was.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def pointers(self) -> dict[int, str]:
        if not self.fs.exists(self._path("versions")):
            return {}
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path("versions"))]
        return {int(n.split("-")[0]): n for n in names if n[:1].isdigit()}

    def version(self) -> int:
        """The newest published version; 0 before the first."""
        return max(self.pointers(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        where = json.loads(self.spark.read.text(f"{self.root}/versions/{self.pointers()[v]}").first()[0])["data"]
        return self.spark.read.parquet(f"{self.root}/{where}")

    def publish(self, rows: DataFrame, expected: int | None = None) -> int:
        """Write ``rows`` as the next version; ``expected``: the version they were made from."""
        now = self.version()
        if expected is not None and expected != now:
            raise RuntimeError(f"version {now} was published meanwhile")
        data = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{data}")
        tmp = self._path(f"_tmp-{uuid.uuid4().hex}")
        stream = self.fs.create(tmp)
        stream.writeBytes(json.dumps({"version": now + 1, "data": data}) + "\n")
        stream.close()
        self.fs.mkdirs(self._path("versions"))
        if not self.fs.rename(tmp, self._path(f"versions/{now + 1:010d}-pointer.json")):
            raise RuntimeError(f"version {now + 1} was published meanwhile")
        return now + 1


def ingest(snapshots: Snapshots, batch: DataFrame, json_col: str = "record", conf: Settings = Settings(), client=None, after: Callable[[int], object] | None = None) -> dict:
    """Validate, verify and merge one batch; valid records go in even if others are rejected.

    ``after(version)`` runs once the batch is published (say, a reload); if it fails, the batch stands and the answer has a warning.
    """
    n = batch.count()
    guard(n, conf)
    valid, rejected = validate(batch.withColumn("position", F.monotonically_increasing_id()), json_col)
    valid = verify(valid, client, conf.verify) if client else valid.withColumn("status", F.lit("unverified"))
    # Written once: a geocoder is asked once a record, and every count below is of the same answers.
    staged = f"{snapshots.root}/batches/{uuid.uuid4().hex}"
    valid.write.parquet(staged)
    valid = snapshots.spark.read.schema(valid.schema).parquet(staged)
    ok, unverified = valid.agg(F.count("*"), F.count_if(F.col("status") == "unverified")).first()
    version, warning = snapshots.version(), {}
    if ok:
        old = snapshots.read(version) if version else valid.drop("position").limit(0).withColumn("row_order", F.lit(0))
        version = snapshots.publish(upsert(old, valid, position="position"), version)
    snapshots.fs.delete(snapshots._path(staged.removeprefix(f"{snapshots.root}/")), True)
    if ok and after:
        try:
            after(version)
        except Exception as e:
            warning = {"warning": f"not reloaded: {type(e).__name__}"}
    return warning | {"received": n, "accepted": ok, "rejected": n - ok, "version": version, "unverified_ratio": round(unverified / max(ok, 1), 3)}


def seed(snapshots: Snapshots, rows: DataFrame, position: str | None = None) -> int:
    """A first version from a whole corpus, its row_order from 0 on in the order of ``position`` (without one, as it is read)."""
    empty = rows.drop(*[c for c in (position,) if c]).limit(0).withColumn("row_order", F.lit(0))
    return snapshots.publish(upsert(empty, rows, position=position), snapshots.version())


def backfill_version(snapshots: Snapshots, statuses: DataFrame) -> int:
    """A new version with the statuses filled in."""
    version = snapshots.version()
    return snapshots.publish(backfill(snapshots.read(version), statuses), version)


def backfill(rows: DataFrame, statuses: DataFrame) -> DataFrame:
    """New statuses by id; others stay."""
    s = statuses.select("poi_id", F.col("status").alias("_s"))
    return rows.join(s, "poi_id", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")
