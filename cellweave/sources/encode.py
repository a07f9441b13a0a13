"""Star-schema and event tables as cell logs.

Each function reads one Parquet table of a folder and returns log entries with
the schema of ``schema.CELLS``; the families that go with them are beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COLUMN_DELETE, MERGE, PUT, Family, cells, utf8

DAY_US = 86_400_000_000
EVENTS = [Family("ev")]
HITS = [Family("hits", "sum")]
CUSTOMERS = [Family("attr")]
EDGES = [Family("out")]
VECTORS = [Family("emb")]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def micros(column: str):
    """Microseconds of a time without zone, read as UTC."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def _user():
    return utf8(F.concat(F.lit("u:"), F.lpad(F.col("user_id").cast("string"), 8, "0")))


def events(spark: SparkSession, folder: str, family: str = "ev") -> DataFrame:
    """Row u:<user>, qualifier event type, f64 value at the event's time; every tenth event deletes its column so far."""
    gone = F.col("event_id") % 10 == 0
    return cells(
        table(spark, folder, "events"), row=_user(), family=F.lit(family), qualifier=utf8("event_type"), ts=micros("ts"), seqno=F.col("event_id"),
        kind=F.when(gone, COLUMN_DELETE).otherwise(PUT), value_type=F.when(~gone, "f64"), value_f64=F.when(~gone, F.col("value")),
    )


def hits(spark: SparkSession, folder: str, family: str = "hits", bucket_us: int = 0, deletes: bool = False) -> DataFrame:
    """Operands k of the events' props, at ts 0 or in buckets of ``bucket_us``."""
    ts = micros("ts")
    at = ts - F.pmod(ts, F.lit(bucket_us)) if bucket_us else F.lit(0)
    gone = (F.col("event_id") % 100 == 0) & F.lit(deletes)
    k = F.get_json_object("props", "$.k").cast("bigint")
    return cells(
        table(spark, folder, "events"), row=_user(), family=F.lit(family), qualifier=utf8("event_type"), ts=at, seqno=F.col("event_id"),
        kind=F.when(gone, COLUMN_DELETE).otherwise(MERGE), value_type=F.when(~gone, "i64"), value_i64=F.when(~gone, k),
    )


def stats(spark: SparkSession, folder: str, family: str = "stats", bucket_us: int = 0) -> DataFrame:
    """Operands: the events' values."""
    ts = micros("ts")
    at = ts - F.pmod(ts, F.lit(bucket_us)) if bucket_us else F.lit(0)
    return cells(
        table(spark, folder, "events"), row=_user(), family=F.lit(family), qualifier=utf8("event_type"), ts=at, seqno=F.col("event_id"),
        kind=F.lit(MERGE), value_type=F.lit("f64"), value_f64=F.col("value"),
    )


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """Row c:<key>; name and segment as bytes, nation as i64; absent where the key says so."""
    rows = table(spark, folder, "customer").withColumn("key", utf8(F.concat(F.lit("c:"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))))
    none = {"v": F.lit(None).cast("binary"), "i": F.lit(None).cast("bigint"), "f": F.lit(None).cast("double")}

    def one(name: str, kind: str, **value):
        return F.struct(F.lit(name).alias("q"), F.lit(kind).alias("t"), *[x.alias(k) for k, x in (none | value).items()])

    columns = F.array(
        one("name", "bytes", v=utf8("c_name")), one("nation", "i64", i=F.col("c_nationkey").cast("bigint")),
        one("segment", "bytes", v=utf8("c_mktsegment")), one("balance", "f64", f=F.col("c_acctbal")),
    )
    each = rows.select("key", "c_custkey", F.inline(columns)).where(~((F.col("q") == "segment") & (F.col("c_custkey") % 3 == 0)))
    return cells(each, row=F.col("key"), family=F.lit("attr"), qualifier=utf8("q"), ts=F.lit(1), seqno=F.col("c_custkey"), value_type=F.col("t"), value=F.col("v"), value_i64=F.col("i"), value_f64=F.col("f"))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Orders to parts and parts to orders: row and qualifier are node keys, the value is the return flag."""
    rows = table(spark, folder, "lineitem")
    order, part = (F.concat(F.lit(a), F.lpad(F.col(b).cast("string"), 9, "0")) for a, b in (("o:", "l_orderkey"), ("p:", "l_partkey")))
    both = rows.select("l_returnflag", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seqno"), micros("l_shipdate").alias("ts"), F.explode(F.array(F.struct(order.alias("a"), part.alias("b")), F.struct(part.alias("a"), order.alias("b")))).alias("e"))
    return cells(both, row=utf8("e.a"), family=F.lit("out"), qualifier=utf8("e.b"), ts=F.col("ts"), seqno=F.col("seqno"), value_type=F.lit("bytes"), value=utf8("l_returnflag"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    key = utf8(F.concat(F.lit("v:"), F.lpad(F.col("vec_id").cast("string"), 9, "0")))
    return cells(rows, row=key, family=F.lit("emb"), qualifier=F.lit(b""), ts=F.lit(0), seqno=F.col("vec_id"), value_type=F.lit("vector"), value_vec=F.col("embedding"))
