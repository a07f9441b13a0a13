"""Dump and load: a database's tables as JSON lines, CSV or Arrow, and back.

A line is a header, a table with its families, or a cell. Byte strings that are
UTF-8 are JSON strings, others {"base64": ...}; integers {"i64": ...}; floats
{"f64": ...}, or {"f64_bits": ...} where JSON has no number for them.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.select import ordered
from ..schema import CELLS, PUT, VALUES, Family

HEADER = {"format": "cellweave-dump", "version": 1}
EXPORT = ("row", "family", "qualifier", "ts", "value", "value_type", "value_i64", "value_f64", "value_vec")


def export(selected: DataFrame, typed: bool = True) -> DataFrame:
    """Resolved cells in the columns of an Arrow export: ts as a timestamp, typed values beside the bytes."""
    out = selected.withColumn("ts", F.timestamp_micros("ts"))
    return out.select(*[c for c in EXPORT if typed or not c.startswith("value_")], *[] if typed else ["value_type"])


def arrow_batches(selected: DataFrame, typed: bool = True):
    """The export as an Arrow table, in natural order: for results that fit the driver."""
    return export(ordered(selected), typed).toArrow()


def _bytes(column: str) -> Column:
    """A JSON value: the string, or an object with its base64 form."""
    text = F.col(column).cast("string")
    same = F.is_valid_utf8(text)
    return F.when(same, F.to_json(F.array(text))).otherwise(F.to_json(F.array(F.struct(F.base64(column).alias("base64")))))


def _inner(array: Column) -> Column:
    """The single element of a JSON array's text."""
    return F.substring(array, F.lit(2), F.length(array) - 2)


def dump_lines(versions: DataFrame, table: str) -> DataFrame:
    """line: one for each cell of resolved ``versions``."""
    f64 = F.when(F.isnan("value_f64") | (F.abs("value_f64") == float("inf")), F.to_json(F.struct(F.col("value_f64").cast("string").alias("f64_bits")))).otherwise(F.to_json(F.struct(F.col("value_f64").alias("f64"))))
    value = F.when(F.col("value_type") == "i64", F.to_json(F.struct(F.col("value_i64").alias("i64")))).when(F.col("value_type") == "f64", f64).when(F.col("value_type") == "vector", F.to_json(F.struct(F.col("value_vec").alias("vector")))).otherwise(_inner(_bytes("value")))
    parts = ['{"cell":{"table":', F.lit(json.dumps(table)), ',"row":', _inner(_bytes("row")), ',"family":', _inner(F.to_json(F.array("family"))), ',"qualifier":', _inner(_bytes("qualifier")), ',"ts":', F.col("ts").cast("string"), ',"value":', value, "}}"]
    return versions.select(F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]).alias("line"))


def dump(spark: SparkSession, versions: DataFrame, table: str, families: list[Family], path: str) -> None:
    """Header and table lines come first in a file of their own."""
    head = [json.dumps({"header": HEADER}), json.dumps({"table": {"name": table, "families": [f.__dict__ for f in families]}})]
    spark.createDataFrame([(x,) for x in head], "line string").coalesce(1).write.mode("append").text(path)
    dump_lines(versions, table).write.mode("append").text(path)


def load(spark: SparkSession, path: str, seqno: int = 1) -> tuple[dict[str, list[Family]], DataFrame]:
    """Tables with their families, and log entries with a ``table`` column."""
    lines = spark.read.text(path)
    heads = lines.where(F.col("value").startswith('{"header"') | F.col("value").startswith('{"table"')).collect()  # a line for each table
    found = [json.loads(x["value"]) for x in heads]
    for x in found:
        if "header" in x and x["header"] != HEADER:
            raise ValueError("not a dump of this format")
    tables = {x["table"]["name"]: [Family(**f) for f in x["table"]["families"]] for x in found if "table" in x}
    cell = F.get_json_object("value", "$.cell")

    def raw(name: str) -> Column:
        own = F.get_json_object(cell, f"$.{name}")
        packed = F.get_json_object(cell, f"$.{name}.base64")
        return F.coalesce(F.unbase64(packed), own.cast("binary"))

    def part(name: str) -> Column:
        return F.get_json_object(cell, f"$.value.{name}")

    i64, f64, bits, vec = part("i64"), part("f64"), part("f64_bits"), part("vector")
    kind = F.when(i64.isNotNull(), "i64").when(f64.isNotNull() | bits.isNotNull(), "f64").when(vec.isNotNull(), "vector").otherwise("bytes")
    rows = lines.where(F.col("value").startswith('{"cell"'))
    columns = {
        "row": raw("row"), "family": F.get_json_object(cell, "$.family"), "qualifier": raw("qualifier"), "ts": F.get_json_object(cell, "$.ts").cast("bigint"), "seqno": F.lit(seqno), "op": F.lit(0), "kind": F.lit(PUT),
        "value_type": kind, "value": F.when(kind == "bytes", raw("value")), "value_i64": i64.cast("bigint"), "value_f64": F.coalesce(f64, bits).cast("double"), "value_vec": F.from_json(vec, "array<float>"),
    }
    out = rows.select(F.get_json_object(cell, "$.table").alias("table"), *[columns[x.split(" ")[0]].cast(x.split(" ")[1]).alias(x.split(" ")[0]) for x in CELLS.split(", ")])
    return tables, out


def csv(versions: DataFrame, path: str) -> None:
    """Keys and byte values as base64, numbers as they are."""
    versions.select(F.base64("row").alias("row"), "family", F.base64("qualifier").alias("qualifier"), "ts", "value_type", F.base64("value").alias("value"), "value_i64", "value_f64").write.option("header", True).csv(path)


__all__ = ["EXPORT", "VALUES", "arrow_batches", "csv", "dump", "dump_lines", "export", "load"]
