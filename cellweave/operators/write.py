"""Writes: log entries made on the driver or from DataFrames, and what a commit returns.

A commit is one append with one sequence number; ``WriteBatch`` collects its
mutations. There is one writer; check-and-mutate and transactions are validated
against the log at commit.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import CELL_DELETE, CELLS, COLUMN, COLUMN_DELETE, FAMILY_DELETE, INTEGER_KINDS, MERGE, PUT, VALUES, Family, wrap_i64, wrapped_sum
from .select import Bounds, Read, select
from .vector import to_bfloat, to_half


class Conflict(Exception):
    """A transaction's read set changed before it committed."""


#: Operand types that a family kind takes.
TAKES = {**dict.fromkeys(INTEGER_KINDS, {"i64"}), **dict.fromkeys(("min_f64", "max_f64", "sum_f64", "mean_var", "histogram", "quantiles"), {"f64"}), "hll": {"i64", "bytes"}, "bloom": {"i64", "bytes"}, "set": {"i64"}}


@dataclass
class WriteBatch:
    """Mutations of one commit, in order. ``ts`` None: the commit's time (0 in aggregate families)."""

    families: dict[str, Family]
    entries: list[dict] = field(default_factory=list)

    def _add(self, row: bytes, family: str, qualifier: bytes | None, kind: int, ts: int | None, **value) -> WriteBatch:
        if family not in self.families:
            raise ValueError(f"no such family: {family}")
        if self.families[family].aggregate and ts is None and kind in (PUT, MERGE):
            ts = 0
        self.entries.append({"row": row, "family": family, "qualifier": qualifier, "kind": kind, "ts": ts, "op": len(self.entries)} | value)
        return self

    def put(self, row: bytes, family: str, qualifier: bytes, value, ts: int | None = None) -> WriteBatch:
        """bytes, int (i64), float (f64), or a list of numbers (vector, as the family's ``dim`` and ``element`` ask)."""
        if isinstance(value, list):
            value = fitted(value, self.families[family].params) if family in self.families else value
        return self._add(row, family, qualifier, PUT, ts, **typed(value))

    def set_add(self, row: bytes, family: str, qualifier: bytes, element: int, ts: int | None = None) -> WriteBatch:
        return self._add(row, family, qualifier, MERGE, ts, value_type="set_add", value_i64=_member(element))

    def set_remove(self, row: bytes, family: str, qualifier: bytes, element: int, ts: int | None = None) -> WriteBatch:
        return self._add(row, family, qualifier, MERGE, ts, value_type="set_remove", value_i64=_member(element))

    def aggregate(self, row: bytes, family: str, qualifier: bytes, value, ts: int | None = None) -> WriteBatch:
        own, what = self.families[family], typed(value)
        if own.aggregate and what["value_type"] not in TAKES.get(own.kind, {what["value_type"]}):
            raise TypeError(f"family {family} ({own.kind}) doesn't take {what['value_type']} operands")
        if isinstance(value, float) and value != value:
            raise ValueError("NaN is refused")
        return self._add(row, family, qualifier, MERGE, ts, **what)

    incr = aggregate

    def delete_cell(self, row: bytes, family: str, qualifier: bytes, ts: int) -> WriteBatch:
        return self._add(row, family, qualifier, CELL_DELETE, ts)

    def delete_column(self, row: bytes, family: str, qualifier: bytes, ts: int | None = None) -> WriteBatch:
        return self._add(row, family, qualifier, COLUMN_DELETE, ts)

    def delete_family(self, row: bytes, family: str, ts: int | None = None) -> WriteBatch:
        return self._add(row, family, None, FAMILY_DELETE, ts)

    def delete_row(self, row: bytes, ts: int | None = None) -> WriteBatch:
        for name in self.families:
            self.delete_family(row, name, ts)
        return self

    def rows(self, seqno: int, commit_ts: int) -> list[dict]:
        """As log entries. Of writes to one cell and time the last counts, except aggregate inputs."""
        last = {}
        for x in self.entries:
            x = x | {"seqno": seqno, "ts": commit_ts if x["ts"] is None else x["ts"]}
            folds = self.families[x["family"]].aggregate and x["kind"] == MERGE
            last[x["op"] if folds else (x["row"], x["family"], x["qualifier"], x["ts"], x["kind"])] = x
        return sorted(last.values(), key=lambda x: x["op"])

    def frame(self, spark: SparkSession, seqno: int, commit_ts: int) -> DataFrame:
        names = [x.split(" ")[0] for x in CELLS.split(", ")]
        return spark.createDataFrame([tuple(x.get(n) for n in names) for x in self.rows(seqno, commit_ts)], CELLS)


def _member(element: int) -> int:
    """Sets hold unsigned 32-bit integers."""
    if not 0 <= element < 1 << 32:
        raise ValueError("a set's elements are 0 to 2^32 - 1")
    return element


#: Elements of a vector family, and what a component is rounded to or must be.
ELEMENTS = ("f32", "f16", "bf16", "i8", "bit")
MOST_DIMENSIONS = 4096


def fitted(value: list, params: dict) -> list[float]:
    """A vector as its family stores it. Wrong lengths, NaN and components out of range are refused."""
    element, dim = params.get("element", "f32"), params.get("dim")
    if element not in ELEMENTS or not 1 <= len(value) <= MOST_DIMENSIONS or (dim and len(value) != dim):
        raise ValueError(f"a vector of {dim or '1 to 4096'} {element} components is asked for")
    own = np.array(value, float)
    if np.isnan(own).any() or (params.get("metric") == "cosine" and not own.any()):
        raise ValueError("NaN, and zero vectors under cosine, are refused")
    if element == "i8" and (own != np.rint(own)).any() | (np.abs(own + 0.5) > 127.5).any():
        raise ValueError("components are integers from -128 to 127")
    if element == "bit" and not np.isin(own, (0, 1)).all():
        raise ValueError("components are 0 or 1")
    if element in ("f16", "bf16"):
        own = (to_half if element == "f16" else to_bfloat)(own)
    return own.astype(np.float32).tolist()


def typed(value) -> dict:
    if isinstance(value, bytes):
        return {"value_type": "bytes", "value": value}
    if isinstance(value, bool) or not isinstance(value, int | float | list):
        raise TypeError("a value is bytes, int, float or a list of floats")
    if isinstance(value, int):
        return {"value_type": "i64", "value_i64": (value + 2**63) % 2**64 - 2**63}
    if isinstance(value, float):
        return {"value_type": "f64", "value_f64": value}
    return {"value_type": "vector", "value_vec": [float(x) for x in value]}


@dataclass(frozen=True)
class Condition:
    """On a column's newest version: exists, absent, or equals ``value``."""

    row: bytes
    family: str
    qualifier: bytes
    test: str
    value: bytes | int | float | None = None

    def holds(self, cells: DataFrame, families: list[Family], snapshot: int | None = None) -> bool:
        found = select(cells, families, Read(rows=Bounds.one(self.row), families=(self.family,), qualifiers=Bounds.one(self.qualifier), snapshot=snapshot)).select(*VALUES).first()
        if self.test != "value":
            return (found is not None) == (self.test == "exists")
        return found is not None and all(found[k] == v for k, v in typed(self.value).items())


def returning(cells: DataFrame, families: list[Family]) -> DataFrame:
    """What each increment of integer sum families returns: ``previous`` and ``current``, in commit order.

    Every caller sees its own step. Puts set the value; sums wrap. A delete at or above
    an input's timestamp (a cell's: at it) that was committed before the input begins
    the column's version anew: the next increment has no previous value.
    """
    names = [f.name for f in families if f.kind == "sum"]
    own = cells.where(F.col("family").isin(names))
    inputs = own.where(F.col("kind").isin(PUT, MERGE)).select(*COLUMN, "ts", "seqno", "op", "kind", "value_i64")
    deletes = own.where(F.col("kind").isin(CELL_DELETE, COLUMN_DELETE, FAMILY_DELETE)).select("row", "family", F.col("qualifier").alias("at"), F.col("ts").alias("upto"), "seqno", "op", "kind")
    # The few deletes meet the versions that they reach, not the inputs.
    hit = (F.col("at").isNull() | (F.col("at") == F.col("qualifier"))) & F.when(F.col("kind") == CELL_DELETE, F.col("ts") == F.col("upto")).otherwise(F.col("ts") <= F.col("upto"))
    starts = deletes.join(inputs.select(*COLUMN, "ts").distinct(), ["row", "family"]).where(hit).select(*COLUMN, "ts", "seqno", "op", "kind", F.lit(None).cast("bigint").alias("value_i64"))
    rows = inputs.unionByName(starts)
    # Inputs of a delete's own commit outlive it.
    by = ["seqno", F.col("kind").isin(PUT, MERGE), "op"]
    order = Window.partitionBy(*COLUMN, "ts").orderBy(*by)
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("reset", F.sum((F.col("kind") != MERGE).cast("int")).over(sofar))
    since = Window.partitionBy(*COLUMN, "ts", "reset").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(F.col("value_i64").cast("decimal(38,0)")).over(since)
    rows = rows.withColumn("current", wrap_i64(total))
    rows = rows.withColumn("previous", F.lag("current").over(order)).where(F.col("kind").isin(PUT, MERGE))
    return rows.select(*COLUMN, "ts", "seqno", "op", "previous", "current")


def conflicts(cells: DataFrame, reads: DataFrame) -> DataFrame:
    """``reads``: txn, row, family, qualifier (null: the row's whole family), start, commit. Transactions to abort.

    One whose read cells, or family ranges, were written after it started and
    before it committed. Reads and writes of a key are sorted by number together, and
    each read looks at the next write alone, so a hot row is no product of both. Keys
    are of three sorts: columns; whole families, for reads of them; and family
    markers, for reads of columns.
    """
    none = F.lit(None).cast("bigint")
    log = cells.select("row", "family", "qualifier", "seqno", F.col("seqno").alias("written"), none.alias("txn"), none.alias("commit"))
    asked = reads.select("row", "family", "qualifier", F.col("start").alias("seqno"), none.alias("written"), F.col("txn").cast("bigint").alias("txn"), F.col("commit").cast("bigint").alias("commit"))
    column, whole = F.col("qualifier").isNotNull(), F.lit(None).cast("binary")
    parts = [
        log.where(column).withColumn("sort", F.lit(0)), log.withColumns({"sort": F.lit(1), "qualifier": whole}), log.where(~column).withColumn("sort", F.lit(2)),
        asked.where(column).withColumn("sort", F.lit(0)), asked.where(~column).withColumn("sort", F.lit(1)), asked.where(column).withColumns({"sort": F.lit(2), "qualifier": whole}),
    ]
    events = parts[0]
    for x in parts[1:]:
        events = events.unionByName(x)
    later = Window.partitionBy("sort", "row", "family", "qualifier").orderBy("seqno", F.col("txn").isNotNull()).rowsBetween(1, Window.unboundedFollowing)
    events = events.withColumn("next", F.first("written", ignorenulls=True).over(later))
    return events.where(F.col("txn").isNotNull() & (F.col("next") < F.col("commit"))).select(F.col("txn").cast(reads.schema["txn"].dataType).alias("txn")).distinct()


def transact(body: Callable[[], object], attempts: int = 8, base_s: float = 5e-6, most_s: float = 0.1, deadline_s: float = 30.0):
    """Runs ``body`` again after Conflict, with jittered, doubling waits, until the deadline."""
    end = time.monotonic() + deadline_s
    for k in range(attempts):
        try:
            return body()
        except Conflict:
            wait = random.uniform(0, min(most_s, base_s * 2**k))
            if k + 1 == attempts or time.monotonic() + wait > end:
                raise
            time.sleep(wait)
    return None


def counter_totals(cells: DataFrame, family: str) -> DataFrame:
    """Wrapping sums of a counter family's operands, deletes aside."""
    return cells.where((F.col("family") == family) & (F.col("kind") == MERGE)).groupBy(*COLUMN, "ts").agg(wrapped_sum(F.col("value_i64")).alias("total"))
