"""The data model: a log of cells, and the families that say how it reads.

A database is an append-only DataFrame of cell entries. Every read is a lazy
DataFrame over it; nothing is updated in place.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PUT, MERGE, CELL_DELETE, COLUMN_DELETE, FAMILY_DELETE = 1, 2, 3, 4, 5
KINDS = {PUT: "put", MERGE: "merge", CELL_DELETE: "delete_cell", COLUMN_DELETE: "delete_column", FAMILY_DELETE: "delete_family"}

CELLS = (
    "row binary, family string, qualifier binary, ts bigint, seqno bigint, op int, kind int, "
    "value_type string, value binary, value_i64 bigint, value_f64 double, value_vec array<float>"
)
VALUES = ("value_type", "value", "value_i64", "value_f64", "value_vec")
COLUMN = ("row", "family", "qualifier")
TWO63, TWO64 = 1 << 63, 1 << 64

#: Aggregate family kinds that fold signed 64-bit integers.
INTEGER_KINDS = ("sum", "min", "max", "bit_or", "bit_and", "bit_xor")


@dataclass(frozen=True)
class Family:
    """A family's fixed policy. ``kind``: standard, or the name of an aggregation."""

    name: str
    kind: str = "standard"
    max_versions: int = 0
    ttl_us: int = 0
    merge_operator: str = ""
    params: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.max_versions < 0 or self.ttl_us < 0:
            raise ValueError(f"family {self.name}: max_versions and ttl_us can't be negative")

    @property
    def aggregate(self) -> bool:
        return self.kind != "standard"


def cells(df: DataFrame, **columns) -> DataFrame:
    """``df`` as cell entries: each keyword gives a column of CELLS, the others are null (op: 0, kind: put)."""
    columns = {"op": F.lit(0), "kind": F.lit(PUT)} | columns
    out = []
    for part in CELLS.split(", "):
        name, kind = part.split(" ")
        out.append(columns.get(name, F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


def utf8(column):
    return F.col(column).cast("binary") if isinstance(column, str) else column.cast("binary")


def wrap_i64(total):
    """A decimal sum as a signed 64-bit integer with wrap-around."""
    two63, two64 = (F.lit(str(x)).cast("decimal(38,0)") for x in (TWO63, TWO64))
    return (F.pmod(total.cast("decimal(38,0)") + two63, two64) - two63).cast("bigint")


def wrapped_sum(column):
    return wrap_i64(F.sum(column.cast("decimal(38,0)")))
