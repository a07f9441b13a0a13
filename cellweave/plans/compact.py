"""Compaction: fewer entries, the same answers at every retained snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.resolve import FOLDS, live_inputs
from ..schema import CELLS, COLUMN, INTEGER_KINDS, MERGE, PUT, Family


def compact(cells: DataFrame, families: list[Family], oldest: int, now: int | None = None) -> DataFrame:
    """Drops what no read at a snapshot of ``oldest`` or later can see.

    Entries newer than ``oldest`` stay. Of those up to it, in standard families
    without merge operator: puts that a newer put of the same cell, a cell delete,
    or a column or family delete at or above them hides already at ``oldest``;
    versions beyond max_versions stay, since a later delete may uncover them, and so
    do deletes, which also hide what is written later below them. Expired entries
    go in any family: time only moves on. Inputs of integer aggregate families fold:
    a version's live ones become one, a put where one of them was, at the place of the
    newest; those that a delete hides are gone.
    """
    plain = [f.name for f in families if not f.aggregate and not f.merge_operator]
    rows = cells
    if now is not None:
        for f in families:
            if f.ttl_us:
                rows = rows.where(~((F.col("family") == f.name) & (F.col("ts") <= now - f.ttl_us) & F.col("kind").isin(1, 2)))
    old = F.col("seqno") <= oldest
    markers = rows.where(old & (F.col("kind") == 5) & F.col("family").isin(plain)).groupBy("row", "family").agg(F.max("ts").alias("marker"))
    column, cell = Window.partitionBy(*COLUMN), Window.partitionBy(*COLUMN, "ts")
    own = rows.join(markers, ["row", "family"], "left").withColumns({
        "cover": F.greatest("marker", F.max(F.when(old & (F.col("kind") == 4), F.col("ts"))).over(column)),
        "newest": F.max(F.when(old & (F.col("kind") == PUT), F.struct("seqno", "op"))).over(cell),
        "cut": F.coalesce(F.max(old & (F.col("kind") == 3)).over(cell), F.lit(False)),
    })
    hidden = (F.col("ts") <= F.coalesce("cover", F.lit(-1))) | F.col("cut") | (F.struct("seqno", "op") < F.col("newest"))
    gone = F.col("family").isin(plain) & old & (F.col("kind") == PUT) & hidden
    out = own.where(~F.coalesce(gone, F.lit(False))).drop("marker", "cover", "newest", "cut")
    folding = [f for f in families if f.kind in INTEGER_KINDS]
    if not folding:
        return out
    before = old & F.col("family").isin([f.name for f in folding]) & F.col("kind").isin(PUT, MERGE)
    return out.where(~before).unionByName(_folded(rows.where(old), folding))


def _folded(rows: DataFrame, families: list[Family]) -> DataFrame:
    """One input for each version of these families: summed before and after the shuffle."""
    parts = None
    for kind in dict.fromkeys(f.kind for f in families):
        inputs = live_inputs(rows, [f for f in families if f.kind == kind])
        newest = F.max(F.struct("seqno", "op"))
        own = inputs.groupBy(*COLUMN, "ts").agg(newest.alias("at"), F.max(F.col("base").cast("int")).alias("base"), FOLDS[kind](F.col("value_i64")).alias("value_i64"))
        parts = own if parts is None else parts.unionByName(own)
    made = parts.withColumns({"seqno": F.col("at.seqno"), "op": F.col("at.op"), "kind": F.when(F.col("base") == 1, PUT).otherwise(MERGE), "value_type": F.lit("i64")})
    names = [x.split(" ") for x in CELLS.split(", ")]
    return made.select(*[(F.col(n) if n in made.columns else F.lit(None)).cast(t).alias(n) for n, t in names])
