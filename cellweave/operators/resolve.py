"""Version resolution: from log entries to the versions that a read may see.

Deletes, expiry, base values and merge operands are settled here, before any
selection. One shuffle on the column (row, family, qualifier) carries all windows
and groupings of a standard family; family markers, which span a row's columns,
come by a join that the optimizer broadcasts where they are few. Aggregate families
have no windows: what deletes and puts say is joined to the inputs likewise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..schema import CELL_DELETE, COLUMN, COLUMN_DELETE, FAMILY_DELETE, INTEGER_KINDS, MERGE, PUT, VALUES, Family, wrap_i64, wrapped_sum


def _column() -> WindowSpec:
    return Window.partitionBy(*COLUMN)


def _version() -> WindowSpec:
    return Window.partitionBy(*COLUMN, "ts")


def _newest() -> WindowSpec:
    return _column().orderBy(F.desc("ts"))


def visible(cells: DataFrame, snapshot: int | None = None) -> DataFrame:
    return cells if snapshot is None else cells.where(F.col("seqno") <= snapshot)


def _expiry(families: list[Family], now: int | None) -> Column:
    """Whether an entry is past its family's time to live."""
    out = F.lit(False)
    if now is not None:
        for f in families:
            if f.ttl_us:
                out = F.when(F.col("family") == f.name, F.col("ts") <= now - f.ttl_us).otherwise(out)
    return out


def _order() -> Column:
    return F.struct("seqno", "op")


def standard(cells: DataFrame, families: list[Family], now: int | None = None) -> DataFrame:
    """Versions of standard families: row, family, qualifier, ts, seqno and the value.

    Deletes hide by timestamp whatever the commit order. The newest put at a
    timestamp is its base. Where a family has the ``i64_add`` operator, operands
    newer than the base fold onto it, and timestamps with operands alone fold onto
    the next older put, as one version that carries the newest timestamp.
    """
    names = [f.name for f in families]
    rows = cells.where(F.col("family").isin(names))
    markers = rows.where(F.col("kind") == FAMILY_DELETE).groupBy("row", "family").agg(F.max("ts").alias("marker"))
    rows = rows.where(F.col("kind") != FAMILY_DELETE).join(markers, ["row", "family"], "left")
    rows = rows.withColumns({
        "cover": F.greatest(F.max(F.when(F.col("kind") == COLUMN_DELETE, F.col("ts"))).over(_column()), F.col("marker")),
        "cut": F.max(F.col("kind") == CELL_DELETE).over(_version()),
        "base": F.max(F.when(F.col("kind") == PUT, _order())).over(_version()),
    })
    live = F.col("kind").isin(PUT, MERGE) & (F.col("ts") > F.coalesce("cover", F.lit(-1))) & ~F.col("cut") & ~_expiry(families, now)
    rows = rows.where(live)
    adding = [f.name for f in families if f.merge_operator == "i64_add"]
    plain = rows.where(~F.col("family").isin(adding)) if adding else rows
    out = plain.where((F.col("kind") == PUT) & (_order() == F.col("base"))).select(*COLUMN, "ts", "seqno", *VALUES)
    if not adding:
        return out
    adds = rows.where(F.col("family").isin(adding) & ((_order() == F.col("base")) | ((F.col("kind") == MERGE) & (F.col("base").isNull() | (_order() > F.col("base"))))))
    at = adds.groupBy(*COLUMN, "ts").agg(
        F.sum(F.col("value_i64").cast("decimal(38,0)")).alias("total"), F.max("seqno").alias("seqno"), F.max((F.col("kind") == PUT).cast("int")).alias("put")
    )
    # A run ends with the put it folds onto: its number is how many puts are newer.
    before = _newest().rowsBetween(Window.unboundedPreceding, -1)
    runs = at.withColumn("run", F.coalesce(F.sum("put").over(before), F.lit(0)))
    runs = runs.groupBy(*COLUMN, "run").agg(F.max("ts").alias("ts"), F.max("seqno").alias("seqno"), wrap_i64(F.sum("total")).alias("value_i64"))
    none = {"value_type": F.lit("i64"), "value": F.lit(None).cast("binary"), "value_f64": F.lit(None).cast("double"), "value_vec": F.lit(None).cast("array<float>")}
    return out.unionByName(runs.withColumns(none).select(*COLUMN, "ts", "seqno", *VALUES))


def live_inputs(cells: DataFrame, families: list[Family], now: int | None = None) -> DataFrame:
    """Inputs of aggregate families that no delete hides, with ``base``: whether they are their version's newest put.

    A delete hides only what was committed before it. Every timestamp is a version
    (a bucket) of its own; inputs older than the version's newest put are gone. What
    deletes and puts say of a version is gathered first and joined to the inputs,
    which are never sorted: a fold of them sums up before its shuffle, so a column
    that a third of all inputs go to is no single task.
    """
    version = [*COLUMN, "ts"]
    rows = cells.where(F.col("family").isin([f.name for f in families]))
    inputs = rows.where(F.col("kind").isin(PUT, MERGE) & ~_expiry(families, now))
    versions = inputs.select(*version).distinct()

    def deletes(kind: int, *key: str) -> DataFrame:
        return rows.where(F.col("kind") == kind).groupBy(*key, F.col("ts").alias("upto")).agg(F.max("seqno").alias("hidden"))

    none = F.lit(None).cast("struct<seqno:bigint,op:int>")
    said = deletes(CELL_DELETE, *COLUMN).select(*COLUMN, F.col("upto").alias("ts"), "hidden", none.alias("newest"))
    for kind, key in ((COLUMN_DELETE, COLUMN), (FAMILY_DELETE, ("row", "family"))):
        met = versions.join(deletes(kind, *key), list(key)).where(F.col("ts") <= F.col("upto"))
        said = said.unionByName(met.select(*version, "hidden", none.alias("newest")))
    puts = inputs.where(F.col("kind") == PUT).groupBy(*version).agg(F.max(_order()).alias("newest"))
    said = said.unionByName(puts.select(*version, F.lit(None).cast("bigint").alias("hidden"), "newest"))
    said = said.groupBy(*version).agg(F.max("hidden").alias("hidden"), F.max("newest").alias("newest"))
    out = inputs.join(said, version, "left").where((F.col("seqno") >= F.coalesce("hidden", F.lit(-1))) & (F.col("newest").isNull() | (_order() >= F.col("newest"))))
    return out.withColumn("base", F.col("kind") == PUT).drop("hidden", "newest")


#: Fold of an integer kind over value_i64.
FOLDS = {
    "sum": wrapped_sum,
    "min": F.min,
    "max": F.max,
    "bit_or": F.bit_or,
    "bit_and": F.bit_and,
    "bit_xor": F.bit_xor,
}


def integers(cells: DataFrame, families: list[Family], now: int | None = None) -> DataFrame:
    """Versions of integer aggregate families, in the columns of ``standard``."""
    inputs = live_inputs(cells, families, now)
    value = F.lit(None).cast("bigint")
    for kind in INTEGER_KINDS:
        names = [f.name for f in families if f.kind == kind]
        if names:
            value = F.when(F.first("family").isin(names), FOLDS[kind](F.col("value_i64"))).otherwise(value)
    out = inputs.groupBy(*COLUMN, "ts").agg(F.max("seqno").alias("seqno"), value.alias("value_i64"))
    none = {"value_type": F.lit("i64"), "value": F.lit(None).cast("binary"), "value_f64": F.lit(None).cast("double"), "value_vec": F.lit(None).cast("array<float>")}
    return out.withColumns(none).select(*COLUMN, "ts", "seqno", *VALUES)


def resolve(cells: DataFrame, families: list[Family], snapshot: int | None = None, now: int | None = None) -> DataFrame:
    """All versions of standard and integer families, before any selection."""
    cells = visible(cells, snapshot)
    plain = [f for f in families if not f.aggregate]
    folded = [f for f in families if f.kind in INTEGER_KINDS]
    other = [f.name for f in families if f.aggregate and f.kind not in INTEGER_KINDS]
    if other:
        raise ValueError(f"families {other} have readouts of their own in operators.aggregates")
    if plain and folded:
        return standard(cells, plain, now).unionByName(integers(cells, folded, now))
    return integers(cells, folded, now) if folded else standard(cells, plain, now)
