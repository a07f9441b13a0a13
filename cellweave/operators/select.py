"""The selection algebra: which rows, families, columns, versions and bytes a read returns.

A ``Read`` is a value object; ``select`` turns it into one DataFrame. Row and
qualifier bounds are predicates on the log, and so reach the Parquet scan; time
range, version counts and value predicates come after resolution, as their
meaning asks for.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import COLUMN, Family
from .resolve import resolve, visible

CELL_OVERHEAD = 16


def successor(prefix: bytes) -> bytes | None:
    """The first key after all keys that start with ``prefix``; None: there is none."""
    trimmed = prefix.rstrip(b"\xff")
    return trimmed[:-1] + bytes([trimmed[-1] + 1]) if trimmed else None


@dataclass(frozen=True)
class Bounds:
    """An interval of keys; None: open end. An inverted one is empty."""

    low: bytes | None = None
    high: bytes | None = None
    low_open: bool = False
    high_open: bool = True

    @classmethod
    def prefix(cls, prefix: bytes) -> Bounds:
        return cls(prefix, successor(prefix))

    @classmethod
    def one(cls, key: bytes) -> Bounds:
        return cls(key, key, high_open=False)

    def test(self, column: Column) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & (column > F.lit(self.low) if self.low_open else column >= F.lit(self.low))
        if self.high is not None:
            out = out & (column < F.lit(self.high) if self.high_open else column <= F.lit(self.high))
        return out


@dataclass(frozen=True)
class ValueFilter:
    """op: equals or prefix (bytes), range (a pair of bytes, the second not included), or one of < <= = >= > (i64)."""

    op: str
    operand: bytes | int | tuple[bytes, bytes]

    def test(self) -> Column:
        if self.op == "equals":
            return F.col("value") == F.lit(self.operand)
        if self.op == "range":
            return Bounds(*self.operand).test(F.col("value"))
        if self.op == "prefix":
            return Bounds.prefix(self.operand).test(F.col("value"))
        value = F.when(F.col("value_type").isin("i64", "varint"), F.col("value_i64"))
        tests = {"<": value < self.operand, "<=": value <= self.operand, "=": value == self.operand, ">=": value >= self.operand, ">": value > self.operand}
        return tests[self.op]


@dataclass(frozen=True)
class Read:
    """``versions`` 0: all. ``families`` None: all, in their own order; else those, in the order given."""

    rows: Bounds = Bounds()
    families: tuple[str, ...] | None = None
    qualifiers: Bounds = Bounds()
    versions: int = 1
    time_range: tuple[int | None, int | None] | None = None
    value_filter: ValueFilter | None = None
    column_limit: int | None = None
    limit: int | None = None
    snapshot: int | None = None
    now: int | None = None

    def but(self, **changes) -> Read:
        return replace(self, **changes)


def chosen(families: list[Family], read: Read) -> list[Family]:
    by = {f.name: f for f in families}
    if read.families is None:
        return families
    unknown = [x for x in read.families if x not in by]
    if unknown:
        raise ValueError(f"no such family: {unknown}")
    return [by[x] for x in read.families]


def family_order(families: list[Family]) -> Column:
    return F.array_position(F.array(*[F.lit(f.name) for f in families]), F.col("family")).cast("int")


def narrowed(cells: DataFrame, families: list[Family], read: Read) -> DataFrame:
    """Log entries that can matter to the read: family markers have no qualifier and stay."""
    names = [f.name for f in families]
    out = visible(cells, read.snapshot).where(F.col("family").isin(names) & read.rows.test(F.col("row")))
    if read.qualifiers != Bounds():
        out = out.where(F.col("qualifier").isNull() | read.qualifiers.test(F.col("qualifier")))
    return out


def select(cells: DataFrame, families: list[Family], read: Read = Read()) -> DataFrame:
    """The read's cells, one row each, with ``fam`` (the family's place). Unordered; see ``ordered``."""
    own = chosen(families, read)
    out = resolve(narrowed(cells, own, read), own, now=read.now)
    if read.time_range is not None:
        low, high = read.time_range
        if low is not None:
            out = out.where(F.col("ts") >= low)
        if high is not None:
            out = out.where(F.col("ts") < high)
    newest = Window.partitionBy(*COLUMN).orderBy(F.desc("ts"))
    cap = F.lit(read.versions or None).cast("int")
    for f in own:
        if f.max_versions:
            cap = F.when(F.col("family") == f.name, F.lit(min(read.versions or f.max_versions, f.max_versions))).otherwise(cap)
    capped = read.versions or any(f.max_versions for f in own)
    if capped or read.value_filter:
        out = out.withColumn("version", F.row_number().over(newest))
        if read.value_filter:
            passed = F.max(F.when(F.col("version") == 1, read.value_filter.test())).over(Window.partitionBy(*COLUMN))
            out = out.withColumn("passed", passed).where("passed").drop("passed")
        if capped:
            out = out.where(cap.isNull() | (F.col("version") <= cap)) if any(f.max_versions for f in own) or not read.versions else out.where(F.col("version") <= read.versions)
        out = out.drop("version")
    if read.column_limit is not None:
        column = F.dense_rank().over(Window.partitionBy("row", "family").orderBy("qualifier"))
        out = out.withColumn("column", column).where(F.col("column") <= read.column_limit).drop("column")
    if read.limit is not None:
        first = out.select("row").distinct().orderBy("row").limit(read.limit)
        out = out.join(first, "row", "left_semi")
    return out.withColumn("fam", family_order(own))


def ordered(selected: DataFrame) -> DataFrame:
    """Natural order: row, family, qualifier, newest version first."""
    return selected.orderBy("row", "fam", "qualifier", F.desc("ts"))


def key_set(spark, keys: list[bytes]) -> DataFrame:
    """Distinct keys in order, with their index."""
    rows = [(i, k) for i, k in enumerate(sorted(set(keys)))]
    return spark.createDataFrame(rows, "index bigint, row binary")


def multi_get(cells: DataFrame, families: list[Family], keys: DataFrame, read: Read = Read()) -> DataFrame:
    """Cells of the rows in ``keys`` (row, index), with the index. Keys without cells give none.

    The join comes before resolution, so other rows never reach a shuffle when the
    keys are few; how it is done is left to the sizes that the optimizer sees.
    """
    own = cells.join(keys.select("row").distinct(), "row", "left_semi")
    return select(own, families, read).join(keys, "row")


def after(selected: DataFrame, row: bytes, fam: int | None = None, qualifier: bytes | None = None) -> DataFrame:
    """What follows a position: a row, or a column of one (keyset pagination)."""
    if fam is None:
        return selected.where(F.col("row") > F.lit(row))
    at = F.struct(F.lit(row).alias("row"), F.lit(fam).alias("fam"), F.lit(qualifier).alias("qualifier"))
    # The first test, which the second implies, reaches the scan.
    return selected.where((F.col("row") >= F.lit(row)) & (F.struct("row", "fam", "qualifier") > at))


def cell_bytes() -> Column:
    """A cell's share of a byte budget, without its row's key."""
    fixed = F.when(F.col("value_type").isin("i64", "f64"), 8).when(F.col("value_type") == "varint", 8)
    return F.length("qualifier") + F.coalesce(fixed, F.length("value"), 4 * F.size("value_vec"), F.lit(0)) + CELL_OVERHEAD


def within(selected: DataFrame, budget: int) -> DataFrame:
    """The longest prefix of whole columns that fits ``budget`` bytes; a row's key counts once.

    Sizes add up in two steps, so that no task holds all columns: per row first,
    then within rows from the place where each one starts.
    """
    columns = selected.groupBy("row", "fam", "qualifier").agg(F.sum(cell_bytes()).alias("size"))
    rows = columns.groupBy("row").agg((F.sum("size") + F.length("row")).alias("row_size"))
    starts = running(rows, "row", "row_size", "row_start").where(F.col("row_start") < budget)
    inside = Window.partitionBy("row").orderBy("fam", "qualifier").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("row_start") + F.length("row") + F.sum("size").over(inside)
    kept = columns.join(starts.select("row", "row_start"), "row").withColumn("end", end).where(F.col("end") <= budget)
    return selected.join(kept.select("row", "fam", "qualifier"), ["row", "fam", "qualifier"], "left_semi")


def running(df: DataFrame, key: str, size: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``size`` over all smaller keys, by range partitions and their totals."""
    parts = df.repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id())
    totals = parts.groupBy("part").agg(F.sum(size).alias("total"))
    # One row for each partition.
    base = totals.withColumn("base", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = Window.partitionBy("part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    out = parts.withColumn("own", F.coalesce(F.sum(size).over(own), F.lit(0)))
    return out.join(F.broadcast(base.select("part", "base")), "part").withColumn(name, F.col("base") + F.col("own")).drop("part", "own", "base")


def row_pages(selected: DataFrame, most: int) -> DataFrame:
    """``selected`` with ``page`` per row: pages of at most ``most`` cells that end with whole columns (a larger column has its own).

    A page's end hangs on the one before it, so a row's column sizes, and nothing
    else, are folded in order.
    """
    sizes = selected.groupBy("row", "fam", "qualifier").agg(F.count("*").cast("int").alias("n"))
    listed = sizes.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("fam", "qualifier", "n"))).alias("columns"))
    start = F.struct(F.lit(0).alias("page"), F.lit(0).alias("held"), F.array().cast("array<int>").alias("pages"))

    def step(a, c):
        full = (a["held"] > 0) & (a["held"] + c["n"] > most)
        page = F.when(full, a["page"] + 1).otherwise(a["page"])
        return F.struct(page.alias("page"), F.when(full, c["n"]).otherwise(a["held"] + c["n"]).alias("held"), F.concat(a["pages"], F.array(page)).alias("pages"))

    paged = listed.withColumn("pages", F.aggregate("columns", start, step)["pages"])
    each = paged.select("row", F.inline(F.arrays_zip(F.col("columns.fam").alias("fam"), F.col("columns.qualifier").alias("qualifier"), F.col("pages").alias("page"))))
    return selected.join(each, ["row", "fam", "qualifier"])
