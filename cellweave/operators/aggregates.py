"""Aggregate families beyond integers, and their readouts.

All take live inputs (``resolve.live_inputs``) and group by the cell's coordinate
(row, family, qualifier, ts). Sketch states are small rows that the engine sums,
maximises or collects with partial aggregation; the last step, over one state a
group, runs on Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sketches as S
from ..functions.hashing import element_hash
from ..schema import COLUMN, Family
from .resolve import live_inputs

CELL = (*COLUMN, "ts")
CELL_SCHEMA = "row binary, family string, qualifier binary, ts bigint"
#: Elements of a readout request at most.
MOST_ASKED = 1024


def inputs(cells: DataFrame, families: list[Family], snapshot: int | None = None, now: int | None = None) -> DataFrame:
    from .resolve import visible

    return live_inputs(visible(cells, snapshot), families, now)


def extrema_f64(rows: DataFrame) -> DataFrame:
    """least, most: by total order, so -0.0 is below 0.0; NaN inputs are refused (skipped)."""
    own = rows.where(~F.isnan("value_f64"))
    # 0.0 and -0.0 are equal to the engine: the sign breaks ties.
    negative = F.when((F.col("value_f64") == 0) & F.col("value_f64").cast("string").startswith("-"), 0).otherwise(1)
    key = F.struct(F.col("value_f64").alias("v"), negative.alias("s"))
    return own.groupBy(*CELL).agg(F.min_by("value_f64", key).alias("least"), F.max_by("value_f64", key).alias("most"))


def _parts(rows: DataFrame, squares: bool) -> DataFrame:
    """Per cell and exponent: n, and exact integer sums of mantissas (and of their squares, in three parts)."""
    names = list(CELL)

    def run(batches):
        for batch in batches:
            m, e = S.float_parts(batch.column(len(names)).to_numpy(zero_copy_only=False))
            high, low = m >> 27, m & ((1 << 27) - 1)
            own = [pa.array(e, pa.int32()), pa.array(m, pa.int64())]
            if squares:
                own += [pa.array(x, pa.int64()) for x in (high * high, 2 * high * low, low * low)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *own], [*names, "e", "m", *["hh", "hl", "ll"] * squares])

    finite = rows.where(F.abs("value_f64") < float("inf")).select(*names, "value_f64")
    sums = ["m", *["hh", "hl", "ll"] * squares]
    each = finite.mapInArrow(run, f"{CELL_SCHEMA}, e int, " + ", ".join(f"{x} bigint" for x in sums))
    return each.groupBy(*names, "e").agg(F.count("*").alias("n"), *[F.sum(F.col(x).cast("decimal(38,0)")).alias(x) for x in sums])


def sum_f64(rows: DataFrame) -> DataFrame:
    """sum: of all finite inputs, exact, rounded once."""
    state = _parts(rows, False).groupBy(*CELL).agg(F.collect_list(F.struct("e", F.col("m").cast("string").alias("m"))).alias("parts"))

    @F.pandas_udf("double")
    def total(parts: pd.Series) -> pd.Series:
        def one(own) -> float:
            least = min(x["e"] for x in own)
            top = sum(int(x["m"]) << (x["e"] - least) for x in own)
            return S.exact_ratio(top << max(least, 0), 1 << max(-least, 0))

        return parts.map(one)

    return state.select(*CELL, total("parts").alias("sum"))


def mean_var(rows: DataFrame) -> DataFrame:
    """n, mean, var_pop, var_samp: each exact, then rounded once."""
    text = [F.col(x).cast("string").alias(x) for x in ("m", "hh", "hl", "ll")]
    state = _parts(rows, True).groupBy(*CELL).agg(F.sum("n").alias("n"), F.collect_list(F.struct("e", *text)).alias("parts"))

    @F.pandas_udf("mean double, var_pop double, var_samp double")
    def moments(n: pd.Series, parts: pd.Series) -> pd.DataFrame:
        out = []
        for count, own in zip(n.tolist(), parts, strict=True):
            least = min(x["e"] for x in own)
            s = sum(int(x["m"]) << (x["e"] - least) for x in own)
            squares = sum(((int(x["hh"]) << 54) + (int(x["hl"]) << 27) + int(x["ll"])) << 2 * (x["e"] - least) for x in own)
            spread = count * squares - s * s
            up, down = 1 << max(least, 0), 1 << max(-least, 0)
            var = [S.exact_ratio(spread * up * up, k * down * down) if k else None for k in (count * count, count * (count - 1))]
            out.append((S.exact_ratio(s * up, count * down), *var))
        return pd.DataFrame(out, columns=["mean", "var_pop", "var_samp"])

    return state.withColumn("o", moments("n", "parts")).select(*CELL, "n", "o.mean", "o.var_pop", "o.var_samp")


def histogram(rows: DataFrame, bounds: list[float]) -> DataFrame:
    """counts: inputs below the first bound, from each bound up to the next, and from the last on; NaN is refused."""
    if not 1 <= len(bounds) <= 1023 or sorted(set(bounds)) != list(bounds):
        raise ValueError("a histogram takes 1 to 1023 increasing bounds")
    bucket = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= F.col("value_f64")))
    each = rows.where(~F.isnan("value_f64")).groupBy(*CELL, bucket.alias("bucket")).agg(F.count("*").alias("n"))
    found = each.groupBy(*CELL).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("n"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(len(bounds))), lambda i: F.coalesce(F.element_at("n", i), F.lit(0)))
    return found.select(*CELL, counts.alias("counts"))


def hll(rows: DataFrame, element: Column | None = None) -> DataFrame:
    """estimate: distinct elements (value_i64, or the bytes of ``value``), by 4096 registers."""
    names = list(CELL)

    def run(batches):
        for batch in batches:
            numbers, raw = (batch.column(len(names) + i).to_pylist() for i in (0, 1))
            found = [S.register(element_hash(b if i is None else i)) for i, b in zip(numbers, raw, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.int32())], [*names, "register", "rank"])

    # Each element once: repeats change nothing, and Python sees fewer.
    distinct = rows.select(*names, "value_i64", "value").distinct()
    registers = distinct.mapInArrow(run, f"{CELL_SCHEMA}, register int, rank int").groupBy(*names, "register").agg(F.max("rank").alias("rank"))
    ranks = registers.groupBy(*names, "rank").agg(F.count("*").alias("n")).groupBy(*names).agg(F.collect_list(F.struct("rank", "n")).alias("ranks"))

    @F.pandas_udf("bigint")
    def estimate(ranks: pd.Series) -> pd.Series:
        return ranks.map(lambda own: S.hll_estimate({x["rank"]: x["n"] for x in own}))

    return ranks.select(*names, estimate("ranks").alias("estimate"))


def quantiles(rows: DataFrame, asked: list[float], bits: int = S.MANTISSA_BITS, max_buckets: int = S.MAX_BUCKETS) -> DataFrame:
    """n, and values: the asked quantiles, each the midpoint of the bucket that holds rank floor(q (n - 1)); finite inputs only."""
    if not 1 <= bits <= 12 or len(asked) > MOST_ASKED:
        raise ValueError("a quantile sketch takes 1 to 12 mantissa bits, a readout 1024 quantiles")
    names = list(CELL)

    def run(batches):
        for batch in batches:
            x = batch.column(len(names)).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(np.sign(x).astype(np.int32)), pa.array(np.where(x == 0, 0, S.quantile_index(x, bits)))], [*names, "sign", "index"])

    finite = rows.where(F.abs("value_f64") < float("inf")).select(*names, "value_f64")
    counts = finite.mapInArrow(run, f"{CELL_SCHEMA}, sign int, index bigint").groupBy(*names, "sign", "index").agg(F.count("*").alias("n"))
    # A store spans MAX_BUCKETS indexes once collapsed: a state of bounded size.
    top = counts.groupBy(*names, "sign").agg(F.max("index").alias("top"))
    kept = counts.join(top, [*names, "sign"]).groupBy(*names, "sign", F.greatest("index", F.col("top") - (max_buckets - 1)).alias("index")).agg(F.sum("n").alias("n"))
    state = kept.groupBy(*names).agg(F.sum("n").alias("n"), F.collect_list(F.struct("sign", "index", F.col("n").alias("c"))).alias("buckets"))

    @F.pandas_udf("array<double>")
    def read(buckets: pd.Series) -> pd.Series:
        def one(own):
            by = {-1: {}, 0: {}, 1: {}}
            for x in own:
                by[x["sign"]][x["index"]] = x["c"]
            return [S.quantile_of(by[-1], sum(by[0].values()), by[1], q, bits) for q in asked]

        return buckets.map(one)

    return state.select(*names, "n", read("buckets").alias("values"))


def bloom(rows: DataFrame, log2_bits: int = 10, hashes: int = 4) -> DataFrame:
    """bits: the set positions, in order."""
    if not 6 <= log2_bits <= 24 or not 1 <= hashes <= 16:
        raise ValueError("a bloom filter takes 2^6 to 2^24 bits and 1 to 16 hashes")
    names = list(CELL)

    def run(batches):
        for batch in batches:
            numbers, raw = (batch.column(len(names) + i).to_pylist() for i in (0, 1))
            found = [S.bloom_positions(element_hash(b if i is None else i), log2_bits, hashes) for i, b in zip(numbers, raw, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(found, pa.list_(pa.int32()))], [*names, "positions"])

    distinct = rows.select(*names, "value_i64", "value").distinct()
    each = distinct.mapInArrow(run, f"{CELL_SCHEMA}, positions array<int>").select(*names, F.explode("positions").alias("bit"))
    return each.groupBy(*names).agg(F.array_sort(F.collect_set("bit")).alias("bits"))


def bloom_contains(element: int | bytes, log2_bits: int = 10, hashes: int = 4) -> Column:
    """Over ``bits``: False means certainly not."""
    out = F.lit(True)
    for p in S.bloom_positions(element_hash(element), log2_bits, hashes):
        out = out & F.array_contains("bits", p)
    return out


def bloom_fill(log2_bits: int = 10) -> Column:
    return F.size("bits") / F.lit(float(1 << log2_bits))


def set_ops(rows: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """members: ``rows`` has CELL, element, added (add or remove), seqno, op; ``base``: CELL, element, seqno of a put's members.

    An element's last operation decides. A put drops everything older and adds its
    members.
    """
    if base is not None:
        start = base.groupBy(*CELL).agg(F.max("seqno").alias("from"))
        puts = base.join(start, list(CELL)).where(F.col("seqno") == F.col("from")).select(*CELL, "element", F.lit(True).alias("added"), "seqno", F.lit(-1).alias("op"))
        newer = rows.join(start, list(CELL), "left").where(F.col("from").isNull() | (F.col("seqno") > F.col("from")))
        rows = newer.select(*CELL, "element", "added", "seqno", "op").unionByName(puts)
    last = rows.groupBy(*CELL, "element").agg(F.max_by("added", F.struct("seqno", "op")).alias("added"))
    return last.where("added").groupBy(*CELL).agg(F.array_sort(F.collect_set("element")).alias("members"))


def sets(rows: DataFrame) -> DataFrame:
    """members of set families from live inputs: operands of type set_add and set_remove in commit order."""
    ops = rows.where(F.col("value_type").isin("set_add", "set_remove"))
    return set_ops(ops.select(*CELL, F.col("value_i64").alias("element"), (F.col("value_type") == "set_add").alias("added"), "seqno", "op"))


def set_algebra(a: Column, b: Column) -> dict[str, Column]:
    """The readouts of two member arrays."""
    both, union = F.array_intersect(a, b), F.array_union(a, b)
    return {"intersection": F.array_sort(both), "union": F.array_sort(union), "difference": F.array_sort(F.array_except(a, b)), "intersection_len": F.size(both), "union_len": F.size(union)}


class MergeOperators:
    """Registered user folds: name to f(base bytes or None, operands oldest first) -> bytes."""

    def __init__(self):
        self._by: dict = {}

    def register(self, name: str, fold) -> None:
        self._by[name] = fold

    def fold(self, rows: DataFrame, name: str) -> DataFrame:
        """value: of each cell, from its live inputs in commit order. Unknown names raise."""
        if name not in self._by:
            raise KeyError(f"unknown merge operator {name}")
        own = self._by[name]
        listed = rows.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("seqno", "op", "base", "value"))).alias("inputs"))

        @F.pandas_udf("binary")
        def run(inputs: pd.Series) -> pd.Series:
            def one(parts):
                base = next((x["value"] for x in parts if x["base"]), None)
                return own(base, [x["value"] for x in parts if not x["base"]])

            return inputs.map(one)

        return listed.select(*CELL, run("inputs").alias("value"))


def concat_fold(separator: bytes):
    """A merge operator that joins operands."""
    return lambda base, operands: separator.join(([] if base is None else [base]) + operands)
