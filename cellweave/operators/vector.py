"""Exact vector search: distances as column expressions or blocked matrix products.

One query: the distance is an expression over the array column and the k nearest
come from the engine's own top-k, which keeps k rows a partition. Many queries:
vectors stream past the (bounded) query block in Arrow batches and every partition
hands on only its k best for each query.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("l2", "ip", "cosine", "hamming")
#: Queries of one block of a batch search: their vectors travel with each task.
MOST_QUERIES = 65_536
#: Numbers of a block of differences, and distances of a block of queries and vectors.
BLOCK_NUMBERS = 1 << 22


def distance(vector: Column, query: list[float], metric: str) -> Column:
    """Smaller is nearer: squared L2, negated inner product, 1 - cosine (null for zero vectors). Doubles throughout."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    if metric == "l2":
        return F.aggregate(F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    if metric == "ip":
        return -dot
    if metric == "cosine":
        norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
        return 1 - F.try_divide(dot, norm * float(np.sqrt(np.square(np.array(query, float)).sum())))
    raise ValueError(f"metric {metric} isn't one of {METRICS}")


def sign_bits(vector: Column) -> Column:
    """A bit for each component, set where it is positive, as longs of 64 bits."""
    def word(i):
        part = F.slice(vector, i * 64 + 1, 64)
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda s, x: F.shiftleft(s, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("bigint")))

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(vector) - 1) / 64).cast("int")), word)


def hamming(bits: Column, query: list[int]) -> Column:
    q = F.array(*[F.lit(x).cast("bigint") for x in query])
    return F.aggregate(F.zip_with(bits, q, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)


def nearest(selected: DataFrame, query: list[float], k: int, metric: str = "l2") -> DataFrame:
    """row, qualifier, distance of the k nearest, by (distance, row, qualifier); other shapes, NaN and zero norms are skipped."""
    fits = selected.where(F.size("value_vec") == len(query))
    found = fits.select("row", "qualifier", distance(F.col("value_vec"), query, metric).alias("distance"))
    return found.where(F.col("distance").isNotNull() & ~F.isnan("distance")).orderBy("distance", "row", "qualifier").limit(k)


def nearest_bits(selected: DataFrame, query: list[float], k: int) -> DataFrame:
    """Like ``nearest`` by the Hamming distance of sign bits."""
    words = [sum(1 << (len(query[i : i + 64]) - 1 - j) for j, x in enumerate(query[i : i + 64]) if x > 0) for i in range(0, len(query), 64)]
    words = [w - (1 << 64) if w >> 63 else w for w in words]
    fits = selected.where(F.size("value_vec") == len(query))
    found = fits.select("row", "qualifier", hamming(sign_bits(F.col("value_vec")), words).alias("distance"))
    return found.orderBy("distance", "row", "qualifier").limit(k)


def nearest_within(found: DataFrame, budget: int) -> DataFrame:
    """The first of ``found`` (a nearest search's k rows at most) whose keys, and 16 bytes each, fit ``budget``."""
    order = Window.orderBy("distance", "row", "qualifier").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = F.sum(F.length("row") + F.length("qualifier") + 16).over(order)
    return found.withColumn("spent", spent).where(F.col("spent") <= budget).drop("spent")


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """``vectors``, ``queries``: id, vec. query, id, distance of each query's k nearest, by (distance, id).

    Queries go against all rows in blocks of MOST_QUERIES: no pairs are made beyond
    the k best of each partition.
    """
    rest = queries.orderBy("id").toLocalIterator()
    found = _nearest_block(vectors, list(islice(rest, MOST_QUERIES)), k, metric)
    while block := list(islice(rest, MOST_QUERIES)):
        found = found.union(_nearest_block(vectors, block, k, metric))
    order = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest_block(vectors: DataFrame, listed: list, k: int, metric: str) -> DataFrame:
    names = [x["id"] for x in listed]
    block = np.array([x["vec"] for x in listed], float).reshape(len(listed), -1)

    def run(batches):
        best = np.empty(0, int), np.empty(0, np.int64), np.empty(0)
        bound = np.full(len(names), np.inf)
        for batch in batches:
            if not batch.num_rows or not names:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vec = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
            step = max(1, min(4096, BLOCK_NUMBERS // len(names)))
            for at in range(0, len(ids), step):
                more = k_best(block, vec[at : at + step], ids[at : at + step], k, metric, bound)
                if len(more[0]):
                    best = _first(*[np.concatenate(x) for x in zip(best, more, strict=True)], k)
                    n = np.bincount(best[0], minlength=len(names))
                    full = n >= k
                    bound[full] = best[2][np.cumsum(n)[full] - 1]
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(np.array(names)[best[0]], pa.int64()), pa.array(best[1], pa.int64()), pa.array(best[2])], ["query", "id", "distance"])

    return vectors.select(F.col("id").cast("bigint"), "vec").mapInArrow(run, "query bigint, id bigint, distance double")


def _distances(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    dot = queries @ vectors.T
    if metric == "ip":
        return -dot
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1 - dot / (np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(vectors, axis=1)[None, :])
    # Squared differences, not the expanded square: close vectors keep their digits.
    step = max(1, BLOCK_NUMBERS // max(1, vectors.size))
    return np.concatenate([np.square(queries[i : i + step, None, :] - vectors[None]).sum(axis=2) for i in range(0, len(queries), step)]) if len(queries) else dot


def _first(query: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``k`` of each query by (distance, id), in that order."""
    order = np.lexsort((ids, d, query))
    query, ids, d = query[order], ids[order], d[order]
    kept = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[kept], ids[kept], d[kept]


def k_best(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, metric: str, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of the query, id, distance of each query's ``k`` nearest by (distance, id), as ``_distances`` has them; NaN left out.

    ``bound``: of each query, a distance beyond which none is wanted. One matrix product
    tells, within its proven error, which vectors can be among the k; only their
    distances are taken in full.
    """
    if metric == "l2":
        own, other = np.einsum("ij,ij->i", queries, queries), np.einsum("ij,ij->i", vectors, vectors)
        with np.errstate(invalid="ignore", over="ignore"):
            rough = other[None, :] - 2 * (queries @ vectors.T)
            # Twice the error of a sum of products, on either side.
            slack = 8 * (queries.shape[1] + 8) * np.finfo(float).eps * (own + np.nanmax(other, initial=0))
    else:
        rough, own, slack = _distances(queries, vectors, metric), 0.0, 0.0
    np.nan_to_num(rough, copy=False, nan=np.inf, posinf=np.inf, neginf=-np.inf)
    limit = np.full(len(queries), np.inf) if bound is None else bound - own
    free = np.isinf(limit)
    if k < len(vectors) and free.any():
        left = rough if free.all() else rough[free]
        limit[free] = left.min(axis=1) if k == 1 else np.partition(left, k - 1, axis=1)[:, k - 1]
    i, j = np.nonzero(rough <= (limit + slack)[:, None])
    if metric == "l2":
        step = max(1, BLOCK_NUMBERS // max(1, queries.shape[1]))
        parts = [np.square(queries[i[x : x + step]] - vectors[j[x : x + step]]).sum(axis=1) for x in range(0, len(i), step)]
        d = np.concatenate(parts) if parts else np.empty(0)
    else:
        d = rough[i, j]
        d = np.where(np.isinf(d), np.nan, d)
    ok = ~np.isnan(d)
    return _first(i[ok], ids[j[ok]], d[ok], k)


def to_half(values: np.ndarray) -> np.ndarray:
    """Round to nearest even to 16 bits; values beyond the format are refused."""
    out = np.asarray(values, np.float32).astype(np.float16)
    if np.isinf(out).any() and not np.isinf(values).any():
        raise OverflowError("beyond half precision")
    return out.astype(np.float32)


def to_bfloat(values: np.ndarray) -> np.ndarray:
    """Round to nearest even to bfloat16; values beyond the format are refused."""
    raw = np.asarray(values, np.float32).view(np.uint32).astype(np.uint64)
    out = ((raw + 0x7FFF + ((raw >> 16) & 1)) & 0xFFFF0000).astype(np.uint32).view(np.float32)
    if np.isinf(out).any() and not np.isinf(values).any():
        raise OverflowError("beyond bfloat16")
    return out
