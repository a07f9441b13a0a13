"""Inverted-file vector index: k-means centroids, lists, and probing search.

Centroids are fitted on a bounded, documented sample (the first SAMPLE vectors by
id); every vector is then put in its nearest list. Members are written sorted by
list, neighbouring lists to a file, so a search reads little beyond those it probes
and there are no more files than the vectors fill.
"""

from __future__ import annotations

import uuid
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.tables import shared_root
from .vector import BLOCK_NUMBERS, _distances, _first, k_best, nearest, nearest_many

#: Vectors that centroids are fitted on, at most: the first by id.
SAMPLE = 50_000
#: Numbers in all centroids at most: they travel with each task.
MOST_NUMBERS = 1 << 23
TARGET, NPROBE, ROUNDS = 1000, 24, 10
#: Of true neighbours that a tuned search finds, and queries that it is tuned on.
RECALL, TUNED = 0.95, 256
#: Vectors placed, or queries whose lists are found, at once.
STEP, PROBED = 1024, 256
#: Neighbouring lists that are dealt to one task, when members are written and when queries meet them.
LISTS = 64


def _closest(vectors: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    """Number of each one's nearest centroid, of equally near ones the first; 0 where none has a distance."""
    out, step, numbers = np.zeros(len(vectors), int), max(1, min(STEP, BLOCK_NUMBERS // len(centroids))), np.arange(len(centroids))
    for i in range(0, len(vectors), step):
        at, own, _ = k_best(vectors[i : i + step], centroids, numbers, 1, metric)
        out[i + at] = own
    return out


def kmeans(vectors: np.ndarray, k: int, metric: str = "l2", rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from evenly spaced seeds; an empty cluster keeps its centroid; unit means under cosine."""
    centroids = vectors[np.arange(k) * len(vectors) // k].astype(float).copy()
    for _ in range(rounds):
        own = _closest(vectors, centroids, metric)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, vectors)
        n = np.bincount(own, minlength=k)
        new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
        if metric == "cosine":
            new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-30)
        if np.allclose(new, centroids, rtol=0, atol=0):
            break
        centroids = new
    return centroids


def _matrix(vec: pa.Array | pa.ChunkedArray) -> np.ndarray:
    own = vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec
    return own.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(own), -1)


def _placed(vectors: DataFrame, centroids: np.ndarray, metric: str) -> DataFrame:
    """``vectors`` (id, vec) with the number of the nearest centroid."""

    @F.pandas_udf("int")
    def place(vec: pd.Series) -> pd.Series:
        return pd.Series(_closest(np.stack(vec.to_numpy()).astype(float), centroids, metric) if len(vec) else [], dtype="int32")

    return vectors.select("id", "vec", place("vec").alias("list"))


class Ivf:
    """``members``: id, vec, list. Build once, search many times."""

    def __init__(self, centroids: np.ndarray, members: DataFrame, metric: str):
        self.centroids, self.members, self.metric = centroids, members, metric

    @classmethod
    def build(cls, vectors: DataFrame, metric: str = "l2", target: int = TARGET, sample: int = SAMPLE, path: str | None = None) -> Ivf:
        """``vectors``: id, vec. Members are written, sorted by list, to ``path`` or the shared folder.

        There are at most as many lists as sampled vectors, and MOST_NUMBERS numbers in
        all centroids: beyond that lists grow past ``target``.
        """
        spark: SparkSession = vectors.sparkSession
        rows = vectors.orderBy("id").limit(sample).select("vec").collect()
        fitted = np.array([x["vec"] for x in rows], float) if rows else np.zeros((1, 1))
        k = min(max(1, ceil(vectors.count() / target)), len(fitted), max(1, MOST_NUMBERS // fitted.shape[1]))
        centroids = kmeans(fitted, k, metric) if rows else fitted
        path = path or f"{shared_root(spark)}/cellweave-ivf-{uuid.uuid4().hex}"
        members = _placed(vectors, centroids, metric)
        members.repartition(F.floor(F.col("list") / LISTS)).sortWithinPartitions("list").write.parquet(path)
        return cls(centroids, spark.read.schema(members.schema).parquet(path), metric)

    def inserted(self, vectors: DataFrame) -> Ivf:
        """With ``vectors`` (id, vec) in their nearest lists; they replace those with their ids."""
        rest = self.deleted(vectors.select("id"))
        return Ivf(self.centroids, rest.members.unionByName(_placed(vectors, self.centroids, self.metric)), self.metric)

    def deleted(self, ids: DataFrame) -> Ivf:
        return Ivf(self.centroids, self.members.join(ids.select("id").distinct(), "id", "left_anti"), self.metric)

    def search_many(self, queries: DataFrame, k: int, nprobe: int = NPROBE) -> DataFrame:
        """``queries``: id, vec. query, id, distance of each query's k nearest in the lists it probes.

        A query goes once to each LISTS neighbouring lists of which it probes any, with
        the numbers of those, and meets their members there, as a matrix product for
        each list; LISTS lists together hand on the k best of each query.
        """
        centroids, metric = self.centroids, self.metric
        nprobe = min(nprobe, len(centroids))

        def probe(batches):
            for batch in batches:
                step = max(1, min(PROBED, BLOCK_NUMBERS // len(centroids)))
                for i in range(0, batch.num_rows, step):
                    part = batch.slice(i, step)
                    at, lists, _ = k_best(_matrix(part.column(1)), centroids, np.arange(len(centroids)), nprobe, metric)
                    order = np.lexsort((lists, at))
                    at, lists = at[order], lists[order].astype(np.int32)
                    first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(lists // LISTS, prepend=-1) != 0))
                    offsets = pa.array(np.append(first, len(at)).astype(np.int32))
                    own = part.take(pa.array(at[first]))
                    yield pa.RecordBatch.from_arrays([*own.columns, pa.array(lists[first] // LISTS), pa.ListArray.from_arrays(offsets, pa.array(lists))], ["query", "vec", "bundle", "lists"])

        def meet(asked: pa.Table, own: pa.Table) -> pa.Table:
            best = np.empty(0, int), np.empty(0, np.int64), np.empty(0)
            if asked.num_rows and own.num_rows:
                wanted, vec = asked["lists"].combine_chunks(), _matrix(asked["vec"])
                probed, place = wanted.flatten().to_numpy(), wanted.value_parent_indices().to_numpy()
                held, ids, members = own["list"].to_numpy(), own["id"].to_numpy(), _matrix(own["vec"])
                bound, more, n = np.full(len(vec), np.inf), [], 0
                for x in np.unique(held):
                    at, here = place[probed == x], held == x
                    step = max(1, BLOCK_NUMBERS // int(here.sum()))
                    for i in range(0, len(at), step):
                        rows = at[i : i + step]
                        query, near, d = k_best(vec[rows], members[here], ids[here], k, metric, bound[rows])
                        more.append((rows[query], near, d))
                        n += len(d)
                        if n > len(best[0]):
                            best = _first(*[np.concatenate(y) for y in zip(best, *more, strict=True)], k)
                            count = np.bincount(best[0], minlength=len(vec))
                            bound[count >= k] = best[2][np.cumsum(count)[count >= k] - 1]
                            more, n = [], 0
                if more:
                    best = _first(*[np.concatenate(y) for y in zip(best, *more, strict=True)], k)
            names = asked["query"].to_numpy()
            return pa.table([pa.array(names[best[0]], pa.int64()), pa.array(best[1], pa.int64()), pa.array(best[2], pa.float64())], ["query", "id", "distance"])

        kind = queries.schema["vec"].dataType.simpleString()
        asked = queries.select(F.col("id").cast("bigint"), "vec").mapInArrow(probe, f"query bigint, vec {kind}, bundle int, lists array<int>")
        own = self.members.select(F.floor(F.col("list") / LISTS).cast("int").alias("bundle"), "list", F.col("id").cast("bigint").alias("id"), "vec")
        met = asked.groupBy("bundle").cogroup(own.groupBy("bundle")).applyInArrow(meet, "query bigint, id bigint, distance double")
        rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))
        return met.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")

    def tuned(self, vectors: DataFrame, queries: DataFrame, k: int, recall: float = RECALL, sample: int = TUNED) -> int:
        """Lists to probe so that the first ``sample`` queries find ``recall`` of their true k nearest: those neighbours' lists are ranked by each query's distance to the centroids."""
        few = queries.orderBy("id").limit(sample)
        true = nearest_many(vectors, few, k, self.metric).select("query", "id").join(self.members.select("id", "list"), "id")
        lists = true.groupBy("query").agg(F.collect_list("list").alias("lists")).join(few.select(F.col("id").alias("query"), "vec"), "query").collect()
        needed = []
        for x in lists:
            rank = np.argsort(np.argsort(_distances(np.array([x["vec"]], float), self.centroids, self.metric)[0], kind="stable"))
            needed += [int(rank[i]) + 1 for i in x["lists"]]
        needed.sort()
        return needed[ceil(recall * len(needed)) - 1] if needed else 1

    def probes(self, query: list[float], nprobe: int) -> list[int]:
        d = _distances(np.array([query], float), self.centroids, self.metric)[0]
        return np.argsort(d, kind="stable")[:nprobe].tolist()

    def search(self, query: list[float], k: int, nprobe: int = NPROBE, keep=None, max_probe: int | None = None) -> DataFrame:
        """id and distance of the k nearest in the probed lists.

        ``keep``: a predicate on members; probes double until k of them fit, or
        ``max_probe`` lists (all, by default) are read.
        """
        most = min(max_probe or len(self.centroids), len(self.centroids))
        while True:
            own = self.members
            if min(nprobe, most) < len(self.centroids):
                own = own.where(F.col("list").isin(self.probes(query, min(nprobe, most))))
            if keep is not None:
                own = own.where(keep)
                if nprobe < most and own.limit(k).count() < k:
                    nprobe *= 2
                    continue
            rows = own.select(F.col("id").alias("row"), F.lit(b"").alias("qualifier"), F.col("vec").alias("value_vec"))
            return nearest(rows, query, k, self.metric).select(F.col("row").alias("id"), "distance")

    def verify(self, vectors: DataFrame) -> dict:
        """Vectors missing from the lists, members without a vector, members listed twice."""
        ids = self.members.select("id")
        return {"missing": vectors.join(ids, "id", "left_anti").count(), "stale": ids.join(vectors, "id", "left_anti").count(), "twice": ids.groupBy("id").count().where("count > 1").count()}

    def sizes(self) -> DataFrame:
        return self.members.groupBy("list").agg(F.count("*").alias("n"))

    def rebalanced(self, target: int = TARGET) -> Ivf:
        """Lists of over twice the target are split by 2-means, those under a quarter dropped; all vectors are placed anew."""
        sizes = {x["list"]: x["n"] for x in self.sizes().collect()}
        kept = []
        for i, c in enumerate(self.centroids):
            n = sizes.get(i, 0)
            if n > 2 * target:
                rows = self.members.where(F.col("list") == i).orderBy("id").limit(SAMPLE).select("vec").collect()
                kept += list(kmeans(np.array([x["vec"] for x in rows], float), 2, self.metric))
            elif n >= target / 4 or len(sizes) == 1:
                kept.append(c)
        centroids = np.array(kept or list(self.centroids))
        return Ivf(centroids, _placed(self.members, centroids, self.metric), self.metric)
