"""Agent memories: hybrid recall, deduplication, forgetting, consolidation.

Memories are one table: ns, id, created (us), kind, text, embedding (array of
float), importance, uses, last_used (us), session, superseded, consolidated,
pinned. Links are another: ns, src, dst, weight. Recall gathers the best of each
signal per namespace, fuses the candidates' ranks, and may walk links from the
best; each step is a keyed aggregation or a window over candidates alone.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import acos, ceil, log, log2, pi

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import squeezed
from ..plans.tables import cut_lineage
from .select import running
from .text import Index
from .vector import distance

SIGNALS = ("vector", "keyword", "recency", "importance", "uses", "graph")
WEIGHTS = (1.0, 1.0, 0.25, 1.0, 1.0, 0.5)
RRF = 60.0
WEEK_US = 7 * 86_400_000_000
CANDIDATES = 50
CONSOLIDATED = 0.5
#: Unlike vectors of a bucket in near_duplicates, about, and the chance that it misses a pair.
BUCKET, MISSED = 256, 0.001
#: Vectors of a part of a larger bucket: a task compares two parts at most. Vectors compared at once, and what products may be off.
PART, STEP, CLOSE = 4096, 512, 1e-9
GRAPH_SEEDS, GRAPH_MOST, GRAPH_HOPS = 10, 20, 4
HIT_BYTES, SIGNAL_BYTES = 16, 48
COLUMNS = {
    "ns": "string", "id": "bigint", "created": "bigint", "kind": "string", "text": "string", "embedding": "array<float>", "importance": "double", "uses": "bigint",
    "last_used": "bigint", "session": "string", "superseded": "boolean", "consolidated": "boolean", "pinned": "boolean",
}
DEFAULTS = {"kind": "episodic", "importance": 0.0, "uses": 0, "superseded": False, "consolidated": False, "pinned": False}


def memories(df: DataFrame, **columns) -> DataFrame:
    """``df`` as memories: keywords give columns, the others their defaults."""
    return df.select(*[columns.get(k, F.lit(DEFAULTS.get(k))).cast(t).alias(k) for k, t in COLUMNS.items()])


@dataclass(frozen=True)
class Recall:
    namespaces: tuple[str, ...]
    now: int
    text: str | None = None
    embedding: tuple[float, ...] | None = None
    k: int = 10
    candidates: int = CANDIDATES
    weights: tuple[float, ...] = WEIGHTS
    fusion: str = "rrf"
    half_life: int = WEEK_US
    session: str | None = None
    include_superseded: bool = False
    byte_budget: int | None = None
    with_signals: bool = False
    expand_hops: int = 0
    expand_most: int = GRAPH_MOST
    #: cosine or another metric of operators.vector.
    metric: str = "cosine"


def eligible(rows: DataFrame, recall: Recall) -> DataFrame:
    out = rows.where(F.col("ns").isin(list(recall.namespaces)) & F.col("text").isNotNull())
    if not recall.include_superseded:
        out = out.where(~F.col("superseded"))
    return out if recall.session is None else out.where(F.col("session") == recall.session)


def _best(rows: DataFrame, order: list, recall: Recall) -> DataFrame:
    """ns, id of each namespace's first: the engine's top-k, which keeps that many a partition."""
    parts = [rows.where(F.col("ns") == ns).orderBy(*order).limit(recall.candidates).select("ns", "id") for ns in recall.namespaces]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def keyword_scores(rows: DataFrame, recall: Recall, indexes: dict[str, Index] | None = None) -> DataFrame:
    """ns, id, keyword: BM25 inside each namespace."""
    parts = []
    for ns in recall.namespaces:
        own = rows.where(F.col("ns") == ns)
        index = (indexes or {}).get(ns) or Index.build(own, "id", "text")
        parts.append(index.scores(recall.text).groupBy("id").agg(F.sum("score").alias("keyword")).select(F.lit(ns).alias("ns"), "id", "keyword"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def with_signals(rows: DataFrame, recall: Recall, keyword: DataFrame | None) -> DataFrame:
    """``rows`` with each signal, null where it has none."""
    age = (F.lit(recall.now) - F.col("created")).cast("double")
    since = F.coalesce(F.lit(recall.now) - F.col("last_used"), age).cast("double")
    shaped = F.size("embedding") == len(recall.embedding or ())
    vector = F.when(shaped, 1 - distance(F.col("embedding"), list(recall.embedding), recall.metric)) if recall.embedding else F.lit(None).cast("double")
    out = rows.withColumns({
        "vector": vector,
        "recency": F.exp(-age / recall.half_life),
        "importance_signal": F.col("importance") * F.when(F.col("consolidated"), CONSOLIDATED).otherwise(1.0),
        "uses_signal": F.when(F.col("uses") > 0, F.log1p(F.col("uses").cast("double")) * F.exp(-since / recall.half_life)),
        "graph": F.lit(None).cast("double"),
    })
    if keyword is None:
        return out.withColumn("keyword", F.lit(None).cast("double"))
    return out.join(keyword, ["ns", "id"], "left")


def candidates(rows: DataFrame, recall: Recall, indexes: dict[str, Index] | None = None) -> DataFrame:
    """Union of the best by vector, keyword and age of each namespace, with all signals."""
    own = eligible(rows, recall)
    keyword = cut_lineage(keyword_scores(own, recall, indexes)) if recall.text else None
    # Ids and one figure each; texts and vectors are read for the candidates alone.
    lists = [_best(own, [F.desc("created"), "id"], recall)]
    if recall.embedding:
        near = with_signals(own, recall, None).select("ns", "id", "vector").where("vector is not null and not isnan(vector)")
        lists.append(_best(near, [F.desc("vector"), "id"], recall))
    if keyword is not None:
        held = keyword.join(own.select("ns", "id"), ["ns", "id"], "left_semi").where("keyword is not null")
        lists.append(_best(held, [F.desc("keyword"), "id"], recall))
    ids = lists[0]
    for x in lists[1:]:
        ids = ids.union(x)
    found = own.join(cut_lineage(ids.distinct()), ["ns", "id"], "left_semi")
    return with_signals(found, recall, keyword)


def _signal(name: str):
    return F.col({"importance": "importance_signal", "uses": "uses_signal"}.get(name, name))


def fuse(found: DataFrame, recall: Recall) -> DataFrame:
    """``found`` with score: of competition ranks, w / (60 + rank), or of min-max scaled values (all equal: 1).

    Candidates are a bounded list: a few CANDIDATES for each namespace.
    """
    total = F.lit(0.0)
    for name, weight in zip(SIGNALS, recall.weights, strict=True):
        value, has = _signal(name), _signal(name).isNotNull()
        if recall.fusion == "rrf":
            rank = F.rank().over(Window.partitionBy(has).orderBy(value.desc()))
            part = F.lit(weight) / (F.lit(RRF) + rank)
        else:
            low, high = F.min(value).over(Window.partitionBy(F.lit(1))), F.max(value).over(Window.partitionBy(F.lit(1)))
            part = F.lit(weight) * F.when(high > low, (value - low) / (high - low)).otherwise(1.0)
        total = total + F.when(has, part).otherwise(0.0)
    return found.withColumn("score", total)


def expand(found: DataFrame, rows: DataFrame, links: DataFrame, recall: Recall, indexes: dict[str, Index] | None = None) -> DataFrame:
    """``found`` and what links lead to, with graph values: the best seed's 1 / place times the weights on a shortest way."""
    fused = fuse(found, recall)
    top = fused.orderBy(F.desc("score"), "id").limit(GRAPH_SEEDS)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "id"))
    frontier = cut_lineage(top.select("ns", "id", (1 / place).alias("value")))
    both = links.select("ns", "src", "dst", "weight").union(links.select("ns", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    own = eligible(rows, recall)
    seen, reached, room = frontier.select("ns", "id"), None, recall.expand_most
    for _ in range(min(recall.expand_hops, GRAPH_HOPS)):
        if room <= 0:
            break
        near = both.join(frontier, (both["ns"] == frontier["ns"]) & (both["src"] == frontier["id"])).select(both["ns"], F.col("dst").alias("id"), (F.col("value") * F.col("weight")).alias("value"))
        new = near.groupBy("ns", "id").agg(F.max("value").alias("value")).join(seen, ["ns", "id"], "left_anti").join(own.select("ns", "id"), ["ns", "id"], "left_semi")
        frontier = cut_lineage(new.orderBy(F.desc("value"), "id").limit(room))
        n = frontier.count()
        if not n:
            break
        room -= n
        seen = seen.union(frontier.select("ns", "id"))
        reached = frontier if reached is None else reached.union(frontier)
    if reached is None:
        return found
    keyword = keyword_scores(own, recall, indexes) if recall.text else None
    more = with_signals(own.join(reached, ["ns", "id"], "left_semi").join(found.select("ns", "id"), ["ns", "id"], "left_anti"), recall, keyword)
    everyone = found.unionByName(more.select(*found.columns)).drop("graph")
    return everyone.join(reached.select("ns", "id", F.col("value").alias("graph")), ["ns", "id"], "left")


def recall_hits(rows: DataFrame, recall: Recall, links: DataFrame | None = None, indexes: dict[str, Index] | None = None) -> DataFrame:
    """ns, id, text, score and the signals of the k best, ties by id; a byte budget keeps the first hit in any case."""
    found = cut_lineage(candidates(rows, recall, indexes))
    if links is not None and recall.expand_hops and recall.expand_most:
        found = expand(found, rows, links, recall, indexes)
    out = fuse(found, recall).select("ns", "id", "text", "score", *[_signal(x).alias(x) for x in SIGNALS]).orderBy(F.desc("score"), "id").limit(recall.k)
    if recall.byte_budget is None:
        return out
    order = Window.orderBy(F.desc("score"), "id")
    size = F.octet_length("text") + F.octet_length(F.col("id").cast("string")) + HIT_BYTES + (SIGNAL_BYTES if recall.with_signals else 0)
    spent = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return out.withColumn("spent", spent).withColumn("place", F.row_number().over(order)).where((F.col("place") == 1) | (F.col("spent") <= recall.byte_budget)).drop("spent", "place")


def exact_dedup(rows: DataFrame) -> DataFrame:
    """One memory for each namespace and squeezed text: the oldest, with the largest importance and a use for every repeat."""
    key = squeezed(F.col("text"))
    first = F.struct("created", "id")
    out = rows.groupBy("ns", key.alias("squeezed")).agg(F.min_by("id", first).alias("id"), F.min("created").alias("created"), F.max("importance").alias("importance"), (F.sum("uses") + F.count("*") - 1).alias("uses"), F.count("*").alias("merged"))
    return out


def lsh_shape(n: int, similarity: float, missed: float = MISSED) -> tuple[int, int]:
    """Bits of a bucket's key, so that a bucket of ``n`` unlike vectors has some BUCKET; tables, so that a pair at ``similarity`` shares no bucket with a chance of ``missed`` at most."""
    bits = max(8, ceil(log2(max(1, n / BUCKET))))
    together = (1 - acos(min(1.0, max(-1.0, similarity))) / pi) ** bits
    return bits, 1 if together >= 1 else ceil(log(missed) / log(1 - together))


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed component by component, so that a pair has one figure wherever it is met."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _nearest_older(similarity: float):
    """Of one bucket's memories: each one's nearest older one at ``similarity`` or more, of equally near ones the oldest."""

    def run(own: pa.Table) -> pa.Table:
        ns, ids, created = own["ns"][0], own["id"].to_numpy(), own["created"].fill_null(np.iinfo(np.int64).min).to_numpy()
        order = np.lexsort((ids, created))
        ids, created = ids[order], own["created"].take(pa.array(order))
        vec = own["embedding"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1).astype(float)[order]
        norm = np.sqrt(_summed(vec, vec))
        found: list[tuple] = []
        for at in range(0, len(ids), STEP):
            end = min(at + STEP, len(ids))
            near = vec[at:end] @ vec[:end].T / (norm[at:end, None] * norm[None, :end])
            near[np.arange(end)[None, :] >= np.arange(at, end)[:, None]] = -np.inf
            i, j = np.nonzero(near >= np.maximum(near.max(axis=1), similarity)[:, None] - CLOSE)
            exact = _summed(vec[at + i], vec[j]) / (norm[at + i] * norm[j])
            i, j, exact = (x[exact >= similarity] for x in (i, j, exact))
            best = np.lexsort((j, -exact, i))
            best = best[np.unique(i[best], return_index=True)[1]]
            found.append((at + i[best], j[best], exact[best]))
        i, j, exact = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([pa.repeat(ns, len(i)), pa.array(ids[i]), pa.array(ids[j]), created.take(pa.array(j)), pa.array(exact)], ["ns", "id", "of", "of_created", "similarity"])

    return run


def near_duplicates(rows: DataFrame, similarity: float = 0.95, bits: int | None = None, tables: int | None = None, seed: int = 7) -> DataFrame:
    """ns, id, of, similarity: each memory's nearest older one at cosine ``similarity`` or more; of equally near ones the oldest.

    Vectors of one dimension are compared with each other; superseded memories, and
    vectors that are null, zero or not finite, with none. Equal embeddings are one: all
    but the oldest are nearest to that one, and it alone is compared with others.
    Candidates share a bucket of signs of random projections in one of ``tables``
    tables (``lsh_shape`` gives both figures where they are null), so no namespace is
    paired with itself. Vectors go to their buckets and are compared there, exactly; a
    bucket hands on each memory's nearest alone, so no pairs are shuffled. Buckets of
    over ``PART`` vectors are dealt in pairs of parts.
    """
    good = F.col("embedding").isNotNull() & F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(good & ~F.coalesce("superseded", F.lit(False)))
    marked = rows.select("ns", "id", "created", "embedding", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("same"))
    heads = marked.groupBy("ns", "dim", "same").agg(F.min(F.struct("created", "id")).alias("head"), F.min_by("embedding", F.struct("created", "id")).alias("embedding"))
    heads = cut_lineage(heads.select("ns", "dim", "same", "head.created", "head.id", "embedding"))
    if bits is None or tables is None:
        own_bits, own_tables = lsh_shape(heads.count(), similarity)
        bits, tables = bits or own_bits, tables or own_tables

    @F.pandas_udf("array<bigint>")
    def keys(vec: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vec), index=vec.index, dtype="object")
        for dim, own in vec.groupby(vec.map(len)):
            planes = np.random.default_rng((seed, dim)).normal(size=(tables * bits, dim))
            signs = (np.stack(own.to_numpy()).astype(float) @ planes.T > 0).reshape(len(own), tables, bits)
            found = (signs * (1 << np.arange(bits))).sum(axis=2) + (np.arange(tables) << bits)
            out.loc[own.index] = pd.Series(list(found), index=own.index)
        return out

    copies = marked.join(heads.select("ns", "dim", "same", F.col("id").alias("of")), ["ns", "dim", "same"]).where("id <> of").select("ns", "id", "of", F.lit(1.0).alias("similarity"))

    keyed = heads.select("ns", "dim", "id", F.explode(keys("embedding")).alias("key"))
    large = cut_lineage(keyed.groupBy("ns", "dim", "key").count().where(F.col("count") > PART).select("ns", "dim", "key", F.ceil(F.col("count") / PART).cast("int").alias("parts")))
    own = heads.select("ns", "dim", "id", "created", "embedding", F.explode(keys("embedding")).alias("key")).join(F.broadcast(large), ["ns", "dim", "key"], "left")
    part, one = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"), F.array(F.lit(0))
    dealt = own.withColumn("part", part).withColumn("beside", F.explode(F.when(F.col("parts").isNull(), one).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    met = dealt.withColumns({"low": F.least("part", "beside"), "high": F.greatest("part", "beside")}).groupBy("ns", "dim", "key", "low", "high")
    pairs = met.applyInArrow(_nearest_older(similarity), "ns string, id bigint, of bigint, of_created bigint, similarity double")
    best = pairs.groupBy("ns", "id").agg(F.max_by("of", F.struct("similarity", -F.col("of_created"), -F.col("of"))).alias("of"), F.max("similarity").alias("similarity"))
    return best.unionByName(copies)


def due(rows: DataFrame, now: int, min_retention: float | None = None, max_age: dict[str, int] | None = None, half_life: int = WEEK_US, use_weight: float = 0.1, links: DataFrame | None = None, per_pass: int = 1000) -> DataFrame:
    """ns, id, retention of memories to forget: too little retention, or too old for their kind; pinned ones, and what live semantic memories derive from (links src to dst), stay."""
    since = (F.lit(now) - F.coalesce("last_used", "created")).cast("double")
    retention = F.col("importance") * F.exp(-since / half_life) + use_weight * F.log1p(F.col("uses").cast("double"))
    test = F.lit(False) if min_retention is None else retention < min_retention
    for kind, age in (max_age or {}).items():
        test = test | ((F.col("kind") == kind) & (F.lit(now) - F.col("created") > age))
    out = rows.withColumn("retention", retention).where(test & ~F.col("pinned"))
    if links is not None:
        live = rows.where((F.col("kind") == "semantic") & ~F.col("superseded")).select("ns", F.col("id").alias("src"))
        held = links.join(live, ["ns", "src"], "left_semi").select("ns", F.col("dst").alias("id")).distinct()
        out = out.join(held, ["ns", "id"], "left_anti")
    return out.select("ns", "id", "retention").orderBy("ns", "id").limit(per_pass)


def _consolidable(rows: DataFrame, ns: str, now: int, min_age: int) -> DataFrame:
    """Old episodic memories that nothing holds back, with ``at``: their place, newest first."""
    old = rows.where((F.col("ns") == ns) & (F.col("kind") == "episodic") & (F.col("created") <= now - min_age) & ~F.col("consolidated") & ~F.col("superseded") & ~F.col("pinned") & F.col("embedding").isNotNull())
    return old.select("session", "id", "created", "embedding", F.struct((-F.col("created")).alias("newest"), "id").alias("at"))


def _greedy(similarity: float, least: int, most: int):
    """Of one session's memories: a group around the first that is left, again and again."""

    def run(own: pa.Table) -> pa.Table:
        own = own.sort_by([("created", "descending"), ("id", "ascending")])
        ids, sessions, created = own["id"].to_pylist(), own["session"].to_pylist(), own["created"].to_pylist()
        lists = own["embedding"].to_pylist()
        unit = [np.array(x, float) for x in lists]
        unit = [x / max(float(np.linalg.norm(x)), 1e-30) for x in unit]
        left, out = list(range(len(ids))), []
        while left:
            seed = left[0]
            near = [seed] + [i for i in left[1:] if len(unit[i]) == len(unit[seed]) and unit[i] @ unit[seed] >= similarity][: most - 1]
            if len(near) >= least:
                out += [(sessions[i], ids[i], ids[seed], created[seed]) for i in near]
            gone = set(near)
            left = [i for i in left if i not in gone]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({name: pa.array([x[k] for x in out], kind) for k, (name, kind) in enumerate(zip(("session", "id", "grp", "seeded"), kinds, strict=True))})

    return run


_GROUPS = "session string, id bigint, grp bigint, seeded bigint"


def consolidation_groups(rows: DataFrame, ns: str, now: int, min_age: int = 3_600_000_000, similarity: float = 0.8, least: int = 2, most: int = 16, groups: int = 100) -> DataFrame:
    """session, id, grp: all old episodic memories of a namespace, grouped greedily around the first ungrouped one of a session by cosine similarity.

    What chained passes scan, ``4 x groups x most`` memories each, newest first, is laid
    side by side: every memory is in one stretch, and no task has more than a stretch.
    """
    old = _consolidable(rows, ns, now, min_age).withColumn("one", F.lit(1))
    placed = running(old, "at", "one", "before").withColumn("stretch", F.floor(F.col("before") / (4 * groups * most)))
    return placed.select("stretch", "session", "id", "created", "embedding").groupBy("stretch", "session").applyInArrow(_greedy(similarity, least, most), _GROUPS).drop("seeded")


def consolidation_pass(rows: DataFrame, ns: str, now: int, after: tuple[int, int] | None = None, min_age: int = 3_600_000_000, similarity: float = 0.8, least: int = 2, most: int = 16, groups: int = 100) -> tuple[DataFrame, tuple[int, int] | None]:
    """One pass: the first ``groups`` groups, newest seed first, of what it scans after a position; and where the next one resumes (created, id), None at the end.

    Groups left out have their seeds after the last kept one's, so the next pass finds them.
    """
    old = _consolidable(rows, ns, now, min_age)
    if after is not None:
        old = old.where(F.col("at") > F.struct(F.lit(-after[0]).alias("newest"), F.lit(after[1]).alias("id")))
    scanned = cut_lineage(old.orderBy("at").limit(4 * groups * most))
    found = cut_lineage(scanned.drop("at").groupBy("session").applyInArrow(_greedy(similarity, least, most), _GROUPS))
    seeds = found.where("id = grp").orderBy(F.desc("seeded"), "grp").limit(groups + 1).collect()
    if len(seeds) > groups:
        kept = [x["grp"] for x in seeds[:groups]]
        return found.where(F.col("grp").isin(kept)).drop("seeded"), (seeds[groups - 1]["seeded"], seeds[groups - 1]["grp"])
    n, last = scanned.agg(F.count("*"), F.max("at")).first()
    return found.drop("seeded"), (-last["newest"], last["id"]) if n == 4 * groups * most else None


def mark_used(rows: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """``rows`` with a use more, and ``now`` as last use, for each row of ``ids`` (ns, id)."""
    n = ids.groupBy("ns", "id").agg(F.count("*").alias("more"))
    out = rows.join(n, ["ns", "id"], "left")
    return out.withColumns({"uses": F.col("uses") + F.coalesce("more", F.lit(0)), "last_used": F.when(F.col("more") > 0, F.greatest("last_used", F.lit(now))).otherwise(F.col("last_used"))}).select(*rows.columns)


def supersede(rows: DataFrame, ids: DataFrame) -> DataFrame:
    found = ids.select("ns", "id").distinct().withColumn("hit", F.lit(True))
    return rows.join(found, ["ns", "id"], "left").withColumn("superseded", F.col("superseded") | F.coalesce("hit", F.lit(False))).select(*rows.columns)


def link(links: DataFrame, more: DataFrame) -> DataFrame:
    """``links`` with ``more`` (ns, src, dst, weight); of equal links the heavier stays."""
    return links.unionByName(more).groupBy("ns", "src", "dst").agg(F.max("weight").alias("weight"))


def forget(rows: DataFrame, links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the memories in ``ids`` (ns, id) and their links."""
    gone = ids.select("ns", "id").distinct()
    left = links.join(gone.withColumnRenamed("id", "src"), ["ns", "src"], "left_anti").join(gone.withColumnRenamed("id", "dst"), ["ns", "dst"], "left_anti")
    return rows.join(gone, ["ns", "id"], "left_anti"), left.select(*links.columns)


def remember(rows: DataFrame, new: DataFrame, links: DataFrame, near: str = "link", similarity: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``links`` after ``new`` memories are stored.

    One whose squeezed text is there already adds a use to the oldest such memory and
    raises its importance. A near duplicate of an older memory is skipped, merged (as
    above) or stored with a link, as ``near`` says: skip, merge or link.
    """
    if near not in ("skip", "merge", "link"):
        raise ValueError("near is skip, merge or link")
    everyone = cut_lineage(rows.withColumn("fresh", F.lit(False)).unionByName(new.withColumn("fresh", F.lit(True))).withColumn("squeezed", squeezed(F.col("text"))))
    order = F.struct("fresh", "created", "id")
    groups = everyone.groupBy("ns", "squeezed").agg(F.min(order).alias("first"), F.max("importance").alias("top"), F.sum(F.col("fresh").cast("int")).alias("more"))
    joined = everyone.join(groups, ["ns", "squeezed"])
    kept = joined.where(F.struct("fresh", "created", "id") == F.col("first"))
    # A fresh first one isn't a use of itself.
    kept = kept.withColumns({"importance": F.greatest("importance", "top"), "uses": F.col("uses") + F.col("more") - F.col("fresh").cast("int")})
    kept = cut_lineage(kept.select(*rows.columns, "fresh"))
    pairs = near_duplicates(kept, similarity).join(kept.where("fresh").select("ns", "id"), ["ns", "id"], "left_semi")
    if near == "link":
        return kept.drop("fresh"), link(links, pairs.select("ns", F.col("id").alias("src"), F.col("of").alias("dst"), F.col("similarity").alias("weight")))
    left = kept.join(pairs.select("ns", "id"), ["ns", "id"], "left_anti")
    if near == "merge":
        gained = pairs.join(kept.select("ns", "id", F.col("importance").alias("i")), ["ns", "id"]).groupBy("ns", F.col("of").alias("id")).agg(F.max("i").alias("i"), F.count("*").alias("n"))
        left = left.join(gained, ["ns", "id"], "left").withColumns({"importance": F.greatest("importance", "i"), "uses": F.col("uses") + F.coalesce("n", F.lit(0))})
    return left.select(*rows.columns), links


def consolidate(rows: DataFrame, groups: DataFrame, fold, ns: str, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Semantic memories that ``fold`` (list of texts, oldest first, to one text) makes of each group; ``rows`` with their sources marked; links to the sources."""
    parts = rows.where(F.col("ns") == ns).join(groups.select("id", "grp"), "id")
    listed = parts.groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("created", "id", "text"))).alias("m"), F.max("importance").alias("importance"), F.first("session").alias("session"))

    @F.pandas_udf("string")
    def run(m: pd.Series) -> pd.Series:
        return m.map(lambda own: fold([x["text"] for x in own]))

    made = memories(listed, ns=F.lit(ns), id=-F.col("grp") - 1, created=F.lit(now), kind=F.lit("semantic"), text=run("m"), importance=F.col("importance"), session=F.col("session"))
    done = groups.select(F.lit(ns).alias("ns"), "id", F.lit(True).alias("hit"))
    marked = rows.join(done, ["ns", "id"], "left").withColumn("consolidated", F.col("consolidated") | F.coalesce("hit", F.lit(False))).select(*rows.columns)
    return made, marked, groups.select(F.lit(ns).alias("ns"), (-F.col("grp") - 1).alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
