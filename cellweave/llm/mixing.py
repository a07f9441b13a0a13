"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Sizes are counted in one narrow pass and staged without texts. Weights, sizes and
caps give each source a target; the mix's blocks go to sources by the highest
quotients target / (2 k + 1), and a source's blocks to its shards likewise, by
the shards' sizes. A shard is a bounded, hash-dealt part of one source (a source
with a third of all rows has a third of all shards), laid out as one stream of
words in seeded order. It passes whole as often as its quota covers it; the rest
are blocks that a seeded permutation picks. What integers leave between quota
and target, less than a block, is taken from or added to the source's largest
shard, so a source's words come to its target exactly.

The driver sees one number per source and shard (SHARDS + sources of them, more than
that only as one for SHARD_MOST words; of sources MOST_SOURCES at most), never
documents. Reruns give the same mix: order and choice hang on seed, id and text.

Defined cases: null or empty texts have size 0 and are never taken; a null source
is the last source; repeated rows are taken each by itself; other columns are
ignored by ``mix`` and passed through by ``draw``; an empty table gives no rows. A
text of any length is one row: its blocks are picked like any others, so a part of it
can be taken, and a shard can be as large as its longest text.
"""

from __future__ import annotations

import heapq
import re
from fractions import Fraction
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import OWN, release, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
PERCENT = 150
CAP = 2
SEED = 17
#: Sources at most: their list is the mix's configuration, held by the driver and broadcast.
MOST_SOURCES = 100_000
#: Shards of the whole corpus, about; and words that a shard has at least, and at most (a larger corpus has more shards).
SHARDS = 2048
SHARD_WORDS = 8192
SHARD_MOST = 1 << 24
#: Words of a block at most; small corpora get smaller ones, so that quotas stay fine.
BLOCK = 1024
BLOCKS_PER_SOURCE = 256
#: Primes over any shard's number of blocks; the seed picks one as a shard's stride.
STRIDES = (1000000007, 1000000009, 1000000021, 1000000033, 1000000087, 1000000093)


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, cap: int = CAP) -> list[float]:
    """``sizes`` in source order. A target over ``cap`` x size stops there; the excess goes by weight to the others, again and again."""
    own = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [Fraction(0)] * len(sizes)
    left, rest = set(range(len(sizes))), Fraction(percent * sum(sizes), 100)
    while left:
        share = rest / sum(own[i] for i in left)
        over = [i for i in left if share * own[i] > cap * sizes[i]]
        if not over:
            for i in left:
                out[i] = share * own[i]
            break
        for i in over:
            out[i] = Fraction(cap * sizes[i])
            rest -= out[i]
            left.remove(i)
    return [float(x) for x in out]


def sainte_lague(votes: list[int], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2 k + 1), ties to the earlier party; ``most``: seats that a party can take.

    Seats that no quotient can win any more stay empty. A party is first given what
    it wins in any case, less one seat of slack, so that the queue serves a few
    seats for each party, however many there are.
    """
    total = sum(votes)
    most = most if most is not None else [seats] * len(votes)
    if not total or seats <= 0:
        return [0] * len(votes)
    # With n parties, quotients down to total / (2 (seats - n / 2)) or more are won for certain.
    sure = max(0, seats - len(votes))
    got = [min(m, max(0, v * sure // total - 1)) for v, m in zip(votes, most, strict=True)]
    queue = [(-Fraction(v, 2 * g + 1), i) for i, (v, g, m) in enumerate(zip(votes, got, most, strict=True)) if v and g < m]
    heapq.heapify(queue)
    for _ in range(seats - sum(got)):
        if not queue:
            break
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(queue, (-Fraction(votes[i], 2 * got[i] + 1), i))
    return got


def _sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``df`` with own columns: source, size (words) and a, b (hashes of id and text)."""
    text = F.col(text_col).cast("string")
    return df.withColumns({
        f"{OWN}id": F.col(id_col).cast("long"), f"{OWN}source": F.col(source_col).cast("string"),
        f"{OWN}a": F.xxhash64(id_col, text), f"{OWN}b": F.xxhash64(F.lit("b"), text, id_col),
        f"{OWN}size": F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"),
    })


def _own(name: str):
    return F.col(OWN + name)


class Plan(NamedTuple):
    #: nth, name, source_size, target, parts: one row per source.
    sources: DataFrame
    #: nth (its source's), shard, total, words: one row per shard.
    shards: DataFrame
    #: Words of a block.
    block: int


def _sharded(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    rows = rows.join(F.broadcast(sources.withColumnsRenamed({x: OWN + x for x in sources.columns})), _own("source").eqNullSafe(_own("name")))
    return rows.withColumn(f"{OWN}shard", F.pmod(F.xxhash64(_own("a"), F.lit(seed)), _own("parts")).cast("int"))


def plan(rows: DataFrame, weights=WEIGHTS, percent: int = PERCENT, cap: int = CAP, seed: int = SEED, shards: int = SHARDS) -> Plan:
    """``rows``: what _sized adds. What each source and shard gives to the mix."""
    spark = rows.sparkSession
    # One row per source: the mix's own configuration.
    sizes = rows.groupBy(_own("source").alias("source")).agg(F.sum(_own("size")).alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(sizes) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group them first")
    sizes = sorted(((x["source"], x["n"]) for x in sizes), key=lambda x: (x[0] is None, x[0] or ""))
    goal = targets([n for _, n in sizes], weights, percent, cap)
    part = min(SHARD_MOST, max(SHARD_WORDS, -(-sum(n for _, n in sizes) // shards)))
    table = [(k, s, n, t, max(1, -(-n // part))) for k, ((s, n), t) in enumerate(zip(sizes, goal, strict=True))]
    sources = spark.createDataFrame(table, "nth int, name string, source_size long, target double, parts int")
    # Two numbers a shard: shards + sources rows at most, and one more for each SHARD_MOST words.
    held = _sharded(rows, sources, seed).groupBy(_own("nth").alias("nth"), _own("shard").alias("shard")).agg(F.sum(_own("size")).alias("n")).collect()
    by: dict = {}
    for x in sorted(held, key=lambda x: x["shard"]):
        by.setdefault(x["nth"], []).append((x["shard"], x["n"]))
    whole = [round(t) for t in goal]
    block = max(1, min(BLOCK, sum(whole) // max(1, BLOCKS_PER_SOURCE * len(sizes))))
    out = []
    for k, (quota, goal_words) in enumerate(zip(sainte_lague(whole, -(-sum(whole) // block)), whole, strict=True)):
        own = by.get(k, [])
        each = sainte_lague([n for _, n in own], quota, [cap * n // block for _, n in own])
        given = [q * block for q in each]
        rest = goal_words - sum(given)
        for i in sorted(range(len(own)), key=lambda i: -own[i][1]):
            step = max(-given[i], min(cap * own[i][1] - given[i], rest))
            given[i], rest = given[i] + step, rest - step
        out += [(k, shard, n, w) for (shard, n), w in zip(own, given, strict=True)]
    return Plan(sources, spark.createDataFrame(out, "nth int, shard int, total long, words long"), block)


def _laid_out(rows: DataFrame, to: Plan, seed: int) -> DataFrame:
    """``rows`` with their shard's figures, their place in its stream (begin), whole passes (full) and picked spans (from, to: words)."""
    shards = to.shards.withColumnsRenamed({x: OWN + x for x in to.shards.columns})
    # Both sides are dealt as the window below asks, where the shards are too many to be sent whole.
    rows = _sharded(rows, to.sources, seed).join(shards, [f"{OWN}nth", f"{OWN}shard"])
    order = [F.xxhash64(_own("b"), F.lit(seed)), _own("a"), _own("b"), _own("id")]
    stream = Window.partitionBy(f"{OWN}nth", f"{OWN}shard").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(f"{OWN}begin", F.coalesce(F.sum(_own("size")).over(stream), F.lit(0)))
    full = F.when(_own("total") > 0, F.floor(_own("words") / _own("total"))).otherwise(F.lit(0)).cast("int")
    return rows.withColumns({f"{OWN}full": F.when(_own("size") > 0, full).otherwise(F.lit(0)), f"{OWN}spans": _spans(to.block, seed)})


def _spans(block: int, seed: int):
    """Column: the document's words that lie in its shard's picked blocks, as ranges from its start.

    Of a shard's n blocks, block i has rank (i x stride + shift) mod n; those below
    the number of whole blocks to take are taken, and the next one in part.
    """
    begin, size, total = _own("begin"), _own("size"), _own("total")
    n = F.ceil(total / F.lit(block)).cast("long")
    rest = F.when(total > 0, _own("words") % total).otherwise(F.lit(0))
    mark = F.xxhash64(_own("source"), _own("shard"), F.lit(seed))
    stride = F.element_at(F.array(*[F.lit(x) for x in STRIDES]), F.pmod(mark, F.lit(len(STRIDES))).cast("int") + 1)
    last, end = n - 1, begin + size

    def rank(i):
        return F.pmod((i % n) * (stride % n) + F.pmod(F.shiftright(mark, 8), n), n)

    def length(i):
        return F.when(i == last, total - last * block).otherwise(F.lit(block))

    # The short last block shifts what the ranks before it hold.
    short, short_rank = block - length(last), rank(last)

    def span(i):
        before = rank(i) * block - F.when(short_rank < rank(i), short).otherwise(F.lit(0))
        taken = F.greatest(F.lit(0), F.least(length(i), rest - before))
        return F.struct((F.greatest(begin, i * block) - begin).cast("long").alias("from"), (F.least(end, i * block + taken) - begin).cast("long").alias("to"))

    blocks = F.sequence(F.floor(begin / block), F.floor((end - 1) / block))
    found = F.filter(F.transform(blocks, span), lambda x: x["from"] < x["to"])
    return F.when((size > 0) & (rest > 0), found).otherwise(F.array().cast("array<struct<from:bigint,to:bigint>>"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, percent: int = PERCENT, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """Per row doc_id, size, source_size, target (its source's), taken (words the mix takes, repeats counted)."""
    rows = _sized(df, id_col, text_col, source_col)
    rows = staged(rows.select(*[_own(x) for x in ("id", "source", "a", "b", "size")]), "sizes")
    rows = _laid_out(rows, plan(rows, weights, percent, cap, seed), seed)
    picked = F.aggregate(_own("spans"), F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"])
    taken = (_own("full") * _own("size") + picked).cast("long")
    return rows.select(_own("id").alias("doc_id"), _own("size").alias("size"), _own("source_size").alias("source_size"), _own("target").alias("target"), taken.alias("taken"))


def _cut(text: str, spans) -> str:
    """The words of ``spans`` with what stands between them; spans that touch stay joined."""
    ends = [m.span() for m in re.finditer(WORD, text)]
    merged: list[list[int]] = []
    for x in spans:
        if merged and merged[-1][1] == x["from"]:
            merged[-1][1] = x["to"]
        else:
            merged.append([x["from"], x["to"]])
    return "\n".join(text[ends[a][0] : ends[b - 1][1]] for a, b in merged)


def draw(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, percent: int = PERCENT, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The mix itself, in ``df``'s columns: a row for each whole pass over a document, and one with its picked words."""
    sized = _sized(df, id_col, text_col, source_col)
    short = staged(sized.select(*[_own(x) for x in ("id", "source", "a", "b", "size")]), "sizes")
    rows = _laid_out(sized, plan(short, weights, percent, cap, seed), seed)

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        release()
        return pd.Series([x if y is None else _cut(x, y) for x, y in zip(text, spans, strict=True)], dtype="object")

    spans = _own("spans")
    whole = F.aggregate(spans, F.lit(0).cast("long"), lambda s, x: s + x["to"] - x["from"]) == _own("size")
    none = F.lit(None).cast("array<struct<from:bigint,to:bigint>>")
    part = F.when(F.size(spans) == 0, F.array().cast("array<array<struct<from:bigint,to:bigint>>>")).otherwise(F.array(F.when(whole, none).otherwise(spans)))
    rows = rows.withColumn(f"{OWN}part", F.explode(F.concat(F.array_repeat(none, _own("full")), part)))
    return rows.withColumn(text_col, cut(F.col(text_col), _own("part"))).select(*[F.col(f"`{x}`") for x in df.columns])
