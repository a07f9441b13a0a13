"""SimHash near-duplicates by shared blocks of bits.

Fingerprints come from one narrow pass. Equal fingerprints collapse first, so a
group of exact copies is one row from there on. The distinct ones are cut into
``BLOCKS`` blocks of bits; two fingerprints that differ in at most MAX_BITS
bits agree on BLOCKS - MAX_BITS whole blocks, so each is keyed by every choice of
that many blocks, buckets are joined on the key, and pairs verified by Hamming
distance. A bucket of more than ``BUCKET`` fingerprints would make too many
pairs: its members go another exact way, in which each is sent to itself and to
its one-bit neighbours. Two fingerprints meet at such a place if and only if
they differ in two bits at most, and no place has more than 65 visitors.

Defined cases: null or wordless texts have fingerprint 0 and link like any
other; fewer words than a shingle make one shingle of all; repeated rows stay
(``link``) or leave one (``drop_copies``); null ids never name a component that
has another id; extra columns are ignored, or passed through by ``drop_copies``; an
empty table gives no rows. A text of any length is one row, whose words, and eight
bytes a shingle, one task holds.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import OWN, join_hot, raw_texts, slices, staged
from .components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
BLOCKS = 4
#: Largest bucket whose pairs are compared one by one.
BUCKET = 32
#: Shingles whose bits are summed at once.
STEP = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: each is set in over half of the shingles' XXH64 values, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) > shingle:
        line = b" ".join(words)
        ends = list(accumulate(len(x) + 1 for x in words))
        parts = [line[a : b - 1] for a, b in zip([0, *ends], ends[shingle - 1 :], strict=False)]
    else:
        parts = [b" ".join(words)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(x, seed) for x in parts]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), STEP):
        ones += np.unpackbits(hashes[i : i + STEP], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``df``: text last. Its other columns and ``fp`` (the fingerprint's bits as a long)."""
    names = df.columns[:-1]

    def run(batches):
        for batch in slices(batches):
            found = [fingerprint(x, shingle, seed) for x in raw_texts(batch.column(len(names)))]
            fp = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp, pa.int64())], [*names, "fp"])

    kinds = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in df.schema.fields[:-1])
    return df.mapInArrow(run, f"{kinds}, fp long")


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``fps``: distinct fp. Edges u, v that connect exactly what distances of MAX_BITS or fewer connect."""
    width = 64 // BLOCKS
    block = [F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(BLOCKS)]
    choices = list(combinations(range(BLOCKS), BLOCKS - MAX_BITS))
    keys = [
        F.struct(F.lit(i).alias("choice"), sum((F.shiftleft(block[b], j * width) for j, b in enumerate(c[1:], 1)), block[c[0]]).alias("key"))
        for i, c in enumerate(choices)
    ]
    keyed = fps.select("fp", F.inline(F.array(*keys)))
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("n")).where("n > 1")
    held = staged(keyed.join(sizes, ["choice", "key"]), "blocks")
    small = held.where(F.col("n") <= bucket)
    other = small.select("choice", "key", F.col("fp").alias("v"))
    close = (F.col("fp") < F.col("v")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= MAX_BITS)
    joined = small.join(other, ["choice", "key"]).where(close).select(F.col("fp").alias("u"), "v")

    crowd = held.where(F.col("n") > bucket).select("fp").distinct()
    flips = [F.lit(0).cast("long"), *[F.lit((1 << i) - ((1 << 64) if i == 63 else 0)).cast("long") for i in range(64)]]
    met = crowd.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(x) for x in flips])).alias("place"))
    met = met.groupBy("place").agg(F.collect_set("fp").alias("all"), F.min("fp").alias("v")).where(F.size("all") > 1)
    met = met.select(F.explode("all").alias("u"), "v").where("u <> v")
    return joined.unionByName(met).distinct()


def _classes(rows: DataFrame, order) -> DataFrame:
    """``rows``: staged, with fp. Per fp n (its rows), and its class's smallest ``order`` as ``first``."""
    fps = staged(rows.groupBy("fp").agg(F.min(order).alias("own"), F.count("*").alias("n")), "fps")
    roots = components(links(fps.select("fp")))
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "own", "n", F.coalesce("root", "fp").alias("root"))
    named = staged(named, "classes")
    first = named.groupBy("root").agg(F.min("own").alias("first"))
    return named.join(first, "root").select("fp", "n", "first")


def link(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row doc_id, fingerprint (16 hex digits), component_id (smallest id of the class)."""
    rows = fingerprints(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")))
    rows = staged(rows, "fingerprints")
    named = join_hot(rows, _classes(rows, F.col("doc_id")), "fp", rows.count())
    return named.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df``'s rows, one of each class: the one with the smallest id, then the smallest hash of id and text.

    Rows that go are found without texts; texts then meet the hashes of those alone,
    hashed and not sorted. Of rows with equal id and text, one stays.
    """
    a, b, lost = f"{OWN}a", f"{OWN}b", f"{OWN}lost"
    text = F.col(text_col).cast("string")
    keyed = df.withColumns({a: F.xxhash64(id_col, text), b: F.xxhash64(F.lit("b"), text, id_col)})
    rows = staged(fingerprints(keyed.select(F.col(id_col).cast("long").alias("doc_id"), F.col(a).alias("a"), F.col(b).alias("b"), text.alias("text"))), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")
    named = join_hot(rows, _classes(rows, order), "fp", rows.count())
    stays = (F.col("a") == F.col("first.a")) & (F.col("b") == F.col("first.b"))
    told = named.groupBy(F.col("a").alias(a), F.col("b").alias(b)).agg((~F.first(stays)).alias(lost), F.count("*").alias("n")).where(F.col(lost) | (F.col("n") > 1))
    told = staged(told.select(a, b, lost), "lost")
    met = keyed.join(told.hint("shuffle_hash"), [a, b], "left")
    names = [F.col(f"`{x}`") for x in df.columns]
    again = met.where(~F.col(lost)).dropDuplicates([a, b])
    return met.where(F.col(lost).isNull()).select(*names).unionByName(again.select(*names))
