"""Best-fit packing of documents into sequences, certified by lower bounds.

``cut_tokens`` turns documents into pieces of at most ``capacity`` tokens (only
longer documents are cut; the first piece takes the odd length). ``pack`` deals
the pieces to partitions of bounded size, packs each best-fit decreasing, and
compares its bin count with the largest bound that a family of dual-feasible
functions proves. A partition that meets its bound is certified: it keeps its
bins, all but the emptiest ones. The others keep those that are full to the last
token. The rest is exchanged: those pieces are dealt anew, over fewer partitions,
and packed again, until a single partition is left or an exchange saves nothing,
in which case the bins before it stay.

Memory: a partition holds about ``part_rows`` rows of numbers; texts and ids
never enter it. Defined cases: null text is empty (one token, the end id);
repeated ids are packed as separate pieces; an empty table gives no rows; other
columns are ignored; a text of any length is encoded whole, by one task, and its
pieces are rows of their own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_BYTES, slices, staged
from .encoders import WORDS, byte_bpe

MODEL = "byte_bpe_50k.json"
END_ID = 0
CAPACITY = 2048
#: Documents encoded at once.
BATCH_ROWS = 1 << 16
#: Pieces packed by one task.
PART_ROWS = 16_384
#: Exchanges at most; each deals the open bins over an eighth as many partitions.
ROUNDS = 8
#: A certified partition's bins with more than this part of the capacity left are exchanged too.
SLACK = 16
MERGE = 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = "row long, length long, bin long, offset long, open boolean"


def cut_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False, words: int = WORDS, at_once: int = BATCH_BYTES) -> DataFrame:
    """The pieces of each document; ``with_ids`` adds their ids as an array. A worker remembers ``words`` words and encodes texts of ``at_once`` bytes together: fewer take less memory and more time."""

    def run(batches):
        encoder = byte_bpe(model, words)
        for batch in slices(batches, BATCH_ROWS, at_once):
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids)}
            ids, ends = encoder.encode_ended(batch.column(1), end_id)
            for doc, begin, end in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                n = end - begin
                at, cut = 0, n - (n - 1) // capacity * capacity
                for piece in range((n - 1) // capacity + 1):
                    own = ids[begin + at : begin + cut]
                    for k, v in zip(out, (doc, piece, at, cut - at, zlib.crc32(own)), strict=False):
                        out[k].append(v)
                    if with_ids:
                        out["ids"].append(own)
                    at, cut = cut, cut + capacity
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out.values(), kinds, strict=True)], list(out))

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES + ", ids array<long>" * with_ids)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the largest bound over dual-feasible functions.

    For t in 1..C/2, f_t(x) = C where x > C - t, x where t <= x <= C - t, else 0;
    for k in 1..32, u_k(x) = x where (k+1) x divides by C, else floor((k+1) x / C) C / k.
    Both are dual feasible: lengths that fit one bin have values that sum to C at most.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    n_up = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])  # pieces of x tokens or more
    mass = counts * np.arange(capacity + 1)
    below = np.concatenate([[0], np.cumsum(mass)])  # tokens in pieces shorter than x
    t = np.arange(1, capacity // 2 + 1)
    big = n_up[capacity - t + 1]
    middle = below[capacity - t + 1] - below[t]
    best = int(np.max(big + -(-middle // capacity))) if len(t) else int(n_up[1])
    best = max(best, -(-int(mass.sum()) // capacity))
    x = np.arange(capacity + 1)
    for k in range(1, 33):
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, k * x, (k + 1) * x // capacity * capacity)  # k times u_k
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each piece's bin and offset, and the bins' fill.

    Open bins are kept by room left; the smallest room that holds the piece is the
    lowest set bit of a big integer, so a piece costs a few operations.
    """
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, fill = 0, []
    for i, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = open_rooms >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            k = rooms[room].pop()
            if not rooms[room]:
                open_rooms ^= 1 << room
        else:
            room, k = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = k, fill[k]
        fill[k] += need
        room -= need
        if room:
            if not rooms[room]:
                open_rooms |= 1 << room
            rooms[room].append(k)
    return bins, offsets, np.array(fill, np.int64)


def _packer(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        lengths = rows["length"].to_numpy()
        bins, offsets, fill = best_fit(lengths, capacity)
        # A certified partition gives up its emptiest bins alone, others all that have room.
        if len(fill) > lower_bound(lengths, capacity):
            leaves = fill < capacity
        else:
            leaves = (fill < min(capacity, fill.min() + 1)) | (fill < capacity - capacity // SLACK)
        # A bin's number: the first row number in it, which no other bin has.
        name = np.full(len(fill), np.iinfo(np.int64).max)
        np.minimum.at(name, bins, rows["row"].to_numpy())
        return pd.DataFrame({"row": rows["row"], "length": lengths, "bin": name[bins], "offset": offsets, "open": leaves[bins]})

    return run


def pack(rows: DataFrame, n_rows: int, capacity: int = CAPACITY, part_rows: int = PART_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """``rows``: row (unique long), length (1..capacity). Returns row, sequence_id, offset."""
    parts = max(1, -(-n_rows // part_rows))
    done, left, before = [], rows, None
    for k in range(rounds + 1):
        deal = F.pmod(F.xxhash64("row", F.lit(k)), F.lit(parts))
        placed = staged(left.withColumn("part", deal).groupBy("part").applyInPandas(_packer(capacity), PLACED), "packed")
        if before is not None and placed.select("bin").distinct().count() >= n_before:
            placed, parts = before, 1  # the exchange saved nothing: the bins stay as they were
        last = k == rounds or parts == 1
        done.append((placed if last else placed.where(~F.col("open"))).select("row", F.col("bin").alias("sequence_id"), "offset"))
        if last:
            break
        before = placed.where("open")
        n_before = before.select("bin").distinct().count()
        left = before.select("row", "length")
        parts = -(-parts // MERGE)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def pack_documents(df: DataFrame, model: str = MODEL, end_id: int = END_ID, capacity: int = CAPACITY, words: int = WORDS, at_once: int = BATCH_BYTES) -> DataFrame:
    """Per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset; ``words`` and ``at_once`` as in cut_tokens."""
    cut = cut_tokens(df, model=model, end_id=end_id, capacity=capacity, words=words, at_once=at_once)
    # Numbers are drawn once, before the table is written; rereading keeps them.
    cut = staged(cut.withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = cut.where(F.col("length") == capacity)
    odd = cut.where(F.col("length") < capacity)
    placed = pack(odd.select("row", "length"), odd.count(), capacity)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    alone = whole.withColumn("sequence_id", F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    return odd.join(placed, "row").select(*names).unionByName(alone.select(*names))


def sequences(pieces: DataFrame) -> DataFrame:
    """``pieces``: sequence_id, offset, ids. The sequences' ids, in order; a sequence is of bounded length."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
