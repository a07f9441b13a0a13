"""Change feed: commits in order, as a stream or a batch, with resumable positions.

``follow_commits`` streams a database's commit records and delivers whole commits in
order; its checkpoint is its position. ``stream`` reads a table's files without
that order, for sinks that don't need it; ``between`` and ``after_token`` are the
feed as a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.select import Bounds
from ..schema import CELLS, KINDS

CHANGE = ("family", "kind", "row", "qualifier", "ts", "value_type", "value", "value_i64", "value_f64")


class FeedExpired(Exception):
    """The position asked for lies before what is retained."""


def _names():
    return F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v)])


def changes(cells: DataFrame, table: str = "") -> DataFrame:
    """Log entries as changes: table, seqno, op, change (its kind's name) and the entry."""
    return cells.select(F.lit(table).alias("table"), "seqno", "op", F.element_at(_names(), F.col("kind")).alias("change"), *[c for c in CHANGE if c != "kind"])


def commits(changed: DataFrame) -> DataFrame:
    """seqno, changes: whole commits, their changes in order."""
    parts = F.struct("op", "table", "change", "family", "row", "qualifier", "ts", "value_type", "value", "value_i64", "value_f64")
    return changed.groupBy("seqno").agg(F.array_sort(F.collect_list(parts)).alias("changes"))


def between(cells: DataFrame, after: int, upto: int | None = None, prefix: bytes | None = None, oldest: int = 0) -> DataFrame:
    """Changes of commits after a position (a snapshot's number or a token); only rows with ``prefix`` where given."""
    if after + 1 < oldest:
        raise FeedExpired(f"position {after} is older than {oldest}")
    out = cells.where(F.col("seqno") > after)
    if upto is not None:
        out = out.where(F.col("seqno") <= upto)
    if prefix is not None:
        out = out.where(Bounds.prefix(prefix).test(F.col("row")))
    return changes(out)


def stream(spark: SparkSession, path: str, after: int = 0, prefix: bytes | None = None, max_files: int = 100) -> DataFrame:
    """A streaming DataFrame of changes over the files that a table's commits wrote, each once, in no order; the family is in a file's path."""
    source = spark.readStream.schema(CELLS).option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true").parquet(path)
    source = source.withColumn("family", F.regexp_extract(F.input_file_name(), "/family=([^/]*)/", 1))
    return between(source, after, prefix=prefix)


def follow(changed: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Calls ``sink`` with each micro-batch, sorted, and its number; a number seen before may be skipped by the sink."""
    def ordered(batch: DataFrame, n: int) -> None:
        sink(batch.orderBy("seqno", "op"), n)

    writer = changed.writeStream.foreachBatch(ordered).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def replicate(changed: DataFrame, checkpoint: str, target: str, once: bool = True) -> StreamingQuery:
    """Applies the feed to a replica's folder: a batch has its own subfolder, written over when it comes again."""
    def apply(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={n}")

    return follow(changed, checkpoint, apply, once)


def changes_of(db, records: list[dict], prefix: bytes | None = None) -> DataFrame:
    """Changes that these records' commits wrote: n (the record's number) and the columns of ``changes``. Compactions write none."""
    parts = []
    for x in records:
        for table, folder in sorted(x["folders"].items()):
            if not x["replaces"]:
                parts.append((x["n"], table, folder))
    by: dict[str, list] = {}
    for n, table, folder in parts:
        by.setdefault(table, []).append((n, folder))
    out = None
    for table, own in by.items():
        rows = db.read([x for _, x in own], "commit")
        numbers = db.spark.createDataFrame([(x.rpartition("=")[2], n) for n, x in own], "commit string, n bigint")
        if prefix is not None:
            rows = rows.where(Bounds.prefix(prefix).test(F.col("row")))
        found = rows.join(F.broadcast(numbers), "commit")  # a row for each commit of the batch
        named = found.select("n", F.lit(table).alias("table"), "seqno", "op", F.element_at(_names(), F.col("kind")).alias("change"), *[c for c in CHANGE if c != "kind"])
        out = named if out is None else out.unionByName(named)
    if out is None:
        return changes(db.spark.createDataFrame([], CELLS)).withColumn("n", F.lit(0).cast("bigint")).select("n", "table", "seqno", "op", "change", *[c for c in CHANGE if c != "kind"])
    return out


def catalog_changes(records: list[dict]) -> list[tuple[int, str, str | None]]:
    """n, event, table of the catalog events in these records, in order."""
    return [(x["n"], e["event"], e["table"]) for x in records for e in x["events"]]


def after_token(db, token: int = 0, upto: int | None = None, prefix: bytes | None = None) -> tuple[DataFrame, list[tuple], int]:
    """Whole commits after a token (a record's number): their changes, their catalog events, and the next token."""
    records = [x for x in db.records() if x["n"] > token and (upto is None or x["n"] <= upto)]
    return changes_of(db, records, prefix), catalog_changes(records), max([token, *(x["n"] for x in records)])


def follow_commits(db, checkpoint: str, sink: Callable[[DataFrame, list[tuple], int], None], prefix: bytes | None = None, most: int = 100, once: bool = True) -> StreamingQuery:
    """Calls ``sink`` with the changes of some whole commits, sorted, their catalog events, and the last one's number.

    The stream is of commit records, in the order they were made, so a commit of many
    files is never split; the checkpoint is the position, and a batch that comes again
    has the same commits.
    """

    def deliver(batch: DataFrame, _: int) -> None:
        records = [x.asDict(recursive=True) for x in batch.orderBy("n").collect()]  # ``most`` at most
        if records:
            sink(changes_of(db, records, prefix).orderBy("n", "seqno", "op"), catalog_changes(records), records[-1]["n"])

    source = db.spark.readStream.schema(db.RECORD).option("maxFilesPerTrigger", most).json(f"{db.path}/commits")
    writer = source.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def event_windows(events: DataFrame, ts: str, width: str, late: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Counts in event-time windows, for streams and batches; streams drop what is later than ``late``."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, slide or width), *keys).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))


def merged(streams: list[DataFrame]) -> DataFrame:
    """Several tables' changes as one stream; order holds inside each alone."""
    out = streams[0]
    for x in streams[1:]:
        out = out.unionByName(x)
    return out


def token(query: StreamingQuery) -> dict | None:
    """A running feed's progress: batch, rows, and the source's end position."""
    last = query.lastProgress
    return last and {"batch": last["batchId"], "rows": last["numInputRows"], "end": [x["endOffset"] for x in last["sources"]]}


#: Memory events, weakest first.
MEMORY_EVENTS = ("Updated", "Remembered", "Summarized", "Superseded", "Deleted")


def memory_events(changed: DataFrame) -> DataFrame:
    """``changed``: seqno, ns, id, event. The strongest event of each memory and commit."""
    order = F.array_position(F.array(*[F.lit(x) for x in MEMORY_EVENTS]), F.col("event"))
    return changed.groupBy("seqno", "ns", "id").agg(F.max_by("event", order).alias("event"))
