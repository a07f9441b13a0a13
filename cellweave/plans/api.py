"""A table's surface: reads, writes, traversal, search and feed on one database folder.

Reads are lazy DataFrames. A commit is one record; a conditional commit and a
transaction are validated against the newest state, and anew where another commit
comes between.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import graph, select, vector, write
from ..operators.select import Bounds, Read
from ..streaming import feed
from .tables import Database


@dataclass
class Page:
    """What fits a byte budget. ``resume``: the last column's position; ``next_bytes``: what the next column needs."""

    cells: DataFrame
    cut_by_budget: bool
    resume: tuple[bytes, int, bytes] | None
    next_bytes: int | None


def page(selected: DataFrame, budget: int, after: tuple[bytes, int, bytes] | None = None) -> Page:
    """The longest prefix of whole columns of ``selected`` after a position; chained pages give every cell once."""
    rest = selected if after is None else select.after(selected, *after)
    cells = select.within(rest, budget)
    last = cells.orderBy(F.desc("row"), F.desc("fam"), F.desc("qualifier")).select("row", "fam", "qualifier").first()
    at = None if last is None else (bytes(last["row"]), last["fam"], bytes(last["qualifier"]))
    left = rest if at is None else select.after(rest, *at)
    head = left.groupBy("row", "fam", "qualifier").agg(F.sum(select.cell_bytes()).alias("size")).orderBy("row", "fam", "qualifier").first()
    if head is None:
        return Page(cells, False, None, None)
    same_row = at is not None and at[0] == bytes(head["row"])
    return Page(cells, True, at or after, head["size"] + (0 if same_row else len(head["row"])))


def position_token(position: tuple[bytes, int, bytes]) -> bytes:
    """A resume position as stable bytes."""
    row, fam, qualifier = position
    return len(row).to_bytes(4, "big") + row + fam.to_bytes(2, "big") + qualifier


def token_position(token: bytes) -> tuple[bytes, int, bytes]:
    n = 4 + int.from_bytes(token[:4], "big")
    if len(token) < n + 2:
        raise ValueError("not a position")
    return token[4:n], int.from_bytes(token[n : n + 2], "big"), token[n + 2 :]


class Table:
    def __init__(self, db: Database, name: str):
        self.db, self.name = db, name
        self.families = db.families(name)

    @property
    def log(self) -> DataFrame:
        return self.db.log(self.name)

    def snapshot(self) -> int:
        """The newest commit's number: a read with it is repeatable."""
        return self.db.seqno()

    def select(self, read: Read = Read()) -> DataFrame:
        return select.select(self.log, self.families, read)

    def get(self, row: bytes, family: str, qualifier: bytes, snapshot: int | None = None) -> DataFrame:
        return self.select(Read(rows=Bounds.one(row), families=(family,), qualifiers=Bounds.one(qualifier), snapshot=snapshot)).limit(1)

    def row(self, row: bytes, read: Read = Read()) -> DataFrame:
        return select.ordered(self.select(read.but(rows=Bounds.one(row))))

    def scan(self, low: bytes | None = None, high: bytes | None = None, read: Read = Read()) -> DataFrame:
        return select.ordered(self.select(read.but(rows=Bounds(low, high))))

    def scan_prefix(self, prefix: bytes, read: Read = Read()) -> DataFrame:
        return select.ordered(self.select(read.but(rows=Bounds.prefix(prefix))))

    def keys(self, keys: list[bytes], read: Read = Read()) -> DataFrame:
        return select.multi_get(self.log, self.families, select.key_set(self.db.spark, keys), read)

    def rows_as_maps(self, read: Read = Read()) -> DataFrame:
        """row, cells: each row's cells in natural order, as one value."""
        parts = F.struct("fam", "qualifier", (-F.col("ts")).alias("newest"), "family", "ts", "value_type", "value", "value_i64", "value_f64", "value_vec")
        return self.select(read).groupBy("row").agg(F.array_sort(F.collect_list(parts)).alias("cells"))

    def traverse(self, seeds: list[bytes], family: str, hops: int, read: Read = Read(), **limits) -> graph.Traversal:
        edges = graph.edges_of(self.select(read.but(families=(family,))))
        return graph.traverse(edges, self.db.spark.createDataFrame([(x,) for x in seeds], "node binary"), hops, **limits)

    def nearest(self, family: str, query: list[float], k: int, metric: str = "l2", read: Read = Read(), keys: list[bytes] | None = None) -> DataFrame:
        read = read.but(families=(family,))
        own = self.select(read) if keys is None else self.keys(keys, read)
        return vector.nearest(own, query, k, metric)

    def feed(self, after: int = 0, prefix: bytes | None = None) -> DataFrame:
        """Changes since a position, as a stream over what commits wrote; ``feed.follow_commits`` gives whole commits in order."""
        return feed.stream(self.db.spark, f"{self.db.path}/cells/{self.name}", after, prefix)

    def changes(self, after: int = 0, upto: int | None = None, prefix: bytes | None = None) -> DataFrame:
        """FeedExpired: compaction has dropped changes after ``after``."""
        return feed.between(self.log, after, upto, prefix, self.db.retained(self.name))

    def batch(self) -> write.WriteBatch:
        return write.WriteBatch({f.name: f for f in self.families})

    def commit(self, batch: write.WriteBatch, now: int | None = None, check=None) -> int:
        """Returns the commit's number."""
        return commit_all(self.db, {self.name: batch}, now, check)

    def commit_if(self, batch: write.WriteBatch, condition: write.Condition, now: int | None = None) -> int | None:
        """None: the condition failed and nothing was written."""

        def check() -> None:
            if not condition.holds(self.log, self.families):
                raise write.Conflict("the condition failed")

        try:
            return self.commit(batch, now, check)
        except write.Conflict:
            return None

    def commit_returning(self, batch: write.WriteBatch, now: int | None = None) -> DataFrame:
        """Commits, and returns what its increments saw: previous and current."""
        seqno = self.commit(batch, now)
        return write.returning(self.log, self.families).where(F.col("seqno") == seqno)

    def transaction(self) -> Transaction:
        return Transaction(self, self.snapshot())


def commit_all(db: Database, batches: dict[str, write.WriteBatch], now: int | None = None, check=None) -> int:
    """One commit to several tables, readable at once; returns its number."""
    at = time.time_ns() // 1000 if now is None else now
    return db.commit(lambda seqno: {t: b.frame(db.spark, seqno, at) for t, b in batches.items()}, check)


@dataclass
class Transaction:
    """Optimistic and serializable over the columns and row families it read."""

    table: Table
    start: int
    reads: list[tuple] = field(default_factory=list)
    batch: write.WriteBatch = None

    def __post_init__(self) -> None:
        self.batch = self.table.batch()

    def get(self, row: bytes, family: str, qualifier: bytes) -> DataFrame:
        self.reads.append((0, row, family, qualifier))
        return self.table.get(row, family, qualifier, self.start)

    def get_row(self, row: bytes) -> DataFrame:
        self.reads += [(0, row, f.name, None) for f in self.table.families]
        return self.table.row(row, Read(snapshot=self.start))

    def commit(self, now: int | None = None) -> int:
        """Raises Conflict if what was read has changed since the start."""

        def check() -> None:
            rows = self.table.db.spark.createDataFrame([(*x, self.start, 2**62) for x in self.reads], "txn int, row binary, family string, qualifier binary, start bigint, commit bigint")
            if write.conflicts(self.table.log, rows).take(1):
                raise write.Conflict(f"what was read changed after {self.start}")

        return self.table.commit(self.batch, now, check if self.reads else None)
