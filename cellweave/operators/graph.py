"""Breadth-first traversal over an adjacency family.

Edges are (src, dst) rows, or a log whose entries are resolved for a hop's frontier
alone. Each hop joins the frontier with the edges and drops visited destinations with
an anti-join; both are keyed joins whose strategy the optimizer picks from real sizes. Frontiers are written to the shared checkpoint
folder, so a lost executor costs one hop at most. Driver traffic is one row of
counts a hop.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import cut_lineage
from ..schema import Family
from .select import Read, running, select

#: Bytes that a node takes of a budget beside its key; with parents.
NODE_BYTES, PARENT_BYTES = 16, 4
MOST_HOPS = 64
MAX_NODES = 10_000_000
#: Nodes that one task may number.
FEW = 100_000


@dataclass
class Traversal:
    #: node, hop (0: seeds), index (place among its hop's sorted nodes), parent (index in the hop before, or null).
    nodes: DataFrame
    stats: dict


def edges_of(selected: DataFrame) -> DataFrame:
    """``selected``: resolved cells of an adjacency family."""
    return selected.select(F.col("row").alias("src"), F.col("qualifier").alias("dst")).distinct()


def edges_from(cells: DataFrame, families: list[Family], read: Read = Read()) -> Callable[[DataFrame], DataFrame]:
    """A function from nodes (node) to the edges that start there: the log is joined to them before it is resolved, which needs a row's own entries alone."""
    if read.limit is not None:
        raise ValueError("a limit on rows needs all rows")

    def of(nodes: DataFrame) -> DataFrame:
        own = nodes.select(F.col("node").alias("row")).distinct()
        return edges_of(select(cells.join(own, "row", "left_semi"), families, read))

    return of


def _numbered(nodes: DataFrame, n: int) -> DataFrame:
    """``nodes`` (``n`` of them) with index: the place in key order.

    A few are counted in one task; many by range partitions and their totals.
    """
    if n <= FEW:
        return nodes.withColumn("index", F.row_number().over(Window.orderBy("node")).cast("bigint") - 1)
    return running(nodes.withColumn("one", F.lit(1)), "node", "one", "index").drop("one")


def traverse(edges: DataFrame | Callable[[DataFrame], DataFrame], seeds: DataFrame, hops: int, per_node_limit: int | None = None, hop_limit: int | None = None, max_nodes: int = MAX_NODES, byte_budget: int | None = None, parents: bool = False) -> Traversal:
    """``edges``: src, dst; or what ``edges_from`` gives. ``seeds``: node. Every node reached within ``hops``, at the first hop that reaches it.

    ``per_node_limit``: a node's first edges by destination, visited ones included.
    ``hop_limit``: of a hop's new nodes, the first by (source's index, node).
    ``max_nodes`` counts seeds. A hop that ``byte_budget`` cuts is the last.
    """
    if not 1 <= hops <= MOST_HOPS:
        raise ValueError("hops must be 1 to 64")

    def leaving(nodes: DataFrame) -> DataFrame:
        own = edges(nodes) if callable(edges) else edges
        if per_node_limit is not None:
            order = Window.partitionBy("src").orderBy("dst")
            own = own.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_node_limit).drop("n")
        return own

    first = cut_lineage(seeds.select("node").distinct())
    total = first.count()
    frontier = cut_lineage(_numbered(first, total))
    visited = frontier.select("node", F.lit(0).alias("hop"), "index", F.lit(None).cast("bigint").alias("parent"))
    stats = {"rows": 0, "edges": 0, "hops_cut": 0, "cut_by_max_nodes": False, "cut_by_budget": False}
    spent = 0
    if byte_budget is not None:
        each = NODE_BYTES + (PARENT_BYTES if parents else 0)
        spent = frontier.agg(F.sum(F.length("node") + each)).first()[0] or 0
    for hop in range(1, hops + 1):
        read = cut_lineage(frontier.join(leaving(frontier), F.col("node") == F.col("src")).select("index", "src", "dst"))
        seen = read.agg(F.countDistinct("src"), F.count("*")).first()
        stats["rows"] += seen[0]
        stats["edges"] += seen[1]
        new = read.groupBy(F.col("dst").alias("node")).agg(F.min("index").alias("parent"))
        new = new.join(visited.select("node"), "node", "left_anti")
        room = max_nodes - total
        limit = min(x for x in (hop_limit, room) if x is not None)
        found = cut_lineage(new)
        n = found.count()
        if n > limit:
            stats["hops_cut"] += 1
            stats["cut_by_max_nodes"] |= room <= limit
            found = cut_lineage(found.orderBy("parent", "node").limit(limit))
            n = min(n, limit)
        last = False
        if byte_budget is not None and n:
            size = found.agg(F.sum(F.length("node") + each)).first()[0]
            if spent + size > byte_budget:
                order = Window.orderBy("parent", "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
                # At most budget / NODE_BYTES nodes can stay: the rest never reaches the single task.
                few = found.orderBy("parent", "node").limit(max(0, byte_budget - spent) // each + 1)
                found = cut_lineage(few.withColumn("end", F.sum(F.length("node") + each).over(order)).where(F.col("end") <= byte_budget - spent).drop("end"))
                n, last = found.count(), True
                stats["cut_by_budget"] = True
            else:
                spent += size
        if not n:
            break
        frontier = cut_lineage(_numbered(found, n))
        visited = visited.unionByName(frontier.select("node", F.lit(hop).alias("hop"), "index", F.col("parent").cast("bigint").alias("parent")))
        total += n
        if last:
            break
    return Traversal(visited if parents else visited.drop("parent"), stats)
