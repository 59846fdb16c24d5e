"""Who hangs on whom: everything below some rows of a hierarchy, by pointer doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelrow.session import cut_lineage


def hanging_on(nodes: DataFrame, ids: Sequence[str], ups: Sequence[str]) -> tuple[DataFrame, int]:
    """The ids of all nodes that are gone or have an ancestor that is, and the number of rounds it took.

    ``nodes`` has one row for each id: the ``ids``, the ``ups`` that point to the parent's ids (null: none; an id that no
    node has: none) and ``gone``.  In each round a node learns from the node it points to and then points as far again, so
    a path of n nodes takes about log2(n) rounds, not n.  Nodes that point nowhere and are not gone leave the rounds.
    A round that finds nothing new is the last, so rings of nodes end as well.
    """
    ids, ups = list(ids), list(ups)
    points = F.col(ups[-1]).isNotNull()
    now = cut_lineage(nodes.select(*ids, *ups, F.col("gone"), F.lit(False).alias("fresh")).filter(F.col("gone") | points))
    rounds = 0
    while True:
        ahead = now.select(
            *[F.col(i).alias(u) for i, u in zip(ids, ups)], F.col("gone").alias("__gone"),
            *[F.col(u).alias(f"__{u}") for u in ups])
        fresh = ~F.col("gone") & F.coalesce("__gone", F.lit(False))
        done = F.col("gone") | fresh
        now = cut_lineage(
            now.drop("fresh").join(ahead, ups, "left").select(
                *ids, *[F.when(~done, F.col(f"__{u}")).alias(u) for u in ups], done.alias("gone"), fresh.alias("fresh"))
            .filter(F.col("gone") | points))
        rounds += 1
        if now.filter("fresh").isEmpty():
            return now.filter("gone").select(*ids), rounds
