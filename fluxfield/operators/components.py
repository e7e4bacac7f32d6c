"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxfield.plans.staging import BROADCAST_BYTES, observed, row_bytes, sized, stored


def _picked(edges: DataFrame, number: int) -> DataFrame:
    """(u, m): for every node the one of the least hash among itself and its neighbours; the round seeds the hash."""
    h = lambda c: F.xxhash64(F.lit(number), c)
    best = edges.union(edges.select("v", "u")).groupBy("u").agg(F.min_by("v", h("v")).alias("m"))
    return best.select("u", F.when(h("m") < h("u"), F.col("m")).otherwise(F.col("u")).alias("m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that has an edge; the component is its least node.

    Rounds of contraction: every node goes over to the one of the least hash among itself and its neighbours, and edges
    link those that are left, until none is. A round halves a chain or more, so rounds grow with the logarithm of what
    is linked and tables shrink from round to round. Then nodes follow where they went to, from the last round back.
    Self-loops make a node a component of its own unless it has other edges; edges with a null end are ignored.
    """
    given = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = given.where("u = v").select("u").distinct()
    ends = lambda u, v: [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]
    now, seen = observed(given.where("u <> v").select(*ends("u", "v")).distinct(), "edges", n=F.count(F.lit(1)))
    rounds = []
    while seen["n"] or not rounds:
        picked = _picked(now, len(rounds))
        picked, size = observed(picked, "picked", bytes=F.sum(row_bytes(picked)))
        hint = "broadcast" if (size["bytes"] or 0) <= BROADCAST_BYTES else "merge"
        rounds.append((picked, hint))
        for end in ("u", "v"):
            # A hub's edges can be split by the sort-merge join: those who picked have a row each.
            now = now.join(picked.select(F.col("u").alias(end), F.col("m").alias(f"_{end}")).hint(hint), end)
        now, seen = observed(now.where("_u <> _v").select(*ends("_u", "_v")).distinct(), "edges", n=F.count(F.lit(1)))
    found, hint = rounds.pop()
    while rounds:
        picked, before = rounds.pop()
        label = found.select(F.col("u").alias("m"), F.col("m").alias("label")).hint(hint)
        found, hint = picked.join(label, "m", "left").select("u", F.coalesce("label", "m").alias("m")), before
    found = stored(found, "labels")
    least = sized(found.groupBy("m").agg(F.min("u").alias("component")), "least")
    found = found.join(least, "m").select(F.col("u").alias("node"), "component")
    alone = loops.withColumnRenamed("u", "node").join(found.select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.union(alone)
