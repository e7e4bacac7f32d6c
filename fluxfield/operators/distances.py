"""Hop distances from a set of nodes, and which of its components each node is attached to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxfield.plans.staging import BROADCAST_BYTES, Rounds, counted, row_bytes, stored, wide

from .chains import contracted
from .components import connected_components
from .graph import induced, prune_zeros, symmetric


def _linked(edges: DataFrame) -> DataFrame:
    """(src, dst) of edges that link two nodes: without zero weights, self-loops and null ends."""
    return (prune_zeros(edges) if "weight" in edges.columns else edges).where("src <> dst").select("src", "dst")


def component_labels(edges: DataFrame, mask: DataFrame) -> DataFrame:
    """(node, component) of the subgraph on mask, direction and zero weights ignored; lone nodes are components."""
    inside, n = counted(induced(_linked(edges), mask), "inside")
    with wide(edges.sparkSession, n):
        found = connected_components(inside)
    return mask.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def component_sizes(edges: DataFrame, mask: DataFrame) -> DataFrame:
    """(component, size), largest first at the sink only."""
    return component_labels(edges, mask).groupBy("component").agg(F.count("*").alias("size"))


def component_counts(edges: DataFrame, mask: DataFrame) -> DataFrame:
    """One row: n_components and largest; zeros for an empty mask."""
    return component_sizes(edges, mask).agg(F.count("*").alias("n_components"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"))


def _nearest(ways: DataFrame, known: DataFrame) -> DataFrame:
    """(node, best): the least (distance, component) at the start of each way to a known node."""
    known = known.select(F.col("node").alias("end"), "distance", "component")
    best = F.min(F.struct((F.col("distance") + F.col("length")).alias("distance"), "component")).alias("best")
    return ways.join(known, "end").groupBy(F.col("src").alias("node")).agg(best)


def hop_distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, distance, component) of all nodes that reach a source over undirected edges, however far.

    sources are (node, component); on ties, of sources too, the least component is kept. Edges with a null end and
    self-loops lead nowhere. No way makes a source nearer, so edges that leave one are dropped before all else. Chains of
    nodes with two neighbours are contracted; then distances spread over what is left, one join and one written part of
    improved nodes a round, until a round improves none; last, inner nodes of chains take the nearer end's. So long
    chains cost rounds by the logarithm of their length.
    """
    reached, links = Rounds(edges.sparkSession, "reached"), _linked(edges)
    start = sources.where("node is not null").groupBy("node").agg(F.min("component").alias("component"))
    start, seen = reached.add(start.select("node", F.lit(0).alias("distance"), "component"), 0, n=F.count(F.lit(1)), bytes=F.sum(row_bytes(start.select("node"))))
    if not seen["n"]:
        return start
    hint = "broadcast" if seen["bytes"] <= BROADCAST_BYTES else "merge"
    leaving = links.union(links.select("dst", "src")).join(start.select(F.col("node").alias("src")).hint(hint), "src", "left_anti")
    with wide(edges.sparkSession, seen["n"]):
        near, n = counted(leaving.distinct(), "near")
    with wide(edges.sparkSession, max(n, seen["n"])):
        ways, frontier, hop, best = contracted(near), start, 0, None
        while seen["n"]:
            hop += 1
            step = _nearest(ways.where("not inner"), frontier)
            if best is not None:
                step = step.join(best, "node", "left").where("known is null or best < known")
            frontier, seen = reached.add(step.select("node", "best.*"), hop)
            # Sources are none of these nodes.
            best = reached.all().where("round > 0").groupBy("node").agg(F.min(F.struct("distance", "component")).alias("known"))
        ends = start.union(best.select("node", "known.*"))
        return stored(ends.union(_nearest(ways.where("inner"), ends).select("node", "best.*")), "distances")


def distance_histogram(distances: DataFrame, asked: DataFrame) -> DataFrame:
    """(distance, n) of the asked nodes; a null distance counts those that reach no source."""
    return asked.select("node").join(distances, "node", "left").groupBy("distance").agg(F.count("*").alias("n"))


def distance_summary(distances: DataFrame, asked: DataFrame) -> DataFrame:
    """One row over the asked nodes: n, unreached, least, most, and percentiles 0, 25, 50, 75, 90, 99."""
    joined = asked.select("node").join(distances, "node", "left")
    histogram = joined.groupBy("distance").agg(F.count("*").alias("n"))
    parts = [F.percentile("distance", p / 100, F.col("n")).alias(f"p{p}") for p in (0, 25, 50, 75, 90, 99)]
    return histogram.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("distance").isNull(), F.col("n"))), F.lit(0)).alias("unreached"), F.min("distance").alias("least"), F.max("distance").alias("most"), *parts
    )


def affiliation(distances: DataFrame, asked: DataFrame) -> DataFrame:
    """(component, n, n_next): asked nodes attached to each component, and those of them one hop away."""
    joined = asked.select("node").join(distances, "node")
    return joined.groupBy("component").agg(F.count("*").alias("n"), F.count_if(F.col("distance") == 1).alias("n_next"))


def touching(edges: DataFrame, labels: DataFrame, asked: DataFrame) -> DataFrame:
    """One row, n_touching: asked nodes that are next to two or more components."""
    near = symmetric(edges).join(asked.select(F.col("node").alias("src")), "src", "left_semi")
    pairs = near.join(labels.withColumnRenamed("node", "dst"), "dst").select("src", "component").distinct()
    return pairs.groupBy("src").count().agg(F.count_if(F.col("count") > 1).alias("n_touching"))
