"""Coarse-graining: maps from nodes to blocks, and the graphs between blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxfield.functions.scalar import UNKNOWN, primary_region, voxel_label, with_side
from fluxfield.plans.staging import Rounds, counted, stored

from .graph import dense_index, nodes_of, prune_zeros, symmetric, total_strength


def _blocks_of_order(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """Consecutive runs of `size` nodes of an order; the last block may be short."""
    if size <= 0:
        raise ValueError("the block size is not positive")
    placed = dense_index(df, order, "_place")
    return placed.select("node", F.expr(f"_place div {int(size)}").cast("long").alias("block_id"))


def random_blocks(nodes: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """(node, block_id) by a seeded hash order, the same on every run and machine."""
    return _blocks_of_order(nodes.select("node"), [F.md5(F.concat(F.lit(f"{seed}:"), F.col("node").cast("string"))), F.col("node")], size)


def degree_blocks(edges: DataFrame, size: int) -> DataFrame:
    """(node, block_id) in ascending order of total strength, ties by node."""
    return _blocks_of_order(total_strength(edges), [F.col("strength"), F.col("node")], size)


def radius_blocks(edges: DataFrame, radius: int, nodes: DataFrame | None = None) -> DataFrame:
    """(node, block_id) of greedy hop-radius clusters, in parallel rounds with the sequential result.

    Sequentially: nodes in order are seeds unless taken, and a seed takes the untaken nodes within `radius` hops of it
    through untaken nodes. In parallel: an untaken node that is the least within twice the radius, through untaken
    nodes, is such a seed for certain, and the balls of two of these are apart; all take theirs at once, and the rest
    goes on. Rounds are few for most orders; for a path in order they grow with its length. Every round takes at least
    the least node left, so they end. Null nodes are left out.
    """
    if radius < 0:
        raise ValueError("the radius is negative")
    left = (nodes_of(edges) if nodes is None else nodes.select("node")).where("node is not null").distinct()
    if radius == 0:
        return dense_index(left, [F.col("node")], "block_id")
    (left, n), near = counted(left, "left"), stored(symmetric(edges).where("src <> dst"), "near")

    def spread(values: DataFrame, near: DataFrame) -> DataFrame:
        """The least value of each node and its neighbours, where any of them has one."""
        moved = near.join(values.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "value")
        return values.select("node", "value").union(moved).groupBy("node").agg(F.min("value").alias("value"))

    taken, number = Rounds(edges.sparkSession, "taken"), 0
    while n or not number:
        least = left.select("node", F.col("node").alias("value"))
        for _ in range(2 * radius):
            least = spread(least, near)
        owner = least.where("node = value")
        for _ in range(radius):
            owner = spread(owner, near)
        owner, _ = taken.add(owner, number)
        left, n = counted(left.join(owner, "node", "left_anti"), "left")
        gone = owner.select("node")
        near = near.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        near, number = stored(near.select("src", "dst"), "near"), number + 1
    owners = taken.all().drop("round")
    ids = dense_index(owners.select(F.col("value").alias("seed")).distinct(), [F.col("seed")], "block_id")
    return owners.join(ids, F.col("value") == F.col("seed")).select("node", "block_id")


def block_edges(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(src, dst, weight) between blocks, self-loops kept, zero sums left out."""
    a = blocks.select(F.col("node").alias("src"), F.col("block_id").alias("_a"))
    b = blocks.select(F.col("node").alias("dst"), F.col("block_id").alias("_b"))
    joined = edges.join(a, "src").join(b, "dst")
    return prune_zeros(joined.groupBy(F.col("_a").alias("src"), F.col("_b").alias("dst")).agg(F.sum("weight").alias("weight")))


def block_summary(blocks: DataFrame, coarse: DataFrame) -> DataFrame:
    """One row: n_blocks, mean_size, n_edges."""
    sizes = blocks.groupBy("block_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_blocks"), F.avg("n").alias("mean_size"))
    return sizes.join(F.broadcast(coarse.agg(F.count("*").alias("n_edges"))))  # one row each


def region_map(meta: DataFrame, unknown: str = UNKNOWN, use_side: bool = False) -> DataFrame:
    """meta with `label` from roi_info_json and rois, and the side if asked for, where it has these columns.

    The unknown label takes no side.
    """
    given = lambda c: F.col(c) if c in meta.columns else F.lit(None).cast("string")
    label = primary_region(given("roi_info_json"), given("rois"), unknown)
    return meta.withColumn("label", with_side(label, given("side"), unknown) if use_side else label)


def voxel_map(meta: DataFrame, size: float, unknown: str = UNKNOWN) -> DataFrame:
    """meta with `label` from soma_x, soma_y, soma_z; a missing one is a KeyError."""
    for c in ("soma_x", "soma_y", "soma_z"):
        if c not in meta.columns:
            raise KeyError(c)
    return meta.withColumn("label", voxel_label(F.col("soma_x"), F.col("soma_y"), F.col("soma_z"), size, unknown))


def label_edges(edges: DataFrame, labels: DataFrame, unknown: str = UNKNOWN, drop_unknown: bool = False, order: str | None = None) -> DataFrame:
    """(src, dst, weight) between labels; ends without a label are unknown. Of a node's labels the last by order counts."""
    last = F.max_by("label", order) if order else F.max("label")
    one = labels.groupBy("node").agg(last.alias("label"))
    a, b = one.select(F.col("node").alias("src"), F.col("label").alias("_a")), one.select(F.col("node").alias("dst"), F.col("label").alias("_b"))
    joined = edges.join(a, "src", "left").join(b, "dst", "left").select(*[F.coalesce(c, F.lit(unknown)).alias(c) for c in ("_a", "_b")], "weight")
    if drop_unknown:
        joined = joined.where((F.col("_a") != unknown) & (F.col("_b") != unknown))
    return joined.groupBy(F.col("_a").alias("src"), F.col("_b").alias("dst")).agg(F.sum("weight").alias("weight"))


def label_table(labels: DataFrame) -> DataFrame:
    """(label, label_index, n_members): members are metadata rows, the index is the rank of the label."""
    return dense_index(labels.groupBy("label").agg(F.count("*").alias("n_members")), [F.col("label")], "label_index")
