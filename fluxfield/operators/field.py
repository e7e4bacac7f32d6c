"""Ternary fields on nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxfield.functions.scalar import sgn_deadzone
from fluxfield.plans.staging import observed, sized

from .graph import run_keys

#: Between these, products of two numbers neither vanish nor overflow.
TINY, HUGE = 1e-100, 1e100


def init_field(residual: DataFrame, nodes: DataFrame, eps: float | Column = 1e-9) -> DataFrame:
    """(node, value): the sign of each node's summed residual over its out-edges; 0 without any."""
    sums = residual.groupBy(F.col("src").alias("node")).agg(F.sum("residual").alias("total"))
    joined = nodes.select("node").join(sums, "node", "left")
    return joined.select("node", sgn_deadzone(F.coalesce("total", F.lit(0.0)), eps).alias("value"))


def _told_by_strength(seen: dict, eps: float) -> bool:
    """Whether every node's targets take at most half of the total, so that its sum is at least half of k_out, and all k_out
    other than 0 are clear of the dead zone and of the ends of doubles by more than sums are rounded."""
    total, taken, out, least, most = (seen[k] for k in ("total", "taken", "out", "least", "most"))
    if None in (total, taken, out, least, most):
        return False
    return TINY < total < HUGE and out * taken <= total / 2 and max(4 * eps, TINY) < least and most < HUGE


def init_field_exact(edges: DataFrame, eps: float = 1e-9) -> DataFrame:
    """init_field of the sparse residual without its rounding: k_out (total - in-strength of targets) / total.

    For whole weights the difference is exact, so nodes whose targets take all in-strength get exactly 0. Edges may be
    those of several graphs under run_id, as the field then is. Where no targets can take half of the total, that is the
    sign of k_out, and in-strengths need not be joined to edges.
    """
    keys = run_keys(edges)
    if not keys:
        rows = edges.select(F.col("src").alias("node"), F.col("weight").alias("k_out"), F.lit(1).alias("out"))
        rows = rows.unionByName(edges.select(F.col("dst").alias("node"), F.col("weight").alias("k_in")), allowMissingColumns=True)
        found = rows.groupBy("node").agg(F.sum("k_out").alias("k_out"), F.count("out").alias("n_out"), F.sum("k_in").alias("k_in"))
        size = F.abs("k_out")
        seen = {"total": F.sum("k_out"), "taken": F.max(F.abs("k_in")), "out": F.max("n_out"), "least": F.min(F.when(size != 0, size)), "most": F.max(size)}
        found, seen = observed(found, "strengths", **seen)
        if _told_by_strength(seen, eps):
            return found.select("node", sgn_deadzone(F.coalesce("k_out", F.lit(0.0)), eps).alias("value"))
    total = edges.groupBy(*keys).agg(F.sum("weight").alias("total"))
    into = sized(edges.groupBy(*keys, "dst").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("k_in")), "in-strengths", hint="shuffle_hash")
    # What edges give their source and what nodes without one have meet in one grouping, so no strengths are joined to it.
    taken = F.when(F.col("src").isNotNull(), F.col("k_in")).alias("taken")
    given = edges.join(into, [*keys, "dst"], "left").select(*keys, F.col("src").alias("node"), F.col("weight").alias("k_out"), taken)
    rows = given.unionByName(into.select(*keys, F.col("dst").alias("node")), allowMissingColumns=True)
    joined = rows.groupBy(*keys, "node").agg(F.sum("k_out").alias("k_out"), F.sum("taken").alias("taken"))
    # total has a row for each graph.
    joined = joined.join(F.broadcast(total), keys) if keys else joined.join(F.broadcast(total))
    sums = F.when(F.col("total") > 0, F.coalesce("k_out", F.lit(0.0)) * (F.col("total") - F.coalesce("taken", F.lit(0.0))) / F.col("total")).otherwise(F.lit(0.0))
    return joined.select(*keys, "node", sgn_deadzone(sums, eps).alias("value"))


def field_balance(state: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Counts of +1, 0 and -1, over all rows or by keys."""
    counts = [F.count_if(F.col("value") == v).alias(n) for v, n in ((1, "positive"), (0, "zero"), (-1, "negative"))]
    return state.groupBy(*keys).agg(*counts) if keys else state.agg(*counts)


def coarse_field(state: DataFrame, blocks: DataFrame) -> DataFrame:
    """Block sums, then sign: (block_id, [channel,] value) from (node, [channel,] value) and (node, block_id)."""
    keys = ["block_id", *[c for c in ("run_id", "channel") if c in state.columns]]
    joined = state.join(blocks.select("node", "block_id"), "node")
    return joined.groupBy(*keys).agg(sgn_deadzone(F.sum("value"), 0.0).alias("value"))
