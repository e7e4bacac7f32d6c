"""Chains of nodes with two neighbours, contracted to links that carry their length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxfield.plans.staging import BROADCAST_BYTES, Rounds, observed, row_bytes, stored


def contracted(near: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(src, end, length, inner) for every edge of near that leads to an end of its chain.

    near is symmetric, without loops and repeats; all edges that leave a node may be missing, which makes it an end that
    no way starts from. Nodes with two neighbours are inner unless they are among the kept ones; all others are ends. Following an edge through inner nodes, `end` is the first end and `length` the edges on
    the way; `inner` tells whether src is inner itself. Edges of rings without an end, and ways back to src, are left
    out. Pointers are doubled, so rounds grow with the logarithm of the longest chain; each round writes only the edges
    that it moved.
    """
    degrees = near.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("lo"), F.max("dst").alias("hi"))
    inner = degrees.where("n = 2").drop("n")
    if kept is not None:
        inner = inner.join(kept.select("node"), "node", "left_anti")
    inner, size = observed(inner, "inner", n=F.count(F.lit(1)), bytes=F.sum(row_bytes(inner)))
    if not size["n"]:
        return near.select("src", F.col("dst").alias("end"), F.lit(1).alias("length"), F.lit(False).alias("inner"))
    inner = inner.hint("broadcast" if size["bytes"] <= BROADCAST_BYTES else "merge")
    mark = inner.select("node", F.lit(True).alias("inner"))
    marked = lambda df, end: df.join(mark.withColumnRenamed("node", end), end, "left").withColumn("inner", F.coalesce("inner", F.lit(False)))

    # An edge src -> first, followed as far as last -> end.
    other = F.when(F.col("src") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    edges = near.join(inner.withColumnRenamed("node", "dst"), "dst").select("src", F.col("dst").alias("first"), F.col("dst").alias("last"), other.alias("end"), F.lit(2).alias("length"))
    ways, counts = Rounds(near.sparkSession, "chains"), {"left": F.count_if(~F.col("done")), "ended": F.count_if("done")}
    moved, seen = ways.add(marked(edges, "end").withColumn("done", ~F.col("inner")).drop("inner"), 0, **counts)
    k = 0
    # A chain has an edge at every distance from its end, so a round that ends none leaves rings only.
    while seen["left"] and (k == 0 or seen["ended"]):
        k += 1
        active = moved.where("not done")
        ahead = ways.all().where("done").drop("round").unionByName(active)
        ahead = ahead.select(F.col("src").alias("last"), F.col("first").alias("end"), F.col("last").alias("_last"), F.col("end").alias("_end"), F.col("length").alias("_length"), F.col("done").alias("_done"))
        step = active.join(ahead, ["last", "end"]).select("src", "first", F.col("_last").alias("last"), F.col("_end").alias("end"), (F.col("length") + F.col("_length") - 1).alias("length"), F.col("_done").alias("done"))
        moved, seen = ways.add(step, k, **counts)
    direct = marked(near, "dst").where("not inner").select("src", F.col("dst").alias("end"), F.lit(1).alias("length"))
    found = direct.unionByName(ways.all().where("done").select("src", "end", "length")).where("src <> end")
    return stored(marked(found, "src").select("src", "end", "length", "inner"), "ways")
