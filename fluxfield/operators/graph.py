"""Basic operators on edge tables (src, dst, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxfield.plans.staging import BROADCAST_BYTES, PART_ROWS, observed, row_bytes, stored, wide

#: Edges of a node, in or out, above which its paths are joined block by block.
HUB_BLOCK = 1024
#: Walks that a task makes and adds up, about; their sums stay in its memory.
WALKS = 1 << 21


def collapse_edges(edges: DataFrame) -> DataFrame:
    """One row a pair, with the sum of weights; zero sums stay."""
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def graph_size(edges: DataFrame) -> DataFrame:
    """One row: n_nodes, n_edges."""
    nodes = nodes_of(edges).agg(F.count("*").alias("n_nodes"))
    return nodes.join(F.broadcast(edges.agg(F.count("*").alias("n_edges"))))  # one row each


def run_keys(df: DataFrame) -> list[str]:
    """run_id, where a table has several graphs or states under it."""
    return [c for c in ("run_id",) if c in df.columns]


def strengths(edges: DataFrame) -> DataFrame:
    """([run_id,] node, k_out, k_in) of every node, in one shuffle."""
    keys = run_keys(edges)
    ends = edges.select(
        *keys,
        F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("weight").alias("out"), F.lit(0.0).alias("in")), F.struct(F.col("dst").alias("node"), F.lit(0.0).alias("out"), F.col("weight").alias("in")))).alias("e")
    )
    return ends.groupBy(*keys, "e.node").agg(F.sum("e.out").alias("k_out"), F.sum("e.in").alias("k_in"))


def total_strength(edges: DataFrame) -> DataFrame:
    """(node, strength): out plus in."""
    return strengths(edges).select("node", (F.col("k_out") + F.col("k_in")).alias("strength"))


def prune_zeros(edges: DataFrame) -> DataFrame:
    return edges.where("weight <> 0")


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst) both ways of every edge whose weight is not zero, once each."""
    some = edges.where("weight <> 0") if "weight" in edges.columns else edges
    return some.select("src", "dst").union(some.select("dst", "src")).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes."""
    for end in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return edges


def add_graphs(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of supports with summed weights."""
    return collapse_edges(a.select("src", "dst", "weight").unionByName(b.select("src", "dst", "weight")))


def paths(a: DataFrame, b: DataFrame, block: int = HUB_BLOCK) -> DataFrame:
    """(src, mid, dst, weight): an edge of a followed by one of b, with the product of their weights.

    A middle node with more than `block` edges on a side makes as many paths as the product of its degrees. Its edges
    are dealt to blocks of about that many by their other end, and each pair of an incoming and an outgoing block is
    joined by itself, so no task has all paths of a hub. Copies of edges that this takes are at most a 2/block of the
    paths. Other nodes are joined as they are.
    """
    left = a.where("dst is not null").select("src", F.col("dst").alias("mid"), "weight")
    right = b.where("src is not null").select(F.col("src").alias("mid"), F.col("dst").alias("_end"), F.col("weight").alias("_w"))
    into, out = left.groupBy("mid").agg(F.count("*").alias("n_in")), right.groupBy("mid").agg(F.count("*").alias("n_out"))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    hubs = into.join(out, "mid").where(F.greatest("n_in", "n_out") > block).select("mid", blocks("n_in").alias("ins"), blocks("n_out").alias("outs"))
    hubs, seen = observed(hubs, "hubs", n=F.count(F.lit(1)), bytes=F.sum(row_bytes(hubs)))
    keys = ["mid"]
    if seen["n"]:
        hubs = hubs.hint("broadcast" if seen["bytes"] <= BROADCAST_BYTES else "merge")
        left, right = (side.join(hubs, "mid", "left").fillna(1, ["ins", "outs"]) for side in (left, right))
        dealt = lambda end, n: F.pmod(F.xxhash64(end), F.col(n)).cast("int")
        copies = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = left.select("src", "mid", "weight", dealt("src", "ins").alias("_in"), copies("outs").alias("_out"))
        right = right.select("mid", "_end", "_w", dealt("_end", "outs").alias("_out"), copies("ins").alias("_in")).hint("merge")
        keys += ["_in", "_out"]
    return left.join(right, keys).select("src", "mid", F.col("_end").alias("dst"), (F.col("weight") * F.col("_w")).alias("weight"))


def path_product(a: DataFrame, b: DataFrame, block: int = HUB_BLOCK) -> DataFrame:
    """Sums over middle nodes of products of weights, clipped at zero; pairs of weight zero are left out."""
    pairs = paths(a, b, block).groupBy("src", "dst")
    return pairs.agg(F.greatest(F.sum("weight"), F.lit(0.0)).alias("weight")).where("weight <> 0")


def k_hop(edges: DataFrame, hops: int) -> DataFrame:
    """Edges plus, for each walk length up to hops, the clipped sums of walks. hops of 1 or less: the edges.

    The longest walks are made and added up where their sources' edges lie (see _with_walks), so they are not shuffled.
    For one flow over a graph without negative weights, kernel_step does the same without this table.
    """
    if hops <= 1:
        return edges
    rows = edges.select("src", "dst", F.col("weight").cast("double").alias("step"))
    if hops > 2:
        reach, total = edges, edges
        for _ in range(hops - 2):
            reach = stored(path_product(reach, edges), "hops")
            total = add_graphs(total, reach)
        both = total.select("src", "dst", F.col("weight").alias("own")).unionByName(reach.select("src", "dst", F.col("weight").alias("step")), allowMissingColumns=True)
        rows = both.groupBy("src", "dst").agg(F.sum("step").alias("step"), F.sum("own").alias("own"))
    return _with_walks(rows, edges)


def _with_walks(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, weight): own of rows (src, dst, step[, own]), or step if there is no own, plus the clipped sums of steps
    followed by an edge; zeros are left out.

    Rows are cut in ranges of sources of about WALKS walks. A range is sent each target's edges once, however many of its
    rows lead there, and makes and adds up its walks by itself: what is shuffled follows the targets of ranges, not the
    walks, of which it is at most as many. Ranges of more walks, as of hubs, are cut again by the walks' ends, each cut
    with all rows of the range, as long as these are fewer than the walks.
    """
    spark, own = rows.sparkSession, "own" if "own" in rows.columns else "step"
    size = edges.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("src").alias("sources")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["n"] // PART_ROWS))
    ranges = max(1, -(-size["n"] ** 2 // max(size["sources"], 1) // WALKS))
    with wide(spark, size["n"]):
        ranged = stored(rows.repartitionByRange(ranges, "src").withColumn("block", F.spark_partition_id()), "ranged")
        out = edges.where("src is not null").groupBy(F.col("src").alias("dst")).agg(F.count("*").alias("n_out"))
        needs = ranged.where("dst is not null and step is not null").groupBy("block", "dst").agg(F.count("*").alias("n_in"))
        needs = stored(needs.join(out.hint("merge"), "dst"), "needs")
        walks = needs.groupBy("block").agg(F.sum(F.col("n_in") * F.col("n_out")).alias("walks"))
        cuts = ranged.groupBy("block").agg(F.count("*").alias("n")).join(walks.hint("merge"), "block", "left").fillna(0, ["walks"])
        cuts = cuts.select("block", F.greatest(F.lit(1), F.ceil(F.least(F.col("walks") / WALKS, F.col("walks") / F.col("n")))).cast("int").alias("cuts"))
        # One row a range.
        before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        cuts, seen = observed(cuts.withColumn("first", F.coalesce(F.sum("cuts").over(before), F.lit(0)).cast("int")), "cuts", cells=F.sum("cuts"))
    cell = lambda at: (F.col("first") + F.pmod(F.xxhash64(at), F.col("cuts"))).cast("int")
    # Dealt beforehand, as lazy joins are planned with the session's number of partitions.
    sent = paths(needs.select(F.col("block").alias("src"), "dst", F.lit(1.0).alias("weight")).repartition(parts, "dst"), edges.where("weight is not null").select("src", "dst", F.col("weight").cast("double").alias("weight")).repartition(parts, "src"))
    sent = sent.join(F.broadcast(cuts), F.col("src") == F.col("block")).select(cell("dst").alias("cell"), "mid", F.col("dst").alias("end"), "weight", F.lit(False).alias("into"))
    each = ranged.join(F.broadcast(cuts), "block").withColumn("cell", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("cuts") - 1)))
    here = F.when(F.col("cell") == cell("dst"), F.col(own)).alias("own")
    each = each.select("cell", F.col("dst").alias("mid"), F.col("src").alias("end"), F.col("step").alias("weight"), F.lit(True).alias("into"), here)
    met = each.unionByName(sent, allowMissingColumns=True).repartitionById(max(1, seen["cells"] or 0), "cell").groupBy("cell", "mid")
    met = met.agg(F.collect_list(F.when(F.col("into"), F.struct("end", "weight", "own"))).alias("ins"), F.collect_list(F.when(~F.col("into"), F.struct("end", "weight"))).alias("outs"))
    # A row itself is the end without a weight.
    ends = F.concat("outs", F.array(F.struct(F.col("mid").alias("end"), F.lit(None).cast("double").alias("weight"))))
    found = met.select("cell", F.explode("ins").alias("i"), ends.alias("ends")).select("cell", "i", F.explode("ends").alias("o"))
    found = found.select("cell", F.col("i.end").alias("src"), F.col("o.end").alias("dst"), F.when(F.col("o.weight").isNull(), F.col("i.own")).alias("own"), (F.col("i.weight") * F.col("o.weight")).alias("walk"))
    zero = F.lit(0.0)
    sums = found.groupBy("cell", "src", "dst").agg((F.coalesce(F.sum("own"), zero) + F.greatest(F.sum("walk"), zero)).alias("weight"))
    return prune_zeros(sums.select("src", "dst", "weight"))


def dense_index(df: DataFrame, order: list[Column], name: str = "node_index") -> DataFrame:
    """Add 0..N-1 by a global order, without putting all rows in one task.

    Rows are range-partitioned and sorted; each partition's offset is the count of rows in those before it.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Written once, so that ranges (chosen from samples) cannot differ between the count and the numbering.
    placed = stored(ranged.withColumn("_id", F.monotonically_increasing_id()), "index")
    placed = placed.withColumn("_part", F.shiftright("_id", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row a partition.
    offsets = placed.groupBy("_part").agg(F.count("*").alias("n")).withColumn("_offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rank = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets.drop("n")), "_part").withColumn(name, (rank + F.col("_offset")).cast("long")).drop("_part", "_offset", "_id")


def first_seen_index(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """(node, node_index): nodes of (source, target, seq) in order of first mention, source before target."""
    ends = rows.select(F.explode(F.array(F.struct(F.col("source").alias("node"), (2 * F.col(seq)).alias("at")), F.struct(F.col("target").alias("node"), (2 * F.col(seq) + 1).alias("at")))).alias("e"))
    seen = ends.groupBy("e.node").agg(F.min("e.at").alias("at"))
    return dense_index(seen, [F.col("at").asc()]).select("node", "node_index")
