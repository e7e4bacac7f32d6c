"""Paths over hubs: the same as without blocks, and spread over tasks."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fluxfield.operators import graph

EDGES = "src long, dst long, weight double"


def _hubs(seed, n=40, m=150):
    """Two hubs, one of them in and out, loops, repeats and weights of both signs."""
    rng = random.Random(seed)
    rows = [(rng.choice([0, 1, rng.randrange(n)]), rng.choice([0, rng.randrange(n)]), float(rng.randint(-3, 4))) for _ in range(m)]
    return rows + rows[:5] + [(n, n, 2.0), (n + 1, n, -1.0)]


@pytest.mark.parametrize("block", [1, 3, 16, 1024])
def test_path_product_by_blocks(spark, block):
    a, b = _hubs(1), _hubs(2)
    want = Counter()
    for s, m, w in a:
        for m2, d, v in b:
            if m == m2:
                want[s, d] += w * v
    frames = [spark.createDataFrame(rows, EDGES) for rows in (a, b)]
    got = {(r.src, r.dst): r.weight for r in graph.path_product(*frames, block).collect()}
    assert got == {k: w for k, w in want.items() if w > 0}
    assert graph.paths(*frames, block).count() == sum(m == m2 for _, m, _ in a for m2, _, _ in b)


def test_path_product_of_nothing(spark):
    e, none = spark.createDataFrame(_hubs(3), EDGES), spark.createDataFrame([], EDGES)
    assert graph.path_product(e, none, 1).isEmpty() and graph.path_product(none, e, 1).isEmpty()
    holes = spark.createDataFrame([(None, 1, 1.0), (1, None, 1.0), (1, 2, 1.0)], EDGES)
    assert sorted(graph.paths(holes, holes, 1).select("mid", "weight").collect()) == [(1, 1.0), (1, 1.0)]


def test_paths_of_a_hub_are_spread(spark):
    into = spark.range(1, 601).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(1.0).alias("weight"))
    out = into.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tasks = graph.paths(into, out, 32).groupBy(F.spark_partition_id().alias("task")).count().collect()
        whole = graph.paths(into, out).groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(r["count"] for r in tasks) == 360_000 == sum(r["count"] for r in whole)
    assert len(tasks) == 4 and max(r["count"] for r in tasks) <= 2 * 360_000 / 4


def test_two_hops_write_no_walks(spark, monkeypatch):
    """Walks of the last length are grouped with the edges; a table of them is not written."""
    rows, names, write = _hubs(5), [], graph.stored
    want, edge = Counter(), Counter()
    for s, m, w in rows:
        edge[s, m] += w
        for m2, d, v in rows:
            if m == m2:
                want[s, d] += w * v
    monkeypatch.setattr(graph, "stored", lambda df, name="table": names.append(name) or write(df, name))
    got = {(r.src, r.dst): r.weight for r in graph.k_hop(spark.createDataFrame(rows, EDGES), 2).collect()}
    total = {k: edge[k] + max(want[k], 0.0) for k in edge.keys() | want.keys()}
    assert got == {k: w for k, w in total.items() if w} and "hops" not in names
