"""Walks made where their sources' edges lie: the same sums, and targets' edges sent once a range."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_paths import EDGES, _hubs

from fluxfield.operators import graph


def _sums(rows, hops):
    edge, total = Counter(), Counter()
    for s, d, w in rows:
        edge[s, d] += w
    total, reach = Counter(edge), dict(edge)
    for _ in range(hops - 1):
        found = Counter()
        for (s, m), w in reach.items():
            for (m2, d), v in edge.items():
                if m == m2 and m is not None:
                    found[s, d] += w * v
        reach = {k: w for k, w in found.items() if w > 0}
        for k, w in reach.items():
            total[k] += w
    return {k: w for k, w in total.items() if w}


@pytest.mark.parametrize("walks", [1, 40, 1 << 21])
@pytest.mark.parametrize("hops", [2, 3])
def test_sums_by_ranges_and_cuts(spark, monkeypatch, walks, hops):
    rows = _hubs(7) + [(None, 1, 2.0), (3, None, 4.0)]
    monkeypatch.setattr(graph, "WALKS", walks)
    found = graph.k_hop(spark.createDataFrame(rows, EDGES), hops).collect()
    assert {(r.src, r.dst): r.weight for r in found} == _sums(rows, hops) and len(found) == len(_sums(rows, hops))


def test_k_hop_of_nothing(spark):
    assert graph.k_hop(spark.createDataFrame([], EDGES), 2).isEmpty()
    one = graph.k_hop(spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], "src string, dst string, weight double"), 2)
    assert sorted(map(tuple, one.collect())) == [("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 2.0)]


def test_walks_are_not_shuffled(spark, monkeypatch):
    """What is joined before the exchange is a row for each edge of a range's targets, not for each walk."""
    first = spark.range(60 * 20).select((F.col("id") % 60).alias("src"), (100 + F.floor(F.col("id") / 60)).alias("dst"), F.lit(1.0).alias("weight"))
    edges = first.union(first.select("dst", F.col("src") + 200, "weight")).cache()
    sent, paths = [], graph.paths
    monkeypatch.setattr(graph, "paths", lambda *a: (lambda found: (sent.append(found.count()), found)[1])(paths(*a)))
    found = graph.k_hop(edges, 2)
    assert found.count() == 2 * 1200 + 3600 and found.where("src < 100 and dst >= 200").agg(F.min("weight"), F.max("weight")).first() == (20.0, 20.0)
    assert sum(sent) <= 60 * 20 * 60 / 10
