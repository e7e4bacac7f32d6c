"""Hop distances over contracted chains, against waves."""

import random

import pytest

from fluxfield.operators import chains, distances, graph
from fluxfield.plans import staging


def _hops(pairs, sources):
    """node -> (distance, component), by one wave after another."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found, wave, distance = {n: (0, c) for n, c in sources}, dict(sources), 0
    while wave:
        distance += 1
        ahead = {}
        for n, c in wave.items():
            for m in near.get(n, ()):
                if m not in found:
                    ahead[m] = min(c, ahead.get(m, c))
        found |= {n: (distance, c) for n, c in ahead.items()}
        wave = ahead
    return found


def _chained(seed):
    """Paths, rings with and without sources, trees of chains and a knot, with sources that tie on chains."""
    rng = random.Random(seed)
    pairs, top = [(rng.randrange(6), rng.randrange(6)) for _ in range(9)], 6
    for _ in range(12):
        at, length = rng.randrange(top), rng.randint(1, 9)
        chain = [at, *range(top, top + length)]
        pairs += zip(chain, chain[1:])
        if rng.random() < 0.4:
            pairs.append((chain[-1], rng.randrange(top)))
        top += length
    for length in (3, 4, 7, 11):
        ring = list(range(top, top + length))
        pairs += zip(ring, ring[1:] + ring[:1])
        top += length
    pairs += zip(range(top, top + 20), range(top + 1, top + 21))
    return pairs, [(n, rng.randint(0, 3)) for n in sorted(rng.sample(range(top + 21), 4))]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_distances_over_contracted_chains(spark, seed):
    pairs, sources = _chained(seed)
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, weight double")
    got = distances.hop_distances(edges, spark.createDataFrame(sources, "node long, component long")).collect()
    assert {r.node: (r.distance, r.component) for r in got} == _hops(pairs, sources) and len(got) == len(_hops(pairs, sources))


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    add = staging.Rounds.add
    monkeypatch.setattr(staging.Rounds, "add", lambda self, *a, **k: rounds.append(self.path) or add(self, *a, **k))
    path = spark.range(2000).selectExpr("id AS src", "id + 1 AS dst", "1.0D AS weight")
    found = distances.hop_distances(path, spark.createDataFrame([(0, 5), (0, 4), (2000, 9)], "node long, component long"))
    assert found.where("distance <> least(node, 2000 - node) OR component <> if(node <= 1000, 4, 9)").isEmpty() and found.count() == 2001
    assert len(rounds) <= 16


def test_ways_of_chains(spark):
    near = graph.symmetric(spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 3), (3, 9), (3, 8), (20, 21), (21, 22), (22, 20)], "src long, dst long")).where("src <> dst")
    ways = chains.contracted(near, spark.createDataFrame([], "node long"))
    assert sorted(map(tuple, ways.collect())) == [(0, 3, 3, False), (1, 0, 1, True), (1, 3, 2, True), (2, 0, 2, True), (2, 3, 1, True), (3, 0, 3, False), (3, 8, 1, False), (3, 9, 1, False), (8, 3, 1, False), (9, 3, 1, False)]


def test_edges_that_leave_sources_are_dropped(spark, monkeypatch):
    """Of a long path whose nodes are sources but for the last few, only edges of these are written for the search."""
    written, counted = [], distances.counted
    monkeypatch.setattr(distances, "counted", lambda df, name: written.append((name, *(found := counted(df, name)))) or found)
    path = spark.range(1000).selectExpr("id AS src", "id + 1 AS dst", "1.0D AS weight")
    found = distances.hop_distances(path, spark.range(991).selectExpr("id AS node", "id % 7 AS component"))
    assert found.where("distance <> greatest(node - 990, 0) OR component <> least(node, 990) % 7").isEmpty() and found.count() == 1001
    assert [(name, n) for name, _, n in written] == [("near", 19)]


def test_labels_write_an_edge_once(spark, monkeypatch):
    """Edges inside the mask are written one way, without loops, zero weights and null ends; lone nodes stay."""
    written, counted = [], distances.counted
    monkeypatch.setattr(distances, "counted", lambda df, name: written.append((name, *(found := counted(df, name)))) or found)
    rows = [(1, 2, 1.0), (2, 3, -1.0), (3, 3, 1.0), (5, 6, 0.0), (8, 9, 1.0), (None, 5, 1.0), (7, 7, 2.0)]
    mask = spark.createDataFrame([(n,) for n in (1, 2, 3, 5, 6, 7, 8, 8)], "node long")
    got = distances.component_labels(spark.createDataFrame(rows, "src long, dst long, weight double"), mask)
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 6), (7, 7), (8, 8)]
    assert [(name, n) for name, _, n in written] == [("inside", 2)]
