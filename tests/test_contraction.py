"""Components by contraction."""

import random

from fluxfield import queries
from fluxfield.operators import components, distances


def test_components_shrink(spark, monkeypatch):
    """Components are those of a search by hand, and the edges of all rounds together are few times the given ones."""
    rng, written = random.Random(3), []
    pairs = [(k, k + 1) for k in range(400) if k % 50] + [(rng.randrange(500, 700), rng.randrange(500, 700)) for _ in range(120)] + [(900, 901 + k) for k in range(60)] + [(2000, 2000), (None, 7)]
    root = {v: v for p in pairs if None not in p for v in p}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        if a is not None:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    observed = components.observed
    monkeypatch.setattr(components, "observed", lambda df, name, **m: written.append((name, found := observed(df, name, **m))) or found)
    got = components.connected_components(spark.createDataFrame(pairs, "src long, dst long"))
    assert sorted(map(tuple, got.collect())) == sorted((v, top(v)) for v in root)
    assert sum(f[1]["n"] for name, f in written if name in ("edges", "stars")) < 3 * len(pairs)
    monkeypatch.setattr(components, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, components.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect())) == sorted((v, top(v)) for v in root)
    assert components.connected_components(spark.createDataFrame([], "src long, dst long")).isEmpty()


def test_touching_nodes_need_no_distances(spark, monkeypatch):
    def fail(*a):
        raise AssertionError("distances are not asked for")

    monkeypatch.setattr(distances, "hop_distances", fail)
    assert queries.QUERIES["touching_nodes"](spark, "/root/testdata/sf0.001").count() == 1
