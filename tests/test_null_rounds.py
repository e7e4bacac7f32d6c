"""What a round of null models shuffles and writes."""

import pytest
from test_models import EDGES, brute_rewired, graph

from fluxfield.operators import kernel, nulls
from fluxfield.plans import jobs, staging


@pytest.mark.parametrize("bits, sent", [(40, None), (3, None), (40, -1)])
def test_marks_that_are_shared(spark, monkeypatch, bits, sent):
    """Edges whose marks match others' by chance, and more dropped pairs than may be broadcast, change no result."""
    monkeypatch.setattr(nulls, "MARK_BITS", bits)
    if sent is not None:
        monkeypatch.setattr(nulls, "BROADCAST_BYTES", sent)
    rows = graph(40, 150, 5)
    edges = nulls.rewired(spark.createDataFrame(rows, EDGES), 3, 5, 2).edges
    for run in ("null-0", "null-1"):
        assert sorted((r.src, r.dst, r.weight) for r in edges.collect() if r.run_id == run) == brute_rewired(rows, 3, 5, run)


def test_a_round_writes_edges_once(spark, monkeypatch):
    """Pairs are written whole; of what proposals are compared by only what several share."""
    written, named = {}, {}

    def keep(found, name):
        named[name] = named.get(name, 0) + 1
        written[name] = written.get(name, 0) + found.count()
        return found

    for name in ("stored", "observed", "counted"):
        write = getattr(nulls, name)
        monkeypatch.setattr(nulls, name, lambda df, name="table", *a, write=write, **k: (lambda found: (keep(found[0] if isinstance(found, tuple) else found, name), found)[1])(write(df, name, *a, **k)))
    # Sparse, so that few proposals name an edge that is there.
    edges = spark.range(4000).selectExpr("id AS src", "(id * 7 + 1) % 4000 AS dst", "1.0D AS weight").where("src <> dst")
    rows = edges.count()
    found = nulls.rewired(edges, 3, 1, 1)
    assert found.edges.count() == rows and named["pairs"] == 3 and named["rewired"] == 1
    assert written["rewired"] == rows and written["pairs"] <= 3 * (rows // 2 + rows // nulls.BUCKET_EDGES)
    assert sum(n for name, n in written.items() if name not in ("rewired", "pairs")) < rows / 20


def test_null_runs_write_first_fields_wide(spark, monkeypatch):
    """First fields of all copies get partitions by their edges, and the flow does not write the copies again."""
    parts, names, write = {}, [], jobs.stored
    monkeypatch.setattr(staging, "PART_ROWS", 20)
    monkeypatch.setattr(jobs, "stored", lambda df, name="table": (parts.update({name: int(spark.conf.get("spark.sql.shuffle.partitions"))}), write(df, name))[1])
    count = kernel.counted
    monkeypatch.setattr(kernel, "counted", lambda df, name: names.append(name) or count(df, name))
    rows = graph(40, 150, 5)
    flow, found = jobs.null_runs(spark.createDataFrame(rows, EDGES), 2, 1, 1, 1e-9, 2)
    assert parts["null-first"] == 15 and "flow-edges" not in names
    assert found.edges.count() == 300 and flow.status.count() == 2
