"""Flows by increments against whole steps, and what they write."""

import random

import pytest
from pyspark.sql import functions as F

from fluxfield.operators import kernel
from fluxfield.operators.kernel import KernelParams, exact_sums, kernel_flow

EDGES = "run_id string, src long, dst long, weight double"


def drawn(seed, run, n=40, m=70):
    draw = random.Random(seed)
    found = {(draw.randrange(n), draw.randrange(n)): draw.choice([-3.0, -1.0, 0.5, 1.0, 2.0]) for _ in range(m)}
    return [(run, a, b, w) for (a, b), w in found.items()], [(run, v, draw.choice([-1, 0, 1])) for v in range(n)]


def result(flow):
    return {
        "status": sorted(flow.status.collect(), key=str),
        "curve": sorted(flow.curve.collect(), key=str),
        "changes": sorted((r.run_id, r.step, r.node, r.prev, r.new) for r in flow.changes.collect()),
        "state": sorted((r.run_id, r.node, r.value) for r in flow.state.collect()),
    }


@pytest.mark.parametrize("large", [False, True])
def test_increments_are_whole_steps(spark, monkeypatch, large):
    """Several runs that close, come back or are stopped, at different steps; small tables and bucketed ones."""
    edges, states = [], []
    for seed in range(5):
        e, s = drawn(seed, str(seed))
        edges, states = edges + e, states + s
    edges, state = spark.createDataFrame(edges, EDGES), spark.createDataFrame(states, "run_id string, node long, value int")
    eps = {str(seed): 0.25 * seed for seed in range(5)}
    assert exact_sums(edges)
    if large:
        monkeypatch.setattr(kernel, "BROADCAST_BYTES", 0)
    got = result(kernel_flow(edges, state, KernelParams(deadzone=eps), 25))
    monkeypatch.setattr(kernel, "exact_sums", lambda edges: False)
    want = result(kernel_flow(edges, state, KernelParams(deadzone=eps), 25))
    assert got == want
    assert {r.status for r in got["status"]} >= {"converged", "cycle"} and len({r.step for r in got["status"]}) > 2
    assert {r[1] for r in got["changes"]} >= {1, 2, 3}


def test_rows_written_follow_the_defect(spark, monkeypatch):
    """A chain of 300 nodes fades from its end, one node a step: later steps write one row each, however many cells."""
    edges = spark.range(299).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    state = spark.range(300).select(F.col("id").alias("node"), F.lit(1).alias("value"))
    written, add = [], kernel._add
    monkeypatch.setattr(kernel, "_add", lambda *a: written.append(add(*a)) or written[-1])
    flow = kernel_flow(edges, state, KernelParams(), 6)
    assert [now.count() for now, _ in written] == [300, 1, 1, 1, 1, 1]
    assert sorted((r.step, r.node) for r in flow.changes.collect()) == [(k, 300 - k) for k in range(1, 7)]
    assert flow.state.where("value = 0").count() == 6 and flow.state.count() == 300


def test_base_is_folded(spark, monkeypatch):
    """A ring that turns for ever reaches two cells a step; the rows written outgrow the base of 12 in the eighth."""
    edges = spark.range(12).select(F.col("id").alias("src"), ((F.col("id") + 1) % 12).alias("dst"), F.lit(2.0).alias("weight"))
    state = spark.range(12).select(F.col("id").alias("node"), F.when(F.col("id") == 0, -1).otherwise(1).alias("value"), F.lit(0.5).alias("eps"))
    folds, folded = [], kernel._Base.folded
    monkeypatch.setattr(kernel._Base, "folded", lambda self, table, step: folds.append(step) or folded(self, table, step))
    flow = kernel_flow(edges, state, KernelParams(deadzone=F.col("eps")), 40)
    assert flow.status.first()[1:] == ("cycle", 12, 0) and folds == [8]
    assert sorted((r.node, r.value, r.eps) for r in flow.state.collect()) == [(v, -1 if v == 0 else 1, 0.5) for v in range(12)]


def test_sums_that_are_not_exact(spark):
    """Tenths, huge weights and numbers that are not finite make whole steps; no edges at all are exact."""
    for weights, want in (([1.0, 2.5, -0.25], True), ([0.1], False), ([2.0**46, 1.0], False), ([float("nan")], False), ([float("inf")], False), ([], True), ([None, 3.0], True)):
        assert exact_sums(spark.createDataFrame([(w,) for w in weights], "weight double")) is want
    edges = spark.createDataFrame([(0, 1, 0.1), (1, 2, 0.2), (2, 3, 0.3)], "src long, dst long, weight double")
    state = spark.createDataFrame([(v, 1) for v in range(4)], "node long, value int")
    flow = kernel_flow(edges, state)
    assert flow.status.first()["step"] == 5 and sorted(r.new for r in flow.changes.collect()) == [0] * 4


def test_null_values_turn_into_signs(spark):
    """A null counts as 0 in sums, and its first sign as no change, as in whole steps; later steps see it."""
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 0, 1.0), (3, 0, 1.0)], "src long, dst long, weight double")
    state = spark.createDataFrame([(0, None), (1, 1), (2, -1), (3, 0)], "node long, value int")
    flow = kernel_flow(edges, state, steps=4, cycle_check=False)
    now, want = {0: 0, 1: 1, 2: -1, 3: 0}, []
    for _ in range(4):
        now = {0: now[1], 1: now[2], 2: now[0], 3: now[0]}
        want.append(dict(now))
    assert {r.node: r.value for r in flow.state.collect()} == want[-1]
