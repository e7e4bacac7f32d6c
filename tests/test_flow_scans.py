"""Steps of small changes over large states."""

from pyspark.sql import functions as F

from fluxfield.operators import kernel
from fluxfield.operators.kernel import KernelParams, kernel_flow


def test_steps_of_small_changes_sort_nothing(spark, monkeypatch):
    """A state that is too large to be broadcast, and changes that are not: steps after the first only scan it."""
    edges = spark.range(299).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    state = spark.range(300).select(F.col("id").alias("node"), F.lit(1).alias("value"))
    plans, reached = [], kernel._Base.reached

    def seen(*a):
        rows = reached(*a)
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows

    monkeypatch.setattr(kernel._Base, "reached", seen)
    monkeypatch.setattr(kernel, "BROADCAST_BYTES", 5000)
    flow = kernel_flow(edges, state, KernelParams(), 4)
    assert len(plans) == 3 and not any("SortMergeJoin" in p for p in plans)
    assert flow.state.where("value = 0").count() == 4 and flow.state.columns == ["node", "value", "run_id"]
    assert {tuple(r) for r in flow.changes.collect()} == {("0", k, 300 - k, 1, 0) for k in range(1, 5)}
