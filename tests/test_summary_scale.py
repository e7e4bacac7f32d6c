"""Summaries and flows over large states: one join of states and labels, and nothing sorted."""

from pyspark.sql import functions as F

from fluxfield.operators import field, kernel, report
from fluxfield.operators.kernel import KernelParams, kernel_flow
from fluxfield.sources import metadata


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def test_attributes_are_summed_like_labels_without_a_sort(spark):
    state = spark.range(40).selectExpr("id AS node", "cast(id % 3 - 1 AS tinyint) AS value")
    meta = spark.range(5, 60).selectExpr("id AS node", "CASE WHEN id % 4 > 0 THEN 'k' || id % 4 END AS kind", "CASE WHEN id % 7 = 0 THEN 'NaN' ELSE 's' || id % 2 END AS side")
    found = report.attribute_summary(state, meta, ["kind", "side"], "shuffle_hash")
    labels = metadata.partition_labels(metadata.align(state, meta.withColumn("row_order", F.lit(0))), ["kind", "side"])
    assert rows(found) == rows(report.partition_summary(state, labels)) and found.count() == 5
    assert "ShuffledHashJoin" in plan(found) and "Sort" not in plan(found)


def test_large_states_are_joined_without_sorts(spark, monkeypatch):
    """What is too large to be broadcast is kept by key, not sorted; last states come from one grouping."""
    plans, sums = [], kernel.neighbour_sums
    edges = spark.range(299).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1.0).alias("weight"))
    state = spark.range(300).select(F.col("id").alias("node"), F.lit(1).alias("value"))
    monkeypatch.setattr(kernel, "neighbour_sums", lambda *a: plans.append(plan(out := sums(*a))) or out)
    monkeypatch.setattr(kernel, "BROADCAST_BYTES", 0)
    flow = kernel_flow(edges, state, KernelParams(), 4)
    assert len(plans) == 3 and not any("SortMergeJoin" in p for p in plans)
    assert "Sort" not in plan(flow.state) and "Join" not in plan(flow.state)
    assert {tuple(r) for r in flow.state.select("node", "value").collect()} == {(k, int(k < 296)) for k in range(300)}
    assert rows(flow.first.select("node", "value")) == [(k, 1) for k in sorted(range(300), key=lambda k: str((k, 1)))]


def test_fingerprints_are_exact_sums(spark):
    """Halves of hashes add up to the sum of the hashes, whatever their signs, and so do their differences."""
    df = spark.range(500).select(F.xxhash64("id").alias("a"), F.xxhash64(F.col("id") + 7).alias("b"))
    hashes = df.collect()
    total = lambda marks: kernel._total(df.agg(*[c.alias(k) for k, c in marks.items()]).first().asDict())
    assert total(kernel._sums(F.col("a"))) == sum(r["a"] for r in hashes)
    assert total(kernel._sums(F.col("a"), F.col("b"), F.col("a") > 0)) == sum(r["a"] - r["b"] for r in hashes if r["a"] > 0)


def test_first_field_follows_strengths_only_where_they_tell_it(spark, monkeypatch):
    """A ring with chords needs no in-strengths joined; a hub that takes most of the total, or a sum near 0, does."""
    chords = [(k, (k * 7 + j) % 50, float(1 + (k + j) % 4) * (-1 if k % 9 == 0 else 1)) for k in range(40) for j in (1, 2)]
    asked, sized = [], field.sized
    monkeypatch.setattr(field, "sized", lambda *a, **k: asked.append(1) or sized(*a, **k))
    for more, joined in ([], 0), ([(k, 60, 30.0) for k in range(30)] + [(60, 60, 5.0)], 1), ([(70, 1, 0.3), (70, 2, -0.3 + 1e-10)], 1):
        asked.clear()
        links = chords + more
        total, into = sum(w for *_, w in links), {}
        for _, dst, w in links:
            into[dst] = into.get(dst, 0.0) + w
        wanted = {n: 0 for a, b, _ in links for n in (a, b)}
        for node in wanted:
            own = [(dst, w) for src, dst, w in links if src == node]
            x = sum(w for _, w in own) * (total - sum(into[dst] for dst, _ in own)) / total
            wanted[node] = (x > 1e-9) - (x < -1e-9)
        found = field.init_field_exact(spark.createDataFrame(links, "src long, dst long, weight double"))
        assert {r["node"]: r["value"] for r in found.collect()} == wanted and len(asked) == joined
