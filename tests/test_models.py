"""Null models, neighbourhoods in space, numbered files and sweeps of many runs."""

import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from fluxfield.operators import kernel, neighbours, nulls
from fluxfield.operators.field import init_field_exact
from fluxfield.operators.graph import nodes_of
from fluxfield.operators.kernel import KernelParams, kernel_flow, kernel_step
from fluxfield.plans import jobs
from fluxfield.plans.staging import bucketed, clear_stored, stored
from fluxfield.sources import edges as E

EDGES = "src long, dst long, weight double"


def graph(n=60, m=240, seed=1):
    draw, found = random.Random(seed), {}
    while len(found) < m:
        # A hub, loops, and chance.
        a, b = (0 if draw.random() < 0.2 else draw.randrange(n) for _ in range(2))
        found[a, b] = float(draw.randrange(1, 9))
    return [(a, b, w) for (a, b), w in found.items()]


def chained(*values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v, h)
    return h - (1 << 64) if h >> 63 else h


def brute_rewired(rows, rounds, seed, run):
    four, eight = (lambda v: v.to_bytes(4, "little")), (lambda v: v.to_bytes(8, "little"))
    buckets, now = max(1, len(rows) // nulls.BUCKET_EDGES), list(rows)
    for number in range(rounds):
        dealt = {}
        for a, b, w in now:
            h = chained(four(seed), four(number), run, eight(a), eight(b))
            dealt.setdefault(h % buckets, []).append((h, a, b, w))
        there, pairs, wanted = {(a, b) for a, b, _ in now}, [], {}
        for some in dealt.values():
            some.sort()
            for k in range(0, len(some) - 1, 2):
                (h, a, b, w), (_, c, d, v) = some[k : k + 2]
                pairs.append(((h, a, b), a, b, w, c, d, v))
                if a != c and b != d and a != b and c != d and a != d and c != b:
                    for e in ((a, d), (c, b)):
                        wanted.setdefault(e, []).append((h, a, b))
        won = Counter(min(keys) for e, keys in wanted.items() if e not in there)
        swapped = {(a, b): (a, d, w) for key, a, b, w, c, d, v in pairs if won[key] == 2}
        swapped |= {(c, d): (c, b, v) for key, a, b, w, c, d, v in pairs if won[key] == 2}
        now = [swapped.get((a, b), (a, b, w)) for a, b, w in now]
    return sorted(now)


@pytest.mark.parametrize("parts", [1, 7])
def test_rewired(spark, parts):
    rows = graph()
    found = nulls.rewired(spark.createDataFrame(rows, EDGES).repartition(parts), 5, 3, 2)
    for run in ("null-0", "null-1"):
        got = sorted(tuple(r) for r in found.edges.where(F.col("run_id") == run).drop("run_id").collect())
        assert got == brute_rewired(rows, 5, 3, run) != sorted(rows)
        for end in (0, 1):
            assert Counter(r[end] for r in got) == Counter(r[end] for r in rows)
        assert len({r[:2] for r in got}) == len(rows) and {r[:2] for r in got if r[0] == r[1]} == {r[:2] for r in rows if r[0] == r[1]}
    assert found.swaps.count() == 10 and found.swaps.agg(F.sum("n_swaps")).first()[0] > 50


def test_rewired_where_nothing_can_be(spark):
    assert nulls.rewired(spark.createDataFrame([], EDGES), 2).edges.count() == 0
    whole = [(a, b, 1.0) for a in range(4) for b in range(4)]
    got = nulls.rewired(spark.createDataFrame(whole, EDGES), 3).edges
    assert sorted((r.src, r.dst) for r in got.collect()) == [r[:2] for r in whole]
    with pytest.raises(ValueError):
        nulls.rewired(got, -1)


def brute_flow(rows, first, eps, steps):
    state, curve = dict(first), []
    for step in range(1, steps + 1):
        sums = dict.fromkeys(state, 0.0)
        for a, b, w in rows:
            sums[a] += w * state[b]
        new = {n: (s > eps) - (s < -eps) for n, s in sums.items()}
        curve.append((step, sum(new[n] != state[n] for n in state)))
        seen, state = state, new
        if new == seen:
            break
    return curve


def test_null_runs_are_the_flow_of_each(spark):
    rows = graph(40, 150, 5)
    flow, found = jobs.null_runs(spark.createDataFrame(rows, EDGES), 3, 4, 1, 1e-9, 6)
    for run in ("null-0", "null-1", "null-2"):
        own = sorted(tuple(r) for r in found.edges.where(F.col("run_id") == run).drop("run_id").collect())
        assert own == brute_rewired(rows, 4, 1, run)
        one = spark.createDataFrame(own, EDGES)
        first = {r.node: r.value for r in init_field_exact(one, 1e-9).collect()}
        curve = sorted((r.step, r.defect) for r in flow.curve.where(F.col("run_id") == run).collect())
        assert curve == brute_flow(own, first, 1e-9, 6)[: len(curve)] and len(curve) == flow.status.where(F.col("run_id") == run).first()["step"]


def test_a_sweep_of_many_runs(spark):
    """Plans do not grow with the runs: 300 of them, each a shift of one state over a ring."""
    ring = spark.range(12).select(F.col("id").alias("src"), ((F.col("id") + 1) % 12).alias("dst"), F.lit(1.0).alias("weight"))
    runs = spark.range(300).select(F.format_string("r%03d", "id").alias("run_id"), F.col("id").alias("k"))
    state = runs.crossJoin(ring.select(F.col("src").alias("node"))).select("run_id", "node", F.when(F.col("k") % 12 == F.col("node"), 1).otherwise(F.when(F.col("k") % 3 == 0, 1).otherwise(0)).alias("value"))
    flow = kernel_flow(ring, state, KernelParams(), 13)
    got = Counter((r.status, r.step, r.cycle_start) for r in flow.status.collect())
    assert got == {("cycle", 12, 0): 200, ("converged", 1, None): 100}
    assert flow.state.count() == 3600


def points(n=300, seed=2):
    draw = random.Random(seed)
    rows = [(k, draw.uniform(-50, 50), draw.uniform(0, 30), draw.choice([0.0, -0.0, 7.5])) for k in range(n)]
    rows += [(n + k, 3.25, 4.0, 0.0) for k in range(40)]  # one place
    rows += [(n + 40 + k, 20 + draw.random() / 50, 20 + draw.random() / 50, 1.0) for k in range(60)]  # a dense spot
    rows += [(n + 100, 5000.0, -3000.0, 9.0), (n + 101, None, 1.0, 1.0), (n + 102, float("nan"), 1.0, 1.0), (n + 103, 1.0, float("inf"), 1.0)]
    return rows


POINTS = "node long, soma_x double, soma_y double, soma_z double"


def squares(rows):
    rows = [r for r in rows if None not in r and all(abs(v) < float("inf") for v in r[1:])]
    for a in rows:
        yield a[0], sorted(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2, b[0]) for b in rows if b[0] != a[0])


@pytest.mark.parametrize("full", [4096, 7])
def test_radius_graph(spark, full):
    rows = points()
    found = neighbours.radius_graph(spark.createDataFrame(rows, POINTS).repartition(3), 3.5, full=full)
    assert sorted((r.src, r.dst) for r in found.collect()) == sorted((a, b) for a, near in squares(rows) for s, b in near if s <= 3.5 * 3.5)
    assert neighbours.radius_graph(spark.createDataFrame([], POINTS), 1.0).count() == 0
    with pytest.raises(ValueError):
        neighbours.radius_graph(found, 0.0)


def test_radius_meets_across_rounded_cells(spark):
    """Points on the borders of cells whose width has no exact form."""
    rows = [(k, k * 0.1, 0.0, 0.0) for k in range(200)]
    found = neighbours.radius_graph(spark.createDataFrame(rows, POINTS), 0.1)
    assert sorted((r.src, r.dst) for r in found.collect()) == sorted((a, b) for a, near in squares(rows) for s, b in near if s <= 0.1 * 0.1)


@pytest.mark.parametrize("k, full", [(5, 7), (45, 4096)])
def test_nearest_graph(spark, k, full):
    rows = points()
    found = neighbours.nearest_graph(spark.createDataFrame(rows, POINTS).repartition(3), k, full=full)
    want = [(a, b, i + 1) for a, near in squares(rows) for i, (_, b) in enumerate(near[:k])]
    assert sorted((r.src, r.dst, r["rank"]) for r in found.collect()) == sorted(want)


def test_nearest_of_few(spark):
    two = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0)], POINTS)
    assert sorted((r.src, r.dst) for r in neighbours.nearest_graph(two, 3).collect()) == [(1, 2), (2, 1)]
    assert neighbours.nearest_graph(two.limit(1), 3).count() == 0 and neighbours.nearest_graph(two.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        neighbours.nearest_graph(two, 0)


@pytest.fixture
def files(spark, tmp_path):
    """Three files, read in parts of some hundred bytes."""
    draw, rows = random.Random(3), []
    for k in range(3):
        some = [(f"n{draw.randrange(50)}", f"m{draw.randrange(50)}", str(draw.randrange(9))) for _ in range(400 + k)]
        rows += [(f"part-{k}.csv", i + 1, *r) for i, r in enumerate(some)]
        lines = ["source_id,target_id,weight", *(",".join(r) for r in some)]
        lines.insert(5, "")  # an empty line is no row
        (tmp_path / f"part-{k}.csv").write_text("\n".join(lines) + "\n")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for c in kept:
        spark.conf.set(c, "300")
    yield str(tmp_path), rows
    for c, v in kept.items():
        spark.conf.set(c, v)


def test_rows_have_the_numbers_of_their_files(spark, files):
    path, rows = files
    found = E.scan_edges(spark, path, numbered=True)
    assert spark.read.text(path).rdd.getNumPartitions() > 12
    got = sorted((r.seq, r.file.rsplit("/", 1)[-1], r.row, r.source, r.target, r.weight_text) for r in found.collect())
    assert got == [(k, *r) for k, r in enumerate(rows)]


def test_index_in_order_of_first_mention(spark, files):
    path, rows = files
    want = {}
    for r in rows:
        for node in r[2:4]:
            want.setdefault(node, len(want))
    found = E.load_graph(spark, path, validate=True, first_seen=True)
    assert {r.node: r.node_index for r in found.index.collect()} == want and found.nodes.count() == len(want)
    assert E.load_graph(spark, path).index is None


def test_errors_name_the_first_bad_row(spark, files):
    from pathlib import Path

    path, rows = files
    file = Path(path) / "part-1.csv"
    lines = file.read_text().split("\n")
    lines[200], lines[301], lines[310], lines[320] = "a,b,-3", ",b,1", "c,d,many", "e,f,-1"
    file.write_text("\n".join(lines))
    with pytest.raises(ValueError, match=re.compile(r"negative weight: 2 rows, first at row 199 of .*part-1.csv: .*; blank endpoint: 1 rows, first at row 300 of .*; weight is not a number: 1 rows, first at row 309 of")):
        E.load_edge_list(spark, path, validate=True)
    with pytest.raises(ValueError, match="negative weight: 2 rows, first at row 199"):
        E.load_edge_list(spark, path)


@pytest.mark.parametrize(
    "text, delimiter",
    [
        ('"a;b;c",d\n"x;y;z",1\n', ","),
        ("a|b|c\n1,5|2,5|3,5\n4|5|6\n", "|"),
        ("a\tb\n1\t2\n", "\t"),
        ("lone\nrow\n", ","),
        ("", ","),
        ('"say ""a;b""",c\n"d",e\n', ","),
        ("a;b\n" + "x" * 9000 + ",,,,\n", ";"),
    ],
)
def test_delimiter_is_told_from_whole_lines(spark, tmp_path, text, delimiter):
    (tmp_path / "f.csv").write_text(text)
    assert E.infer_delimiter(spark, str(tmp_path / "f.csv")) == delimiter


def test_a_step_does_not_shuffle_edges_that_stay(spark):
    """States too large to be sent to all tasks are dealt to the buckets of the edges."""
    edges = spark.createDataFrame(graph(), EDGES)
    state = stored(nodes_of(edges).withColumn("value", (F.col("node") % 3 - 1).cast("int")))
    stay = bucketed(edges, ["dst"], "edges")
    step = kernel_step(stay, state, KernelParams(), "merge")
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_node" in plan and "hashpartitioning(dst" not in plan and "SortMergeJoin" in plan
    assert sorted(tuple(r) for r in step.collect()) == sorted(tuple(r) for r in kernel_step(edges, state).collect())
    tables = [t.name for t in spark.catalog.listTables() if t.name.startswith("fluxfield_")]
    assert tables and clear_stored(spark) and not any(t.name in tables for t in spark.catalog.listTables())


def test_flow_over_buckets_is_the_same(spark, monkeypatch):
    rows = graph(50, 200, 9)
    edges = spark.createDataFrame(rows, EDGES)
    first = nodes_of(edges).withColumn("value", (F.col("node") % 3 - 1).cast("int"))
    small = kernel_flow(edges, first, KernelParams(deadzone=0.5), 7)
    monkeypatch.setattr(kernel, "BROADCAST_BYTES", -1)
    large = kernel_flow(edges, first, KernelParams(deadzone=0.5), 7)
    want = brute_flow(rows, {r.node: r.value for r in first.collect()}, 0.5, 7)
    for flow in (small, large):
        curve = sorted((r.step, r.defect) for r in flow.curve.collect())
        assert curve == want[: len(curve)] and len(curve) == flow.status.first()["step"]
    assert sorted(map(tuple, small.state.collect())) == sorted(map(tuple, large.state.collect()))


def test_near_places(spark):
    """Copies at a place are joined once, as lists of nodes, and lose no pair."""
    rows = [(i, float(i % 3), 0.0, 0.0) for i in range(900)] + [(900, 50.0, 0.0, 0.0), (901, 0.0, None, 0.0)]
    points = spark.createDataFrame(rows, "node long, soma_x double, soma_y double, soma_z double").repartition(3)
    found = neighbours.near_places(points, 1.0, full=200).cache()
    assert found.count() <= 40 and sum(len(r.nodes) * len(r.others) for r in found.collect()) == 1 + 900 * 300 + 2 * 2 * 300 * 300
    assert neighbours.radius_graph(points, 1.0, full=200).distinct().count() == 900 * 299 + 2 * 2 * 300 * 300


def test_proposals_are_hashed(spark):
    """The grouping of proposed edges hashes numbers; it does not sort."""
    now = spark.createDataFrame([("r", 1, 2)], "run_id string, src long, dst long")
    wanted = spark.createDataFrame([("r", 1, 2, 7, 0), ("r", 1, 3, 7, 0), ("r", 4, 5, 8, 3), ("r", 5, 4, 8, 3), ("r", 4, 5, 9, 4), ("r", 6, 6, 9, 4)], "run_id string, x long, y long, key long, h long")
    found = nulls._swapped(now, wanted)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(8, "r")]
