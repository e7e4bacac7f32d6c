"""Operators on toy graphs with known results."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from fluxfield.functions.scalar import entropy, primary_region, purity, sgn_deadzone, voxel_label
from fluxfield.operators import baseline, blocks, distances, field, graph, kernel
from fluxfield.operators.components import connected_components
from fluxfield.operators.kernel import KernelParams
from fluxfield.plans import jobs, staging
from fluxfield.sources import edges as E
from fluxfield.sources import metadata, sinks

CHAIN = [(0, 1, 1.0), (1, 0, 1.0), (1, 2, 1.0), (2, 1, 1.0)]
BASE = [(0, 1, 1.0), (0, 2, 2.0), (1, 2, 3.0), (2, 0, 4.0)]


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src long, dst long, weight double")


def state(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "node long, value int")


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_validation(spark):
    rows = spark.createDataFrame([("a", "b", "1.0"), ("b", "c", "0"), ("c", "a", "")], "source string, target string, weight_text string")
    summary, bad = E.validate_edges(rows)
    assert got(summary, "n_rows", "n_nodes", "n_zero", "n_missing") == [(3, 3, 1, 1)] and bad.count() == 0
    for w, what in (("-1", "negative"), ("x", "not a number"), ("NaN", "not finite"), ("1_000", "not a number")):
        broken = spark.createDataFrame([("a", "b", w)], rows.schema)
        with pytest.raises(ValueError, match=what):
            E.validate_edges(broken)
        assert E.validate_edges(broken, "quarantine")[1].count() == 1
    with pytest.raises(ValueError, match="blank endpoint"):
        E.validate_edges(spark.createDataFrame([("", "b", "1")], rows.schema))
    with pytest.raises(ValueError, match="no edges"):
        E.validate_edges(rows.limit(0))


def test_files(spark, tmp_path):
    path = tmp_path / "edges.tsv"
    path.write_text("source_id\ttarget_id\tweight\nn1\tn2\t2\nn2\tn3\t\nn2\tn3\t3\nn3\tn1\t0\n")
    assert E.infer_delimiter(spark, str(path)) == "\t"
    found = E.load_edge_list(spark, str(path), validate=True)
    assert got(found, "src", "dst", "weight") == [("n1", "n2", 2.0), ("n2", "n3", 4.0), ("n3", "n1", 0.0)]
    with pytest.raises(KeyError):
        E.load_edge_list(spark, str(path), source_col="nope")
    meta = tmp_path / "meta.csv"
    meta.write_text("neuron_id,cell_type,size\nn1,T1,5\nn2,T2,x\nn3,T3,\nn3,T1,\nn9,T9,1\n")
    aligned = metadata.align(graph.nodes_of(found), metadata.load_metadata(spark, str(meta)))
    assert got(metadata.with_numbers(aligned, ["size"]), "node", "cell_type", "size", "size_number") == [("n1", "T1", "5", 5.0), ("n2", "T2", "x", None), ("n3", "T1", None, None)]
    with pytest.raises(KeyError):
        metadata.partition_labels(aligned, ["nope"])
    sinks.write_coarse_edges(found, str(tmp_path / "out"), run_id="r1", fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2


def test_scalars(spark):
    df = spark.createDataFrame([(float(x),) for x in (-2, -1, 0, 1, 2)] + [(float("nan"),)], "x double")
    assert [r[0] for r in df.select(sgn_deadzone(F.col("x"), 1.0)).collect()] == [-1, 0, 0, 0, 1, 0]
    with pytest.raises(ValueError):
        sgn_deadzone(F.lit(1.0), -1.0)
    rows = [('{"A":{"pre":1,"post":2},"B":{"pre":3,"post":0}}', None, "A"), ('{"A":5,"B":"7"}', None, "A"), ("bad", "|X|Y", "X"), ("{}", None, "unknown"), (None, None, "unknown"), ("null", "Z", "Z"), ("[1]", "", "unknown")]
    df = spark.createDataFrame(rows, "j string, r string, want string")
    assert all(a == b for a, b in df.select(primary_region(F.col("j"), F.col("r")), "want").collect())
    df = spark.createDataFrame([(10.5, -0.5, 0.0), (None, 1.0, 1.0)], "x double, y double, z double")
    assert [r[0] for r in df.select(voxel_label(F.col("x"), F.col("y"), F.col("z"), 10)).collect()] == ["1_-1_0", "unknown"]
    df = spark.createDataFrame([(2, 1, 1), (4, 0, 0), (0, 0, 0)], "a int, b int, c int")
    cols = [F.col(c) for c in "abc"]
    assert [tuple(r) for r in df.select(entropy(*cols), purity(*cols)).collect()] == [(1.5, 0.5), (0.0, 1.0), (0.0, 0.0)]


def test_residuals(spark):
    e = edges(spark, BASE)
    a, b = baseline.sparse_residual(e), baseline.residuals(e, "dense_dc")
    assert [round(r[2], 9) for r in got(a, "src", "dst", "residual")] == [0.7, 0.5, 1.5, 2.4]
    assert [round(r[2], 9) for r in got(b, "src", "dst", "residual")] == [0.7, 0.5, 1.5, 2.4]
    assert got(baseline.sign_balance(a), "positive", "zero", "negative") == [(4, 0, 0)]
    z = edges(spark, [*BASE, (1, 0, 0)])
    assert got(baseline.sign_balance(baseline.sparse_residual(z)), "positive", "zero", "negative") == [(4, 0, 1)]
    empty = edges(spark, [(0, 1, 0), (1, 2, 0)])
    r = baseline.sparse_residual(empty)
    assert r.count() == 0 and got(baseline.sign_balance(r, edges=empty), "positive", "zero", "negative") == [(0, 2, 0)]
    assert got(field.init_field_exact(empty), "node", "value") == [(0, 0), (1, 0), (2, 0)]
    with pytest.raises(ValueError):
        baseline.dense_expectation(e, limit=2)


def test_dense_residual_has_no_limit(spark):
    # More nodes than a dense expectation may have.
    ring = spark.range(baseline.DENSE_NODES + 10).select(F.col("id").alias("src"), F.pmod(F.col("id") + 1, F.lit(baseline.DENSE_NODES + 10)).alias("dst"), F.lit(2.0).alias("weight"))
    r = baseline.residuals(ring, "dense_dc")
    n = baseline.DENSE_NODES + 10
    assert r.count() == n and r.where(F.abs(F.col("expected") - 2.0 / n) > 1e-12).count() == 0
    for rows in (BASE, [(0, 1, 0), (1, 2, 0)], [(0, 1, 2), (1, 2, -2)], [(0, 1, -2), (1, 2, -3)]):
        e = edges(spark, rows)
        want = baseline.residual_against(e, baseline.dense_expectation(e))
        cols = ("src", "dst", "weight", "expected", "residual")
        assert got(baseline.residuals(e, "dense_dc"), *cols) == got(want, *cols)


def test_k_hop_and_matrix_free(spark):
    e = edges(spark, CHAIN)
    assert got(graph.k_hop(e, 2), "src", "dst", "weight") == [(0, 0, 1.0), (0, 1, 1.0), (0, 2, 1.0), (1, 0, 1.0), (1, 1, 2.0), (1, 2, 1.0), (2, 0, 1.0), (2, 1, 1.0), (2, 2, 1.0)]
    s = state(spark, [1, -1, 1])
    table = kernel.kernel_step(graph.k_hop(e, 3), s)
    assert got(table, "node", "value") == got(kernel.kernel_step(e, s, KernelParams(3)), "node", "value")


def test_flows(spark):
    e = edges(spark, CHAIN)
    flow = kernel.kernel_flow(e, state(spark, [1, 1, 1]))
    assert got(flow.status, "status", "step") == [("converged", 1)] and got(flow.curve, "defect") == [(0,)]
    flow = kernel.kernel_flow(e, state(spark, [1, -1, 1]))
    assert got(flow.status, "status", "step", "cycle_start") == [("cycle", 2, 0)] and got(flow.curve, "step", "defect") == [(1, 3), (2, 3)]
    assert got(flow.state, "node", "value") == [(0, 1), (1, -1), (2, 1)]
    flow = kernel.kernel_flow(e, state(spark, [1, -1, 1]), steps=3, cycle_check=False)
    assert got(flow.status, "status", "step") == [("max_steps", 3)]
    flow = kernel.kernel_flow(e, state(spark, [1, -1, 1]), steps=0)
    assert got(flow.status, "status", "step") == [("max_steps", 0)] and flow.changes.count() == 0 and got(flow.state, "value") == [(-1,), (1,), (1,)]
    peel = kernel.kernel_flow(edges(spark, [(0, 1, 1), (1, 2, 1), (2, 3, 1)]), state(spark, [1, 1, 1, 0]))
    assert got(peel.curve, "step", "defect") == [(1, 1), (2, 1), (3, 1), (4, 0)] and got(peel.changes, "step", "node", "prev", "new") == [(1, 2, 1, 0), (2, 1, 1, 0), (3, 0, 1, 0)]
    full = edges(spark, [(a, b, 1) for a in range(3) for b in range(3)])
    run = jobs.defect_run(full)
    assert got(run.first, "value") == [(0,)] * 3 and got(run.flow.status, "status", "step") == [("converged", 1)]


def test_coupling(spark):
    e = edges(spark, [(0, 1, 3), (0, 2, 2)])
    s = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (1, 0, 1), (1, 1, 0), (2, 0, 0), (2, 1, -1)], "node long, channel int, value int")
    m = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0)], "c_out int, c_in int, coef double")
    assert got(kernel.kernel_step(e, s, KernelParams(1, m)).where("node = 0"), "channel", "value") == [(0, -1), (1, 1)]


def test_components(spark):
    e = edges(spark, [(0, 1, 1), (3, 3, 1), (4, 5, 0)])
    mask = spark.createDataFrame([(0,), (1,), (2,), (4,), (5,)], "node long")
    assert got(distances.component_counts(e, mask), "n_components", "largest") == [(4, 2)]
    assert got(distances.component_counts(e, mask.limit(0)), "n_components", "largest") == [(0, 0)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (None, 3)], "src long, dst long")
    found = connected_components(chain)
    assert {r.component for r in found.collect() if r.node < 99} == {0} and found.count() == 62


def test_radius(spark):
    path = edges(spark, [(i, i + 1, 1) for i in range(4)])

    def clusters(e, r):
        return [b for _, b in got(blocks.radius_blocks(e, r), "node", "block_id")]

    assert clusters(path, 1) == [0, 0, 1, 1, 2] and clusters(path, 2) == [0, 0, 0, 1, 1] and clusters(path, 0) == [0, 1, 2, 3, 4]
    assert clusters(edges(spark, [(0, 2, 1), (2, 3, 1), (1, 3, 1), (1, 4, 1)]), 1) == [0, 1, 0, 1, 1]
    assert clusters(edges(spark, [(0, 2, 1), (2, 3, 1), (3, 1, 1), (3, 4, 1)]), 2) == [0, 1, 0, 0, 2]
    with pytest.raises(ValueError):
        blocks.radius_blocks(path, -1)
    rnd = random.Random(5)
    pairs = {tuple(rnd.sample(range(25), 2)) for _ in range(30)}
    near = {i: set() for p in pairs for i in p}
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    for r in (1, 2):
        want = {}
        for k, seed in enumerate(x for x in sorted(near)):
            if seed in want:
                continue
            front = {seed}
            want[seed] = seed
            for _ in range(r):
                front = {v for u in front for v in near[u] if v not in want}
                want |= dict.fromkeys(front, seed)
        rank = {s: i for i, s in enumerate(sorted(set(want.values())))}
        assert dict(got(blocks.radius_blocks(edges(spark, [(*p, 1) for p in pairs]), r), "node", "block_id")) == {n: rank[s] for n, s in want.items()}


def test_blocks(spark):
    e = edges(spark, [(a, (a * 7 + 3) % 11, 1 + a % 3) for a in range(11)] + [(0, 5, 2)])
    total = e.agg(F.sum("weight")).first()[0]
    for own in (blocks.random_blocks(graph.nodes_of(e), 4), blocks.degree_blocks(e, 4)):
        sizes = [r[0] for r in own.groupBy("block_id").count().orderBy("block_id").select("count").collect()]
        assert sizes == [4, 4, 3] and blocks.block_edges(e, own).agg(F.sum("weight")).first()[0] == total
    with pytest.raises(ValueError):
        blocks.random_blocks(graph.nodes_of(e), 0)
    own = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)], "node long, block_id long")
    assert got(field.coarse_field(state(spark, [1, 1, -1, -1, 1]), own), "block_id", "value") == [(0, 1), (1, 0)]
    labels = spark.createDataFrame([(0, "a"), (1, "b")], "node long, label string")
    out = blocks.label_edges(edges(spark, [(0, 1, 1), (0, 9, 2)]), labels)
    assert got(out, "src", "dst", "weight") == [("a", "b", 1.0), ("a", "unknown", 2.0)]
    assert blocks.label_edges(edges(spark, [(0, 1, 1), (0, 9, 2)]), labels, drop_unknown=True).count() == 1
    meta = spark.createDataFrame([(1, None, "", "L"), (2, '{"A":1}', None, "R")], "node long, roi_info_json string, rois string, side string")
    assert got(blocks.region_map(meta, use_side=True), "node", "label") == [(1, "unknown"), (2, "A_R")]


def test_involution(spark):
    rnd = random.Random(1)
    e = edges(spark, [(rnd.randrange(9), rnd.randrange(9), rnd.randrange(5)) for _ in range(30)])
    s = [rnd.choice([-1, 0, 1]) for _ in range(9)]
    a, b = (got(kernel.kernel_step(e, state(spark, [k * v for v in s])), "node", "value") for k in (1, -1))
    assert a == [(n, -v) for n, v in b]


def test_report_and_jobs(spark):
    e = edges(spark, [(0, 1, 1), (1, 0, 1), (1, 2, 1), (3, 0, 1)])
    labels = spark.createDataFrame([(n, "kind", lab) for n, lab in enumerate(["x", "x", "y", None])], "node long, field string, label string")
    out = jobs.defect_report(e, labels=labels)
    assert got(out["size"], "n_nodes", "n_edges") == [(4, 4)]
    assert out["label_counts"].count() == 3
    assert got(out["partition_summary"], "label", "n", "positive", "zero") == [("x", 2, 2, 0), ("y", 1, 0, 1)]
    assert got(out["top_purity"], "label", "purity") == [("x", 1.0)]
    assert jobs.subsampled(e, 1.0).count() == 4 and jobs.subsampled(e, 0.0).count() == 0
    eps = jobs.degree_deadzone(e, 10.0)
    first = out["state"].join(eps, "node", "left").fillna(0.0, ["eps"])
    assert {v for _, v in got(kernel.kernel_step(e, first, KernelParams(deadzone=F.col("eps"))), "node", "value")} == {0}


def brute_level(rows):
    """(nodes, zeros, first defect, components) of the flow over plain (src, dst, weight) rows."""
    nodes = sorted({x for a, b, _ in rows for x in (a, b)})
    total, k_in = sum(w for *_, w in rows), dict.fromkeys(nodes, 0.0)
    for _, b, w in rows:
        k_in[b] += w
    out = {n: sum(w for a, _, w in rows if a == n) for n in nodes}
    value = {n: int(out[n] * (total - sum(k_in[b] for a, b, _ in rows if a == n)) > 1e-9) for n in nodes}
    first = None
    while True:
        new = {n: int(sum(w * value[b] for a, b, w in rows if a == n) > 1e-9) for n in nodes}
        defect = sum(new[n] != value[n] for n in nodes)
        first, value = defect if first is None else first, new
        if not defect:
            break
    top = {n: n for n in nodes if value[n] == 1}
    for _ in nodes:
        for a, b, w in rows:
            if w and a in top and b in top:
                top[a] = top[b] = min(top[a], top[b])
    return len(nodes), sum(v == 0 for v in value.values()), first, len(set(top.values()))


def test_persistence(spark):
    rnd = random.Random(8)
    rows = sorted({(a, b): float(rnd.randrange(1, 5)) for a, b in (rnd.sample(range(16), 2) for _ in range(20))}.items())
    rows = [(a, b, w) for (a, b), w in rows]
    want, level = [], rows
    for k in range(3):
        want.append((k, *brute_level(level)))
        nodes = sorted({x for a, b, _ in level for x in (a, b)}, key=lambda n: (hashlib.md5(f"0:{n}".encode()).hexdigest(), n))
        block, sums = {n: i // 2 for i, n in enumerate(nodes)}, {}
        for a, b, w in level:
            sums[block[a], block[b]] = sums.get((block[a], block[b]), 0.0) + w
        level = [(a, b, w) for (a, b), w in sums.items() if w]
    assert got(jobs.persistence(edges(spark, rows), 2, 2), "level", "n_nodes", "n_zero", "first_defect", "n_components") == want


def test_loader_errors(spark, tmp_path):
    bad, bare = tmp_path / "bad.csv", tmp_path / "bare.csv"
    bad.write_text("source_id,target_id,weight\na,b,abc\n")
    bare.write_text("source_id,target_id\na,b\na,b\n")
    for validate in (False, True):
        with pytest.raises(ValueError, match="not a number"):
            E.load_edge_list(spark, str(bad), validate=validate)
    assert got(E.load_edge_list(spark, str(bare)), "src", "dst", "weight") == [("a", "b", 2.0)]
    with pytest.raises(KeyError, match="weight"):
        E.load_edge_list(spark, str(bare), validate=True)
    with pytest.raises(KeyError, match="weight"):
        jobs.validate_job(spark, str(bare))
    with pytest.raises(ValueError, match="partitions need metadata"):
        E.load_graph(spark, str(bare), partition_fields=["x"])
    with pytest.raises(KeyError):
        blocks.voxel_map(spark.createDataFrame([(1, 2.0)], "node int, soma_x double"), 10)


def test_load_graph(spark, tmp_path):
    path, meta = tmp_path / "edges.csv", tmp_path / "meta"
    path.write_text("source_id,target_id,weight,type\nn1,n2,2,x\nn2,n3,,x\nn2,n3,3,y\n")
    meta.mkdir()
    # The first file by name is the largest; the row of the last file counts.
    (meta / "a.csv").write_text("neuron_id,cell_type\n" + "n1,T1\n" * 50)
    (meta / "b.csv").write_text("neuron_id,cell_type\nn1,T2\nn3,\n")
    found = E.load_graph(spark, str(path), str(meta), partition_fields=["cell_type"], validate=True)
    assert sorted(map(tuple, found.partitions.collect()), key=repr) == [("n1", "cell_type", "T2"), ("n2", "cell_type", None), ("n3", "cell_type", None)]
    typed = E.load_edge_list(spark, str(path), type_col="type")
    assert got(typed, "src", "dst", "channel", "weight") == [("n1", "n2", "x", 2.0), ("n2", "n3", "x", 1.0), ("n2", "n3", "y", 3.0)]
    assert got(E.load_edge_list(spark, str(path), blank_weight=None), "weight") == [(2.0,), (3.0,)]
    with pytest.raises(KeyError):
        E.load_graph(spark, str(path), str(meta), partition_fields=["nope"])


def test_no_limit_on_hops_or_rounds(spark):
    path = edges(spark, [(i, i + 1, 1) for i in range(12)])
    found = distances.hop_distances(path, spark.createDataFrame([(0, 0)], "node long, component long"))
    assert got(found, "node", "distance", "component") == [(i, i, 0) for i in range(13)]
    assert distances.hop_distances(path, spark.createDataFrame([], "node long, component long")).count() == 0
    some = spark.createDataFrame([(1, 2, 1.0), (None, 2, 1.0)], "src long, dst long, weight double")
    assert got(blocks.radius_blocks(some, 1), "node", "block_id") == [(1, 0), (2, 0)]
    assert blocks.radius_blocks(some.limit(0), 1).count() == 0


def test_sized(spark):
    df = spark.range(100).select("id", F.lit("é" * 10).alias("text"), F.array(F.struct(F.lit("a").alias("x"))).alias("list"), F.create_map(F.lit("k"), F.col("id")).alias("map"))
    plan = lambda side: spark.range(10).join(side, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(staging.sized(df)) and "strategy=merge" in plan(staging.sized(df, limit=99))
    assert "strategy=broadcast" in plan(staging.sized(df.limit(0)))


def test_runs_and_reports(spark, tmp_path):
    edge_file, meta, voxels = (tmp_path / n for n in ("e.csv", "m.csv", "v.csv"))
    edge_file.write_text("source_id,target_id,weight\n1,2,3\n2,3,\n1,9,1\n")
    meta.write_text('bodyId,roi_info_json,rois,side\n1,"{""A"":1}",,L\n2,,|B|C,\n3,,,R\n2,,|C,\n')
    voxels.write_text("bodyId,soma_x,soma_y,soma_z\n1,1,1,1\n2,12,1,1\n3,,1,1\n")
    out = str(tmp_path / "roi")
    assert got(jobs.region_run(spark, str(edge_file), str(meta), out, use_side=True, fmt="csv"), "n_members", "n_pairs") == [(4, 3)]
    read = lambda path: sorted(map(tuple, spark.read.option("header", True).csv(path).collect()))
    assert read(f"{out}/edges") == [("A_L", "C", "3.0"), ("A_L", "unknown", "1.0"), ("C", "unknown", "0.0")]
    assert read(f"{out}/labels") == [("A_L", "0", "1"), ("B", "1", "1"), ("C", "2", "1"), ("unknown", "3", "1")]
    out = str(tmp_path / "voxel")
    jobs.voxel_run(spark, str(edge_file), str(voxels), out, 10, drop_unknown=True, fmt="csv")
    assert read(f"{out}/edges") == [("0_0_0", "1_0_0", "3.0")]
    path, out = edges(spark, [(i, i + 1, 1) for i in range(4)]), str(tmp_path / "radius")
    assert got(jobs.radius_run(path, 1, out, fmt="csv"), "n_blocks", "n_edges") == [(3, 4)]
    assert read(f"{out}/blocks") == [("0", "0", "0"), ("1", "1", "0"), ("2", "2", "1"), ("3", "3", "1"), ("4", "4", "2")]
    report = jobs.defect_report(path)
    sinks.write_report(jobs.run_report(report), str(tmp_path / "report"))
    row = json.loads(spark.read.text(str(tmp_path / "report")).first()[0])
    assert row["status"] == "converged" and row["n_nodes"] == 5 and [c["step"] for c in row["curve"]] == list(range(1, row["step"] + 1))
    sinks.write_state(report["state"], jobs.node_index(report["state"]), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "state")).columns == ["node_index", "body_id", "value"]
    sinks.write_defect_nodes(report["changes"], jobs.node_index(report["state"]), str(tmp_path / "changes"))
    assert spark.read.parquet(str(tmp_path / "changes")).count() == report["changes"].count()
    state = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (3, 0), (4, 1), (7, 0)], "node long, value int")
    changes = spark.createDataFrame([(1, 1, 1, 0), (2, 2, 1, 0)], "step int, node long, prev int, new int")
    one, components = jobs.geometry_report(path, state, changes)
    one = one.first()
    assert (one.graph.nodes, one.components["count"], one.neutral.n, one.neutral.unreached, one.neutral.by_distance) == (5, 2, 4, 1, {"1": 2, "2": 1})
    assert got(components, "component", "size", "neutral", "neutral_d1", "defect", "defect_d1") == [(0, 1, 2, 1, 2, 1), (4, 1, 1, 1, 0, 0)]


def test_typed_channels_in_a_flow(spark):
    typed = spark.createDataFrame([(0, 1, "x", 1.0), (1, 0, "x", 1.0), (0, 1, "y", 1.0)], "src long, dst long, channel string, weight double")
    s = spark.createDataFrame([(n, c, 1) for n in (0, 1) for c in "xy"], "node long, channel string, value int")
    flow = kernel.kernel_flow(typed, s)
    assert got(flow.state, "node", "channel", "value") == [(0, "x", 1), (0, "y", 0), (1, "x", 1), (1, "y", 0)]
    assert got(flow.changes, "step", "node", "channel") == [(1, 1, "y"), (2, 0, "y")]
