"""Composite jobs: from an edge table to curves, fields, components and coarse graphs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxfield.operators import baseline as B
from fluxfield.operators import blocks as K
from fluxfield.operators import distances as D
from fluxfield.operators.distances import component_counts
from fluxfield.operators.field import coarse_field, field_balance, init_field, init_field_exact
from fluxfield.operators.graph import collapse_edges, dense_index, graph_size, nodes_of
from fluxfield.operators.kernel import Flow, KernelParams, flips, kernel_flow, kernel_step
from fluxfield.operators.nulls import Rewired, rewired
from fluxfield.operators.report import label_counts, partition_summary, top_purity
from fluxfield.sources import sinks
from fluxfield.sources.edges import scan_edges, validate_edges
from fluxfield.sources.metadata import enrich, load_metadata, project_attributes

from .staging import counted, stored, wide


@dataclass(frozen=True)
class DefectConfig:
    """The flow always runs on the weights themselves; the baseline only sets the first field. The baseline `distance`
    needs edges with a distance and the width of its bins, in the unit of distances."""

    baseline: str = "sparse_dc"
    deadzone: float = 1e-9
    steps: int = 20
    hops: int = 1
    expectation: DataFrame | None = field(default=None, compare=False)
    distance_width: float | None = None


@dataclass(frozen=True)
class DefectRun:
    first: DataFrame
    flow: Flow
    residual: DataFrame


def first_field(edges: DataFrame, config: DefectConfig) -> tuple[DataFrame, DataFrame]:
    """(residuals, first field)."""
    residual = B.residuals(edges, config.baseline, config.expectation, config.distance_width)
    if config.baseline == "sparse_dc" and config.expectation is None:
        return residual, init_field_exact(edges, config.deadzone)
    return residual, init_field(residual, nodes_of(edges), config.deadzone)


def defect_run(edges: DataFrame, config: DefectConfig = DefectConfig()) -> DefectRun:
    edges, n = counted(edges, "run-edges")
    with wide(edges.sparkSession, n):
        residual, first = first_field(edges, config)
        first = stored(first, "first")
    return DefectRun(first, kernel_flow(edges, first, KernelParams(config.hops, None, config.deadzone), config.steps), residual)


def defect_report(edges: DataFrame, config: DefectConfig = DefectConfig(), labels: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything the defect-curve job reports, by name."""
    run = defect_run(edges, config)
    last = run.flow.state.drop("run_id")
    out = {
        "size": graph_size(edges),
        "residual_balance": B.sign_balance(run.residual, config.deadzone, edges),
        "status": run.flow.status,
        "curve": run.flow.curve,
        "changes": run.flow.changes,
        "state": last,
        "final_balance": field_balance(last),
        "flips": flips(run.first, last),
        "positive_components": component_counts(edges, last.where("value = 1")),
        "negative_components": component_counts(edges, last.where("value = -1")),
    }
    if labels is not None:
        summary = partition_summary(last, labels)
        out |= {"label_counts": label_counts(labels), "partition_summary": summary, "top_purity": top_purity(summary)}
    return out


def run_report(report: dict[str, DataFrame]) -> DataFrame:
    """One row from defect_report: sizes, balances, status, the curve as an array, flips and components."""
    named = lambda part, tag: report[part].select(*[F.col(c).alias(f"{tag}_{c}") for c in report[part].columns])
    # As many entries as steps.
    curve = report["curve"].agg(F.array_sort(F.collect_list(F.struct("step", "defect"))).alias("curve"))
    parts = [
        report["size"], named("residual_balance", "residual"), report["status"].drop("run_id"), curve, report["flips"],
        named("final_balance", "final"), named("positive_components", "positive"), named("negative_components", "negative"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out


def geometry_report(edges: DataFrame, state: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one nested row, a row for each component of the +1 nodes), of a closed state and the changes that led to it.

    Neutral nodes have value 0 in the state, defect nodes changed at some step. Both are told by their hops to the
    nearest +1 node and by the component that it is in; distance 1 means next to it.
    """
    labels = stored(D.component_labels(edges, state.where("value = 1").select("node")), "labels")
    found = D.hop_distances(edges, labels)
    asked = {"neutral": state.where("value = 0").select("node"), "defect": stored(changes.select("node").distinct(), "changed")}
    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    components, columns = sizes, []
    for name, nodes in asked.items():
        near = D.affiliation(found, nodes).select("component", F.col("n").alias(name), F.col("n_next").alias(f"{name}_d1"))
        components = components.join(near, "component", "left")
        columns += [name, f"{name}_d1"]
    components = stored(components.select("component", "size", *[F.coalesce(c, F.lit(0)).alias(c) for c in columns]), "components")
    one = graph_size(edges).select(F.struct(F.col("n_nodes").alias("nodes"), F.col("n_edges").alias("edges")).alias("graph"))
    parts = [
        field_balance(state).select(F.struct("positive", "zero", "negative").alias("state")),
        components.agg(F.struct(F.count("*").alias("count"), F.coalesce(F.max("size"), F.lit(0)).alias("largest")).alias("components")),
    ]
    for name, nodes in asked.items():
        # As many entries as distances that occur.
        counts = D.distance_histogram(found, nodes).where("distance is not null")
        counts = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("distance").cast("string"), "n")))).alias("by_distance"))
        summary = D.distance_summary(found, nodes).join(F.broadcast(counts)).join(F.broadcast(D.touching(edges, labels, nodes)))
        parts.append(summary.select(F.struct("*").alias(name)))
    for p in parts:
        one = one.join(F.broadcast(p))  # one row each
    return one, components


def gauge_sweep(edges: DataFrame, deadzones: list[float], baselines: list[str], steps: int = 20) -> Flow:
    """The flow for every baseline and dead zone, as runs of one set of joins; run ids are baseline:deadzone."""
    edges, n = counted(edges, "sweep-edges")
    first, eps = None, {}
    with wide(edges.sparkSession, n):
        for b in baselines:
            for d in deadzones:
                run = f"{b}:{d:g}"
                # Each is written by itself, so that no task works out several at once.
                one = stored(first_field(edges, DefectConfig(b, d))[1], "first").withColumn("run_id", F.lit(run))
                first, eps[run] = one if first is None else first.unionByName(one), d
    return kernel_flow(edges, first, KernelParams(deadzone=eps), steps)


def block_sweep(edges: DataFrame, sizes: list[int], seeds: list[int], config: DefectConfig = DefectConfig()) -> Flow:
    """Random blocks of every size and seed, each coarse graph a run; run ids are size:seed."""
    edges = stored(edges, "sweep-edges")
    nodes, graphs, fields, eps = stored(nodes_of(edges), "nodes"), None, None, {}
    for k in sizes:
        for s in seeds:
            run = f"{k}:{s}"
            coarse = stored(K.block_edges(edges, K.random_blocks(nodes, k, s)), "coarse")
            one, init = coarse.withColumn("run_id", F.lit(run)), first_field(coarse, config)[1].withColumn("run_id", F.lit(run))
            graphs, fields = (one, init) if graphs is None else (graphs.unionByName(one), fields.unionByName(init))
            eps[run] = config.deadzone
    return kernel_flow(graphs, fields, KernelParams(config.hops, None, eps), config.steps)


def commutation_defect(edges: DataFrame, state: DataFrame, blocks: DataFrame, eps: float = 0.0) -> DataFrame:
    """One row, n_blocks and n_differ: blocks where stepping then coarse-graining differs from the other order."""
    params = KernelParams(deadzone=eps)
    then_coarse = coarse_field(kernel_step(edges, state, params), blocks)
    coarse_first = coarse_field(state, blocks).withColumnRenamed("block_id", "node")
    then_step = kernel_step(K.block_edges(edges, blocks), coarse_first, params)
    both = then_coarse.join(then_step.select(F.col("node").alias("block_id"), F.col("value").alias("other")), "block_id")
    return both.agg(F.count("*").alias("n_blocks"), F.count_if(F.col("value") != F.col("other")).alias("n_differ"))


def persistence(edges: DataFrame, size: int, levels: int = 2, seed: int = 0, config: DefectConfig = DefectConfig()) -> DataFrame:
    """(level, n_nodes, n_zero, first_defect, n_components) of the graph and its successive random coarse-grainings."""
    rows = None
    for level in range(levels + 1):
        edges = stored(edges, "level")
        run = defect_run(edges, config)
        last = run.flow.state.drop("run_id")
        one = (
            field_balance(last)
            .select(F.lit(level).alias("level"), (F.col("positive") + F.col("zero") + F.col("negative")).alias("n_nodes"), F.col("zero").alias("n_zero"))
            .join(F.broadcast(run.flow.curve.where("step = 1").select(F.col("defect").alias("first_defect"))))  # one row each
            .join(F.broadcast(component_counts(edges, last.where("value = 1")).select("n_components")))
        )
        rows = one if rows is None else rows.unionByName(one)
        edges = K.block_edges(edges, K.random_blocks(nodes_of(edges), size, seed))
    return rows


def subsampled(edges: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """A seeded share of the edges, for perturbation runs."""
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "src", "dst")), 1, 8), 16, 10).cast("long")
    return edges.where(key < int(share * (1 << 32)))


def null_runs(edges: DataFrame, runs: int = 10, rounds: int = 10, seed: int = 0, deadzone: float = 1e-9, steps: int = 20) -> tuple[Flow, Rewired]:
    """The flow over `runs` null models of a graph, as runs of one set of joins, and the null models."""
    nulls = rewired(edges, rounds, seed, runs)
    # Written once, as first fields and the flow read them several times.
    graphs, n = counted(nulls.edges, "null-edges")
    with wide(graphs.sparkSession, n):
        first = stored(init_field_exact(graphs, deadzone), "null-first")
    return kernel_flow(graphs, first, KernelParams(deadzone=deadzone), steps, rows=n), Rewired(graphs, nulls.swaps)


def degree_deadzone(edges: DataFrame, per_strength: float) -> DataFrame:
    """(node, eps): a dead zone in proportion to out-strength, to join to a state and pass as a column."""
    return edges.groupBy(F.col("src").alias("node")).agg((per_strength * F.sum("weight")).alias("eps"))


def node_index(nodes: DataFrame) -> DataFrame:
    """(node, node_index) by the order of ids."""
    # Written first, since ranges are found by a pass of their own.
    nodes, n = counted(nodes.select("node").distinct(), "nodes")
    with wide(nodes.sparkSession, n):
        return stored(dense_index(nodes, [F.col("node")]), "node-index")


def block_run(edges: DataFrame, blocks: DataFrame, out: str, **how) -> DataFrame:
    """Coarse edges and block map of any blocks (random, by strength, hop radius), written to <out>/edges and <out>/blocks.

    One row: n_blocks, mean_size, n_edges.
    """
    coarse = stored(K.block_edges(edges, blocks), "coarse")
    sinks.write_coarse_edges(coarse, f"{out}/edges", **how)
    sinks.write_block_map(blocks, node_index(blocks), f"{out}/blocks", **how)
    return K.block_summary(blocks, coarse)


def radius_run(edges: DataFrame, radius: int, out: str, **how) -> DataFrame:
    edges = stored(edges, "run-edges")
    return block_run(edges, stored(K.radius_blocks(edges, radius), "blocks"), out, **how)


def label_run(edges: DataFrame, meta: DataFrame, out: str, kind: str, unknown: str, drop_unknown: bool, order: str, **how) -> DataFrame:
    """Edges between labels and the table of labels, written to <out>/edges and <out>/labels. One row: n_members, n_pairs."""
    coarse = stored(K.label_edges(edges, meta, unknown, drop_unknown, order), "coarse")
    sinks.write_coarse_edges(coarse, f"{out}/edges", keep_zero=True, **how)
    sinks.write_label_table(K.label_table(meta), f"{out}/labels", kind, **how)
    return meta.agg(F.count("*").alias("n_members")).join(F.broadcast(coarse.agg(F.count("*").alias("n_pairs"))))  # one row each


def _block_inputs(spark: SparkSession, edge_path: str, metadata_path: str, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Edges, whose three columns are needed and blank weights left out of sums, and metadata by id."""
    edges = scan_edges(spark, edge_path, need_weight=True)
    weight = F.trim("weight_text").try_cast("double")
    edges = edges.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.coalesce(weight, F.lit(0.0)).alias("weight"))
    return collapse_edges(edges), load_metadata(spark, metadata_path, id_col)


def region_run(spark: SparkSession, edge_path: str, metadata_path: str, out: str, unknown: str = K.UNKNOWN, use_side: bool = False, drop_unknown: bool = False, id_col: str = "bodyId", **how) -> DataFrame:
    edges, meta = _block_inputs(spark, edge_path, metadata_path, id_col)
    meta = stored(K.region_map(meta, unknown, use_side).select("node", "label", "row_order"), "regions")
    return label_run(edges, meta, out, "roi", unknown, drop_unknown, "row_order", **how)


def voxel_run(spark: SparkSession, edge_path: str, metadata_path: str, out: str, size: float, unknown: str = K.UNKNOWN, drop_unknown: bool = False, id_col: str = "bodyId", **how) -> DataFrame:
    edges, meta = _block_inputs(spark, edge_path, metadata_path, id_col)
    meta = stored(K.voxel_map(meta, size, unknown).select("node", "label", "row_order"), "voxels")
    return label_run(edges, meta, out, "voxel", unknown, drop_unknown, "row_order", **how)


def validate_job(spark: SparkSession, path: str, **how) -> DataFrame:
    """The summary of an edge file, weight column needed; an error names what is wrong."""
    return validate_edges(scan_edges(spark, path, need_weight=True, numbered=True, **how))[0]


def enrichment_job(attributes: DataFrame, names: dict[str, str], json_col: str, point_col: str, midline: float | None = None, status: str | None = None) -> DataFrame:
    return enrich(project_attributes(attributes, names, status), json_col, point_col, midline)
