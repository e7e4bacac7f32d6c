"""Writers of results. Every path is explicit; a run id becomes a column's folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxfield.plans.staging import stored


def write_table(df: DataFrame, path: str, run_id: str | None = None, fmt: str = "parquet", partition_by: list[str] | None = None, order_by: list[str] | None = None) -> None:
    """Write df under path, ordered within files, by run and by the columns of partition_by."""
    parts = list(partition_by or [])
    if run_id is not None:
        df, parts = df.withColumn("run_id", F.lit(run_id)), ["run_id", *parts]
    if order_by:
        df = df.orderBy(*order_by)
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
    (writer.partitionBy(*parts) if parts else writer).save(path)


def write_curve(curve: DataFrame, path: str, **how) -> None:
    write_table(curve.select("step", "defect"), path, order_by=["step"], **how)


def _indexed(df: DataFrame, index: DataFrame) -> DataFrame:
    """df with node_index from (node, node_index), and the node as body_id; written, since putting rows in order reads
    them twice."""
    return stored(df.join(index.select("node", "node_index"), "node").withColumnRenamed("node", "body_id"), "indexed")


def write_state(state: DataFrame, index: DataFrame, path: str, **how) -> None:
    """node_index, body_id, [channel,] value."""
    channel = [c for c in ("channel",) if c in state.columns]
    write_table(_indexed(state, index).select("node_index", "body_id", *channel, "value"), path, order_by=["node_index"], **how)


def write_defect_nodes(changes: DataFrame, index: DataFrame, path: str, **how) -> None:
    """node_index, body_id, [channel,] prev_value, new_value, in a folder for each step."""
    channel = [c for c in ("channel",) if c in changes.columns]
    rows = _indexed(changes, index).select("step", "node_index", "body_id", *channel, F.col("prev").alias("prev_value"), F.col("new").alias("new_value"))
    write_table(rows, path, partition_by=["step"], order_by=["step", "node_index"], **how)


def write_block_map(blocks: DataFrame, index: DataFrame, path: str, **how) -> None:
    """node_index, body_id, block_id."""
    write_table(_indexed(blocks, index).select("node_index", "body_id", "block_id"), path, order_by=["node_index"], **how)


def write_label_table(table: DataFrame, path: str, kind: str = "roi", **how) -> None:
    """<kind>_label, <kind>_index, neuron_count, from a table of labels with their rank and number of members."""
    rows = table.select(F.col("label").alias(f"{kind}_label"), F.col("label_index").alias(f"{kind}_index"), F.col("n_members").alias("neuron_count"))
    write_table(rows, path, order_by=[f"{kind}_index"], **how)


def write_metadata(enriched: DataFrame, path: str, **how) -> None:
    write_table(enriched, path, **how)


def write_partition_summary(summary: DataFrame, path: str, **how) -> None:
    write_table(summary, path, partition_by=["field"], **how)


def write_coarse_edges(edges: DataFrame, path: str, keep_zero: bool = False, **how) -> None:
    """source_id, target_id, weight; zero weights are left out unless asked for."""
    out = edges.select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"), "weight")
    write_table(out if keep_zero else out.where("weight <> 0"), path, order_by=["source_id", "target_id"], **how)


def write_report(df: DataFrame, path: str, **how) -> None:
    """One JSON document a row."""
    write_table(df.select(F.to_json(F.struct(*df.columns)).alias("value")), path, fmt="text", **how)
