"""Node metadata: reading, alignment to nodes, enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxfield.functions.scalar import as_number, coordinate, parse_object, side_label

from .edges import infer_delimiter


def load_metadata(spark: SparkSession, path: str, id_col: str = "neuron_id", delimiter: str | None = None) -> DataFrame:
    """Delimited files with blanks as null and the id as `node`; `row_order` is the order of rows, files by name."""
    raw = spark.read.option("header", True).option("escape", '"').option("sep", delimiter or infer_delimiter(spark, path)).csv(path)
    if id_col not in raw.columns:
        raise KeyError(id_col)
    fields = [F.when(F.trim(c) != "", F.col(c)).alias(c) for c in raw.columns if c != id_col]
    # Tasks take files by size, so rows go by file, then by where in it their task began, then as the task met them.
    place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    return raw.select(F.col(id_col).alias("node"), *fields, F.struct(*[c.alias(k) for c, k in zip(place, ("file", "block", "row"), strict=True)]).alias("row_order"))


def last_row(meta: DataFrame, order: str | Column = "row_order") -> DataFrame:
    """One row a node: the last one, with its nulls."""
    fields = [c for c in meta.columns if c not in ("node", "row_order")]
    last = meta.groupBy("node").agg(F.max_by(F.struct(*fields), order).alias("m")) if fields else meta.select("node").distinct()
    return last.select("node", *[F.col(f"m.{c}").alias(c) for c in fields])


def align(nodes: DataFrame, meta: DataFrame, order: str | Column = "row_order") -> DataFrame:
    """Metadata of each node: nulls where there is none; rows for other ids are dropped."""
    return nodes.select("node").join(last_row(meta, order), "node", "left")


def partition_labels(aligned: DataFrame, fields: list[str], keys: list[str] | None = None) -> DataFrame:
    """(node, field, label) for the named fields, or other keys than the node; an unknown field is a KeyError."""
    keys = keys or ["node"]
    for f in fields:
        if f not in aligned.columns:
            raise KeyError(f)
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("label")) for f in fields])
    return aligned.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.field", "p.label")


def with_numbers(aligned: DataFrame, fields: list[str]) -> DataFrame:
    """A companion column `<field>_number` for each field: the number it spells, else null."""
    return aligned.select("*", *[as_number(F.col(f)).alias(f"{f}_number") for f in fields])


def project_attributes(df: DataFrame, names: dict[str, str], status: str | None = None, status_col: str = "status") -> DataFrame:
    """Rename and select attributes (old name to new), with an optional status pushed to the source."""
    if status is not None:
        if "'" in status or '"' in status:
            raise ValueError("quotes in status")
        df = df.where(F.col(status_col) == status)
    return df.select(*[F.col(a).alias(b) for a, b in names.items()])


def enrich(df: DataFrame, json_col: str, point_col: str, midline: float | None = None) -> DataFrame:
    """Add rois (sorted region keys, bar-separated), n_rois, soma_x/y/z and side; drop the point."""
    keys = F.array_sort(F.map_keys(parse_object(F.col(json_col))))
    x = coordinate(F.col(point_col), 0)
    return df.select(
        *[c for c in df.columns if c != point_col],
        F.array_join(keys, "|").alias("rois"),
        F.size(keys).alias("n_rois"),
        *[coordinate(F.col(point_col), k).alias(f"soma_{a}") for k, a in enumerate("xyz")],
        side_label(x, midline).alias("side"),
    )
