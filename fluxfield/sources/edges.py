"""Edge lists: reading, validation, collapse of repeated edges, and whole graphs with metadata."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxfield.functions.scalar import default_weight
from fluxfield.operators.graph import first_seen_index
from fluxfield.plans.staging import sized, stored

CANDIDATES = (",", "\t", ";", "|")
#: What a delimiter is told from: so many characters at the start of a file.
SAMPLE_CHARS = 4096


def first_lines(spark: SparkSession, path: str) -> list[str]:
    """Whole lines of the first SAMPLE_CHARS characters of a file, or of the first file of a folder."""
    rows = spark.read.text(path).limit(SAMPLE_CHARS // 2).select(F.substring("value", 1, SAMPLE_CHARS).alias("value")).collect()
    lines, left = [], SAMPLE_CHARS
    for r in rows:
        left -= len(r["value"]) + 1
        if lines and left < 0:
            break
        lines.append(r["value"])
    return lines


def outside_quotes(line: str) -> str:
    """A line without what stands in double quotes; a doubled quote in them leaves and enters again."""
    return "".join(line.split('"')[::2])


def infer_delimiter(spark: SparkSession, path: str) -> str:
    """The candidate that most of the first lines have equally often outside quotes, of two such the more frequent one;
    a comma if none occurs. Lines without any other character count for nothing."""
    lines = [outside_quotes(x) for x in first_lines(spark, path) if x.strip()]

    def score(delimiter: str) -> tuple[int, int]:
        counts = [x.count(delimiter) for x in lines]
        return max(((counts.count(n), n) for n in set(counts) if n), default=(0, 0))

    best = max(CANDIDATES, key=score)
    return best if score(best)[0] else ","


def scan_edges(
    spark: SparkSession,
    path: str,
    source_col: str = "source_id",
    target_col: str = "target_id",
    weight_col: str = "weight",
    delimiter: str | None = None,
    need_weight: bool = False,
    type_col: str | None = None,
    numbered: bool = False,
    distance_col: str | None = None,
) -> DataFrame:
    """A delimited file as (source, target, weight_text[, channel][, distance_text]) of strings.

    A missing weight column gives nulls, or a KeyError if it is needed. type_col is a column whose values are channels,
    distance_col one of distances in any unit.
    numbered: also file, row (from 1 in the file, the header and empty lines not counted) and seq (from 0 over all
    files by name); the rows are then written once. A quoted field cannot hold a line break, as files are read in parts.
    """
    raw = spark.read.option("header", True).option("escape", '"').option("sep", delimiter or infer_delimiter(spark, path)).csv(path)
    if not raw.columns:
        raise ValueError("no header row")
    if not numbered:
        return pick_columns(raw, source_col, target_col, weight_col, need_weight, type_col, distance_col=distance_col)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("met")]
    return number_rows(pick_columns(raw, source_col, target_col, weight_col, need_weight, type_col, place, distance_col))


def number_rows(rows: DataFrame) -> DataFrame:
    """rows with (file, block, met) numbered: row from 1 in each file and seq from 0 over all files, by name.

    A task reads a part of a file from its start to its end, so rows of one part are in the order in which they were
    met. Parts are counted, and the rows before each are the sum of the counts before it.
    """
    rows = stored(rows, "numbered")
    parts = rows.groupBy("file", "block").agg(F.count("*").alias("here"), F.min("met").alias("first"))
    # A row for each part of a file.
    before = lambda *keys: F.coalesce(F.sum("here").over(Window.partitionBy(*keys).orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("file", "block", "first", before("file").alias("_row"), before().alias("_seq"))
    at = F.col("met") - F.col("first")
    numbered = rows.join(sized(parts, "parts"), ["file", "block"])
    return numbered.withColumns({"row": F.col("_row") + at + 1, "seq": F.col("_seq") + at}).drop("block", "met", "first", "_row", "_seq")


def pick_columns(
    raw: DataFrame,
    source_col: str = "source_id",
    target_col: str = "target_id",
    weight_col: str = "weight",
    need_weight: bool = False,
    type_col: str | None = None,
    more: list[Column] | None = None,
    distance_col: str | None = None,
) -> DataFrame:
    """Columns of any table as (source, target, weight_text[, channel][, distance_text]), and more; a missing one is a
    KeyError."""
    optional = {"channel": type_col, "distance_text": distance_col}
    for c in (source_col, target_col, *([weight_col] if need_weight else []), *filter(None, optional.values())):
        if c not in raw.columns:
            raise KeyError(c)
    weight = F.col(weight_col).cast("string") if weight_col in raw.columns else F.lit(None).cast("string")
    given = [F.col(c).cast("string").alias(name) for name, c in optional.items() if c]
    return raw.select(F.col(source_col).cast("string").alias("source"), F.col(target_col).cast("string").alias("target"), weight.alias("weight_text"), *given, *(more or []))


def violation(end_check: bool = True, distance: bool = False) -> Column:
    """What is wrong with a row of (source, target, weight_text[, distance_text]), or null; blank weights and distances
    are fine."""
    w = F.trim(F.coalesce("weight_text", F.lit("")))
    number = w.try_cast("double")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    ends = (blank(F.col("source")) | blank(F.col("target"))) & F.lit(end_check)
    far = F.trim(F.coalesce("distance_text", F.lit(""))) if distance else F.lit("")
    away = far.try_cast("double")
    return (
        F.when(ends, "blank endpoint")
        .when((w != "") & number.isNull(), "weight is not a number")
        .when(F.isnan(number) | (F.abs(number) == float("inf")), "weight is not finite")
        .when(number < 0, "negative weight")
        .when((far != "") & (away.isNull() | F.isnan(away) | (away < 0) | (away == float("inf"))), "distance is not a number from 0 on")
    )


def edge_violations(rows: DataFrame) -> DataFrame:
    """Rows with what is wrong: a blank end, text that is no number, an infinite or NaN weight, a negative weight, a distance that is no number from 0 on."""
    return rows.withColumn("violation", violation(distance="distance_text" in rows.columns))


def violation_kinds(bad: DataFrame) -> DataFrame:
    """(violation, n, first): how many rows there are of each kind, and one of them as (source, target, weight_text); of
    numbered rows it is the first, with seq, file and row in front."""
    place = ["seq", "file", "row"] if "seq" in bad.columns else []
    return bad.groupBy("violation").agg(F.count("*").alias("n"), F.min(F.struct(*place, "source", "target", "weight_text")).alias("first"))


def raise_violations(bad: DataFrame) -> None:
    """An error that names one row of each kind of violation, with its count; none if there are no bad rows. Of numbered
    rows it is the first one, and the kind that comes first is named first."""
    numbered, told = "seq" in bad.columns, []
    kinds = violation_kinds(bad).collect()  # a few kinds
    for k in sorted(kinds, key=lambda k: k["first"]["seq"] if numbered else k["violation"]):
        row = k["first"]
        where = f"first at row {row['row']} of {row['file']}: " if numbered else "such as "
        told.append(f"{k['violation']}: {k['n']} rows, {where}{(row['source'], row['target'], row['weight_text'])}")
    if told:
        raise ValueError("; ".join(told))


def validate_edges(rows: DataFrame, mode: str = "raise") -> tuple[DataFrame, DataFrame]:
    """(summary, bad rows). The summary has n_rows, n_nodes, n_zero, n_missing over the good rows.

    mode `raise`: an error names one violation of each kind with its count; `quarantine`: bad rows are returned.
    """
    if mode not in ("raise", "quarantine"):
        raise ValueError(mode)
    checked = edge_violations(rows)
    good, bad = checked.where("violation is null"), checked.where("violation is not null")
    if mode == "raise":
        raise_violations(bad)
        if good.isEmpty():
            raise ValueError("no edges")
    return edge_summary(good), bad


def edge_summary(rows: DataFrame) -> DataFrame:
    """One row: n_rows, n_nodes, n_zero, n_missing over (source, target, weight_text)."""
    w = default_weight(F.col("weight_text"))
    missing = F.trim(F.coalesce("weight_text", F.lit(""))) == ""
    counts = rows.agg(F.count("*").alias("n_rows"), F.count_if(w == 0).alias("n_zero"), F.count_if(missing).alias("n_missing"))
    ends = rows.select(F.col("source").alias("node")).union(rows.select("target"))
    nodes = ends.distinct().agg(F.count("*").alias("n_nodes"))
    return counts.join(F.broadcast(nodes))  # one row each


def collapse(rows: DataFrame, blank_weight: float | None = 1.0) -> DataFrame:
    """(src, dst[, channel], weight[, distance]): the sum of weights per pair, and channel where rows have one. Zero sums
    stay. The distance is the least that rows of the pair give, null if none does.

    blank_weight None leaves blanks out of sums. Text that is no number is an error of the query.
    """
    weight = default_weight(F.col("weight_text"), blank_weight)
    channel = ["channel"] if "channel" in rows.columns else []
    distance = [F.min(F.trim("distance_text").try_cast("double")).alias("distance")] if "distance_text" in rows.columns else []
    return rows.groupBy(F.col("source").alias("src"), F.col("target").alias("dst"), *channel).agg(F.coalesce(F.sum(weight), F.lit(0.0)).alias("weight"), *distance)


def checked_rows(spark: SparkSession, path: str, validate: bool = False, **how) -> DataFrame:
    """Numbered rows of an edge file. Negative weights, text that is no number and wrong distances are errors either way;
    validation also needs the weight column, both ends, finite weights and at least one row. how: of scan_edges."""
    rows = scan_edges(spark, path, need_weight=validate, numbered=True, **how)
    if validate:
        validate_edges(rows)
    else:
        kinds = ("weight is not a number", "negative weight", "distance is not a number from 0 on")
        raise_violations(rows.withColumn("violation", violation(False, "distance_text" in rows.columns)).where(F.col("violation").isin(*kinds)))
    return rows


def load_edge_list(spark: SparkSession, path: str, validate: bool = False, min_weight: float | None = None, blank_weight: float | None = 1.0, **how) -> DataFrame:
    """Read, check (see checked_rows) and collapse an edge list. how: column names, delimiter, type_col, distance_col of scan_edges."""
    return _edges(checked_rows(spark, path, validate, **how), min_weight, blank_weight)


def _edges(rows: DataFrame, min_weight: float | None = None, blank_weight: float | None = 1.0) -> DataFrame:
    edges = collapse(rows, blank_weight)
    return edges if min_weight is None else edges.where(F.col("weight") >= min_weight)


@dataclass(frozen=True)
class Graph:
    """edges (src, dst[, channel], weight[, distance]); nodes (node); metadata (node, fields), aligned to nodes, and partitions
    (node, field, label), both None if not asked for; index (node, node_index) in the order in which the file mentions
    nodes, if asked for."""

    edges: DataFrame
    nodes: DataFrame
    metadata: DataFrame | None = None
    partitions: DataFrame | None = None
    index: DataFrame | None = None


def load_graph(
    spark: SparkSession,
    path: str,
    metadata_path: str | None = None,
    metadata_id_col: str = "neuron_id",
    partition_fields: list[str] | None = None,
    validate: bool = False,
    first_seen: bool = False,
    min_weight: float | None = None,
    blank_weight: float | None = 1.0,
    **how,
) -> Graph:
    """An edge list, its nodes, their metadata and the fields asked for as partitions, in one call.

    first_seen: also the index of nodes by their first mention in the file, a source before its target, over all rows
    whatever their weight. Partitions without metadata are an error; a field that the metadata lacks is a KeyError.
    """
    from .metadata import align, load_metadata, partition_labels

    rows = checked_rows(spark, path, validate, **how)
    edges, index = _edges(rows, min_weight, blank_weight), first_seen_index(rows) if first_seen else None
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    if not metadata_path:
        if partition_fields:
            raise ValueError("partitions need metadata")
        return Graph(edges, nodes, index=index)
    aligned = align(nodes, load_metadata(spark, metadata_path, metadata_id_col, how.get("delimiter")))
    return Graph(edges, nodes, aligned, partition_labels(aligned, partition_fields) if partition_fields else None, index)
