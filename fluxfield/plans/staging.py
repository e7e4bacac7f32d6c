"""Written intermediate tables and join hints with a checked size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Estimated bytes in memory up to which a side may be broadcast; beyond it the join shuffles instead.
BROADCAST_BYTES = 96 << 20
#: What a row in a hash table takes besides its values.
ROW_BYTES = 32
#: Rows of a large table that a task of a shuffle takes on: what it groups or joins them by stays near the processor.
PART_ROWS = 1 << 18
#: What a task of a large table reads of files or of a shuffle, where the session does not say.
PART_BYTES = {"spark.sql.files.maxPartitionBytes": "16m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}
#: How many partitions joined ones are at least, of a size worth a task, where the session does not say.
PART_NUMBER = "spark.sql.adaptive.coalescePartitions.minPartitionNum"
#: How names of bucketed tables begin; the application's id follows.
BUCKETED = "fluxfield_"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir (or the context) names it.

    Only a session in one process, as in tests, gets a folder of its own where none is named; a cluster must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/fluxfield-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def wide(spark: SparkSession, rows: int) -> Iterator[None]:
    """Shuffles planned inside have at least a partition for each PART_ROWS of so many rows, and scans and joined
    partitions are cut by PART_BYTES, so that what a task holds does not grow with them."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    parts = max(int(before), -(-rows // PART_ROWS))
    cuts = PART_BYTES | {PART_NUMBER: str(parts)}
    unset = [k for k in cuts if spark.conf.get(k, None) is None]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    for k in unset:
        spark.conf.set(k, cuts[k])
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        for k in unset:
            spark.conf.unset(k)


@contextmanager
def beside(spark: SparkSession) -> Iterator[None]:
    """Joins planned inside on more columns than a side is dealt by leave that side where it lies."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _own_tables(spark: SparkSession) -> str:
    """What the names of this application's bucketed tables begin with."""
    return BUCKETED + "".join(c if c.isalnum() else "_" for c in spark.sparkContext.applicationId.lower()) + "_"


def bucketed(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """df written in as many buckets by these columns as shuffles have partitions, so that joins on them shuffle the
    other side only. A table of the session's catalog with its files in the shared folder; clear_stored drops it."""
    spark = df.sparkSession
    table = f"{_own_tables(spark)}{name.replace('-', '_')}_{uuid.uuid4().hex}"
    path = new_path(spark, name)
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *columns).sortBy(*columns).option("path", path).format("parquet").saveAsTable(table)
    return spark.table(table)


def clear_stored(spark: SparkSession) -> bool:
    """Delete all tables that this application has written; frames that still read them are of no use then."""
    for table in spark.catalog.listTables(pattern=f"{_own_tables(spark)}*"):
        spark.sql(f"DROP TABLE IF EXISTS {table.name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str = "table", compression: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """stored(df), and aggregates over its rows that are worked out as they are written."""
    seen = Observation()
    out = stored(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), name)
    return out, seen.get


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """stored(df) and the number of its rows."""
    out, seen = observed(df, name, n=F.count(F.lit(1)))
    return out, seen["n"]


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long") + 16
    if isinstance(kind, T.StructType):
        return sum((value_bytes(value.getField(f.name), f.dataType) for f in kind.fields), F.lit(16).cast("long"))
    if isinstance(kind, T.ArrayType):
        inner = F.aggregate(value, F.lit(0).cast("long"), lambda total, x: total + value_bytes(x, kind.elementType))
        return F.coalesce(inner, F.lit(0)) + 24
    if isinstance(kind, T.MapType):
        parts = [value_bytes(f(value), T.ArrayType(k)) for f, k in ((F.map_keys, kind.keyType), (F.map_values, kind.valueType))]
        return parts[0] + parts[1]
    return F.lit(8 if isinstance(kind, T.NumericType | T.BooleanType | T.DateType | T.TimestampType) else 64).cast("long")


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row of df takes in a hash table."""
    return sum((value_bytes(F.col("`" + f.name.replace("`", "``") + "`"), f.dataType) for f in df.schema.fields), F.lit(ROW_BYTES).cast("long"))


def sized(small: DataFrame, name: str = "side", limit: int = BROADCAST_BYTES, hint: str = "merge") -> DataFrame:
    """small, written, with a join hint: broadcast if its rows, weighed as they are written, take at most limit bytes in
    memory, else a shuffled join: by sorting, or as the given hint says."""
    width = row_bytes(small)
    out, seen = observed(small, name, bytes=F.sum(width))
    return F.broadcast(out) if (seen["bytes"] or 0) <= limit else out.hint(hint)


class Rounds:
    """A table that grows by a part a round. Each part is written once, and all are read as one scan, however many."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.fields = spark, new_path(spark, name), {}

    def add(self, df: DataFrame, number: int, **metrics: Column) -> tuple[DataFrame, dict]:
        """The written part, and aggregates over its rows."""
        part, seen = f"{self.path}/round={number}", Observation()
        metrics = metrics or {"n": F.count(F.lit(1))}
        df.observe(seen, *[c.alias(k) for k, c in metrics.items()]).write.parquet(part)
        self.fields |= {f.name: f for f in df.schema}
        return self.spark.read.schema(df.schema).parquet(part), seen.get

    def all(self) -> DataFrame:
        """All parts, with their number as `round`; columns a part lacks are null."""
        return self.spark.read.schema(T.StructType([*self.fields.values(), T.StructField("round", T.IntegerType())])).parquet(self.path)
