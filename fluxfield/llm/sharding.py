"""Sharding by sampled splitters: near-equal bytes in each shard, equal texts together where that is possible.

The sort key of a document is a hash of its text, so equal texts are neighbours. Keys are drawn with chances in
proportion to document sizes, a bounded number however large the corpus; quantiles of the draws are the splitters of
many fine ranges. Ranges that turn out overfull in bytes or rows are subdivided by another hash of the key, which keeps
equal texts together; only a heavy text, one that fills a mean range by itself, is dealt by a hash of a number written
with each row, so null and repeated ids and rows repeated whole are split like any other. There are at most twice as
many heavy texts as ranges, whatever the input.
The pieces, in key order, are then cut into shards where the running sum of their exact sizes passes each share. A
document's slot is the piece's offset in its shard plus its rank in the piece, so no task needs a whole shard.

Law: `bytes`. Null texts count as empty, of size 1. Rows with the same id and text are ordered arbitrarily among
themselves, which no column shows but the slot. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SHARDS = 8
#: The ranges are found in two steps of this many comparisons.
STEP = 32
RANGES = STEP * STEP
DRAWS = 32 * RANGES
#: A range is overfull above this multiple of the mean range.
OVERFULL = 2


def unit_hash(*cols: Column) -> Column:
    """A uniform number from 0 to 1."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def splitters(rows: DataFrame, total: int, draws: int = DRAWS, ranges: int = RANGES) -> list[int]:
    """Quantiles of keys drawn by size: ranges - 1 sorted keys, some perhaps equal. The driver gets the draws."""
    times = F.floor(F.col("size") * F.lit(draws / max(1, total)) + unit_hash(F.col("row")))
    drawn = rows.select("key", times.alias("times")).where("times > 0").groupBy("key").agg(F.sum("times").alias("times")).collect()
    points = sorted((r["key"], r["times"]) for r in drawn)
    all_draws, upto, cuts = sum(n for _, n in points), 0, []
    for key, n in points:
        upto += n
        while len(cuts) < ranges - 1 and upto * ranges >= (len(cuts) + 1) * all_draws:
            cuts.append(key)
    return cuts + [(1 << 63) - 1] * (ranges - 1 - len(cuts))


def range_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts are below key: a coarse step over every 32nd cut, then one over the cuts between."""
    constant = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda c: c < key))
    coarse = below(constant(cuts[STEP - 1 :: STEP])) * STEP
    return coarse + below(F.slice(constant(cuts), coarse + 1, F.lit(STEP)))


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, size, text_crc32, law, shard, slot, grown_shard (null: the law is not `key`)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_col).alias("_id"),
            F.monotonically_increasing_id().alias("row"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        ),
        "shards",
    )
    total, n = (x or 0 for x in rows.agg(F.sum("size"), F.count("*")).first())
    rows = stored(rows.withColumn("range", range_of(F.col("key"), splitters(rows, total))), "ranges")
    means = F.greatest(F.col("size") / max(1.0, total / RANGES), F.col("n") / max(1.0, n / RANGES))
    found = rows.groupBy("range").agg(F.sum("size").alias("size"), F.count("*").alias("n")).where(means > OVERFULL)
    full = {r["range"]: r["parts"] for r in found.select("range", F.ceil(means).cast("int").alias("parts")).collect()}
    parts = F.split(F.lit(",".join(str(full.get(k, 1)) for k in range(RANGES))), ",").cast("array<int>")
    rows = rows.withColumn("parts", parts[F.col("range")])
    keys = rows.where("parts > 1").groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    heavy = [r["key"] for r in keys.where((means > 1) & (F.col("n") > 1)).select("key").collect()]
    dealt_by = F.when(F.col("key").isin(heavy), F.xxhash64("row", F.lit(1))).otherwise(F.xxhash64("key", F.lit(1)))
    rows = rows.withColumn("part", F.when(F.col("parts") > 1, F.pmod(dealt_by, "parts")).otherwise(F.lit(0)).cast("int")).drop("parts")
    # At most four times as many pieces as ranges, whatever the input.
    pieces = rows.groupBy("range", "part").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("range", "part").collect()
    upto, slots, placed = 0, [0] * shards, []
    for p in pieces:
        shard = min(shards - 1, (2 * upto + p["size"]) * shards // (2 * total))
        placed.append((p["range"], p["part"], shard, slots[shard]))
        upto, slots[shard] = upto + p["size"], slots[shard] + p["n"]
    places = docs.sparkSession.createDataFrame(placed, "range int, part int, shard int, first long")
    in_piece = Window.partitionBy("range", "part").orderBy("key", "_id")
    return (
        rows.withColumn("rank", F.row_number().over(in_piece))
        .join(F.broadcast(places), ["range", "part"])
        .select(
            F.col("_id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("rank") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
