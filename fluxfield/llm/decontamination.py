"""Benchmark decontamination: windows of test words in training texts.

A window is ten consecutive words of a benchmark item, or all words of a shorter one. Training words that lie in any
occurrence of a window are hit. Two passes over the documents: the first hashes short blocks of words at a stride that
every window must contain a block of, and looks them up in the hashed blocks of the benchmark; the second takes only
documents with such a block, and compares every window of theirs, as text, with the benchmark's windows. The
benchmark's blocks and windows are broadcast if they are small enough as written, else the joins shuffle.

Null and empty texts have no words. Rows that repeat an id with another text are judged apart; a row repeated whole is
returned as often as it is there: each row keeps a number of its own until its blocks are counted, and verdicts are
joined to the written rows, so that copies of one row, however many, are dealt like any others. Items without words have no window; items without an id have windows
that hit words, but are not counted. Empty tables give empty results or no hits; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, packed, sized, stored

WIDTH = 10
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, -1), "")


def starts(n: Column, width: int, step: int = 1) -> Column:
    """0, step, 2 step ... for windows of this width in n words."""
    none = F.array().cast("array<int>")
    return F.when(n >= width, F.sequence(F.lit(0), n - width, F.lit(step))).otherwise(none)


def block_of(width: int) -> tuple[int, int]:
    """Length and stride of blocks: each window of this width holds one whole block that starts at a multiple."""
    length = (width + 1) // 2
    return length, width - length + 1


def block_hashes(words: Column, width: int, step: int) -> Column:
    length, _ = block_of(width)
    at = lambda i: F.xxhash64(F.lit(width), *[words[i + k] for k in range(length)])
    return F.transform(starts(F.size(words), length, step), at)


def windows(words: Column, width: int) -> Column:
    at = lambda i: F.struct(i.alias("pos"), F.lit(width).alias("width"), F.array_join(F.slice(words, i + 1, F.lit(width)), " ").alias("gram"))
    return F.transform(starts(F.size(words), width), at)


def find_benchmark_windows(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Returns id, n_words, n_hit, n_items, items_sha256, contaminated, spans (word ranges hit, end exclusive)."""
    return judged(docs, benchmark, width, id_col, text_col, item_col, item_text_col).drop("_text_hash")


def text_hash(text: Column) -> Column:
    """With the id, what tells judged documents apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def judged(docs: DataFrame, benchmark: DataFrame, width: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """find_benchmark_windows with the hash of each row's text as _text_hash."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), normal_words(F.col(item_text_col)).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("width", F.least(F.lit(width), F.size("words")))
    widths = sorted(r[0] for r in items.select("width").distinct().collect())
    every = lambda f, none: F.concat(*[F.when(F.col("width") == k, f(F.col("words"), k)).otherwise(none) for k in widths])
    no_windows, no_hashes = F.array().cast("array<struct<pos:int,width:int,gram:string>>"), F.array().cast("array<bigint>")
    if widths:
        grams = items.select("item", F.explode(every(windows, no_windows)).alias("w")).select("item", F.col("w.gram").alias("gram"))
        blocks = items.select(F.explode(every(lambda w, k: block_hashes(w, k, 1), no_hashes)).alias("block"))
    else:
        grams, blocks = items.select("item", F.lit("").alias("gram")), items.select(F.lit(0).cast("long").alias("block"))
    grams, blocks = sized(grams.distinct(), "grams"), sized(blocks.distinct().withColumn("found", F.lit(True)), "blocks")

    docs = docs.select(F.col(id_col).alias("_id"), text_hash(F.col(text_col)).alias("_text_hash"), F.col(text_col).alias("_text"))
    read = docs.select("_id", "_text_hash", F.monotonically_increasing_id().alias("row"), normal_words(F.col("_text")).alias("words"))
    hashes = F.concat(no_hashes, *[block_hashes(F.col("words"), k, block_of(k)[1]) for k in widths])
    seen = (
        read.select("_id", "_text_hash", "row", F.size("words").alias("n_words"), F.explode_outer(hashes).alias("block"))
        .join(blocks, "block", "left")
        .groupBy("row", "_id", "_text_hash")
        .agg(F.max("n_words").cast("long").alias("n_words"), F.max(F.coalesce("found", F.lit(False))).alias("found"))
    )
    seen = stored(seen.drop("row"), "seen")
    same = lambda a, b: a["_id"].eqNullSafe(b["_id"]) & (a["_text_hash"] == b["_text_hash"])
    maybe = sized(seen.where("found").select("_id", "_text_hash").distinct(), "maybe")
    some = docs.join(maybe, same(docs, maybe), "left_semi")
    some = some.select("_id", "_text_hash", normal_words(F.col("_text")).alias("words"))
    found = (
        some.select("_id", "_text_hash", F.explode(F.concat(no_windows, *[windows(F.col("words"), k) for k in widths])).alias("w"))
        .select("_id", "_text_hash", F.col("w.pos").alias("pos"), (F.col("w.pos") + F.col("w.width")).alias("end"), F.col("w.gram").alias("gram"))
        .join(grams, "gram")
        .groupBy("_id", "_text_hash")
        .agg(F.sort_array(F.collect_set(F.struct("pos", "end"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["upto"], s["pos"]))).alias("n"), F.greatest(acc["upto"], s["end"]).alias("upto")),
    )["n"]
    found = found.select(F.col("_id").alias("_id2"), F.col("_text_hash").alias("_hash2"), covered.cast("long").alias("n_hit"), "items", "spans")
    both = seen["_id"].eqNullSafe(F.col("_id2")) & (seen["_text_hash"] == F.col("_hash2"))
    # The documents with hits have no bound: broadcast if they are few as written, else a shuffled join, in which copies
    # of one row beyond a partition's size are split.
    return seen.join(sized(found, "found"), both, "left").select(
        F.col("_id").alias(id_col),
        "_text_hash",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.col("spans"),
    )


def clean_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = WIDTH,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """docs without the rows that hold a benchmark window; other rows of such an id, or without an id, stay."""
    found = judged(docs, benchmark, width, id_col, text_col, item_col, item_text_col).where("contaminated")
    bad = sized(found.select(F.col(id_col).alias("bad"), F.col("_text_hash").alias("bad_hash")).distinct(), "contaminated")
    rows = packed(docs, id=F.col(id_col), hash=text_hash(F.col(text_col)))
    return rows.join(bad, rows["id"].eqNullSafe(bad["bad"]) & (rows["hash"] == bad["bad_hash"]), "left_anti").select("doc.*")


ORACLE_SQL = r"""
WITH b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item, least(10, len(w)) AS width, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS gram
  FROM b, unnest(range(1, greatest(2, len(w) - 8))) AS u(i) WHERE len(w) > 0),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (
  SELECT doc_id, i, k AS width, array_to_string(w[i : i + k - 1], ' ') AS gram
  FROM d, (SELECT DISTINCT width AS k FROM g), unnest(range(1, len(w) - k + 2)) AS u(i)),
h AS (SELECT doc_id, i, p.width, item FROM p JOIN g ON p.gram = g.gram AND p.width = g.width),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + width)) AS u(j) GROUP BY doc_id),
m AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m USING (doc_id)
"""
