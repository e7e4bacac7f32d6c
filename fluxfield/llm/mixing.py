"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts.

Each source has a weight and a budget of words: the sources share the corpus size by weight, none above `cap` times its
own size, and what a capped source leaves goes to the others by weight. Every document gets a random key from a hash of
its id. Within a source documents are ordered by key; key ranges are summed first, so the running sum of any document
is its range's offset plus a sum inside the range, and a source that holds a third of all rows is dealt over many
ranges. A source's budget is met to the word: whole epochs of all its documents, then documents in key order, the last
one in part.

Rows of one source, key and size are alike to the mix: they are counted before they are sorted, so an id that holds a
third of all rows is a few counted rows in its range. If the cut falls among alike rows, which of them come before it
goes by a number written with each row.

Nulls and empty texts have size 0 and nothing is taken of them. A null source is a source of its own, ordered last.
Null and repeated ids share a key. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, sized, stored, words_of

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = "mix-0"
KEY_BITS = 60
RANGE_BITS = 10


def random_key(id_: Column, seed: str) -> Column:
    """A uniform number of 60 bits from the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size -> with target, budget. One row per source is all that meets in one task here.

    With sources ordered by size per weight, the first k reach their cap; the level (words per unit of weight) of the
    others is what is left over their weights. The right k is the one whose level no remaining source's cap is below,
    and among such k the level is highest there.
    """
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_source) - 1) % len(weights)
    df = sizes.withColumn("weight", F.array(*[F.lit(w) for w in weights])[turn])
    df = df.withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    df = df.withColumn("level", left / F.sum("weight").over(after))
    df = df.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything))
    target = F.when(F.col("ratio") < F.col("level"), F.col("most").cast("double")).otherwise(F.col("level") * F.col("weight"))
    df = df.withColumn("target", target)
    return df.select("source", "source_size", "target", F.floor(F.col("target") + 0.5).cast("long").alias("budget"))


def source_cuts(rows: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """A row for each source of written rows (source, size, random_key, row): source_size, target, epochs, and where the
    order of (random_key, size, row) is cut: rows before the cut are taken once more, `part` words of the row at it."""
    alike = rows.groupBy("source", "random_key", "size").agg(F.count("*").alias("n"))
    alike = stored(alike.withColumn("range", F.shiftright("random_key", KEY_BITS - RANGE_BITS)).withColumn("words", F.col("size") * F.col("n")), "alike")
    ranges = alike.groupBy("source", "range").agg(F.sum("words").alias("range_size"))
    targets = stored(source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, cap), "targets")
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("offset", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
    ranges = ranges.select(F.col("source").alias("_source"), F.col("range").alias("_range"), "offset")
    inside = Window.partitionBy("source", "range").orderBy("random_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = alike.withColumn("before", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    # The ranges are many and their number has no useful bound: both sides are shuffled on source and range.
    summed = summed.join(ranges.hint("merge"), summed["source"].eqNullSafe(F.col("_source")) & (summed["range"] == F.col("_range")))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - epochs * F.col("source_size"))
    ends = targets.select(F.col("source").alias("_source2"), "rest")
    before = F.col("offset") + F.col("before")
    at = summed.join(sized(ends), summed["source"].eqNullSafe(F.col("_source2"))).where((before <= F.col("rest")) & (F.col("rest") < before + F.col("words")))
    # One row for each source whose rest is not nothing: the alike rows that the cut falls among.
    whole = F.expr("(rest - before_all) div size")
    at = at.withColumn("before_all", before).select(
        F.col("source").alias("_source"), F.col("random_key").alias("cut_key"), F.col("size").alias("cut_size"), whole.alias("whole"), (F.col("rest") - F.col("before_all") - whole * F.col("size")).alias("part")
    )
    at = sized(at, "cuts")
    among = rows.join(at, rows["source"].eqNullSafe(at["_source"]) & (rows["random_key"] == at["cut_key"]) & (rows["size"] == at["cut_size"]))
    # The row numbers ascend by the task that wrote them: first the task, then the row in it.
    among = stored(among.select("_source", "row", F.shiftright("row", 33).alias("task"), "whole"), "among")
    tasks = among.groupBy("_source", "task", "whole").agg(F.count("*").alias("n"))
    up_to = Window.partitionBy("_source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.withColumn("first", F.coalesce(F.sum("n").over(up_to), F.lit(0))).where((F.col("first") <= F.col("whole")) & (F.col("whole") < F.col("first") + F.col("n")))
    tasks = sized(tasks.select(F.col("_source").alias("_source3"), F.col("task").alias("_task"), "first"))
    inner = among.join(tasks, among["_source"].eqNullSafe(tasks["_source3"]) & (among["task"] == tasks["_task"]))
    nth = F.row_number().over(Window.partitionBy("_source").orderBy("row")) - 1 + F.col("first")
    cut_rows = inner.withColumn("nth", nth).where("nth = whole").select(F.col("_source").alias("_source4"), F.col("row").alias("cut_row"))
    cuts = at.join(cut_rows.hint("merge"), at["_source"].eqNullSafe(cut_rows["_source4"])).select("_source", F.struct(F.col("cut_key").alias("random_key"), F.col("cut_size").alias("size"), F.col("cut_row").alias("row")).alias("cut"), "part")
    return targets.join(cuts.hint("merge"), targets["source"].eqNullSafe(cuts["_source"]), "left").select(F.col("source").alias("_source"), "source_size", "target", "epochs", "cut", "part")


def decided(rows: DataFrame, weights: tuple[int, ...], cap: int, source: str = "source") -> DataFrame:
    """Written rows with source, size, random_key and row -> with source_size, target, epochs, and `extra`: the words
    taken beyond whole epochs."""
    key_columns = rows.select(F.col(source).alias("source"), "size", "random_key", "row")
    cuts = sized(source_cuts(key_columns, weights, cap), "source-cuts")
    df = rows.join(cuts, rows[source].eqNullSafe(F.col("_source")))
    at = F.struct("random_key", "size", "row")
    extra = F.when(F.col("cut").isNull() | (at > F.col("cut")), 0).when(at < F.col("cut"), F.col("size")).otherwise(F.col("part"))
    return df.withColumn("extra", extra.cast("long"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How many words the mix takes of each document.

    Returns id, size, source_size, target, taken, source, random_key, epochs (whole epochs of its source).
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.size(words_of(F.col(text_col))).cast("long").alias("size"),
        random_key(F.col(id_col), seed).alias("random_key"),
        F.monotonically_increasing_id().alias("row"),
    )
    taken = (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken")
    return decided(stored(rows, "mix"), weights, cap).select(F.col("id").alias(id_col), "size", "source_size", "target", taken, "source", "random_key", "epochs")


def mixed_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each epoch of each document.

    The documents are written once with a number for each row, and each row gets what mix_sources takes of it: whole
    copies, and of the row that the cut falls in its first words, joined by single spaces. Texts are not shuffled.
    Documents of which nothing is taken are absent. n_chars, where there is one, is that of the text.
    """
    own = {
        "source": F.col(source_col),
        "size": F.size(words_of(F.col(text_col))).cast("long"),
        "random_key": random_key(F.col(id_col), seed),
        "row": F.monotonically_increasing_id(),
    }
    df = decided(stored(packed(docs, **own), "to-mix"), weights, cap)
    copies = F.col("epochs") + F.when(F.col("extra") > 0, 1).otherwise(0)
    df = df.where((F.col("size") > 0) & (copies > 0)).withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    is_part = (F.col("copy") > F.col("epochs")) & (F.col("extra") < F.col("size"))
    cut_text = F.array_join(F.slice(words_of(F.col("doc").getField(text_col)), F.lit(1), F.col("extra").cast("int")), " ")
    text = F.when(is_part, cut_text).otherwise(F.col("doc").getField(text_col))
    out = {c: F.col("doc").getField(c) for c in docs.columns} | {text_col: text}
    if "n_chars" in out:
        out["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return df.select(*[c.alias(k) for k, c in out.items()])


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-0:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS random_key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS most, 3 * source_size / weight AS ratio FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ()
             - coalesce(sum(most) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM r),
v AS (SELECT *, max(level) FILTER (level <= ratio) OVER () AS final FROM l),
t AS (
  SELECT source, source_size, target, floor(target + 0.5)::BIGINT AS budget
  FROM (SELECT *, CASE WHEN ratio < final THEN most::DOUBLE ELSE final * weight END AS target FROM v)),
p AS (
  SELECT d.*, t.source_size, t.target, t.budget, CASE WHEN t.source_size > 0 THEN t.budget // t.source_size ELSE 0 END AS epochs,
         sum(size) OVER (PARTITION BY d.source ORDER BY random_key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - upto)))::BIGINT AS taken,
       source, random_key, epochs::BIGINT AS epochs
FROM p
"""
