"""Quality rules: a hashed n-gram log-likelihood ratio between trusted and raw text.

Words and adjacent word pairs of every document are hashed into a fixed number of buckets. Bucket counts over all
trusted documents and over the whole corpus give two smoothed multinomials; a document's score is the mean log ratio
over its own n-grams. A document stays if it passes the base rules and its score reaches the threshold, which is the
highest cut on a fixed grid that at least `trusted_share` of the calibration documents reach. Those are a fixed fifth
of the trusted documents, by a hash of the id; the model is fitted on the others, so it has not seen them.

All of it is DataFrame functions: one scan counts buckets, one scan scores. Ratios are whole millionths, so sums do
not depend on the order of rows and reruns agree.

Null or empty texts have no words, fail the base rules and score 0. Repeated rows are each returned. Without trusted
documents every ratio and the threshold are 0, so only the base rules decide. Columns other than the id and the text
are ignored; labels for unknown documents count for nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import int_array, let, sized, stored, words_of

BUCKETS = 1 << 14
SMOOTHING = 0.5
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
TRUSTED_SHARE = 0.99
#: One trusted document in this many calibrates the threshold.
CALIBRATION = 5
UNIT = 1_000_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Width of the threshold grid, in millionths.
GRID = 1_000


def paired(hashes: Column, apart: int) -> Column:
    """Hashes of the pairs of elements that are so far apart."""
    n = F.size(hashes)
    firsts = F.when(n > apart, F.sequence(F.lit(0), n - 1 - apart)).otherwise(F.array().cast("array<int>"))
    return F.transform(firsts, lambda i: F.xxhash64(hashes[i], hashes[i + apart]))


def word_hashes(docs: DataFrame, words: Column) -> DataFrame:
    """docs with _one, hashes of the words, and _two, of neighbouring words. Words are hashed once; all longer n-grams
    are hashes of hashes."""
    df = docs.withColumn("_one", F.transform(words, lambda w: F.xxhash64(w)))
    return df.withColumn("_two", paired(F.col("_one"), 1))


def bucket_of(hashed: Column, buckets: int) -> Column:
    return F.pmod(hashed, F.lit(buckets)).cast("int")


def repeated_words(windows: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window whose hash occurs more than once among windows."""
    sorted_windows = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # After sorting, a window repeats if a neighbour has its hash. let() keeps the sorted array from being made anew.
    again = let(
        sorted_windows,
        lambda s: F.filter(
            s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])
        ),
    )
    covered = F.aggregate(
        F.sort_array(F.transform(again, lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")),
        lambda acc, s: F.struct((acc["n"] + F.least(F.lit(width), s - acc["last"])).alias("n"), s.alias("last")),
    )
    return covered["n"].cast("long")


def base_columns(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id, the words and the base counts of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(F.col(id_col), text.alias("_text"), words_of(text).alias("_words"), lines.alias("_lines"))
    n = F.size("_words")
    # Windows of 8 words as pairs of pairs of pairs; a text of one window repeats none.
    df = word_hashes(df, F.col("_words")).withColumn("_four", paired(F.col("_two"), 2))
    df = df.withColumn("_windows", F.when(n > WINDOW, paired(F.col("_four"), 4)).otherwise(F.array().cast("array<bigint>")))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    return df.select(
        id_col,
        "_one",
        "_two",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, repeated_words(F.col("_windows"))).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def marked(trusted: DataFrame, id_col: str) -> DataFrame:
    """Each trusted id once, with whether it is one of those that only calibrate the threshold."""
    ids = trusted.select(F.col(id_col).alias("_id")).where("_id is not null").distinct()
    return ids.withColumn("_calibrates", F.pmod(F.xxhash64("_id"), F.lit(CALIBRATION)) == 0)


def bucket_weights(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str, buckets: int) -> list[int]:
    """Log ratio of trusted to raw frequency of each bucket, in millionths. The result has `buckets` numbers."""
    fits = marks.where("not _calibrates").select("_id", F.lit(1).alias("_mark"))
    rows = docs.select(F.col(id_col).alias("_id"), words_of(F.col(text_col)).alias("_words")).join(fits, "_id", "left")
    counts = (
        word_hashes(rows, F.col("_words"))
        .select("_mark", F.explode(F.concat("_one", "_two")).alias("_hash"))
        .select("_mark", bucket_of(F.col("_hash"), buckets).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.count("_mark").alias("trusted"))
        .collect()
    )
    all_raw, all_trusted = sum(r["raw"] for r in counts), sum(r["trusted"] for r in counts)
    if not all_trusted:
        return [0] * buckets
    raw, good = [0] * buckets, [0] * buckets
    for r in counts:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["trusted"]
    share = lambda n, total: (n + SMOOTHING) / (total + SMOOTHING * buckets)
    return [round(UNIT * math.log(share(g, all_trusted) / share(r, all_raw))) for g, r in zip(good, raw, strict=True)]


def score_threshold(scored: DataFrame, share: float) -> int:
    """The highest grid point that at least this share of the calibration rows reach; 0 without any."""
    grid = (
        scored.where("calibrates and n_words > 0")
        .groupBy(F.floor(F.col("llr_micro") / GRID).alias("cell"))
        .agg(F.count("*").alias("n"))
        .orderBy("cell")
        .collect()
    )
    total, below, cut = sum(r["n"] for r in grid), 0, 0
    for r in grid:
        cut = r["cell"] * GRID
        below += r["n"]
        if below > (1 - share) * total:
            break
    return cut


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    trusted_share: float = TRUSTED_SHARE,
) -> DataFrame:
    """Score and threshold every document against trusted ones (a frame with the ids of trusted documents).

    Returns id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr, threshold.
    """
    marks = sized(marked(trusted, id_col), "marks")
    weights = int_array(bucket_weights(docs, marks, id_col, text_col, buckets))
    base = base_columns(docs, id_col, text_col)
    # The weight of bucket k is element k of a constant array.
    summed = lambda start, hashes: F.aggregate(hashes, start, lambda acc, h: acc + weights[bucket_of(h, buckets)])
    total = summed(summed(F.lit(0).cast("long"), "_one"), "_two")
    n_grams = F.greatest(F.lit(1), 2 * F.col("n_words") - 1)
    scored = base.select(
        id_col, *COUNTS, F.floor(total / n_grams).cast("long").alias("llr_micro")
    )
    scored = scored.join(marks, scored[id_col] == marks["_id"], "left")
    calibrates = F.coalesce("_calibrates", F.lit(False)).alias("calibrates")
    scored = stored(scored.select(id_col, *COUNTS, "llr_micro", calibrates), "quality")
    cut = score_threshold(scored, trusted_share)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return scored.select(
        id_col,
        *COUNTS,
        failed.alias("base_failed"),
        (~failed & (F.col("llr_micro") >= cut)).alias("kept"),
        (F.col("llr_micro") / UNIT).alias("llr"),
        F.lit(cut / UNIT).alias("threshold"),
    )
