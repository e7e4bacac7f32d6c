"""Importance resampling: draw the documents of a corpus that look most like a target, by hashed n-gram features.

A feature is a run of words; its bucket is the CRC-32 of its bytes modulo the number of buckets. The gain of a bucket is
how much likelier the target makes it than the corpus, add-one smoothed, as a whole number of thousandths. A document's
weight is the sum of gains over its features, its score the weight plus a Gumbel variate from a hash of its id, and the
highest scores are drawn: sampling without replacement in proportion to exp(weight / 1000).

Features are found a batch of texts at a time: the texts are joined with separator sentinels, one pass of a regular
expression finds all words, their places searched in the documents' offsets tell whose each is, n-grams whose ends are
of two documents are masked, and one bincount adds the rest up. Texts are read once: their bucket numbers are written
(two bytes a feature), with a histogram a task, so that the pass that weighs documents reads those. Histograms are
summed by Spark; the driver gets one number a bucket. Ranks come from a range sort with the row's number as last key,
so no score, id or text, however often it occurs, is one task.

Null and empty texts have no feature and weigh 0; they can be drawn only if least_words is 0. Null ids are hashed as
empty. Rows repeated whole have one score and consecutive ranks. An empty target or corpus has no counts (gains follow
from smoothing alone); empty documents give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fluxfield.operators.graph import dense_index

from .common import new_path, packed, stored

PERCENT, LEAST_WORDS, NGRAMS, BUCKETS, SEED = 10, 20, 1, 10_000, 2024
#: Words in UTF-8: runs of ASCII letters and of all bytes beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Between texts that are joined; no word holds it.
SENTINEL = b"\x00"
#: Bytes of texts that are joined at once; a longer text is a batch of its own.
JOINED_BYTES = 1 << 20


def text_batches(texts: list[bytes], room: int = JOINED_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `room` bytes together."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > room:
            yield first, k
            first, held = k, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)


def batch_features(texts: list[bytes], ngrams: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all features in document order, features a document, words a document)."""
    joined = SENTINEL.join(texts).lower()  # of bytes: A-Z only
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + len(SENTINEL)
    offsets = np.cumsum(sizes) - sizes
    spans = np.fromiter(((m.start(), m.end()) for m in WORD.finditer(joined)), np.dtype((np.int64, 2)))
    owner = np.searchsorted(offsets, spans[:, 0], side="right") - 1
    words = [joined[a:b] for a, b in spans.tolist()]
    sums = list(map(zlib.crc32, words))
    found, owners = [np.array(sums, np.int64) % buckets], [owner]
    for n in range(2, ngrams + 1):
        # The sum of a longer run goes on from that of the shorter one.
        sums = [zlib.crc32(w, zlib.crc32(b" ", s)) for s, w in zip(sums, words[n - 1 :], strict=False)]
        whole = owner[: len(sums)] == owner[n - 1 :]
        found.append((np.array(sums, np.int64) % buckets)[whole])
        owners.append(owner[: len(sums)][whole])
    of = np.concatenate(owners)
    features = np.concatenate(found)
    if ngrams > 1:
        features = features[np.argsort(of, kind="stable")]
    return features, np.bincount(of, minlength=len(texts)), np.bincount(owner, minlength=len(texts))


def _code(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _features(ngrams: int, buckets: int) -> Callable:
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, names = np.zeros(buckets, np.int64), ["row", "id", "n_words", "n_features", "codes", "histogram"]
        kinds: list = []
        for batch in batches:
            kinds = kinds or [batch.schema.field(0).type, batch.schema.field(1).type]
            texts = batch.column(2).cast(pa.large_binary()).fill_null(b"").to_pylist()
            for a, b in text_batches(texts):
                found, per_doc, words = batch_features(texts[a:b], ngrams, buckets)
                seen += np.bincount(found, minlength=buckets)
                codes = found.astype(_code(buckets))
                ends = np.concatenate([[0], np.cumsum(per_doc)]) * codes.itemsize
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(codes)])
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(words), pa.array(per_doc), binary.cast(pa.binary()), pa.nulls(b - a, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names)
        if kinds:
            none = [pa.nulls(1, k) for k in (*kinds, pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([seen.tolist()], pa.list_(pa.int64()))], names)

    return features


def features_of(texts: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> tuple[DataFrame, np.ndarray]:
    """(a row of bucket codes for each row of (row, id, text), how often each bucket occurs in all of them)."""
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"row bigint, id {kind}, n_words bigint, n_features bigint, codes binary, histogram array<bigint>"
    found = stored(texts.select("row", "id", F.col("text").cast("string")).mapInArrow(_features(ngrams, buckets), schema), "features")
    sums = found.where("histogram is not null").select(F.posexplode("histogram").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for r in sums.collect():  # as many rows as buckets
        counts[r["bucket"]] = r["n"]
    return found.where("histogram is null").drop("histogram"), counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log-likelihood ratio of each bucket, rounded down."""
    buckets, s, t = float(len(corpus)), corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _weights(gain: np.ndarray) -> Callable:
    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(4)
            data = [np.frombuffer(c, _code(len(gain))) for c in codes.to_pylist()]
            sums = np.array([int(gain[c].sum()) for c in data], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums)], ["row", "id", "n_words", "n_features", "weight"])

    return weights


def ranked(rows: DataFrame, target: DataFrame, percent: int, least_words: int, ngrams: int, buckets: int, seed: int) -> DataFrame:
    """(row, id, n_words, n_features, weight, score, rank) of rows (row, id, text) against the target's texts (text)."""
    features, corpus = features_of(rows, ngrams, buckets)
    _, wanted = features_of(target.select(F.lit(0).cast("long").alias("row"), F.lit("").alias("id"), "text"), ngrams, buckets)
    kind = rows.schema["id"].dataType.simpleString()
    weighed = features.mapInArrow(_weights(gains(corpus, wanted)), f"row bigint, id {kind}, n_words bigint, n_features bigint, weight bigint")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    seen = Observation()
    weighed = weighed.withColumn("score", F.col("weight") + noise)
    weighed = stored(weighed.observe(seen, F.count_if(F.col("n_words") >= least_words).alias("n")), "weighed")
    able = F.col("n_words") >= least_words
    drawn = percent * (seen.get["n"] or 0) // 100
    order = [F.col("score").desc(), F.col("id").asc(), F.col("row").asc()]
    ranks = dense_index(weighed.where(able), order, "rank").withColumn("rank", F.col("rank") + 1)
    ranks = ranks.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranks.unionByName(weighed.where(~able).withColumn("rank", F.lit(None).cast("long")))


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    ngrams: int = NGRAMS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """Returns id, n_words, n_features, weight, score, rank: of every document, the rank null if it is not drawn.

    Of the documents with at least least_words words, percent in a hundred are drawn, rounded down; ties go to the
    smaller id. Features are runs of 1 to ngrams words.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = ranked(rows, target.select(F.col(target_text_col).alias("text")), percent, least_words, ngrams, buckets, seed)
    return found.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank")


def resampled_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", **how) -> DataFrame:
    """The drawn rows of docs with all their columns. docs are written once with a number for each row, which ranks are
    joined by: no row is drawn twice or lost because it has equals."""
    how = {"percent": PERCENT, "least_words": LEAST_WORDS, "ngrams": NGRAMS, "buckets": BUCKETS, "seed": SEED} | how
    path = new_path(docs.sparkSession, "numbered")
    numbered = packed(docs, row=F.monotonically_increasing_id())
    numbered.write.parquet(path)
    numbered = docs.sparkSession.read.schema(numbered.schema).parquet(path)
    rows = numbered.select("row", F.col(f"doc.{id_col}").alias("id"), F.col(f"doc.{text_col}").alias("text"))
    drawn = ranked(rows, target.select(F.col(target_text_col).alias("text")), **how).where("rank is not null").select("row")
    return numbered.join(stored(drawn, "drawn").hint("merge"), "row", "left_semi").select("doc.*")


ORACLE_SQL = r"""
WITH k AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)) AS crcs),
d AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS MATERIALIZED (SELECT row, unnest(w) AS word FROM d),
y AS MATERIALIZED (SELECT unnest(w) AS word FROM b),
c AS MATERIALIZED (
  SELECT word, xor(4294967295, list_reduce(list_transform(range(octet_length(encode(word))), lambda i: ('0x' || hex(encode(word))[2 * i + 1 : 2 * i + 2])::BIGINT),
         lambda c, b: xor(crcs[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) % 10000 AS bucket
  FROM (SELECT word FROM x UNION SELECT word FROM y), k),
s AS (SELECT bucket, count(*) AS s FROM x JOIN c USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM y JOIN c USING (word) GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM x)::DOUBLE AS s_all, (SELECT count(*) FROM y)::DOUBLE AS t_all),
g AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
  FROM (SELECT range AS bucket FROM range(10000)) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), n),
v AS (SELECT row, sum(gain)::BIGINT AS weight FROM x JOIN c USING (word) JOIN g USING (bucket) GROUP BY row),
z AS (
  SELECT row, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN v USING (row)),
r AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, row) AS rank, count(*) OVER () AS n FROM z WHERE n_features >= 20)
SELECT doc_id, n_features AS n_words, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM z LEFT JOIN r USING (row)
"""
