"""Toxicity: a counterfactually regularised linear classifier.

Features are the words of a text and the character 4- to 6-grams of its words with their boundaries, each present or
absent, hashed. From a bounded sample of labelled rows, feature counts by class are summed on executors; the features
that tell the classes apart best stay. For every sampled text that names a group, two counterfactual copies are made:
each identity term swapped for the next of its kind, and for a neutral word. The logistic loss then has a penalty on
the squared change of the score (log odds) between text and copies, so that the weights do not rest on which group is
named, or on naming one. The fit is full-batch gradient descent from zero, so reruns agree.

Scores use whole texts, one scan, no shuffle. Words are memorised per task; of a word of any length only the distinct
hashes are held. The driver gets the features of at most `sample_rows` rows, up to MAX_FEATURES places of 4 bytes each
for a text and, where it names a group, its two copies: 20,000 rows of 1,000 places, a third of them with copies, are
some 130 MB. Null and empty texts get the score of no
evidence (the intercept), far below one half when toxic labels are the minority; with no labelled rows every score is
0. Repeated rows are each scored. Labels that are null, or for unknown documents, are not learnt from; a document with
several labels counts as toxic if one says so; of several rows with a labelled id, one is learnt from, that whose text
has the least hash. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: At most this many labelled rows are learnt from, one for each id: the ids with the least hashes.
SAMPLE_ROWS = 20_000
HASH_BITS = 20
MAX_FEATURES = 3_000
MIN_DOCUMENTS = 3
L2 = 5e-5
COUNTERFACTUAL = 1.0
STEPS = 800
RATE = 3.0
FOLDS = 5
#: Words whose features a task keeps, none longer than MEMO_CHARS, and rows it turns to features at once.
MEMO_WORDS, MEMO_CHARS = 150_000, 40
FIT_ROWS = 256
#: Rows of a batch of documents that are kept.
OUT_ROWS = 512

#: Words that name groups, by kind; swaps stay within a kind. The last column is neutral.
IDENTITY_TERMS = {
    "en_people": (("women", "men", "girls", "boys", "gays", "lesbians", "muslims", "christians", "jews", "hindus", "immigrants", "refugees", "foreigners"), "people"),
    "en_person": (("woman", "man", "girl", "boy", "muslim", "christian", "jew", "hindu", "immigrant", "refugee", "foreigner"), "person"),
    "en_adjective": (("female", "male", "gay", "lesbian", "straight", "transgender", "black", "white", "asian", "latino", "african", "american", "european", "jewish", "islamic", "catholic", "disabled", "deaf", "blind", "old", "young"), "human"),
    "de_people": (("frauen", "männer", "schwule", "lesben", "muslime", "christen", "juden", "migranten", "ausländer"), "menschen"),
    "fr_people": (("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "étrangers"), "personnes"),
    "es_people": (("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "extranjeros"), "personas"),
}

WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def swaps() -> tuple[dict[str, str], dict[str, str]]:
    """Each identity term's next of its kind, and its neutral word."""
    after, neutral = {}, {}
    for terms, plain in IDENTITY_TERMS.values():
        after |= dict(zip(terms, (*terms[1:], terms[0]), strict=True))
        neutral |= dict.fromkeys(terms, plain)
    return after, neutral


def word_features(word: str) -> set[int]:
    """Hashes of a word and of its character 4- to 6-grams."""
    marked, last, crc = f"<{word}>", (1 << HASH_BITS) - 1, zlib.crc32
    found = {crc(marked[i : i + n].encode()) & last for n in (4, 5, 6) for i in range(len(marked) - n + 1)}
    found.add(crc(f"={word}".encode()) & last)
    return found


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that have each feature, by label, over a task's rows (text, label)."""
    counts, memo = np.zeros((2, 1 << HASH_BITS), np.int64), {}
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = set()
            for w in words_in(text):
                own = memo.get(w)
                if own is None:
                    own = array("i", word_features(w))
                    if len(w) <= MEMO_CHARS:
                        memo[w] = own
                found.update(own)
            if found:
                counts[label, np.fromiter(found, np.int64, len(found))] += 1
            if len(memo) > MEMO_WORDS // 4:
                memo.clear()
    has = np.nonzero(counts.sum(axis=0))[0]
    if len(has):
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(counts[0, has]), pa.array(counts[1, has])], ["feature", "clean", "toxic"])


class Features:
    """The chosen features of a text's words, by place in the list of chosen ones."""

    def __init__(self, chosen: list[int]) -> None:
        self.place, self.memo = {f: i for i, f in enumerate(chosen)}, {}

    def of(self, words: set[str]) -> set[int]:
        memo, place = self.memo, self.place
        if len(memo) > MEMO_WORDS:
            memo.clear()
        found: set[int] = set()
        for w in words:
            own = memo.get(w)
            if own is None:
                own = tuple(place[f] for f in word_features(w) if f in place)
                if len(w) <= MEMO_CHARS:
                    memo[w] = own
            if own:
                found.update(own)
        return found


def _rows_to_fit(chosen: list[int]) -> Callable:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, (after, neutral) = Features(chosen), swaps()
        # A bounded number of rows at once, as each has many features.
        for batch in (b.slice(k, FIT_ROWS) for b in batches for k in range(0, b.num_rows, FIT_ROWS)):
            out: list[tuple] = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_in(text)
                copies = [{m.get(w, w) for w in words} for m in (after, neutral)] if not words.isdisjoint(after) else []
                out.append((label, sorted(features.of(words)), [sorted(features.of(c)) for c in copies]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.list_(pa.int32())), pa.array([x[2] for x in out], pa.list_(pa.list_(pa.int32())))],
                ["label", "own", "copies"],
            )

    return rows


@dataclass(frozen=True)
class Model:
    features: list[int]
    weights: list[float]
    intercept: float
    rows: int


def fit(rows: list, n_features: int, strength: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights and intercept for rows of (label, own features, features of counterfactual copies)."""
    y = np.array([r[0] for r in rows], float)
    n = len(y)

    def flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([f for x in lists for f in x], np.int64)

    row, col = flat([r[1] for r in rows])
    # A copy's change: features gained count +1, lost -1.
    pairs = [(set(r[1]), set(c)) for r in rows for c in r[2]]
    change = [[(f, 1.0) for f in sorted(b - a)] + [(f, -1.0) for f in sorted(a - b)] for a, b in pairs]
    crow, ccol = flat([[f for f, _ in c] for c in change])
    sign = np.array([s for c in change for _, s in c], float)
    m = max(1, len(pairs))
    w, bias = np.zeros(n_features), float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    velocity, vbias = np.zeros(n_features), 0.0
    # Rare features get as large a step as common ones.
    scale = 1.0 / np.sqrt((np.bincount(col, minlength=n_features) + 1.0) / n)
    limit = 1.0 / (1.0 + 4.0 * strength)
    for _ in range(STEPS):
        p = 1.0 / (1.0 + np.exp(-(bias + np.bincount(row, w[col], n))))
        grad = np.bincount(col, (p - y)[row], n_features) / n + L2 * w
        if len(pairs):
            moved = np.bincount(crow, sign * w[ccol], len(pairs))
            grad += strength * 2 / m * np.bincount(ccol, sign * moved[crow], n_features)
        velocity = 0.9 * velocity - RATE * limit * 0.1 * grad * scale
        vbias = 0.9 * vbias - RATE * 0.1 * float((p - y).mean())
        w, bias = w + velocity, bias + vbias
    return w, bias


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    strength: float = COUNTERFACTUAL,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Learn from at most sample_rows rows, one for each labelled id outside the held-out fold."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "_id")
    rows = stored(rows.withColumn("_place", F.struct(F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))), "labelled")
    # One row for each id, so that sample_rows bounds the rows too, however often an id is repeated.
    first = rows.groupBy("_id").agg(F.min("_place").alias("_place")).select("_place")
    rows = stored(rows.join(F.broadcast(first), "_place").select("text", "label"), "learnt")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic + clean:
        return Model([], [], 0.0, 0)
    counts = rows.mapInArrow(_class_counts, "feature bigint, clean bigint, toxic bigint").groupBy("feature")
    counts = counts.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= MIN_DOCUMENTS)
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (toxic + 1 - a)) - F.log(b / (clean + 1 - b))
    strong = F.abs(odds) / F.sqrt(1 / a + 1 / (toxic + 1 - a) + 1 / b + 1 / (clean + 1 - b))
    chosen = [r["feature"] for r in counts.withColumn("z", strong).orderBy(F.desc("z"), "feature").limit(MAX_FEATURES).collect()]
    fitted = rows.mapInArrow(_rows_to_fit(chosen), "label int, own array<int>, copies array<array<int>>")
    # Of the bounded sample, only the places of chosen features come here; sorted, as rows may come in any order.
    data = sorted(((r["label"], r["own"], r["copies"]) for r in fitted.collect()), key=repr)
    weights, bias = fit(data, len(chosen), strength)
    return Model(chosen, weights.tolist(), bias, toxic + clean)


def _scores(model: Model) -> Callable:
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights = Features(model.features), model.weights
        for batch in batches:
            odds = [model.intercept + sum(weights[f] for f in sorted(features.of(words_in(t.as_py())))) for t in batch.column(1)]
            score = 1.0 / (1.0 + np.exp(-np.clip(np.array(odds, float), -700, 700))) if model.rows else np.zeros(len(odds))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["id", "score"])

    return scores


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, held_out, score, predicted."""
    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_scores(model), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _kept(model: Model, names: list[str], text_col: str) -> Callable:
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights, at = Features(model.features), model.weights, names.index(text_col)
        # Whole texts go out again: in small batches, so that neither side holds many copies of them.
        for batch in (b.slice(k, OUT_ROWS) for b in batches for k in range(0, b.num_rows, OUT_ROWS)):
            odds = [model.intercept + sum(weights[f] for f in sorted(features.of(words_in(t.as_py())))) for t in batch.column(at)]
            yield batch.filter(pa.array([not model.rows or x < 0 for x in odds], pa.bool_()))

    return kept


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without those whose score reaches one half: one scan, no join."""
    return docs.mapInArrow(_kept(model, docs.columns, text_col), docs.schema)
