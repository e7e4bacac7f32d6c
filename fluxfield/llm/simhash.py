"""SimHash near-duplicates by Golay-code fuzzy hashing.

A document's fingerprint has 64 bits, each set if it is set in over half of the hashes of its word shingles. Two
fingerprints link at 3 or fewer differing bits; the answer is the components of these links.

Fingerprints are cut into segments of 23, 23 and 18 bits. Of at most 3 errors, no two segments can have 2 each, so two
segments at least have at most 1. The perfect (23,12) Golay code puts any 23 bits within 3 of exactly one codeword; if
two segments differ in at most 1 bit, the codeword nearest to one of them is within 4 of the other. So each fingerprint
is looked up by the nearest codewords of its three pairs of segments, in a table that holds, for every pair, the
codewords within 4 of either segment: 1 or 6 each, and so 84 keys of 24 bits per fingerprint on average. Candidates are
verified by their differing bits inside the join, so only true links come out of it.

Equal fingerprints are one class from the start, whatever their number, and components are found among the fingerprints,
so null and repeated ids link like any other. Null, empty and word-free texts have fingerprint zero and are linked too.
Rows with the same id are each returned. A component whose ids are all null has a null label. Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxfield.operators.components import connected_components

from .common import packed, sized, stored

SHINGLE = 3
SEED = 42
MAX_BITS = 3
#: Low bit and width of each segment.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the (23,12) Golay code.
GENERATOR = 0xAE3
LENGTH, CHECK_BITS, REACH = 23, 11, 4


def fingerprint(text: bytes | None) -> int:
    """64 bits of one text."""
    words = (text or b"").lower().split()  # of bytes, both are ASCII only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        one = xxhash.xxh64_intdigest
        hashes = [one(joined[a:b], SEED) for a, b in zip(starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    most = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(most, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text, row) -> (id, print, row)."""
    for batch in batches:
        prints = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None) for x in batch.column(1).cast(pa.binary())), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), batch.column(2)], ["id", "print", "row"])


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    words = words.copy()
    for bit in range(LENGTH - 1, CHECK_BITS - 1, -1):
        words ^= np.where(words >> bit & 1, GENERATOR << (bit - CHECK_BITS), 0)
    return words


def error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome, the errors of weight up to 4 that have it (the lightest first), and their number: 1 or 6."""
    errors = np.array([sum(1 << i for i in c) for k in range(REACH + 1) for c in combinations(range(LENGTH), k)], np.int64)
    where = syndromes(errors)
    table, count = np.zeros((1 << CHECK_BITS, 6), np.int64), np.zeros(1 << CHECK_BITS, np.int64)
    for error, s in zip(errors.tolist(), where.tolist(), strict=True):
        table[s, count[s]] = error
        count[s] += 1
    return table, count


def codeword_keys(segment: np.ndarray, table: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (n, 6) of the codewords within 4 of each segment, the nearest first, and how many there are."""
    s = syndromes(segment)
    return (segment[:, None] ^ table[s]) >> CHECK_BITS, count[s]


def _keys(batches: Iterator[pa.RecordBatch], probe: bool) -> Iterator[pa.RecordBatch]:
    """Rows (print, rep, key): a print's three keys to look up, or all its keys to be found by."""
    errors = error_patterns()
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        found = [codeword_keys((prints >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1), *errors) for low, width in SEGMENTS]
        rows, keys = [], []
        for p, (a, b) in enumerate(PAIRS):
            for i in range(1 if probe else 6):
                for j in range(1 if probe else 6):
                    has = np.nonzero((found[a][1] > i) & (found[b][1] > j))[0]
                    rows.append(has)
                    keys.append(p << 24 | found[a][0][has, i] << 12 | found[b][0][has, j])
        row, key = pa.array(np.concatenate(rows)), pa.array(np.concatenate(keys).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), key], ["print", "rep", "key"])


def print_components(rows: DataFrame) -> DataFrame:
    """Rows (id, text, row) -> id, print, row, best: the least of (id is null, id, row) in the row's component."""
    id_type = rows.schema["id"].dataType.simpleString()
    prints = stored(rows.select("id", "text", "row").mapInArrow(_fingerprints, f"id {id_type}, print bigint, row bigint"), "prints")
    best = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    classes = stored(prints.groupBy("print").agg(F.min(best).alias("best")), "classes")
    own = classes.select("print", F.col("print").alias("rep"))
    table = own.mapInArrow(lambda it: _keys(it, False), "print bigint, rep bigint, key int").select("print", "key")
    probes = own.mapInArrow(lambda it: _keys(it, True), "print bigint, rep bigint, key int")
    probes = probes.select(F.col("print").alias("print2"), "key")
    # Prints are distinct here, so no key gathers copies; the probes, three a print, are the smaller side to hash.
    links = table.join(probes.hint("shuffle_hash"), "key").where(
        (F.bit_count(F.col("print").bitwiseXOR(F.col("print2"))) <= MAX_BITS) & (F.col("print") < F.col("print2"))
    )
    joined = connected_components(links.select("print", "print2"), "print", "print2").withColumnRenamed("node", "print")
    linked = stored(classes.join(sized(joined, "joined"), "print"), "linked")
    least = linked.groupBy("component").agg(F.min("best").alias("least"))
    linked = linked.join(sized(least, "least"), "component").select("print", "least")
    labels = classes.join(sized(linked), "print", "left").select("print", F.coalesce("least", "best").alias("best"))
    # A print may hold a third of all rows: a sort-merge join, whose large partitions are split at run time.
    return prints.join(labels.hint("merge"), "print")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, fingerprint (16 hex digits), component_id (the least id of the component)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(0).cast("long").alias("row"))
    return print_components(rows).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.col("best.id").alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: one with its least id; without an id only if no row of the component has one.

    The documents are written once with a number for each row, by which copies are dropped.
    """
    rows = stored(packed(docs, id=F.col(id_col), row=F.monotonically_increasing_id()), "numbered")
    found = print_components(rows.select("id", F.col("doc").getField(text_col).alias("text"), "row"))
    dropped = found.where(F.col("row") != F.col("best.row")).select("row")
    return rows.join(sized(dropped, "copies"), "row", "left_anti").select("doc.*")
