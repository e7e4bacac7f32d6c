"""Token-ID output: Arrow stream files of equal-length sequences and masks, written in id order and read back.

Documents are range-partitioned and sorted by id; each task encodes its documents, appends the end id to each, and
packs the ids into sequences of SEQUENCE ids. A token file is one Arrow stream whose record batches all have
BATCH_ROWS rows of two fixed-size lists, `ids` and `mask` (false: padding at the file's end). So all batches have one
length in bytes, and sequence k of a memory-mapped file is row k % BATCH_ROWS of batch k // BATCH_ROWS, without a copy.
Next to it an index stream has `doc_id`, `start` (in the file) and `n_tokens`. Ids take 16 bits when the vocabulary
has at most 65,536, else 32.

A file's name has the task's attempt, and only files whose task ended count: their names are the rows of the written
manifest, so a lost executor leaves at most a file nobody reads. The folder is any URI that pyarrow.fs opens.

Ids are encoded piece by piece for the one make of tokenizer where that is the same (see Pieces), which is checked when
the file is loaded; for any other, texts are encoded whole.

Null texts count as empty and have the end id alone. Ids may be integers or strings, which the files keep as they are.
Rows with the same id are all written, ordered among themselves by a hash of the text, and divided among files like any
others: ranges are of id, hash and the row's number. Null ids come first. An empty table writes no file. Other columns
are ignored.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, stored

END_ID = 2
#: Fixed value: the length of the mark that ends an Arrow stream.
END_BYTES = 8
SEQUENCE = 1024
BATCH_ROWS = 64
#: Bytes of text for a task: the total over TASKS, within these bounds.
TASKS, LEAST_BYTES, MOST_BYTES = 2_000, 8 << 20, 1 << 30
#: Pieces whose ids a Python worker keeps, none longer than MEMO_BYTES.
MEMO_WORDS, MEMO_BYTES = 800_000, 48
#: The normaliser and pre-tokenizer for which texts may be encoded piece by piece (Pieces says why).
#: Texts of any other tokenizer are encoded whole.
PIECEWISE = {
    "normalizer": {
        "type": "Sequence",
        "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
    },
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
#: Letters from A to Latin Extended-B, which lower-casing keeps single letters, then signs that start no contraction
#: and no special token.
SIMPLE = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+)([!-&(-/:;=?@\[-`{}~]*)")


def worker_memo(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, which Spark keeps for many tasks."""
    return sys.__dict__.setdefault("_fluxfield_memo", {}).setdefault(name, {})


class Pieces(dict):
    """Ids (bytes) of white-space separated pieces of texts, worked out when first asked for.

    The tokenizer drops white space and never joins what it separates, so the ids of a text are those of its pieces one
    after another. A piece of Latin letters, with signs after them perhaps, is one lower-cased word for the model,
    which is asked directly; all other pieces go through the whole tokenizer. When a generation is full the next
    begins, and takes over from the last what is still asked for.
    """

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.model, self.kind = self.tokenizer.model, id_type(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.code = "H" if self.kind == "<u2" else "I"
        self.letters = byte_letters()
        self.last: dict = {}

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= MEMO_WORDS // 2:
            self.last = dict(self)
            self.clear()
        ids = self.last.get(piece)
        if ids is None:
            text = piece.decode()
            if m := SIMPLE.fullmatch(text):
                word = m[1].lower()
                if word == text:
                    if not word.isascii():
                        word = piece.decode("latin-1").translate(self.letters)
                    ids = self.coded([t.id for t in self.model.tokenize(word)])
                else:
                    ids = self[word.encode()] + (self[m[2].encode()] if m[2] else b"")
            else:
                ids = self.plain(text)
        if len(piece) <= MEMO_BYTES:
            self[piece] = ids
        return ids

    def plain(self, text: str) -> bytes:
        return self.coded(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def coded(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()


def byte_letters() -> dict[int, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, where it is another one."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + k for k, b in enumerate(others)}


def by_pieces(tokenizer) -> bool:
    """Whether a tokenizer is of the make that Pieces knows, with no added token that white space is part of."""
    made = json.loads(tokenizer.to_str())
    added = [t["content"] for t in made["added_tokens"]]
    plain = {"type": "BPE", "dropout": None, "unk_token": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "continuing_subword_prefix": None}
    return (
        all(made[k] == v for k, v in PIECEWISE.items())
        and all(made["model"].get(k) == v for k, v in plain.items())
        and all(t.startswith("<|") and len(t.split()) == 1 for t in added)
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in made["added_tokens"])
        and made["truncation"] is None
    )


def encoder(vocabulary: str, end_id: int) -> Callable[[list[bytes]], list[bytes]]:
    """A function that encodes texts (UTF-8) to ids (little-endian, with the end id)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    memo = worker_memo("pieces")
    if vocabulary not in memo:
        memo[vocabulary] = Pieces(vocabulary)
    pieces = memo[vocabulary]
    ids, end = pieces.__getitem__, np.array([end_id], pieces.kind).tobytes()
    if not by_pieces(pieces.tokenizer):
        return lambda texts: [pieces.plain(t.decode()) + end for t in texts]
    return lambda texts: [b"".join(map(ids, t.split())) + end for t in texts]  # bytes split at ASCII white space


def id_type(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def vocabulary_size(vocabulary: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary).get_vocab_size(with_added_tokens=True)


def token_schema(kind: str) -> pa.Schema:
    ids = pa.list_(pa.field("item", pa.uint16() if kind == "<u2" else pa.uint32(), False), SEQUENCE)
    return pa.schema([pa.field("ids", ids, False), pa.field("mask", pa.list_(pa.field("item", pa.bool_(), False), SEQUENCE), False)])


def token_batch(ids: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """One batch of BATCH_ROWS sequences; ids beyond the given ones are padding."""
    whole = np.zeros(SEQUENCE * BATCH_ROWS, ids.dtype)
    whole[: len(ids)] = ids
    mask = np.arange(len(whole)) < len(ids)
    lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=f.type) for x, f in zip((whole, mask), schema, strict=True)]
    return pa.RecordBatch.from_arrays(lists, schema=schema)


def _write(folder: str, vocabulary: str, end_id: int, kind: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, schema, room = encoder(vocabulary, end_id), token_schema(kind), SEQUENCE * BATCH_ROWS
        task = TaskContext.get()
        system, root = fs.FileSystem.from_uri(folder)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        writers, kept, total, docs = None, [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if not writers:
                index_schema = pa.schema([("doc_id", batch.schema.field(0).type), ("start", pa.int64()), ("n_tokens", pa.int64())])
                files = [system.open_output_stream(f"{root}/{name}.{x}.arrows") for x in ("tokens", "index")]
                writers = [pa.ipc.new_stream(f, s) for f, s in zip(files, (schema, index_schema), strict=True)]
            at = 0
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            for part in range(0, batch.num_rows, 256):  # a bounded number of texts at once
                coded = encode(texts.slice(part, 256).to_pylist())
                counts = np.array([len(c) for c in coded], np.int64) // int(kind[-1])
                begin = total + np.cumsum(counts) - counts
                ids = batch.column(0).slice(part, 256)
                writers[1].write_batch(pa.RecordBatch.from_arrays([ids, pa.array(begin), pa.array(counts)], schema=index_schema))
                total, docs = total + int(counts.sum()), docs + len(coded)
                kept.append(np.frombuffer(b"".join(coded), kind))
                if sum(map(len, kept)) >= room:
                    joined, at = np.concatenate(kept), 0
                    while len(joined) - at >= room:
                        writers[0].write_batch(token_batch(joined[at : at + room], schema))
                        at += room
                    kept = [joined[at:]]
        if writers:
            if rest := np.concatenate(kept).size:
                writers[0].write_batch(token_batch(np.concatenate(kept)[:rest], schema))
            for w, f in zip(writers, files, strict=True):
                w.close()
                f.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "name": [name], "n_docs": [docs], "n_tokens": [total]}, schema=MANIFEST)

    return write


MANIFEST = pa.schema([("part", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def write_token_files(
    docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text"
) -> list:
    """Write docs to folder in ascending order of their ids.

    Returns a row (part, name, n_docs, n_tokens) for each pair of files, in order.
    """
    kind = id_type(vocabulary_size(vocabulary))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = -(-size // min(MOST_BYTES, max(LEAST_BYTES, size // TASKS))) or 1
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    order = ["id", "hash", "row"]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text")
    manifest = rows.mapInArrow(_write(folder, vocabulary, end_id, kind), "part int, name string, n_docs bigint, n_tokens bigint")
    return stored(manifest, "manifest").orderBy("part").collect()


def _tokens(reader: pa.RecordBatchReader, kind: str) -> Iterator[np.ndarray]:
    """The ids that are not padding, a batch at a time."""
    for batch in reader:
        ids, mask = (batch.column(k).flatten() for k in range(2))
        used = mask.true_count
        yield ids.to_numpy(zero_copy_only=True)[:used]


def _read(folder: str, kind: str) -> Callable:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for manifest in batches:
            for name, first in zip(manifest.column("name").to_pylist(), manifest.column("first").to_pylist(), strict=True):
                with system.open_input_file(f"{root}/{name}.tokens.arrows") as f, system.open_input_file(f"{root}/{name}.index.arrows") as g:
                    chunks, left = _tokens(pa.ipc.open_stream(f), kind), np.empty(0, kind)
                    for index in pa.ipc.open_stream(g):
                        sums = []
                        for n in index.column("n_tokens").to_pylist():
                            got = [left]
                            have = len(left)
                            while have < n:
                                got.append(next(chunks))
                                have += len(got[-1])
                            joined = np.concatenate(got) if len(got) > 1 else left
                            sums.append(zlib.crc32(joined[:n].astype("<u4").tobytes()))
                            left = joined[n:]
                        start = pa.array(index.column("start").to_numpy() + first)
                        yield pa.RecordBatch.from_arrays([index.column("doc_id"), start, index.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_token_files(spark, manifest: list, vocabulary: str, folder: str, id_kind: str = "bigint") -> DataFrame:
    """Returns doc_id, start (over all files), n_tokens, ids_crc32 from the files of a manifest of ids of this type."""
    kind, first, rows = id_type(vocabulary_size(vocabulary)), 0, []
    for r in manifest:
        rows.append((r["name"], first))
        first += r["n_tokens"]
    files = spark.createDataFrame(rows, "name string, first bigint").repartition(max(1, len(rows)))
    return files.mapInArrow(_read(folder, kind), f"doc_id {id_kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def sequence(path: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and mask of sequence k of a local token file, by way of a memory map; the ids are not copied.

    All batches take the same bytes, so the place of a batch is worked out and the ones before it are not read.
    """
    file = pa.memory_map(path)
    schema = pa.ipc.read_schema(file)
    first = file.tell()
    pa.ipc.read_message(file)
    place = first + (file.tell() - first) * (k // BATCH_ROWS)
    if k < 0 or place >= file.size() - END_BYTES:
        raise IndexError(k)
    file.seek(place)
    batch = pa.ipc.read_record_batch(pa.ipc.read_message(file), schema)
    ids, mask = batch.column(0), batch.column(1)
    at = (k % BATCH_ROWS) * SEQUENCE
    return ids.flatten().to_numpy(zero_copy_only=True)[at : at + SEQUENCE], mask.flatten().slice(at, SEQUENCE).to_numpy(zero_copy_only=False)


def token_files(docs: DataFrame, vocabulary: str, folder: str | None = None, **how) -> DataFrame:
    """Write docs as token files and return what the files say of each document."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    id_kind = docs.schema[how.get("id_col", "doc_id")].dataType.simpleString()
    return read_token_files(spark, write_token_files(docs, vocabulary, folder, **how), vocabulary, folder, id_kind)
