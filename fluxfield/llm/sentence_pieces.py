"""SentencePiece encoding and decoding by a table of distinct chunks.

The library marks spaces as U+2581. In a vocabulary where no piece has a mark after another character, no merge crosses
the place before a run of marks, so the ids of a text are those of its chunks (a run of marks with what follows) one
after another, and each distinct chunk has to be segmented only once, however often it occurs:

1. Texts are cut into chunks and gathered into blocks of about BLOCK_BYTES. A block keeps its distinct chunks, and for
   each of its texts the places of its chunks among them, compressed.
2. Blocks' chunks are dealt by their hash into buckets. In a bucket all blocks' equal chunks meet, and each distinct one
   is segmented once and its ids decoded.
3. What was found goes back to the blocks, a row for each bucket and block, and ids and decoded texts are put together
   by place.

A block names a chunk once, so no chunk, however frequent, is a hot key, and the number of buckets grows with the bytes
of all texts, so none outgrows a task. Blocks are shuffled once and read twice, by steps 2 and 3 of one job. A text
longer than a block is a block of its own. Whether chunks are independent is checked when the model is loaded: marks
only in front of pieces, no normalization but the marks, no pieces of the user. For any other model a text is one
chunk, which is the same work without the gain.

Null and empty texts have no ids and decode to an empty text. Repeated rows are each returned; null ids are kept. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Characters of a block's texts, about, and what a text counts besides; bytes of all texts for each bucket of chunks.
BLOCK_CHARS, TEXT_CHARS, BUCKET_BYTES = 16 << 20, 64, 8 << 20
#: A space, then what a chunk has after its first mark.
CHUNK = re.compile(" ( *[^ ]*)")


class Model:
    """A SentencePiece model and whether its texts may be cut into chunks. A chunk is named without its first mark."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(k) for k in range(self.library.get_piece_size())]
        self.mark = self.library.piece_to_id(MARK)
        self.in_chunks = self.mark != self.library.unk_id() and not any(MARK in p.lstrip(MARK) for p in pieces) and self._only_marks()

    def _only_marks(self) -> bool:
        from sentencepiece import sentencepiece_model_pb2 as spec

        made = spec.ModelProto()
        made.ParseFromString(self.library.serialized_model_proto())
        how, user = made.normalizer_spec, spec.ModelProto.SentencePiece.USER_DEFINED
        plain = not how.precompiled_charsmap and how.add_dummy_prefix and how.escape_whitespaces and not how.remove_extra_whitespaces
        return plain and not made.trainer_spec.treat_whitespace_as_suffix and not any(p.type == user for p in made.pieces)

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        return CHUNK.findall(" " + text.replace(MARK, " ")) if self.in_chunks else [text]

    def encode(self, chunks: list[str]) -> list[list[int]]:
        ids = self.library.encode(chunks, num_threads=1)
        return [[self.mark] if self.in_chunks and not c else x for c, x in zip(chunks, ids, strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


def squeezed(*parts: bytes) -> bytes:
    """Parts one after another, compressed, with their length in front."""
    data = b"".join(parts)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def stretched(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def planes(numbers: np.ndarray) -> bytes:
    """Byte by byte of all numbers, as the higher ones are mostly zero."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def numbers_of(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def packed_texts(texts: list[str]) -> bytes:
    data = [t.encode() for t in texts]
    return squeezed(len(data).to_bytes(4, "little"), planes(np.fromiter(map(len, data), np.int64, len(data))), *data)


def unpacked_texts(data: bytes) -> list[str]:
    data = stretched(data)
    n = int.from_bytes(data[:4], "little")
    ends = np.concatenate([[0], np.cumsum(numbers_of(data[4 : 4 + 4 * n]), dtype=np.int64)])
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(data[4 + 4 * n :])).to_pylist()


def packed_codes(codes: np.ndarray) -> bytes:
    return squeezed(planes(codes))


def unpacked_codes(data: bytes) -> np.ndarray:
    return numbers_of(stretched(data))


def packed_ids(ids: list[list[int]]) -> bytes:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    values = np.fromiter((x for one in ids for x in one), np.int64, int(sizes.sum()))
    return squeezed(len(ids).to_bytes(4, "little"), planes(sizes), planes(values))


def unpacked_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, ids)."""
    data = stretched(data)
    end = 4 + 4 * int.from_bytes(data[:4], "little")
    return numbers_of(data[4:end]), numbers_of(data[end:])


def _blocks(model_path: str, room: int, buckets: int) -> Callable:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, number, kind = Model(model_path), TaskContext.get().partitionId() << 32, None
        ids, counts, codes, places, held = [], [], [], {}, 0

        def block() -> pa.RecordBatch:
            chunks = list(places)
            bucket = np.fromiter((zlib.crc32(c.encode()) % buckets for c in chunks), np.int64, len(chunks))
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(chunks), np.uint32)
            place[order] = np.arange(len(chunks), dtype=np.uint32)
            some, first = np.unique(bucket[order], return_index=True)
            packs = [packed_texts([chunks[k] for k in order[a:b]]) for a, b in zip(first, [*first[1:], len(chunks)], strict=False)]
            now = place[np.concatenate(codes)] if chunks else np.zeros(0, np.uint32)
            columns = [pa.array([number]), pa.array([ids], pa.list_(kind)), pa.array([counts], pa.list_(pa.int64())), pa.array([packed_codes(now)], pa.binary())]
            columns += [pa.array([some.tolist()], pa.list_(pa.int64())), pa.array([packs], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, ["block", "ids", "counts", "codes", "buckets", "chunks"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                size = len(text) + TEXT_CHARS
                if held and held + size > room:
                    yield block()
                    number, ids, counts, codes, places, held = number + 1, [], [], [], {}, 0
                chunks = model.chunks(text)
                codes.append(np.fromiter((places.setdefault(c, len(places)) for c in chunks), np.uint32, len(chunks)))
                ids.append(key)
                counts.append(len(chunks))
                held += size
        if ids:
            yield block()

    return blocks


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, of, chunks): a row for each bucket that a block has chunks of."""
    for batch in batches:
        for k in range(batch.num_rows):
            buckets, chunks = (batch.column(c).slice(k, 1).flatten() for c in (4, 5))
            yield pa.RecordBatch.from_arrays([buckets, pa.array([batch.column(0)[k].as_py()] * len(buckets), pa.int64()), chunks], ["bucket", "of", "chunks"])


def _segment(model_path: str) -> Callable:
    def segment(rows: pa.Table) -> pa.Table:
        """Of one bucket: the ids of each block's chunks, and their decoded texts where these are others."""
        model, places, of_row = Model(model_path), {}, []
        for data in rows.column("chunks").to_pylist():
            chunks = unpacked_texts(data)
            of_row.append([places.setdefault(c, len(places)) for c in chunks])
        chunks = list(places)
        ids, other = [], {}
        for at in range(0, len(chunks), 4096):
            part = model.encode(chunks[at : at + 4096])
            for k, (chunk, text) in enumerate(zip(chunks[at : at + 4096], model.decode(part), strict=True)):
                if text != chunk:
                    other[at + k] = text
            ids += part
        packs = [packed_ids([ids[k] for k in row]) for row in of_row]
        others = [[(j, other[k]) for j, k in enumerate(row) if k in other] if other else [] for row in of_row]
        columns = [rows.column("of"), rows.column("bucket"), pa.array(packs, pa.binary())]
        columns += [pa.array([[j for j, _ in row] for row in others], pa.list_(pa.int64())), pa.array([[t for _, t in row] for row in others], pa.list_(pa.string()))]
        return pa.Table.from_arrays(columns, ["of", "bucket", "found", "places", "texts"])

    return segment


def _together(blocks: pa.Table, found: pa.Table) -> pa.Table:
    """The texts of one block from what was found of its chunks, bucket by bucket as the block numbers them."""
    decoded, sizes, values = [], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)]
    chunks = blocks.column("chunks")[0].as_py()
    for row, data in zip(found.sort_by("bucket").to_pylist() if chunks else [], chunks, strict=True):
        texts = unpacked_texts(data)
        for k, text in zip(row["places"], row["texts"], strict=True):
            texts[k] = text
        decoded += texts
        one = unpacked_ids(row["found"])
        sizes.append(one[0])
        values.append(one[1])
    sizes, values, codes = np.concatenate(sizes).astype(np.int64), np.concatenate(values), unpacked_codes(blocks.column("codes")[0].as_py())
    first, until = np.cumsum(sizes) - sizes, np.cumsum([0, *blocks.column("counts")[0].as_py()])
    keys, lists, texts = blocks.column("ids").combine_chunks().flatten(), [], []
    for a, b in zip(until[:-1].tolist(), until[1:].tolist(), strict=True):
        own = codes[a:b]
        n = sizes[own]
        # Each id's place among the chunks' ids: its chunk's first, and how far it is in the chunk.
        at = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        lists.append(values[at].astype(np.int32))
        texts.append(" ".join([decoded[c] for c in own.tolist()]))
    ends = np.cumsum([0, *map(len, lists)])
    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists)))
    return pa.Table.from_arrays([keys, ids, pa.array(texts, pa.string())], ["id", "ids", "decoded"])


def encode(docs: DataFrame, model_path: str, block_chars: int = BLOCK_CHARS, bucket_bytes: int = BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, ids (array<int>), decoded (what the library decodes these ids to) of every text."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // bucket_bytes + 1
    schema = f"block bigint, ids array<{kind}>, counts array<bigint>, codes binary, buckets array<bigint>, chunks array<binary>"
    # One exchange, which both of its readers share; _named takes whole rows, so that it stays the same exchange.
    blocks = rows.mapInArrow(_blocks(model_path, block_chars, buckets), schema).repartition("block")
    named = blocks.mapInArrow(_named, "bucket bigint, of bigint, chunks binary")
    found = named.groupBy("bucket").applyInArrow(_segment(model_path), "of bigint, bucket bigint, found binary, places array<bigint>, texts array<string>")
    both = blocks.groupBy("block").cogroup(found.groupBy("of"))
    return both.applyInArrow(_together, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def _decode(model_path: str) -> Callable:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [x or [] for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.decode(ids), pa.string())], ["id", "text"])

    return decode


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Returns id and text of rows of ids from elsewhere; null and empty lists decode to an empty text."""
    kind = encoded.schema[id_col].dataType.simpleString()
    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decode(model_path), f"id {kind}, text string").withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Returns id, n_tokens, ids_sha256, decoded_sha256 of encode()'s rows."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
