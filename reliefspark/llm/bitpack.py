"""Token-id files: every id in the fewest bits its vocabulary needs.

A shard file holds, little-endian throughout:

    header   8 bytes magic, u32 bits, u32 ids a block, u64 zero
    blocks   the ids of a block, `bits` bits each, lowest bit first, padded to a byte
    index    u64 blocks, u64 documents, u64 ids, then u64 position of each block,
             i64 doc_id and u64 first id (within the shard) of each document
    end      u64 position of the index

Block positions make any id reachable by one seek and one shift; a block is
unpacked by numpy at once. Shards hold ascending doc_id ranges, so that the
documents of all shards, one after the other, are in ascending doc_id order.

Null texts count as empty; null doc_ids stand first, as the least number there is, and
come back as null. Documents with equal doc_id stay apart and keep their
own ids; their order among each other follows their text. Columns other than
doc_id and text are ignored. No documents: no shards and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .tokens import encoder

MAGIC = b"IDBITS01"
HEADER = struct.Struct("<8sIIQ")
BLOCK_IDS = 1 << 16


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8), axis=None, bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    out = np.zeros(n, np.uint32)
    for k in range(bits):
        out |= spread[:, k].astype(np.uint32) << np.uint32(k)
    return out


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


class ShardWriter:
    """Appends documents; holds one unfinished block and the index."""

    def __init__(self, uri: str, vocabulary: int, block_ids: int = BLOCK_IDS):
        files, path = _open(uri)
        files.create_dir(path.rsplit("/", 1)[0], recursive=True)
        # the index position is known only at the end and a stream can't seek back: it stands in the last 8 bytes too
        self.out = files.open_output_stream(path)
        self.bits, self.block_ids = bits_for(vocabulary), block_ids
        self.out.write(HEADER.pack(MAGIC, self.bits, block_ids, 0))
        self.at, self.blocks, self.docs, self.starts = HEADER.size, [], [], []
        self.rest, self.n = np.zeros(0, np.uint32), 0

    def add(self, doc_ids: list[int], ids: list[np.ndarray]) -> None:
        for d, x in zip(doc_ids, ids, strict=True):
            self.docs.append(d)
            self.starts.append(self.n)
            self.n += len(x)
        held = np.concatenate([self.rest, *ids])
        while len(held) >= self.block_ids:
            self._block(held[: self.block_ids])
            held = held[self.block_ids :]
        self.rest = held.copy()

    def _block(self, ids: np.ndarray) -> None:
        self.blocks.append(self.at)
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        head = np.array([len(self.blocks), len(self.docs), self.n], "<u8").tobytes()
        self.out.write(head + np.array(self.blocks, "<u8").tobytes() + np.array(self.docs, "<i8").tobytes() + np.array(self.starts, "<u8").tobytes() + struct.pack("<Q", self.at))
        self.out.close()


class Shard:
    """Random access to the ids of a shard file."""

    def __init__(self, uri: str):
        files, path = _open(uri)
        self.file = files.open_input_file(path)
        magic, self.bits, self.block_ids, _ = HEADER.unpack(self.file.read_at(HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError(f"not a token-id shard: {uri}")
        size = self.file.size()
        (index,) = struct.unpack("<Q", self.file.read_at(8, size - 8))
        raw = self.file.read_at(size - 8 - index, index)
        blocks, docs, self.n = (int(x) for x in np.frombuffer(raw, "<u8", 3))
        self.blocks = np.frombuffer(raw, "<u8", blocks, 24)
        self.doc_ids = np.frombuffer(raw, "<i8", docs, 24 + 8 * blocks)
        self.starts = np.append(np.frombuffer(raw, "<u8", docs, 24 + 8 * (blocks + docs)), self.n).astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        n = min(self.block_ids, self.n - k * self.block_ids)
        return unpack(self.file.read_at((n * self.bits + 7) // 8, int(self.blocks[k])), self.bits, n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the shard, from the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        held = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return held[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """doc_id, first id and ids of each document, every block read once."""
        held, base, k = np.zeros(0, np.uint32), 0, 0
        for d, a, b in zip(self.doc_ids.tolist(), self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            if b > base + len(held):
                need = [held[a - base :]]
                while k * self.block_ids < b:
                    need.append(self.block(k))
                    k += 1
                held, base = np.concatenate(need), a
            yield d, a, held[a - base : b - base]


_MANIFEST = "shard int, path string, n_docs long, n_tokens long"


def write_ids(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Encode documents, end each with `end_id` and write shards; returns the manifest.

    Each task writes to a name of its own attempt, and only attempts that succeeded
    appear in the manifest, so retried and speculative tasks do no harm.
    """
    spark = docs.sparkSession
    C.short_batches(spark)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, context, out = encoder(tokenizer_path), TaskContext.get(), None
        path = f"{folder}/{context.partitionId():06d}-{context.taskAttemptId()}.idbits"
        end = np.array([end_id], "<u4").tobytes()
        for b in C.slices(batches, "text", 4 << 20):
            out = out or ShardWriter(path, max(enc.vocab_size, end_id + 1))
            ids = enc.ids(b.column("text").to_pylist())
            out.add(b.column("doc_id").to_pylist(), [np.frombuffer(x + end, "<u4") for x in ids])
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([context.partitionId()], pa.int32()), "path": [path], "n_docs": pa.array([len(out.docs)], pa.int64()), "n_tokens": pa.array([out.n], pa.int64())})

    ordered = C.texts_of(docs).repartitionByRange(C.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, _MANIFEST)


_SPANS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_ids(spark: SparkSession, manifest: list) -> DataFrame:
    """One row for each document of the shards: doc_id, start, n_tokens, ids_crc32.

    `manifest` has a row for each shard file: its size follows the number of files,
    not that of documents.
    """
    rows, base = [], 0
    for m in sorted(manifest, key=lambda m: m.shard):
        rows.append((m.path, base))
        base += m.n_tokens

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("base").to_pylist(), strict=True):
                found: list[tuple[int, int, int, int]] = []
                for d, a, ids in Shard(path).documents():
                    found.append((d, first + a, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(found) == 8192:
                        yield _spans(found)
                        found = []
                if found:
                    yield _spans(found)

    files = spark.createDataFrame(rows, "path string, base long")
    return files.repartition(max(1, len(rows))).mapInArrow(read, _SPANS)


def _spans(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the documents' ids as shard files in the shared folder and read them back."""
    spark = docs.sparkSession
    manifest = write_ids(docs, C.fresh_path(spark, "token-ids"), tokenizer_path, end_id).collect()
    return C.given_ids(read_ids(spark, manifest))


def op2_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), 1)
