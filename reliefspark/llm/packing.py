"""Hierarchical packing of documents into training sequences.

Documents become runs of token ids. Full windows of the longest tier are cut off first;
what is left of each document is routed to the smallest context tier that holds it (by
default 128, 256, 512, 1024). Each tier, the longest first, packs windows of its own
length: its longest piece opens one, the gap is filled with the longest fitting pieces of
the same and shorter tiers, and where none fits, a piece of the shortest one is cut to
fill it exactly. What stays when a task's documents end is dealt to windows whose lengths
are powers of two. So are all tiers, so nothing needs padding.
Sequences of a block of documents are dealt to step groups in a snake order of
attention cost (sum of squared piece lengths), so that groups cost about the same.

A task packs its own partition block by block, so nothing is shuffled and memory holds
one block. Every id lies in exactly one piece. Null texts count as empty (their piece
is the end id alone); repeated and null doc_ids are packed row by row; other columns are
ignored; no documents give no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common as C
from .tokens import encoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length int, tier int, step_group long"
TIERS = (128, 256, 512, 1024)
GROUP = 64
#: Sequence ids of a task lie in a range of their own.
TASK_BITS = 36


class Packer:
    """Packs runs of lengths; knows nothing of ids but their places."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers))
        self.window = self.tiers[-1]
        self.pools: list[list[tuple[int, int, int]]] = [[] for _ in self.tiers]  # (length, document, start), ascending
        self.held = [0] * len(self.tiers)  # ids that wait in each pool
        self.sequences: list[list[tuple[int, int, int]]] = []

    def route(self, piece: tuple[int, int, int]) -> None:
        k = next(i for i, t in enumerate(self.tiers) if piece[0] <= t)
        insort(self.pools[k], piece)
        self.held[k] += piece[0]

    def add(self, document: int, length: int) -> None:
        start = 0
        while length - start >= self.window:
            self.sequences.append([(self.window, document, start)])
            start += self.window
        if length > start:
            self.route((length - start, document, start))

    def _pop(self, k: int, i: int) -> tuple[int, int, int]:
        piece = self.pools[k].pop(i)
        self.held[k] -= piece[0]
        return piece

    def _take(self, gap: int, tier: int) -> tuple[int, int, int]:
        """The longest waiting piece of a tier or a shorter one that fits; if none does, one cut to fit."""
        for k in range(tier, -1, -1):
            if (i := bisect_right(self.pools[k], (gap, 1 << 62, 0))) > 0:
                return self._pop(k, i - 1)
        k = next(k for k in range(tier + 1) if self.pools[k])
        length, document, start = self._pop(k, -1)
        self.route((length - gap, document, start + gap))
        return gap, document, start

    def waiting(self) -> int:
        return sum(self.held)

    def fill(self, length: int, tier: int) -> None:
        """One sequence of exactly `length` ids of a tier and shorter ones; as many must be waiting there."""
        out, gap = [], length
        while gap:
            piece = self._take(gap, tier)
            out.append(piece)
            gap -= piece[0]
        self.sequences.append(out)

    def pack(self, last: bool) -> list[list[tuple[int, int, int]]]:
        """Each tier opens windows of its own length while it has pieces, the longest tier first."""
        top = len(self.tiers) - 1
        for k in range(top, -1, -1):
            while self.pools[k] and sum(self.held[: k + 1]) >= self.tiers[k]:
                self.fill(self.tiers[k], k)
        if last:
            left = self.waiting()
            for bit in reversed(range(left.bit_length())):
                if left >> bit & 1:
                    self.fill(1 << bit, top)
        out, self.sequences = self.sequences, []
        return out


def step_groups(sequences: list[list[tuple[int, int, int]]], size: int) -> list[int]:
    """Group of each sequence, dealt back and forth by falling attention cost."""
    cost = [sum(n * n for n, _, _ in s) for s in sequences]
    groups, out = max(1, -(-len(sequences) // size)), [0] * len(sequences)
    for place, i in enumerate(sorted(range(len(sequences)), key=lambda i: (-cost[i], i))):
        turn, at = divmod(place, groups)
        out[i] = at if turn % 2 == 0 else groups - 1 - at
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, tiers: tuple[int, ...] = TIERS, group: int = GROUP, block_ids: int = 1 << 20) -> DataFrame:
    """One row for each piece: where its ids stand in its document and in its sequence."""
    spark = docs.sparkSession
    C.short_batches(spark)

    def rows(packer: Packer, ids: dict[int, tuple[int, bytes]], state: list[int], last: bool) -> Iterator[pa.RecordBatch]:
        sequences = packer.pack(last)
        groups = step_groups(sequences, group)
        out: list[tuple] = []
        for s, g in zip(sequences, groups, strict=True):
            at, total = 0, sum(n for n, _, _ in s)
            tier = next(t for t in packer.tiers if total <= t)
            for n, k, start in s:
                doc_id, data = ids[k]
                out.append((doc_id, start, n, zlib.crc32(memoryview(data)[4 * start : 4 * (start + n)]), len(data) // 4, state[0], at, total, tier, state[1] + g))
                at += n
            state[0] += 1
        state[1] += max(groups, default=-1) + 1
        for i in range(0, len(out), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 8192], strict=True), _TYPES, strict=True)], names=_NAMES)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer, end = encoder(tokenizer_path), Packer(tiers), np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << TASK_BITS
        state, ids, held, k = [first, first], {}, 0, 0
        for b in C.slices(batches, "text", 4 << 20):
            for d, x in zip(b.column("doc_id").to_pylist(), enc.ids(b.column("text").to_pylist()), strict=True):
                ids[k] = (d, x + end)
                packer.add(k, len(x) // 4 + 1)
                held, k = held + len(x) // 4 + 1, k + 1
            if held >= block_ids:
                yield from rows(packer, ids, state, False)
                stay = {p[1] for pool in packer.pools for p in pool}
                ids = {i: ids[i] for i in stay}
                held = packer.waiting()
        yield from rows(packer, ids, state, True)

    return C.given_ids(C.texts_of(docs).mapInArrow(work, SCHEMA))


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [{"long": pa.int64(), "int": pa.int32()}[x.split()[1]] for x in SCHEMA.split(", ")]


def op5_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)
