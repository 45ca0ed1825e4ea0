"""Removal of repeated substrings by suffix sorting.

Texts are UTF-8 bytes. A byte goes if a SPAN-byte string over it also starts earlier
(in a document of smaller id, or earlier in the same one). Sorting every suffix of a
corpus is not needed for that: each SPAN-byte window is known by its anchor, the
leftmost K-byte string in it whose hash is least, and equal windows have equal anchors
at equal places. Consecutive windows of one anchor form a run.

1. A task finds the runs of its documents. Of runs with equal hashes and equal bytes in a
   task only the earliest goes on; the windows of the others are repeats.
2. Runs meet by anchor, in sorted streams. Anchors with several runs ask for their bytes.
3. Of runs with equal bytes the earliest stays. Around each anchor the right and (reversed)
   left contexts of the others are suffix-sorted by hash comparison with byte verification;
   common extensions to both sides tell which windows are equal, and all but the earliest
   of them are repeats. Runs of anchors with more than CROWD of them (the edges of a
   passage that very many texts share) are first split by the bytes around the anchor, so
   that no task has to hold them all.
4. Repeats of a document are united and cut out.

No hash decides alone: what is removed has been compared byte by byte. Null texts are empty;
texts below SPAN bytes lose nothing. Rows of equal doc_id and text are one document given
several times: they are no repeats of each other and are cut alike. Rows of equal doc_id
and different texts are documents of their own, in the order of their texts' hashes
(`copy`). A null doc_id is an id like any other, the least there is. Lone surrogates can't
occur in UTF-8 input. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import common as C
from .suffixes import BASE, INVERSE, Suffixes, powers

SPAN, K = 100, 24
#: Windows of a run, at most: the k-grams of a window.
REACH = SPAN - K + 1
#: Runs of one anchor, at most, that one task sorts.
CROWD = 50_000
#: Bytes of text that are worked on at a time; longer texts are cut into overlapping pieces.
_BLOCK = 512 << 10
_PLACE_BITS = 24
_M = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xD6E8FEB86659FD93))


def _packed(start: np.ndarray, windows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """A run's start, number of windows and anchor offset in one number that sorts by start."""
    return start << 14 | windows << 7 | anchor


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 14, place >> 7 & 127, place & 127


def runs(data: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of documents laid end to end: anchor hash, run hash, document, packed place."""
    n = len(data)
    if n > 2 * _BLOCK + SPAN:  # one very long text, or some: pieces that share SPAN - 1 bytes hold every window once
        found = []
        for k, (at, size) in enumerate(zip(first.tolist(), length.tolist(), strict=True)):
            for low in range(0, max(1, size - SPAN + 1), _BLOCK):
                part = data[at + low : at + min(size, low + _BLOCK + SPAN - 1)]
                a, r, d, p = runs(part, np.zeros(1, np.int64), np.array([len(part)], np.int64))
                found.append((a, r, d + k, p + (low << 14)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    ok = length >= SPAN
    if n < SPAN or not ok.any():
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    padded = np.concatenate([data, np.zeros(K + 8, np.uint8)])
    eight = np.ndarray((n + K,), "<u8", padded.data, strides=(1,))
    h = eight[:n] * _M[0]
    h ^= h >> np.uint64(32)
    h += eight[8 : n + 8] * _M[1]
    h *= _M[3]
    h ^= h >> np.uint64(29)
    h += eight[16 : n + 16] * _M[2]
    h *= _M[0]
    h ^= h >> np.uint64(32)
    # order by the hash's upper bits, then by place, so that a window's least value tells its anchor
    key = h >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS) | np.arange(n, dtype=np.uint64)
    whole = -(-n // REACH) * REACH
    padded_key = np.full(whole + REACH, np.iinfo(np.uint64).max, np.uint64)
    padded_key[:n] = key
    rows = padded_key.reshape(-1, REACH)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[REACH - 1 : REACH - 1 + n])
    starts = C.ragged(first[ok], length[ok] - SPAN + 1)
    doc = np.repeat(np.flatnonzero(ok), length[ok] - SPAN + 1)
    anchor = (least[starts] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    windows = np.diff(np.append(at, len(starts)))
    s, m, d = starts[at], anchor[at], doc[at]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(BASE, n), dtype=np.uint64)])
    run = (sums[s + windows + REACH - 1] - sums[s]) * powers(INVERSE, n)[s] + windows.astype(np.uint64) * _M[2]
    return h[m], run, d, _packed(s - first[d], windows, m - s)


FOUND = "kind int, anchor long, run long, doc_id long, copy long, place long"
_FOUND = [("kind", pa.int32()), ("anchor", pa.int64()), ("run", pa.int64()), ("doc_id", pa.int64()), ("copy", pa.int64()), ("place", pa.int64())]
#: Kinds of FOUND rows: bytes run..place of a document are a repeat; a run; a run whose bytes are asked for.
REPEAT, RUN, ASK = 0, 1, 2


def _rows(kind: int, *columns: np.ndarray, step: int = 65_536) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(columns[0]), step):
        part = [c[i : i + step] for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind), pa.int32()), *(pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, pa.int64()) for c in part)], names=[x for x, _ in _FOUND])


def _united(doc: np.ndarray, copy: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges that touch or overlap in a document become one."""
    if not len(doc):
        return doc, copy, low, high
    by = np.lexsort((low, copy, doc))
    doc, copy, low, high = doc[by], copy[by], low[by], high[by]
    rank = np.zeros(len(doc), np.int64)
    rank[1:] = np.cumsum((doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]))
    shift = rank * (np.int64(high.max()) + 2)
    reach = np.maximum.accumulate(high + shift)
    new = np.ones(len(doc), bool)
    new[1:] = low[1:] + shift[1:] > reach[:-1]
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(doc)) - 1
    return doc[at], copy[at], low[at], reach[ends] - shift[at]


def _repeats(doc: np.ndarray, copy: np.ndarray, place: np.ndarray) -> Iterator[pa.RecordBatch]:
    start, windows, _ = _unpacked(place)
    d, c, low, high = _united(doc, copy, start, start + windows + SPAN - 1)
    return _rows(REPEAT, d * 0x9E3779B1 % (1 << 40), low, d, c, high)


def _again(*columns: np.ndarray) -> np.ndarray:
    """Which of the sorted rows equal the row before in all columns."""
    out = np.zeros(len(columns[0]), bool)
    out[1:] = np.logical_and.reduce([c[1:] == c[:-1] for c in columns])
    return out


def _equal(data: np.ndarray, x: np.ndarray, y: np.ndarray, length: np.ndarray, step: int = 20_000) -> np.ndarray:
    """Whether the bytes from x on and from y on are the same, for each pair."""
    out = np.zeros(len(x), bool)
    for i in range(0, len(x), step):
        n = length[i : i + step]
        same = data[C.ragged(x[i : i + step], n)] == data[C.ragged(y[i : i + step], n)]
        out[i : i + step] = np.logical_and.reduceat(same, np.cumsum(n) - n)
    return out


def find_runs(docs: DataFrame, flush: int = 1_000_000) -> DataFrame:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        texts_held: list[np.ndarray] = []

        def send() -> Iterator[pa.RecordBatch]:
            a, r, d, c, p, at = (np.concatenate(x) for x in zip(*held, strict=True))
            data = np.concatenate(texts_held)
            by = np.lexsort((p, c, d, r, a))
            by = by[~_again(a[by], r[by], d[by], c[by], p[by])]  # the run of a repeated row is the same run
            a, r, d, c, p, at = a[by], r[by], d[by], c[by], p[by], at[by]
            # runs of equal hashes are repeats if they follow one of the same bytes
            windows = _unpacked(p)[1]
            again = _again(a, r, windows)
            k = np.flatnonzero(again)
            again[k] = _equal(data, at[k], at[k - 1], windows[k] + SPAN - 1)
            yield from _rows(RUN, a[~again], r[~again], d[~again], c[~again], p[~again])
            yield from _repeats(d[again], c[again], p[again])

        size = 0
        for b in C.slices(batches, "text", _BLOCK):
            texts = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            length = np.array([len(t) for t in texts], np.int64)
            ids, copies = b.column("doc_id").to_numpy(), b.column("copy").to_numpy()
            data = np.frombuffer(b"".join(texts), np.uint8)
            first = np.cumsum(length) - length
            a, r, d, p = runs(data, first, length)
            held.append((a, r, ids[d], copies[d], p, size + first[d] + (p >> 14)))
            texts_held.append(data)
            size += len(data)
            if sum(len(x[0]) for x in held) > flush:
                yield from send()
                held, texts_held, size = [], [], 0
        if held:
            yield from send()

    return docs.mapInArrow(work, FOUND)


def settle_runs(found: DataFrame) -> DataFrame:
    """Repeats found so far, and the runs whose anchor has others beside it."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # the last run, and whether it was asked for
        for b in batches:
            kind = b.column("kind").to_numpy()
            out = kind == REPEAT
            if out.any():
                yield b.filter(pa.array(out))
            a, r, d, c, p = (b.column(x).to_numpy()[~out] for x in ("anchor", "run", "doc_id", "copy", "place"))
            if not len(a):
                continue
            if last:
                a, r, d, c, p = (np.concatenate([[x], y]) for x, y in zip(last[:5], (a, r, d, c, p), strict=True))
            new = ~_again(a, r, d, c, p)
            a, r, d, c, p = a[new], r[new], d[new], c[new], p[new]
            asked_before = bool(last and last[5])
            beside = np.zeros(len(a), bool)
            beside[1:] |= a[1:] == a[:-1]
            beside[:-1] |= a[1:] == a[:-1]
            asked = bool(beside[-1]) or (len(a) == 1 and asked_before)
            if asked_before:
                beside[0] = False  # it has been sent
            yield from _rows(ASK, a[beside], r[beside], d[beside], c[beside], p[beside])
            last = (a[-1], r[-1], d[-1], c[-1], p[-1], asked)

    dealt = found.repartition(C.partitions(found.sparkSession), "anchor").sortWithinPartitions("anchor", "run", "doc_id", "copy", "place")
    return dealt.mapInArrow(work, FOUND)


RUNS = "anchor long, doc_id long, copy long, place long, bytes binary"


def read_runs(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The bytes of the runs that were asked for."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text", _BLOCK):
            out: list[list] = [[], [], [], [], []]
            for d, k, t, want in zip(*(b.column(x).to_pylist() for x in ("doc_id", "copy", "text", "asked")), strict=True):
                data = t.encode("utf-8", "surrogatepass")
                for x in want:
                    start, windows = x["place"] >> 14, x["place"] >> 7 & 127
                    for c, v in zip(out, (x["anchor"], d, k, x["place"], data[start : start + windows + SPAN - 1]), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 4 + [pa.binary()], strict=True)], names=["anchor", "doc_id", "copy", "place", "bytes"])

    wanted = asked.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("anchor", "place")).alias("asked"))
    return docs.join(wanted, ["doc_id", "copy"]).mapInArrow(work, RUNS)


def repeated_windows(anchor: np.ndarray, doc: np.ndarray, copy: np.ndarray, place: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, ...]:
    """Byte ranges of the windows that an earlier run of the same anchor has too."""
    start, windows, left = _unpacked(place)
    n = len(data)
    length = np.array([len(x) for x in data], np.int64)
    flat = np.frombuffer(b"".join(data) + b"\0" * SPAN, np.uint8)
    first = np.cumsum(length) - length
    _, group = np.unique(anchor, return_inverse=True)
    sides = []
    for back, size in ((False, np.minimum(SPAN, length - left)), (True, left)):
        rows = np.empty((n, REACH if back else SPAN), np.uint8)
        step = -1 - np.arange(REACH) if back else np.arange(SPAN)
        for i in range(0, n, 4096):  # the index of all rows at once would be eight times their size
            rows[i : i + 4096] = flat[np.clip((first + left)[i : i + 4096, None] + step, 0, len(flat) - 1)]
        sides.append(Suffixes(rows, size).sorted_with_common(group))
    age = np.empty(n, np.int64)
    age[np.lexsort((start + left, copy, doc))] = np.arange(n)
    repeat = np.zeros((n, REACH), bool)
    classes = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for back in range(REACH):  # bytes of the window before the anchor
        rows = np.flatnonzero((left >= back) & (left - back < windows))
        if len(rows) < 2:
            continue
        for (order, shared), cls, depth in zip(sides, classes, (SPAN - back, back), strict=True):
            cls[order] = np.cumsum(shared < depth)
        key = classes[0][rows] * (n + 1) + classes[1][rows]
        by = np.lexsort((age[rows], key))
        again = np.flatnonzero(key[by][1:] == key[by][:-1]) + 1
        repeat[rows[by[again]], left[rows[by[again]]] - back] = True
    row, at = np.nonzero(repeat)
    return _united(doc[row], copy[row], start[row] + at, start[row] + at + SPAN)


RANGES = "doc_id long, copy long, low long, high long"


def _ranges(doc: np.ndarray, copy: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, copy, low, high)], names=["doc_id", "copy", "low", "high"])


def compare_runs(read: DataFrame, hold: int = 20_000) -> DataFrame:
    """Step 3 for anchors that one task can hold: whole anchors, some at a time."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close(t: pa.Table) -> pa.RecordBatch:
            anchor, doc, copy, place = (t[x].to_numpy() for x in ("anchor", "doc_id", "copy", "place"))
            data, left = t["bytes"].to_pylist(), place & 127
            # of equal runs (the same bytes around the anchor) the first stays to be sorted
            seen: dict[tuple, int] = {}
            first = np.array([seen.setdefault(k, i) for i, k in enumerate(zip(anchor.tolist(), left.tolist(), data, strict=True))], np.int64)
            own = first == np.arange(len(first))
            start, windows, _ = _unpacked(place[~own])
            again = _united(doc[~own], copy[~own], start, start + windows + SPAN - 1)
            others = repeated_windows(anchor[own], doc[own], copy[own], place[own], [data[i] for i in np.flatnonzero(own)])
            return _ranges(*(np.concatenate(x) for x in zip(again, others, strict=True)))

        end: list = [np.zeros(0, np.int64)] * 4
        for b in batches:
            key = [np.concatenate([e, b.column(c).to_numpy()]) for e, c in zip(end, ("anchor", "doc_id", "copy", "place"), strict=True)]
            again, end = _again(*key)[len(end[0]) :], [k[-1:] for k in key]
            held.append(b.filter(pa.array(~again)) if again.any() else b)  # repeated rows give the same runs
            if sum(x.num_rows for x in held) >= hold:
                t = pa.Table.from_batches(held)
                a = t["anchor"].to_numpy()
                whole = int(np.searchsorted(a, a[-1]))
                if whole:
                    yield close(t.slice(0, whole))
                    held = t.slice(whole).combine_chunks().to_batches()
        if held:
            yield close(pa.Table.from_batches(held))

    dealt = read.repartition(C.partitions(read.sparkSession), "anchor").sortWithinPartitions("anchor", "doc_id", "copy", "place")
    return dealt.mapInArrow(work, RANGES)


#: Bytes before a window's anchor from which a part of a crowded anchor's windows begins: few windows where contexts part.
_STEPS = (0, 1, 2, 4, 8, 16, 32, 45, 61, 69, 73, 75, 76, REACH)


def split_crowds(read: DataFrame) -> DataFrame:
    """Runs of crowded anchors in parts by their windows' place and surroundings.

    A part holds the windows that have between two of _STEPS bytes before the anchor. All of
    its windows hold the same bytes next to the anchor, so parts meet by these instead of by
    the anchor alone: equal windows still meet, and what shares one side only is dealt out.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for a, d, c, p, x in zip(*(b.column(n).to_pylist() for n in ("anchor", "doc_id", "copy", "place", "bytes")), strict=True):
                start, windows, left = p >> 14, p >> 7 & 127, p & 127
                for least, end in zip(_STEPS, _STEPS[1:], strict=False):
                    # window w of the run has left - w bytes before the anchor
                    first, last = max(0, left - end + 1), min(windows - 1, left - least)
                    if first > last:
                        continue
                    shared = x[left - least : left + SPAN - end + 1]
                    key = int.from_bytes(hashlib.blake2b(shared, digest_size=8, key=struct.pack("<qq", a, least)).digest(), "little", signed=True)
                    for o, v in zip(out, (key, d, c, (start + first) << 14 | (last - first + 1) << 7 | (left - first), x[first : last + SPAN]), strict=True):
                        o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, [pa.int64()] * 4 + [pa.binary()], strict=True)], names=["anchor", "doc_id", "copy", "place", "bytes"])

    return read.mapInArrow(work, RUNS)


def compare_crowded(read: DataFrame) -> DataFrame:
    """Step 3 for crowded anchors: equal parts by their bytes, through aggregation, then the same suffix sort on the rest."""
    same = ["anchor", "bytes", "windows", "left"]
    parts = C.cut(split_crowds(read), "crowded-parts").withColumns({"windows": F.shiftright("place", 7).bitwiseAND(127), "left": F.col("place").bitwiseAND(127)})
    own = F.struct("doc_id", "copy", "place")
    least = parts.groupBy(*same).agg(F.min(own).alias("least"), F.count("*").alias("n"))
    again = parts.join(least.where("n > 1").select(*same, "least"), same).where(own != F.col("least"))
    start = F.shiftright("place", 14)
    whole = again.select("doc_id", "copy", start.alias("low"), (start + F.col("windows") + SPAN - 1).alias("high"))
    return whole.unionByName(compare_runs(least.select("anchor", "least.*", "bytes")))


def copy_of(docs: DataFrame) -> Column:
    """What tells rows of one doc_id with different texts apart: 0 where no doc_id is repeated."""
    once = docs.groupBy(C.id_column().alias("id")).count().where(F.col("count") > 1).isEmpty()
    return F.lit(0).cast("long") if once else F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Byte ranges (doc_id, copy, low, high) of documents (doc_id, copy, text) to remove; they may overlap."""
    settled = C.cut(settle_runs(find_runs(docs)), "settled-runs")
    asked = settled.where(F.col("kind") == ASK)
    whole = settled.where(F.col("kind") == REPEAT).select("doc_id", "copy", F.col("run").alias("low"), F.col("place").alias("high"))
    crowded = [r["anchor"] for r in asked.groupBy("anchor").count().where(F.col("count") > crowd).select("anchor").collect()]  # at most one for each `crowd` runs
    if not crowded:
        return whole.unionByName(compare_runs(read_runs(docs, asked)))
    names = docs.sparkSession.createDataFrame([(x,) for x in crowded], "anchor long")
    read = read_runs(docs, asked.join(names, "anchor", "left_anti"))
    dense = C.cut(read_runs(docs, asked.join(names, "anchor", "left_semi")), "crowded-runs")
    return whole.unionByName(compare_runs(read)).unionByName(compare_crowded(dense))


def _cuts(cut: list | None, size: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted((x["low"], min(x["high"], size)) for x in cut or () if x["low"] < size):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _kept(data: bytes, cuts: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for low, high in cuts:
        out.append(data[at:low])
        at = high
    return b"".join([*out, data[at:]])


def with_cuts(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, copy, text and cuts (array of low, high) of every document."""
    C.short_batches(docs.sparkSession)
    rows = C.texts_of(docs, copy_of(docs).alias("copy"))
    by = repeats(rows, crowd).groupBy("doc_id", "copy").agg(F.collect_list(F.struct("low", "high")).alias("cuts"))
    return rows.join(by, ["doc_id", "copy"], "left")


def removed_substrings(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for d, t, c in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("cuts").to_pylist(), strict=True):
                data = t.encode("utf-8", "surrogatepass")
                cuts = _cuts(c, len(data))
                kept = _kept(data, cuts)
                for x, v in zip(out, (d, len(data), len(data) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest()), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.int64()] * 4 + [pa.string()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return C.given_ids(with_cuts(docs, crowd).mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))


def without_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """The documents, all columns as they are, with repeated bytes cut from their text.

    Bytes of a character that is cut in part go as a whole. A document that loses every
    byte stays with an empty text; a null text stays null.
    """
    C.short_batches(docs.sparkSession)
    copy, inner = copy_of(docs), [f.name for f in docs.schema if f.name.lower() == "text"][0]
    by = repeats(C.texts_of(docs, copy.alias("copy")), crowd).groupBy("doc_id", "copy").agg(F.collect_list(F.struct("low", "high")).alias("cuts"))
    # the table's own columns travel in one, so that none can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"), C.id_column().alias("doc_id"), copy.alias("copy"))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = []
            for t, c in zip(b.column("text").to_pylist(), b.column("cuts").to_pylist(), strict=True):
                data = (t or "").encode("utf-8", "surrogatepass")
                text.append(t if t is None or not c else _kept(data, _cuts(c, len(data))).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(text, pa.string())], names=["row", "text"])

    joined = rows.join(by, ["doc_id", "copy"], "left").select("row", "text", "cuts")
    cut = joined.mapInArrow(work, StructType([StructField("row", docs.schema), StructField("text", StringType())]))
    return cut.select(*[F.col("text").alias(inner) if c == inner else F.col("row")[c].alias(c) for c in docs.columns])


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
