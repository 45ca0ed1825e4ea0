"""Benchmark decontamination: n-gram hits by count, then Smith-Waterman alignment.

An alignment of words (match 2, mismatch -1, gap -1) scores against a perfect copy of the
item's n words; pairs from the threshold t up are leaks. With m <= n matches and e errors
2m - e >= 2tn holds, so the matches form at most e + 1 unbroken runs and hold at least
m - e - 1 >= (2t - 1)n - 1 of the item's pairs of neighbouring words. Items for which that is
less than one are known by their single words, of which at least tn match. So of an item's
g grams any g - need + 1 hold one that a leak must show: the rarest ones, by their number in
the benchmark, are its seeds. Documents are joined with items on seeds; an item with enough
different grams in the document is then aligned around their hits. Longer rare n-grams would
lose edited, short and templated items, which these seeds can't.

The benchmark goes to tasks in parts of bounded size, one pass over the documents for
each part; items are never cut. Null or wordless texts on either side match nothing.
Repeated or null doc_ids or item_ids give a pair for each row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

THRESHOLD = 0.6
#: Characters of benchmark text that one pass carries to every task.
PART_CHARS = 4 << 20
_WORDS = re.compile(r"[^\W_]+")
PAIRS = "doc_id long, item_id long, score double, start_word int, n_words int"


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over word numbers: best score and the range of b it covers."""
    n, m = len(a), len(b)
    # cells of one antidiagonal depend on the two before it only
    before, last, best = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32), (0, 0, 0)
    begin_before, begin_last = np.full(n + 1, -1), np.full(n + 1, -1)
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        diagonal, up, left = before[i - 1] + np.where(a[i - 1] == b[j - 1], 2, -1), last[i - 1] - 1, last[i] - 1
        score = np.maximum(np.maximum(diagonal, 0), np.maximum(up, left))
        from_diagonal = np.where(before[i - 1] > 0, begin_before[i - 1], j - 1)
        begin = np.where(score == diagonal, from_diagonal, np.where(score == up, begin_last[i - 1], begin_last[i]))
        now, begin_now = np.zeros(n + 1, np.int32), np.full(n + 1, -1)
        now[i], begin_now[i] = score, begin
        k = int(np.argmax(score))
        if score[k] > best[0]:
            best = (int(score[k]), int(begin[k]), int(j[k]))
        before, last, begin_before, begin_last = last, now, begin_last, begin_now
    return best


def _keys(ids: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the words (n = 1) or of the pairs of neighbouring words (n = 2); 0 is no word of the benchmark."""
    return ids if n == 1 else np.where((ids[:-1] > 0) & (ids[1:] > 0), ids[:-1] << 31 | ids[1:], 0)


class Seeds:
    """Pairs of neighbouring words (or single words) of a part of the benchmark."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD):
        self.threshold, self.words = threshold, {}
        self.items: list[tuple[int, np.ndarray]] = []
        for item_id, text in items:
            ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in _WORDS.findall((text or "").lower())], np.int64)
            if len(ids):
                self.items.append((item_id, ids))
        self.size = np.array([len(ids) for _, ids in self.items], np.int64)
        pairs = np.ceil((2 * threshold - 1) * self.size - 1 - 1e-9).astype(np.int64)
        #: Words of a gram and different grams that an alignment from the threshold up holds at least.
        self.gram = np.where(pairs >= 1, 2, 1)
        self.need = np.where(pairs >= 1, pairs, np.maximum(1, np.ceil(threshold * self.size - 1e-9).astype(np.int64)))
        #: Words of a document that such an alignment covers at most.
        self.reach = self.size + np.floor(2 * (1 - threshold) * self.size + 1e-9).astype(np.int64)
        self.tables = []
        for n in (1, 2):
            which = np.flatnonzero(self.gram == n)
            if len(which):
                key = np.concatenate([_keys(self.items[k][1], n) for k in which])
                grams = self.size[which] - n + 1
                item, offset = np.repeat(which, grams), C.ragged(np.zeros(len(which), np.int64), grams)
                by = np.argsort(key, kind="stable")
                keys, first, count = np.unique(key[by], return_index=True, return_counts=True)
                self.tables.append((n, keys, first, count, item[by], offset[by], np.unique(key[self._rare(item, np.repeat(count, count)[np.argsort(by)])])))

    def _rare(self, item: np.ndarray, often: np.ndarray) -> np.ndarray:
        """Places of the rarest grams of each item, so many that every leak shows one."""
        by = np.lexsort((often, item))
        begin = np.searchsorted(item[by], item[by])
        grams = np.bincount(item, minlength=len(self.items))
        return by[np.arange(len(by)) - begin < (grams - self.need + 1)[item[by]]]

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Items with enough different grams in a document: their number, and place and offset of each hit."""
        for n, keys, first, count, item, offset, seeds in self.tables:
            if len(ids) < n:
                continue
            key = _keys(ids, n)
            if not (seeds[np.minimum(np.searchsorted(seeds, key), len(seeds) - 1)] == key).any():
                continue
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            at = np.flatnonzero(keys[place] == key)
            place = place[at]
            found = C.ragged(first[place], count[place])
            if not len(found):
                continue
            enough = np.bincount(item[np.unique(found)], minlength=len(self.items)) >= self.need
            if not enough.any():
                continue
            p = np.repeat(at, count[place])
            kept = np.flatnonzero(enough[item[found]])
            kept = kept[np.lexsort((p[kept], item[found[kept]]))]
            k = item[found[kept]]
            for part in np.split(kept, np.flatnonzero(k[1:] != k[:-1]) + 1):
                yield int(item[found[part[0]]]), p[part], offset[found[part]]

    def _windows(self, k: int, p: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Parts of a document that hold every alignment from the threshold up whole."""
        reach = int(self.reach[k])
        ahead = np.searchsorted(p, p + reach)
        dense = np.flatnonzero(ahead - np.arange(len(p)) >= self.need[k])
        if not len(dense):
            return
        lo, hi = np.maximum(0, p[dense] + 1 - reach), np.minimum(len(ids), p[dense] + reach)
        apart = np.flatnonzero(lo[1:] >= hi[:-1]) + 1
        for i, j in zip([0, *apart.tolist()], [*apart.tolist(), len(dense)], strict=True):
            a, b = int(lo[i]), int(hi[j - 1])
            shared = np.concatenate(([0], np.cumsum(np.isin(ids[a:b], self.items[k][1]))))
            span = min(reach, b - a)
            if (shared[span:] - shared[: len(shared) - span]).max() >= self.threshold * self.size[k] - 1e-9:
                yield a, b

    def leaks(self, text: str) -> list[tuple[int, float, int, int]]:
        """item_id, score, first word and words of the best window of each leaked item."""
        found = _WORDS.findall(text.lower())
        ids = np.fromiter(map(self.words.get, found, repeat(0)), np.int64, len(found))
        out = []
        for k, p, offset in self.hits(ids):
            item_id, item = self.items[k]
            best, most = (0.0, 0, 0), 2 * len(item)
            begin, grams = np.unique(p - offset, return_counts=True)
            verbatim = begin[grams == len(item) - self.gram[k] + 1]
            if len(verbatim):
                best = (1.0, int(verbatim[0]), len(item))
            else:
                for lo, hi in self._windows(k, p, ids):
                    if 2 * int(np.isin(item, ids[lo:hi]).sum()) >= self.threshold * most:  # no alignment scores more than its matches
                        score, a, b = align(item, ids[lo:hi])
                        if score / most > best[0]:
                            best = (score / most, lo + a, b - a)
            if best[0] >= self.threshold:
                out.append((item_id, *best))
        return out


def parts(benchmark: DataFrame, most: int = PART_CHARS) -> Iterator[list[tuple[int, str]]]:
    """Items in parts of at most `most` characters, one item at least, read one by one."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        n = len(r["text"] or "")
        if held and size + n > most:
            yield held
            held, size = [], 0
        held.append((r["item_id"], r["text"]))
        size += n
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, start_word and n_words of every leaked pair."""
    C.short_batches(docs.sparkSession)
    rows = C.texts_of(docs)

    def one(items: list[tuple[int, str]]) -> DataFrame:
        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(items, threshold)
            for b in batches:
                found = [(None if d == C.NO_ID else d, *x) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for x in seeds.leaks(t)]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate([pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()])], names=["doc_id", "item_id", "score", "start_word", "n_words"])

        return rows.mapInArrow(work, PAIRS)

    out = None
    for items in parts(benchmark):
        out = one(items) if out is None else out.unionByName(one(items))
    return out if out is not None else docs.sparkSession.createDataFrame([], PAIRS)


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns as they are, that hold no benchmark item."""
    C.short_batches(docs.sparkSession)
    for items in parts(benchmark):

        def work(batches: Iterable[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(items, threshold)
            for b in batches:
                yield b.filter(pa.array([not seeds.leaks(t or "") for t in b.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(work, docs.schema)
    return docs


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
