"""Near duplicates: MinHash bands, odd sketches, then full shingle sets.

A text's set holds its distinct word shingles. Documents of equal sets form a class,
found by a 128-bit sum over the set and confirmed on the sets, and one of each class goes on. MinHash samples are
cut into bands; documents that share a band are candidates. Every band bucket is tied
to its least document only, so candidates are never written out as pairs; components of
these ties are the clusters within which links can lie. Inside a cluster pairs that are
not yet connected are compared by odd sketches (the samples folded into a parity
bitmap: the XOR's population count estimates a high similarity precisely), and what
passes is confirmed on the full sets. Clusters beyond a size are compared block against
block in tasks of their own. Links' components give the groups.

The bands miss a pair at the threshold with a chance of at most MISS, and the sketch's
cut lies six standard deviations below it.

Empty, wordless and null texts have an empty set and are linked with nothing. Texts with
fewer words than a shingle have their whole word sequence as one shingle. Rows of equal
doc_id are documents of their own that happen to share an id; `copy`, the text's hash, tells
them apart, and of rows equal in both one is kept. A null doc_id is an id like any other,
the least there is. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .components import components

ROWS, MISS, BITS = 5, 1e-7, 512
#: Documents of a cluster, and numbers of their sets, that one side of a comparison holds.
BLOCK, BLOCK_SHINGLES = 2048, 4 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD))


def bands_for(share: float) -> int:
    """Bands of ROWS samples with which a pair at the threshold is missed with chance MISS."""
    return int(np.ceil(np.log(MISS) / np.log(1 - share**ROWS)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """Hashes of words, kept for the length of a task."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def shingles(text: str, size: int, hashes: Words | None = None) -> np.ndarray:
    """Sorted distinct 64-bit numbers of a text's shingles."""
    words = C.words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map((Words() if hashes is None else hashes).__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = _mixed(out * _MIX[2] + h[i : len(h) - n + 1 + i])
    return np.unique(out)


class Sketcher:
    """MinHash samples, band keys and odd sketches of shingle sets."""

    def __init__(self, bands: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.k = bands, bands * ROWS
        self.factor = rng.integers(0, 1 << 63, self.k, np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = rng.integers(0, 1 << 63, self.k, np.uint64)
        self.salt = np.arange(self.k, dtype=np.uint64) * _MIX[0]

    def samples(self, s: np.ndarray) -> np.ndarray:
        out = np.full(self.k, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(s), 1024):
            part = s[None, i : i + 1024] * self.factor[:, None]
            part += self.shift[:, None]
            np.minimum(out, part.min(1), out=out)
        return out

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        rows = samples.reshape(self.bands, ROWS)
        key = np.arange(self.bands, dtype=np.uint64)
        for i in range(ROWS):
            key = _mixed(key * _MIX[2] + rows[:, i])
        return key.view(np.int64)

    def odd_sketch(self, samples: np.ndarray) -> bytes:
        at = (_mixed(samples ^ self.salt) % np.uint64(BITS)).astype(np.int64)
        odd = np.bincount(at, minlength=BITS) & 1
        return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()

    def most_apart(self, share: float) -> int:
        """Bits in which the sketches of a pair at the threshold differ at most (six deviations)."""
        apart = self.k * (1 - share) + 6 * np.sqrt(self.k * share * (1 - share))
        z = BITS / 2 * (1 - np.exp(-4 * apart / BITS))
        return int(np.ceil(z + 6 * np.sqrt(z * (1 - z / BITS))))


SIGNATURES = "doc_id long, copy long, n_shingles long, sum1 long, sum2 long, bands array<long>"


def copy_of() -> Column:
    """Hash of a text, which tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    return C.texts_of(docs, copy_of().alias("copy"))


def signatures(docs: DataFrame, size: int, bands: int) -> DataFrame:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, hashes = Sketcher(bands), Words()
        for b in C.slices(batches, "text", 2 << 20):
            n, s1, s2, keys = [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingles(t, size, hashes)
                n.append(len(s))
                s1.append(int(_mixed(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                s2.append(int(_mixed(s * _MIX[2] + _MIX[1]).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                keys.append(sketcher.band_keys(sketcher.samples(s)) if len(s) else np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copy"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), lists], names=["doc_id", "copy", "n_shingles", "sum1", "sum2", "bands"])

    return keyed(docs).mapInArrow(work, SIGNATURES)


class Links:
    """Finds links among documents that are not connected yet."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray], sketches: np.ndarray, percent: int, most_apart: int):
        self.ids, self.sets, self.sketches, self.percent, self.most = ids, sets, sketches, percent, most_apart
        self.sizes = np.array([len(s) for s in sets])
        self.label = np.arange(len(ids))

    def confirm(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of the others are linked with i, on the full sets."""
        lengths = self.sizes[others]
        flat = np.concatenate([self.sets[j] for j in others])
        mine = self.sets[i]
        at = np.minimum(np.searchsorted(mine, flat), len(mine) - 1)
        both = np.add.reduceat((mine[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        return 100 * both >= self.percent * (lengths + len(mine) - both)

    def run(self, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
        """Links that connect members of `left` with members of `right`; a forest of them suffices."""
        out = []
        for i in left.tolist():
            while True:
                small, large = np.minimum(self.sizes[right], self.sizes[i]), np.maximum(self.sizes[right], self.sizes[i])
                j = right[(self.label[right] != self.label[i]) & (100 * small >= self.percent * large)]
                if not len(j):
                    break
                apart = np.bitwise_count(self.sketches[j] ^ self.sketches[i]).sum(1)
                order = np.argsort(apart, kind="stable")
                j, apart = j[order], apart[order]
                j = j[apart <= self.most]
                found = None
                for at in range(0, len(j), 64):
                    hit = np.flatnonzero(self.confirm(i, j[at : at + 64]))
                    if len(hit):
                        found = int(j[at + hit[0]])
                        break
                if found is None:
                    break
                out.append((int(self.ids[i]), int(self.ids[found])))
                self.label[self.label == self.label[found]] = self.label[i]
        return out


EDGES = "a long, b long"


def _placed(clusters: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """Where the set of a row (doc_id, copy) is needed: component, sides, turn, node.

    Representatives of classes meet those of their cluster (component from 0 up). Every row
    of a class with several meets the class's first row (turn 0; component below 0). Sides
    are so many that none holds much more than BLOCK documents or BLOCK_SHINGLES numbers.
    """

    def sides(rows: DataFrame, by: str) -> DataFrame:
        size = F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)
        return rows.groupBy(by).agg(F.greatest(F.ceil(size), F.lit(1)).cast("int").alias("sides"))

    inside = clusters.join(classes.select(F.col("node").alias("id"), "doc_id", "copy", "n_shingles"), "id")
    links = inside.join(sides(inside, "component"), "component").select("doc_id", "copy", "component", "sides", F.lit(1).alias("turn"), F.col("id").alias("node"))
    same = members.join(sides(members, "node"), "node").select("doc_id", "copy", (-1 - F.col("node")).alias("component"), "sides", F.when(F.col("first"), 0).otherwise(1).alias("turn"), "node")
    return links.unionByName(same)


def links(docs: DataFrame, clusters: DataFrame, classes: DataFrame, members: DataFrame, size: int, bands: int, percent: int) -> DataFrame:
    """Confirmed links inside clusters (id, component) of classes, as edges that connect what they link.

    Rows of one class are confirmed on their full sets too: two different sets of one class
    would be a collision of its 128-bit sum, which ends the job.
    """
    spark = docs.sparkSession
    placed = _placed(clusters, classes, members)
    few = max(1, -(-(clusters.count() + members.count()) // BLOCK))  # tasks that small groups share
    roles = placed.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("component", "sides", "turn", "node")).alias("roles"))  # two at most
    # a merge join at every size: a broadcast of the clusters would grow with the documents
    rows = keyed(docs).join(roles.hint("merge"), ["doc_id", "copy"]).select("doc_id", "copy", "text", "roles")

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher, hashes = Sketcher(bands), Words()
        for b in C.slices(batches, "text", 2 << 20):
            s = [shingles(t, size, hashes) for t in b.column("text").to_pylist()]
            compared = [any(r["component"] >= 0 for r in x) for x in b.column("roles").to_pylist()]
            sketch = [sketcher.odd_sketch(sketcher.samples(x)) if c else b"" for x, c in zip(s, compared, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copy"), b.column("roles"), pa.array([x.tobytes() for x in s], pa.binary()), pa.array(sketch, pa.binary())], names=["doc_id", "copy", "roles", "members", "sketch"])

    role = "struct<component:bigint,sides:int,turn:int,node:bigint>"
    made = rows.mapInArrow(sets, f"doc_id long, copy long, roles array<{role}>, members binary, sketch binary")
    made = made.select("doc_id", "copy", F.explode("roles").alias("r"), "members", "sketch").select("doc_id", "copy", "r.*", "members", "sketch")
    made = made.withColumn("side", F.pmod(F.xxhash64("doc_id", "copy", F.lit(9)), F.col("sides")).cast("int"))
    # a block meets every block of its cluster once, itself included; a class's first row goes to all sides, another to its own
    every = F.sequence(F.lit(0), F.col("sides") - 1)
    own = F.col("component") < 0
    other = F.explode(F.when(own & (F.col("turn") == 1), F.array("side")).otherwise(every))
    made = made.withColumn("other", other)
    made = made.withColumn("i", F.when(own, F.col("other")).otherwise(F.least("side", "other"))).withColumn("j", F.when(own, F.col("other")).otherwise(F.greatest("side", "other")))
    task = F.when(F.col("sides") == 1, F.pmod(F.xxhash64("component"), F.lit(few))).otherwise(F.xxhash64("component", "i", "j"))
    made = made.withColumn("task", task).select("task", "component", "i", "j", "turn", "side", "node", "doc_id", "copy", "members", "sketch")
    most = Sketcher(bands).most_apart(percent / 100)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            ids = np.array([r[3] for r in held])
            found = Links(ids, [np.frombuffer(r[4], np.uint64) for r in held], np.frombuffer(b"".join(r[5] for r in held), np.uint64).reshape(len(held), -1), percent, most)
            side = np.array([r[2] for r in held])
            i, j = held[0][1]
            edges = found.run(np.flatnonzero(side == i), np.flatnonzero(side == j)) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], names=["a", "b"])

        key, seen, first = None, None, None
        for b in batches:
            for c, i, j, s, turn, d, doc, copy, m, k in zip(*(b.column(x).to_pylist() for x in ("component", "i", "j", "side", "turn", "node", "doc_id", "copy", "members", "sketch")), strict=True):
                if key != (c, i, j):
                    if held:
                        yield close()
                    key, seen, first, held = (c, i, j), None, None, []
                if seen == (doc, copy):  # a repeated row
                    continue
                seen = (doc, copy)
                if c >= 0:
                    held.append((c, (i, j), s, d, m, k))
                elif turn == 0:
                    first = m
                elif first is not None and first != m:
                    raise ValueError(f"documents of one 128-bit sum differ in their shingles, such as {doc}")
        if held:
            yield close()

    dealt = made.repartition(max(C.partitions(spark), 1), "task").sortWithinPartitions("component", "i", "j", "turn", "node", "doc_id", "copy")
    return dealt.mapInArrow(work, EDGES)


def _judged(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, copy, n_shingles, component_id and chosen of every row; equal rows are chosen alike."""
    C.short_batches(docs.sparkSession)
    bands = bands_for(percent / 100)
    signed = C.cut(signatures(docs, size, bands), "signatures")
    same, own = ["n_shingles", "sum1", "sum2"], F.struct("doc_id", "copy")
    filled = signed.where("n_shingles > 0")
    first = filled.groupBy(*same).agg(F.min(own).alias("first"), F.max(own).alias("last"))
    # written once, so the numbers stay
    classes = C.cut(first.select(*same, "first.doc_id", "first.copy", (F.col("first") != F.col("last")).alias("several"), F.monotonically_increasing_id().alias("node")), "classes")
    members = filled.select("doc_id", "copy", *same).join(classes.where("several").select(*same, "node", F.struct("doc_id", "copy").alias("top")), same)
    members = C.cut(members.select("doc_id", "copy", "node", "n_shingles", (own == F.col("top")).alias("first")).distinct(), "class-members")
    firsts = filled.select("doc_id", "copy", "bands").join(classes.select("doc_id", "copy", "node"), ["doc_id", "copy"])
    posted = firsts.select("node", F.explode("bands").alias("band"))
    shared = posted.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("band", "least")
    ties = posted.join(shared, "band").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    clusters = C.cut(components(ties), "clusters")
    groups = components(links(docs, clusters, classes, members, size, bands, percent)).withColumnRenamed("id", "node")
    tops = groups.join(classes, "node").groupBy("component").agg(F.min(own).alias("top"))
    known = classes.join(groups.join(tops, "component").select("node", "top"), "node", "left").select(*same, F.coalesce("top", own).alias("top"))
    named = filled.select("doc_id", "copy", *same).join(known, same)
    judged = named.select("doc_id", "copy", "n_shingles", F.col("top.doc_id").alias("component_id"), (own == F.col("top")).alias("chosen"))
    # empty sets are linked with nothing and meet in no join
    return judged.unionByName(signed.where("n_shingles = 0").select("doc_id", "copy", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("chosen")))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    columns = ["doc_id", "copy", "n_shingles", "component_id", "chosen"]
    counted = _judged(docs, size, percent).groupBy(*columns).agg(F.count("*").alias("n"))
    rows = counted.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    kept = F.col("chosen") & ((F.col("i") == 1) | (F.col("n_shingles") == 0))
    return C.given_ids(rows.select("doc_id", "n_shingles", "component_id", kept.alias("kept")), "component_id")


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns as they are, that are the first of their group: one row of each."""
    judged = C.cut(_judged(docs, size, percent).groupBy("doc_id", "copy").agg(F.min("n_shingles").alias("n_shingles"), F.min("chosen").alias("chosen"), F.count("*").alias("n")), "judged")
    # the table's own columns travel in one, so that none can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), C.id_column().alias("doc_id"), copy_of().alias("copy"))
    left = rows.join(judged.where("not chosen"), ["doc_id", "copy"], "left_anti")
    twice = judged.where("chosen and n > 1 and n_shingles > 0")
    if not twice.isEmpty():
        nth = F.row_number().over(Window.partitionBy("doc_id", "copy").orderBy("doc_id"))
        equal = left.join(twice, ["doc_id", "copy"], "left_semi").withColumn("nth", nth).where("nth = 1").drop("nth")
        left = left.join(twice, ["doc_id", "copy"], "left_anti").unionByName(equal)
    return left.select("row.*")


def op9_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=3, percent=85)
