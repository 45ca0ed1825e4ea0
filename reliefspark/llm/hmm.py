"""Language-model scores by a hidden Markov model over word classes.

Tokens are the lower-cased words of a text and one end. Every token has a class: the
most frequent training tokens have one of their own, any other goes by a hash of its
ending. Latent states emit classes; a class emits its tokens by their smoothed counts,
whatever the state, so the probability of a text is the forward probability of its
class sequence times its tokens' shares of their classes.

Counts cover all training documents. Each task numbers the tokens of its documents group
by group; groups' tokens meet in hash buckets, where counts are added up, and the counts
come back to the groups, so texts are tokenized once and never shuffled. Baum-Welch starts from a clustering of a bounded sample and
runs over the whole training set until the likelihood settles: each task adds up the
expected counts of its documents, and these sums add up across tasks. The scaled forward
recursion then gives each text's exact likelihood.

Null texts count as empty (one end token). Repeated doc_ids are scored row by row, and
all count in training; rows without a doc_id are held out. Without training documents
counts are 0 and only smoothing is left. Other columns are ignored.
"""

from __future__ import annotations

import ctypes
import heapq
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

STATES, ENDINGS = 6, 1021
#: Tokens with a class of their own: one in OWN_SHARE of the distinct ones, within bounds.
OWN_SHARE, OWN = 64, (1000, 4096)
#: Training documents, at most, that the starting point of Baum-Welch is found on, and tokens of one of them.
START_SAMPLE, START_TOKENS = 1500, 10_000
#: Rounds of Baum-Welch over the corpus, at most, and the gain in log10 likelihood a token below which it has settled.
ROUNDS, SETTLED = 4, 2e-3
#: Characters and rows beyond which a group of documents ends.
GROUP_CHARS, GROUP_ROWS = 24 << 20, 50_000
#: Characters of text for one bucket of tokens.
BUCKET_CHARS = 8 << 20
#: The end token: no word, since words hold no white space.
END = "\n"
ADD = 0.1


def _give_back() -> None:
    """Freed memory goes back to the system: Python workers live on between tasks, and an executor pays for what they keep."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc alone has it
        trim(0)


def _lean(work: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work that starts and ends without the memory that work before has freed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _give_back()
        yield from work(batches)
        _give_back()

    return run


def tokens(text: str) -> list[str]:
    out = C.words_of(text)
    out.append(END)
    return out


def ending(token: str) -> int:
    return zlib.crc32(token[-3:].encode("utf-8", "surrogatepass")) % ENDINGS


class Vocabulary(dict):
    """Numbers of the distinct tokens of a group, in order of first sight."""

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        return n


def _packed(words: list[str]) -> bytes:
    return zlib.compress(" ".join(words).encode("utf-8", "surrogatepass"), 1)


def _unpacked(data: bytes) -> list[str]:
    text = zlib.decompress(data).decode("utf-8", "surrogatepass")
    return text.split(" ") if text else []


def _squeezed(ids: np.ndarray) -> bytes:
    """Numbers below 2^24 in three bytes: the lower two of all, then the upper one of all, which is nearly always 0."""
    return ids.astype("<u2").tobytes() + (ids >> 16).astype(np.uint8).tobytes()


def _spread(data: bytes) -> np.ndarray:
    n = len(data) // 3
    return np.frombuffer(data, "<u2", n).astype(np.uint32) | np.frombuffer(data, np.uint8, n, 2 * n).astype(np.uint32) << 16


#: A document (kind 0): ids. Tokens of a group in a bucket (kind 1): words, their numbers in the group, their training counts.
_CODED = "kind int, grp long, doc_id long, held_out boolean, ids binary, bucket int, words binary, at binary, n binary"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _batch(schema: str, rows: int, **given) -> pa.RecordBatch:
    """The given columns and nulls for the others."""
    types = {name: _TYPES[kind] for name, kind in (x.split() for x in schema.split(", "))}
    columns = [given[k] if isinstance(given.get(k), pa.Array) else pa.array(given[k], t) if k in given else pa.nulls(rows, t) for k, t in types.items()]
    return pa.RecordBatch.from_arrays(columns, names=list(types))


def coded(rows: DataFrame, buckets: int) -> DataFrame:
    """Documents as numbers of their group's tokens, and each group's tokens, dealt to buckets by hash.

    A group is a stretch of a task's rows, bounded by characters and rows, so no key decides
    its size. The result is written once, so group numbers stay.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, seen, chars, held, counts = TaskContext.get().partitionId() << 32, Vocabulary(), 0, 0, np.zeros(0, np.int64)

        def close() -> Iterator[pa.RecordBatch]:
            n, words = np.concatenate([counts, np.zeros(len(seen) - len(counts), np.int64)]), list(seen)
            home = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint32, len(words)) % buckets
            by = np.argsort(home, kind="stable")
            cuts = np.searchsorted(home[by], np.arange(buckets + 1))
            for i in range(0, buckets, 64):
                parts = [(k, by[cuts[k] : cuts[k + 1]]) for k in range(i, min(buckets, i + 64)) if cuts[k] < cuts[k + 1]]
                if parts:
                    yield _batch(_CODED, len(parts), kind=[1] * len(parts), grp=[grp] * len(parts), bucket=[k for k, _ in parts], words=[_packed([words[x] for x in at]) for _, at in parts], at=[at.astype("<i4").tobytes() for _, at in parts], n=[n[at].astype("<i8").tobytes() for _, at in parts])

        for b in C.slices(batches, "text", 4 << 20):
            ids, trained = [], []
            for t, out in zip(b.column("text").to_pylist(), b.column("held_out").to_pylist(), strict=True):
                w = tokens(t)
                k = np.fromiter(map(seen.__getitem__, w), np.uint32, len(w))
                chars += len(t)
                ids.append(_squeezed(k))
                if not out:
                    trained.append(k)
            if trained:  # added up at once, so that a group's tokens are not held
                n = np.bincount(np.concatenate(trained), minlength=len(counts))
                n[: len(counts)] += counts
                counts = n
            held += b.num_rows
            yield _batch(_CODED, len(ids), kind=[0] * len(ids), grp=[grp] * len(ids), doc_id=b.column("doc_id"), held_out=b.column("held_out"), ids=ids)
            if chars > GROUP_CHARS or held > GROUP_ROWS:
                yield from close()
                grp, seen, chars, held, counts = grp + 1, Vocabulary(), 0, 0, np.zeros(0, np.int64)
        if held:
            yield from close()

    return rows.mapInArrow(_lean(work), _CODED)


#: Global counts of a bucket's tokens (kind 1); a task's tokens and counts by ending (kind 2); its most frequent tokens (kind 3).
_TOTALS = "kind int, bucket int, words binary, n binary, size array<long>, mass array<long>, token string, often long"


def token_totals(groups: DataFrame) -> DataFrame:
    """Counts added up over groups, bucket by bucket; a task holds the distinct tokens of one bucket."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, mass, best = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64), []

        def close(bucket: int, total: dict[str, int]) -> Iterator[pa.RecordBatch]:
            nonlocal best
            words, n = list(total), np.fromiter(total.values(), np.int64, len(total))
            known = np.flatnonzero(n)
            end = np.fromiter((ending(words[i]) for i in known), np.int64, len(known))
            size[:] += np.bincount(end, minlength=ENDINGS)
            mass[:] += np.bincount(end, n[known], ENDINGS).astype(np.int64)
            best = heapq.nsmallest(OWN[1], best + [(-int(n[i]), words[i]) for i in known if n[i] > 1 or len(known) < OWN[1]])
            for i in range(0, len(words), 100_000):
                yield _batch(_TOTALS, 1, kind=[1], bucket=[bucket], words=[_packed(words[i : i + 100_000])], n=[n[i : i + 100_000].astype("<i8").tobytes()])

        bucket, total = None, {}
        for b in batches:
            for k, w, n in zip(b.column("bucket").to_pylist(), b.column("words").to_pylist(), b.column("n").to_pylist(), strict=True):
                if k != bucket:
                    if total:
                        yield from close(bucket, total)
                    bucket, total = k, {}
                get = total.get
                for x, c in zip(_unpacked(w), np.frombuffer(n, "<i8").tolist(), strict=True):
                    total[x] = get(x, 0) + c
        if total:
            yield from close(bucket, total)
        yield _batch(_TOTALS, 1, kind=[2], size=[size.tolist()], mass=[mass.tolist()])
        yield _batch(_TOTALS, len(best), kind=[3] * len(best), token=[w for _, w in best], often=[-n for n, _ in best])

    dealt = groups.select("bucket", "words", "n").repartition(C.partitions(groups.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_lean(work), _TOTALS)


class Classes:
    """Classes of tokens and their sizes; small, so tasks carry it."""

    def __init__(self, totals: DataFrame):
        size, mass = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
        by_ending = totals.where("kind = 2").select(F.posexplode(F.arrays_zip("size", "mass")).alias("ending", "x"))
        for r in by_ending.groupBy("ending").agg(F.sum("x.size").alias("k"), F.sum("x.mass").alias("n")).collect():  # ENDINGS rows
            size[r["ending"]], mass[r["ending"]] = r["k"], r["n"]
        self.n_tokens, self.n_distinct = int(mass.sum()), int(size.sum())
        n_own = int(np.clip(self.n_distinct // OWN_SHARE, OWN[0], OWN[1]))
        top = totals.where("kind = 3").orderBy(F.desc("often"), "token").limit(n_own).collect()
        self.own = {r["token"]: ENDINGS + i for i, r in enumerate(top)}
        for r in top:
            size[ending(r["token"])] -= 1
            mass[ending(r["token"])] -= r["often"]
        self.n = ENDINGS + len(top)
        # every ending class also has room for one unseen token
        self.total = np.concatenate([mass + ADD * (size + 1), np.array([r["often"] + ADD for r in top])])

    def of(self, words: list[str]) -> np.ndarray:
        own = self.own
        return np.array([own[w] if w in own else ending(w) for w in words], "<u2")


_COUNTED = "grp long, at binary, n binary, classes binary"


def group_counts(groups: DataFrame, totals: DataFrame, classes: Classes) -> DataFrame:
    """Global counts and classes of each group's tokens; a task holds the counts of one bucket."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, total = None, {}
        for b in batches:
            for kind, k, g, w, at, n in zip(*(b.column(c).to_pylist() for c in ("kind", "bucket", "grp", "words", "at", "n")), strict=True):
                if k != bucket:
                    bucket, total = k, {}
                words = _unpacked(w)
                if kind == 0:
                    total.update(zip(words, np.frombuffer(n, "<i8").tolist(), strict=True))
                else:
                    yield _batch(_COUNTED, 1, grp=[g], at=[at], n=[np.fromiter(map(total.__getitem__, words), "<i8", len(words)).tobytes()], classes=[classes.of(words).tobytes()])

    first = totals.where("kind = 1").select(F.lit(0).alias("kind"), "bucket", F.lit(None).cast("long").alias("grp"), "words", F.lit(None).cast("binary").alias("at"), "n")
    both = first.unionByName(groups.select(F.lit(1).alias("kind"), "bucket", "grp", "words", "at", "n"))
    return both.repartition(C.partitions(groups.sparkSession), "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_lean(work), _COUNTED)


def sequences(docs: DataFrame, counted: DataFrame, classes: Classes) -> DataFrame:
    """Per document: base score, known tokens, log10 shares within classes, class sequence."""
    base = np.log10(classes.n_tokens + ADD * (classes.n_distinct + 1))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, share double, classes binary"
    total = np.log10(classes.total)

    def work(key: tuple, docs: pa.Table, counted: pa.Table) -> pa.Table:
        _give_back()
        at, n, cls = (np.concatenate([np.frombuffer(x, kind) for x in counted[c].to_pylist()]) for c, kind in (("at", "<i4"), ("n", "<i8"), ("classes", "<u2")))
        count, code = np.zeros(len(at), np.int64), np.zeros(len(at), "<u2")
        count[at], code[at] = n, cls
        log = np.log10(count + ADD)
        share, known = log - total[code], count > 0
        out: list[list] = [[] for _ in range(5)]
        for x in docs["ids"].to_pylist():
            k = _spread(x)
            for c, v in zip(out, (len(k), int(known[k].sum()), float(log[k].sum() - len(k) * base), float(share[k].sum()), code[k].tobytes()), strict=True):
                c.append(v)
        return pa.table([docs["doc_id"], docs["held_out"], *(pa.array(c, t) for c, t in zip(out, [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()], strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return docs.groupBy("grp").cogroup(counted.groupBy("group")).applyInArrow(work, schema)


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # emit: classes x states

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Model:
        """Expected counts, smoothed towards uniform starts and moves and the overall classes."""
        k = len(start)
        s, m = start + 1, move + 1 + 20 * np.eye(k)
        e = emit + 50 * prior[:, None]
        return Model(s / s.sum(), m / m.sum(1, keepdims=True), e / e.sum(0))


def _padded(seqs: list[np.ndarray]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Longest first, laid out by position: all first tokens, then all second ones, ..."""
    order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
    lengths = np.array([len(seqs[i]) for i in order])
    place = np.arange(lengths.sum(), dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
    by = np.argsort(place, kind="stable")
    alive = np.bincount(place)
    del place
    return order, np.concatenate([seqs[i] for i in order])[by], alive


def forward(model: Model, seqs: list[np.ndarray], keep: bool = False):
    """log10 likelihood of each sequence by the scaled forward recursion; keep: alphas and scales too, laid out as the tokens."""
    order, flat, alive = _padded(seqs)
    at, total = 0, np.zeros(len(seqs))
    alphas, scales = (np.empty((len(flat), len(model.start))), np.empty(len(flat))) if keep else (None, None)
    a = np.tile(model.start, (len(seqs), 1))
    for t, n in enumerate(alive.tolist()):
        a = (a[:n] @ model.move if t else a[:n]) * model.emit[flat[at : at + n]]
        c = a.sum(1)
        a /= c[:, None]
        total[:n] += np.log(c)
        if keep:
            alphas[at : at + n], scales[at : at + n] = a, c
        at += n
    out = np.empty(len(seqs))
    out[order] = total / np.log(10)
    return (out, flat, alive, alphas, scales) if keep else out


def expected(model: Model, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of the sequences (one Baum-Welch E-step), and their log10 likelihood."""
    likelihood, flat, alive, gammas, scales = forward(model, seqs, True)  # alphas, until each has met its beta
    k, classes = len(model.start), len(model.emit)
    move, at = np.zeros((k, k)), len(flat)
    b = np.zeros((0, k))
    for t in range(len(alive) - 1, -1, -1):
        n, at = alive[t], at - alive[t]
        now = np.ones((n, k))
        if t + 1 < len(alive) and (m := alive[t + 1]):
            ahead = model.emit[flat[at + n : at + n + m]] * b / scales[at + n : at + n + m, None]
            now[:m] = ahead @ model.move.T
            move += model.move * (gammas[at : at + m].T @ ahead)
        b = now
        gammas[at : at + n] *= b
    del scales
    emit = np.stack([np.bincount(flat, gammas[:, s], classes) for s in range(k)], 1)
    return gammas[: alive[0]].sum(0), move, emit, float(likelihood.sum())


def start_model(seqs: list[np.ndarray], classes: int, states: int) -> Model:
    """A starting point alone: texts dealt to states by k-means-like passes."""
    counts = np.stack([np.bincount(s, minlength=classes) for s in seqs]).astype(float)
    prior = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * classes)
    rng = np.random.default_rng(3)
    centre = [counts[int(np.argmax(counts.sum(1)))]]
    lift = counts / np.sqrt(prior) / np.maximum(1, counts.sum(1, keepdims=True))
    for _ in range(states - 1):  # furthest first
        c = np.stack([x / np.sqrt(prior) / max(1, x.sum()) for x in centre])
        near = ((lift**2).sum(1)[:, None] - 2 * lift @ c.T + (c**2).sum(1)).min(1)
        centre.append(counts[int(np.argmax(near * np.log1p(counts.sum(1))))])
    logs = np.log(np.stack(centre) + 5 * prior) - np.log(np.stack(centre).sum(1, keepdims=True) + 5)
    for _ in range(10):
        side = np.argmax(counts @ logs.T + 1e-6 * rng.random((len(seqs), states)), 1)
        sums = np.stack([counts[side == s].sum(0) for s in range(states)])
        logs = np.log(sums + 20 * prior) - np.log(sums.sum(1, keepdims=True) + 20)
    return Model(np.full(states, 1 / states), np.full((states, states), 0.02 / states) + 0.98 * np.eye(states), np.exp(logs).T)


def _batches(b: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    rows, seqs, held = [], [], 0
    for i, x in enumerate(b.column("classes")):
        s = np.frombuffer(x.as_buffer(), "<u2")
        if held and held + len(s) > most:
            yield rows, seqs
            rows, seqs, held = [], [], 0
        rows.append(i)
        seqs.append(s)
        held += len(s)
    if rows:
        yield rows, seqs


def _joined(batches: Iterable[pa.RecordBatch], most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Several batches as one: the more sequences side by side, the fewer steps."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _together(batches: Iterable[pa.RecordBatch], most: int = 1 << 20) -> Iterator[list[np.ndarray]]:
    """Sequences of several batches at once: the more side by side, the fewer steps."""
    seqs, held = [], 0
    for b in batches:
        for x in b.column("classes"):
            s = np.frombuffer(x.as_buffer(), "<u2")
            if held and held + len(s) > most:
                yield seqs
                seqs, held = [], 0
            seqs.append(s)
            held += len(s)
    if seqs:
        yield seqs


def baum_welch(seqs: DataFrame, model: Model, most: int = ROUNDS, settled: float = SETTLED) -> Model:
    """Rounds over all training sequences until their likelihood settles; tasks' expected counts add up across partitions."""
    k, classes = model.emit.shape[1], model.emit.shape[0]
    width, before = k + k * k + classes * k, None
    for _ in range(most):

        def work(batches: Iterable[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(width + 2)
            for x in _together(batches):
                s, m, e, likelihood = expected(model, x)
                sums += np.concatenate([s, m.ravel(), e.ravel(), [likelihood, sum(map(len, x))]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["at", "n"])

        rows = seqs.mapInArrow(_lean(work), "at long, n double").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # one row for each parameter of the model
        sums = np.zeros(width + 2)
        sums[rows["at"].to_numpy()] = rows["n"].to_numpy()
        emit = sums[k + k * k : width].reshape(classes, k)
        prior = (emit.sum(1) + 0.5) / (emit.sum() + 0.5 * classes)
        model = Model.from_counts(sums[:k], sums[k : k + k * k].reshape(k, k), emit, prior)
        now = sums[width] / max(1.0, sums[width + 1])
        if before is not None and now - before < settled:
            break
        before = now
    return model


def score_documents(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    C.short_batches(spark)
    rows = C.texts_of(docs, C.held_out(10).alias("held_out"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    known = C.cut(coded(rows, int(np.clip(-(-chars // BUCKET_CHARS), 8, 4096))), "coded-documents")
    groups = known.where("kind = 1")
    totals = C.cut(token_totals(groups), "token-totals")
    classes = Classes(totals)
    counted = group_counts(groups, totals, classes).withColumnRenamed("grp", "group")
    seqs = C.cut(sequences(known.where("kind = 0").select("grp", "doc_id", "held_out", "ids"), counted, classes), "class-sequences", known, totals)
    train = seqs.where("not held_out")
    start = C.sampled(train.where(F.col("n_tokens") <= START_TOKENS), F.xxhash64("doc_id"), START_SAMPLE).select("classes").collect()
    if start:
        first = start_model([np.frombuffer(bytes(r["classes"]), "<u2").astype(np.int64) for r in start], classes.n, states)
        model = baum_welch(train.select("classes"), first, rounds)
    else:
        model = Model(np.ones(1), np.ones((1, 1)), np.full((classes.n, 1), 1 / classes.n))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _joined(batches):
            score = np.zeros(b.num_rows)
            for at, x in _batches(b):
                score[at] = forward(model, x)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(b.column("share").to_numpy() + score)], names=[*b.schema.names[:5], "score"])

    out = seqs.mapInArrow(_lean(work), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return C.given_ids(out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(classes.n_tokens).cast("long").alias("train_tokens"), "base_score", "score"))


def op10_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
