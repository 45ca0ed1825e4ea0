"""Toxicity by weak supervision.

Voters are lexicon entries (whole words and word beginnings whose training documents
are nearly all toxic) and patterns (shouting, repeated marks, several entries in one
text, no entry at all). A generative label model, fitted by expectation maximisation
on the votes alone, estimates each voter's accuracy; voters that still agree beyond
what the latent class explains are correlated and share their weight. A linear
classifier is trained on the posterior labels and scores whole texts.

Labels choose the lexicon and the class balance only, on a bounded sample of training
rows. Neither labels nor lang, source or doc_id enter a score. Null and empty texts
cast no lexicon vote and are scored like any other. Repeated and null doc_ids are scored
row by row (nothing is learned from null ones). With no toxic label to learn from every score is 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import learn

#: Lexicon voters, at most (a parameter of the model's size), and the lengths of word beginnings that may be entries.
LEXICON, STEMS = 400, (3, 4, 5, 6, 7, 8)
#: Chance, at most, that a term without meaning becomes an entry, over all terms of the sample.
CHANCE = 1e-2
_LETTERS = regex.compile(r"\p{L}+")
_SHOUT = regex.compile(r"\b\p{Lu}{3,}\b")
_MARKS = regex.compile(r"[!?]{2,}")


def terms(text: str) -> set[str]:
    """Words of a text, and beginnings of words marked by a trailing star."""
    words = set(_LETTERS.findall(text.lower()))
    out = set(words)
    for n in STEMS:
        out.update([w[:n] + "*" for w in words if len(w) >= n])
    return out


def patterns(text: str, hits: int) -> list[int]:
    """Votes of the patterns: 1 toxic, -1 clean, 0 none."""
    words = max(1, text.count(" ") + 1)
    return [
        int(hits >= 2),
        int(hits >= 4),
        -int(hits == 0),
        int(len(_SHOUT.findall(text)) > 0.05 * words),
        int(len(_MARKS.findall(text)) > 0.02 * words),
        -int(hits == 0 and words > 50),
    ]


N_PATTERNS = len(patterns("", 0))


def apart(sample: DataFrame) -> DataFrame:
    """The sample without near copies, which would make every word of a copied text look telling."""

    def keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys: list[list[int]] = [[] for _ in _KEYS]
            for t in b.column("text").to_pylist():
                w = C.words_of(t)
                for k, salt in zip(keys, _KEYS, strict=True):
                    k.append(min((zlib.crc32(" ".join(w[i : i + 3]).encode("utf-8", "replace"), salt) for i in range(max(1, len(w) - 2))), default=0))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(k, pa.int64()) for k in keys)], names=[*b.schema.names, *_KEY_NAMES])

    rows = sample.mapInArrow(keyed, ", ".join(["doc_id long", "text string", "y double", *(f"{k} long" for k in _KEY_NAMES)]))
    for k in _KEY_NAMES:
        rows = rows.groupBy(k, "y").agg(F.min(F.struct("doc_id", "text", *(x for x in _KEY_NAMES if x != k))).alias("row")).select(k, "y", "row.*")
    return rows.select("text", "y")


_KEYS = (0, 77, 991)
_KEY_NAMES = tuple(f"key{i}" for i in range(len(_KEYS)))


def mine_lexicon(sample: DataFrame, most: int = LEXICON) -> list[str]:
    """Terms of training documents that are nearly only in toxic ones, best first."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = (Counter(), Counter())
        for b in batches:
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                seen[int(y)].update(terms(t))
        toxic = list(seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.string()), pa.array([seen[1][t] for t in toxic], pa.int64()), pa.array([seen[0][t] for t in toxic], pa.int64())], names=["term", "bad", "good"])

    # clean counts count only where a task has the term in a toxic text too, so they are joined again below
    share = sample.agg(F.avg("y")).first()[0] or 0.0
    if not share:
        return []
    toxic = sample.where("y = 1").mapInArrow(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"))
    # of so many terms one is found in `least` toxic documents alone by chance no more often than CHANCE
    least = max(4, int(np.ceil(np.log(max(1, toxic.count()) / CHANCE) / -np.log(min(share, 0.9)))))
    kept = {r["term"]: r["bad"] for r in toxic.where(F.col("bad") >= least).collect()}  # terms of the bounded sample

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                seen.update(kept.keys() & terms(t))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "good"])

    good = {r["term"]: r["good"] for r in sample.where("y = 0").mapInArrow(clean, "term string, good long").groupBy("term").agg(F.sum("good").alias("good")).collect()}
    telling = {term: bad for term, bad in kept.items() if bad / (bad + good.get(term, 0)) >= 0.9}
    out: list[str] = []
    for term in sorted(telling, key=lambda t: (-telling[t], len(t), t)):
        if len(out) == most or any(term.startswith(o.rstrip("*")) for o in out):
            continue
        # the longest form that is found about as often says it more precisely
        forms = [t for t, bad in telling.items() if term.endswith("*") and t.startswith(term[:-1]) and bad >= 0.95 * telling[term]]
        best = max([term, *forms], key=lambda t: (len(t.rstrip("*")), t))
        if best not in out:
            out.append(best)
    return out


class Lexicon:
    """Which entries a text has."""

    def __init__(self, entries: list[str]):
        self.at = {e: i for i, e in enumerate(entries)}
        self.whole = {e for e in entries if not e.endswith("*")}
        self.stems = {n: {e[:-1] for e in entries if e.endswith("*") and len(e) == n + 1} for n in STEMS}

    def hits(self, text: str) -> list[int]:
        words = set(_LETTERS.findall(text.lower()))
        found = {self.at[w] for w in words & self.whole}
        for n, stems in self.stems.items():
            if stems:
                found |= {self.at[s + "*"] for s in stems & {w[:n] for w in words}}
        return sorted(found)


def votes(texts: list[str], lexicon: Lexicon) -> np.ndarray:
    out = np.zeros((len(texts), len(lexicon.at) + N_PATTERNS), np.int8)
    for i, t in enumerate(texts):
        hit = lexicon.hits(t)
        out[i, hit] = 1
        out[i, len(lexicon.at) :] = patterns(t, len(hit))
    return out


def label_model(v: np.ndarray, prior: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the latent class for each row, voters' accuracies and their shares.

    Votes are 1, -1 or 0. For each class a voter has a distribution over its three
    outcomes. A voter's share is 1 over the summed positive correlations that the class
    doesn't explain, so a group of copies of one voter counts as one.
    """
    outcome = np.stack([v == 1, v == -1, v == 0]).astype(np.float32)
    share = np.ones(v.shape[1])
    post = learn.sigmoid(3.0 * (v == 1).any(1) - 3.0 * (v == -1).any(1) + np.log(prior / (1 - prior)))
    for k in range(rounds):
        logs = []
        for p in (post, 1 - post):
            mass = np.einsum("oij,i->oj", outcome, p.astype(np.float32)) + 0.1
            logs.append(np.log(mass / mass.sum(0)))
        ratio = np.einsum("oij,oj->i", outcome, (share * (logs[0] - logs[1])).astype(np.float32)) + np.log(prior / (1 - prior))
        post = learn.sigmoid(ratio)
        if k in (5, 12):
            left = v - np.where(post[:, None] > 0.5, (v * post[:, None]).sum(0) / (post.sum() + 1e-9), (v * (1 - post)[:, None]).sum(0) / ((1 - post).sum() + 1e-9))
            dev = left.std(0) + 1e-9
            corr = (left.T @ left) / len(v) / dev[:, None] / dev[None, :]
            share = 1 / np.maximum(1, np.where(corr > 0.3, corr, 0).sum(0))
    agree = np.where(v == 1, post[:, None], np.where(v == -1, 1 - post[:, None], 0)).sum(0)
    return post, (agree + 0.5) / ((v != 0).sum(0) + 1), share


def features(v: np.ndarray, lexicon: int) -> np.ndarray:
    """Inputs of the linear classifier: entries present, patterns, and the log of the number of entries."""
    return np.hstack([v.astype(np.float32), np.log1p(v[:, :lexicon].sum(1, dtype=np.int64))[:, None].astype(np.float32)])


class Model:
    """A trained toxicity scorer; plain arrays, so tasks can carry it."""

    def __init__(self, entries: list[str], weights: np.ndarray, intercept: float, accuracies: np.ndarray, shares: np.ndarray):
        self.entries, self.weights, self.intercept, self.accuracies, self.shares = entries, weights, intercept, accuracies, shares

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.entries:
            return np.zeros(len(texts))
        lexicon = Lexicon(self.entries)
        v = votes(texts, lexicon)
        return learn.sigmoid(features(v, len(self.entries)) @ self.weights + self.intercept)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Train on the sampled training documents (at most learn.LABEL_SAMPLE)."""
    C.short_batches(docs.sparkSession)
    labelled = C.texts_of(docs).join(F.broadcast(learn.label_sample(labels, "toxic")), "doc_id").select("doc_id", "text", "y")
    sample = C.cut(apart(labelled), "toxicity-sample")
    entries = mine_lexicon(sample)
    if not entries:
        return Model([], np.zeros(0), 0.0, np.zeros(0), np.zeros(0))
    width = len(entries) + N_PATTERNS

    def cast(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(entries)
        for b in batches:
            v = votes(b.column("text").to_pylist(), lexicon)
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([r.tobytes() for r in v], pa.binary())], names=["y", "votes"])

    rows = sample.mapInArrow(cast, "y double, votes binary").toArrow()
    v = np.frombuffer(b"".join(rows["votes"].to_pylist()), np.int8).reshape(-1, width)
    prior = float(np.clip(rows["y"].to_numpy().mean(), 0.001, 0.999))
    post, accuracies, shares = label_model(v, prior)
    weights, intercept = learn.lasso_logistic(features(v, len(entries)), post, 0.0002)
    return Model(entries, weights, intercept, accuracies, shares)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.slices(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(b.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    scored = C.texts_of(docs).mapInArrow(work, "doc_id long, score double")
    return C.given_ids(scored.select("doc_id", C.held_out(5).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")))


def clean_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns as they are, whose score is below the threshold."""
    model, columns = fit(docs, labels), docs.columns

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [t or "" for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(model.scores(text) < threshold)).select(columns)

    return docs.mapInArrow(work, docs.schema)


def op7_toxicity_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
