"""Quality by a sparse rule ensemble.

Statistics of whole texts become features; boosted shallow trees on a bounded labelled
sample propose rules (every path from a root); lasso logistic regression keeps few of
them; the kept rules are compiled into one Spark column expression that scores all
documents. Neither labels nor lang, source or doc_id enter a score.

Null and empty texts have all statistics 0 and are scored like any other. Repeated
doc_ids are scored row by row, null ones too (nothing is learned from them). Without two classes of labels the score is the share
of label 1 (0.5 without labels). Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import learn

STATS = ("n_words", "word_len", "long_word", "symbols", "punctuation", "digits", "upper", "letters", "newlines", "distinct", "top_word", "repeated_pairs", "repeated_lines", "line_words", "entropy", "symbol_ends", "bars", "capital_words", "squeeze")

_CLASS = np.zeros((256, 6), np.float64)  # symbol, punctuation, digit, upper, letter, newline
for _c in range(256):
    _s = chr(_c)
    _CLASS[_c] = [_s in "#$%&*+/<=>@\\^_|~{}[]", _s in "!\"'(),-.:;?`", _s.isdigit() and _c < 128, "A" <= _s <= "Z", "A" <= _s <= "Z" or "a" <= _s <= "z" or _c > 127, _s == "\n"]


def statistics(text: str) -> tuple[float, ...]:
    """STATS of one text."""
    data = text.encode("utf-8", "replace")
    words = C.WORD.findall(text)
    if not words:
        return (0.0,) * len(STATS)
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = bytes_.sum()
    symbols, punctuation, digits, upper, letters, newlines = (bytes_ @ _CLASS) / n
    p = bytes_[bytes_ > 0] / n
    m = len(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    count = Counter(words)
    return (
        float(np.log1p(m)), sum(map(len, words)) / m, float(max(map(len, words))), symbols, punctuation, digits, upper, letters, newlines,
        len(count) / m**0.75, max(count.values()) / m, 1 - len(pairs) / max(1, m - 1), 1 - len(set(lines)) / max(1, len(lines)), m / max(1, len(lines)),
        float(-(p * np.log2(p)).sum()), sum(not w[-1].isalnum() and w[-1] not in ".,;:!?" for w in words) / m, sum(w == "|" for w in words) / m, sum(w[0].isupper() for w in words) / m,
        len(zlib.compress(data, 1)) / len(data),
    )


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every document."""
    C.short_batches(docs.sparkSession)
    names = ["doc_id", *STATS]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([statistics(t.as_py()) for t in b.column("text")], np.float64).reshape(b.num_rows, len(STATS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(rows[:, i]) for i in range(len(STATS)))], names=names)

    return C.texts_of(docs).mapInArrow(work, ", ".join(["doc_id long", *(f"{s} double" for s in STATS)]))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, n_bins: int = 48, penalty: float = 0.0008, seed: int = 5) -> tuple[list[tuple[list[tuple[int, float, bool]], float]], float]:
    """Rules as ((feature, threshold, above), ...) with weights, and the intercept."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return [], float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, n_bins + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1)
    rng, at, paths = np.random.default_rng(seed), np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = learn.sigmoid(at)
        rows = rng.random(len(y)) < 0.6
        nodes = learn.grow(bins[rows], n_bins, (p - y)[rows], (p * (1 - p))[rows], depth)
        hit = np.zeros(len(y), int)
        for path, value in nodes:
            inside = np.all([(bins[:, f] > b) == above for f, b, above in path], 0)
            deeper = inside & (len(path) > hit)
            at[deeper] += rate * value
            hit[deeper] = len(path)
            paths[tuple(sorted(set(path)))] = inside
    kept = list(paths)
    if not kept:  # too few rows to split
        return [], float(np.log(y.mean() / (1 - y.mean())))
    w, b = learn.lasso_logistic(np.stack([paths[k] for k in kept], 1).astype(np.float32), y, penalty)
    rules = [([(f, float(edges[f][min(c, len(edges[f]) - 1)]) if len(edges[f]) else 0.0, above) for f, c, above in k], float(v)) for k, v in zip(kept, w, strict=True) if abs(v) > 1e-6]
    return rules, b


def compile_rules(rules: list[tuple[list[tuple[int, float, bool]], float]], intercept: float) -> Column:
    """The ensemble's probability as one column expression over STATS."""
    total = F.lit(intercept)
    for path, weight in rules:
        inside = F.lit(True)
        for f, cut, above in path:
            inside = inside & ((F.col(STATS[f]) > cut) if above else (F.col(STATS[f]) <= cut))
        total = total + F.when(inside, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    stats = C.cut(with_statistics(docs), "quality-statistics")
    sample = learn.label_sample(labels, "quality")
    rows = stats.join(F.broadcast(sample), "doc_id").select("y", *STATS).toArrow()  # at most LABEL_SAMPLE labels
    x = np.stack([rows[s].to_numpy() for s in STATS], 1) if rows.num_rows else np.zeros((0, len(STATS)))
    score = compile_rules(*fit_rules(x, rows["y"].to_numpy()))
    out = stats.select("doc_id", C.held_out(5).alias("held_out"), score.alias("score"))
    return C.given_ids(out.withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
