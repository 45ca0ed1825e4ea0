"""Every corpus operator and pipeline stage on rows that break things, and the pipeline against a brute-force one."""

import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from oracle import differences
from pyspark.sql import functions as F
from reliefspark.llm import bitpack, decontaminate, hmm, minhash, packing, permutation, quality, queries, substrings, toxicity, urls
from reliefspark.llm.tokens import Encoder
from test_llm import SF, WORD

#: Names that operators use inside.
CLASHES = ("copy", "row", "cuts", "nth", "side", "other", "task", "component", "sides", "score", "held_out", "grp", "at", "token", "n", "ids", "__id", "__gone", "__cuts", "gone", "members", "first", "y", "chosen", "words", "least", "kind", "place")
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(40_000))
ROWS = [(1, "same words here again and again " * 9), (1, "same words here again and again " * 9), (None, "a row without an id " * 12), (None, "a row without an id " * 12), (None, None), (2, None), (2, ""), (3, "  \n\t "), (4, LONG), (4, LONG), (5, "one"), (6, "one"), (7, "ÄÖ ſ ﬁ \u2028 x" * 30)]


def nasty(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("xx"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    return df.withColumns({c: F.lit(1) for c in CLASHES}).repartition(3)


def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 8)] + [(None, 1, 1), (3, None, None), (3, 0, 1)], "doc_id long, quality int, toxic int").withColumn("y", F.lit(0))


def benchmark(spark):
    return spark.createDataFrame([(1, "same words here again and again same words here"), (None, "a row without an id a row"), (3, None), (4, "")], "item_id long, text string").withColumns({"doc_id": F.lit(5), "score": F.lit(1)})


PATH = public_tokenizers.path("word_bpe_49k.json")
OPERATORS = {
    "op2": lambda d, s: bitpack.round_trip(d, PATH, 1),
    "op6": lambda d, s: quality.score_quality(d, labels(s)),
    "op7": lambda d, s: toxicity.score_toxicity(d, labels(s)),
    "op8": lambda d, s: substrings.removed_substrings(d),
    "op9": lambda d, s: minhash.near_duplicates(d, 3, 85),
    "op10": lambda d, s: hmm.score_documents(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, name):
    got = Counter(r["doc_id"] for r in OPERATORS[name](nasty(spark), spark).collect())
    assert got == Counter(d for d, _ in ROWS)
    assert OPERATORS[name](nasty(spark, []), spark).count() == 0


def test_rows_without_an_id(spark):
    near = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(nasty(spark), 3, 85).where("n_shingles > 0").collect())
    assert near == Counter([(1, 1, True), (1, 1, False), (None, None, True), (None, None, False), (4, 4, True), (4, 4, False), (5, 5, True), (6, 5, False), (7, 7, True)])
    for name in ("op6", "op7", "op10"):
        assert {r["held_out"] for r in OPERATORS[name](nasty(spark), spark).where("doc_id IS NULL").collect()} == {True}
    cut = {(r["doc_id"], r["n_removed"] == r["n_bytes"]) for r in substrings.removed_substrings(nasty(spark)).where("n_bytes > 0").collect()}
    assert not any(gone for _, gone in cut)
    assert {r["doc_id"] for r in decontaminate.find_leaks(nasty(spark), benchmark(spark)).collect()} == {1, None}


def test_op4_and_op5_on_odd_rows(spark):
    pairs = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(nasty(spark), benchmark(spark)).collect())
    assert pairs == Counter({(1, 1): 2, (None, None): 2})
    for docs, bench in ((nasty(spark, []), benchmark(spark)), (nasty(spark), benchmark(spark).limit(0))):
        assert decontaminate.find_leaks(docs, bench).count() == 0
    pieces = packing.pack_documents(nasty(spark), PATH, 0).where("start = 0").collect()
    assert Counter(r["doc_id"] for r in pieces) == Counter(d for d, _ in ROWS)
    assert packing.pack_documents(nasty(spark, []), PATH, 0).count() == 0


def test_op1_and_op3_on_odd_rows(spark):
    vectors = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(1, 50)] + [(None, [1.0, 1.0, 1.0]), (20, None), (40, [9.0, 9.0, 9.0]), (40, [9.0, 9.0, 9.0]), (60, [1.0, float("nan"), 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("block", "kind", "ids", "numbers", "vectors", "score", "rank")})
    got = Counter(r["query_id"] for r in permutation.search(df, df.where("vec_id % 20 = 0")).collect())
    assert got == Counter({20: 20, 40: 60})  # vec_id 40 stands on three rows
    assert permutation.search(df, df.where("vec_id = 60")).count() == 0
    odd = spark.createDataFrame([(1, None), (1, None), (None, "http://a.com/en/x"), (2, ""), (3, "x://" + "a" * 50_000)], "page_id long, url string").withColumns({c: F.lit("1") for c in ("host", "path", "rest", "after", "tail", "key", "b", "n", "fold", "given", "truth", "features", "probability")})
    assert Counter(r["page_id"] for r in urls.judge(odd).collect()) == Counter([1, 1, None, 2, 3])


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns_and_rows(spark, tmp_path, k):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    stage = corpus_pipeline.STAGES[k][1]
    docs = nasty(spark)
    left = stage(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and [f.dataType for f in left.schema] == [f.dataType for f in docs.schema]
    rows = Counter(r["doc_id"] for r in left.collect())
    want = {1: [Counter({1: 1, None: 2, 2: 2, 3: 1, 4: 1, 5: 1, 7: 1})], 2: [Counter(d for d, _ in ROWS)], 3: [Counter([2, 2, 3, 4, 4, 5, 6, 7, None])]}
    assert k == 0 or rows in want[k]
    assert stage(spark, nasty(spark, []), str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert not differences(spark, name, queries.queries()[name], queries.oracle_sql()[name], SF)


def leaked(items, text, threshold=decontaminate.THRESHOLD):
    """Items that align with the text anywhere: Smith-Waterman over whole texts, but where even all shared words could not reach."""
    words = decontaminate._WORDS.findall((text or "").lower())
    out = set()
    for k, item in items:
        a = decontaminate._WORDS.findall((item or "").lower())
        if not a or sum(w in set(words) for w in a) < threshold * len(a):
            continue
        number = {}
        x, y = (np.array([number.setdefault(w, len(number)) for w in t]) for t in (a, words))
        if decontaminate.align(x, y)[0] >= threshold * 2 * len(a) - 1e-9:
            out.add(k)
    return out


def test_op4_equals_alignment_of_every_pair(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in queries.queries()["op4_decontamination"](spark, SF).collect()}
    want = {(r["doc_id"], k) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for k in leaked(items, r["text"])}
    assert want and got == want


def near_groups(docs, size=5, percent=80):
    """doc_id to the least doc_id of its group, by comparing all pairs that share a shingle."""
    sets, by, up = {}, {}, {}
    for d, t in docs:
        w = WORD.findall((t or "").encode().lower().decode())
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
        up[d] = d
        for x in sets[d]:
            by.setdefault(x, []).append(d)

    def top(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in {(a, b) for ds in by.values() for a in ds for b in ds if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {d: top(d) for d in sets}


def without_repeats(docs):
    seen, out = set(), []
    for d, t in sorted(docs):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        out.append((d, np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")))
    return out


def test_pipeline_equals_brute_force(spark):
    docs, gold = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.score_toxicity(docs, gold).where("predicted = 1").collect()}
    left = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in toxic]
    group = near_groups(left)
    left = without_repeats([(d, t) for d, t in left if group[d] == d])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {d: t for d, t in left if not leaked(items, t)}
    enc, pieces = Encoder(public_tokenizers.path("byte_bpe_50k.json")), {}
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert pieces.keys() == left.keys()
    for d, t in left.items():
        ids, at = enc.ids([t])[0] + np.array([0], "<u4").tobytes(), 0
        for p in sorted(pieces[d], key=lambda p: p["start"]):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + p["length"])]) and p["doc_tokens"] == len(ids) // 4
            at += p["length"]
        assert at == len(ids) // 4


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_op1_recall_by_the_query_itself(spark, sf):
    table = permutation.usable(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")).toArrow()
    ids, x = table["vec_id"].to_numpy(), permutation.matrix(table["embedding"].combine_chunks())
    got, hit, n = {}, 0, 0
    for r in queries.queries()["op1_permutation_index"](spark, f"/root/testdata/{sf}").collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(1)
        s[ids == ids[i]] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        hit, n = hit + len(got[ids[i]].keys() & set(best.tolist())), n + 20
        assert all(np.isclose(v, s[ids == k][0], rtol=1e-12) for k, v in got[ids[i]].items())
    assert hit / n >= 0.95


def test_op3_on_hosts_not_seen_before(spark):
    accuracy, n = urls.held_out_accuracy(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"))
    assert n > 100 and accuracy >= 0.8


def test_op6_expression_equals_rules(spark):
    rng = np.random.default_rng(9)
    x = rng.random((400, len(quality.STATS)))
    rules, bias = quality.fit_rules(x, (x[:, 2] + x[:, 5] > 1).astype(float), trees=8)
    want = np.full(len(x), bias)
    for path, weight in rules:
        want += weight * np.all([(x[:, f] > cut) == above for f, cut, above in path], 0)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ", ".join(["i int", *(f"{s} double" for s in quality.STATS)]))
    got = {r["i"]: r["p"] for r in df.select("i", quality.compile_rules(rules, bias).alias("p")).collect()}
    assert rules and np.allclose([got[i] for i in range(len(x))], 1 / (1 + np.exp(-want)))


def test_op10_expected_counts_equal_sums_over_paths(spark):
    rng = np.random.default_rng(7)
    m = hmm.Model(*(x / x.sum(a, keepdims=True) for x, a in ((rng.random(2), 0), (rng.random((2, 2)), 1), (rng.random((4, 2)), 0))))
    seqs = [np.array(s) for s in ([0, 2, 1, 3], [3], [1, 1, 0])]
    start, move, emit, total = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2)), 0.0
    for s in seqs:
        paths = list(np.ndindex(*[2] * len(s)))
        p = np.array([m.start[q[0]] * np.prod([m.emit[c, k] for c, k in zip(s, q, strict=True)]) * np.prod([m.move[a, b] for a, b in zip(q, q[1:], strict=False)]) for q in paths])
        total += np.log10(p.sum())
        for q, w in zip(paths, p / p.sum(), strict=True):
            start[q[0]] += w
            for t, (c, k) in enumerate(zip(s, q, strict=True)):
                emit[c, k] += w
                if t:
                    move[q[t - 1], k] += w
    got = hmm.expected(m, seqs)
    assert all(np.allclose(a, b) for a, b in zip(got, (start, move, emit, total), strict=True))
    df = spark.createDataFrame([(bytearray(s.astype("<u2").tobytes()),) for s in seqs], "classes binary").repartition(2)
    prior = (emit.sum(1) + 0.5) / (emit.sum() + 2)
    one, other = hmm.baum_welch(df, m, 1), hmm.Model.from_counts(start, move, emit, prior)
    assert np.allclose(one.emit, other.emit) and np.allclose(one.move, other.move) and np.allclose(one.start, other.start)


def test_op10_workers_hold_little(monkeypatch):
    """A few arrays for each token of an E-step; of a group's tokens, while it is numbered, only those of a batch."""

    def peak(f):
        tracemalloc.start()
        try:
            return f(), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    rng, k = np.random.default_rng(8), hmm.STATES
    m = hmm.Model(np.full(k, 1 / k), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(500), k).T)
    seqs = [rng.integers(0, 500, n).astype("<u2") for n in rng.integers(1, 700, 800)]
    got, most = peak(lambda: hmm.expected(m, seqs))
    assert np.isclose(got[2].sum(), sum(map(len, seqs))) and most < 90 * sum(map(len, seqs))

    class Rows:
        def mapInArrow(self, work, schema):
            return work

    monkeypatch.setattr(hmm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(60)), "held_out": [i % 10 == 0 for i in range(60)], "text": ["a b c d " * 250] * 60})

    def train_counts():
        groups = (b.to_pylist() for b in hmm.coded(Rows(), 8)([batch] * 20))
        return Counter({w: c for b in groups for r in b if r["kind"] == 1 for w, c in zip(hmm._unpacked(r["words"]), np.frombuffer(r["n"], "<i8").tolist(), strict=True)})

    got, most = peak(train_counts)
    assert got == Counter({**dict.fromkeys("abcd", 20 * 54 * 250), hmm.END: 20 * 54}) and most < 8 << 20


def test_op8_compares_bytes_not_hashes():
    data = np.frombuffer(b"abcdeabcdfabcde", np.uint8)
    assert substrings._equal(data, np.array([0, 0, 0]), np.array([5, 10, 5]), np.array([5, 5, 4]), step=2).tolist() == [False, True, True]
