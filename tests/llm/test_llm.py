"""The corpus operators against brute force, round trips and held-out labels."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from reliefspark.llm import bitpack, decontaminate, hmm, learn, minhash, packing, permutation, quality, queries, substrings, suffixes, toxicity, urls
from reliefspark.llm.tokens import Encoder

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", None, "  \n", "one", "two words", "Ünïcode ǅ ﬁ … \u2028x \x1f \x00 ²½", "a" * 300, "the cat " * 400, "x" * 50 + "\n" + "y" * 5000]


def docs_of(spark, texts, extra=True):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return df.withColumns({"score": F.lit(1), "words": F.lit("clash"), "sides": F.lit(2)}) if extra else df


def sample(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs_of(spark, ODD, False).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    return docs.select("doc_id", "text").unionByName(odd).withColumn("words", F.lit("clash"))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(spark, name):
    texts = [r["text"] or "" for r in sample(spark).collect()]
    enc = Encoder(public_tokenizers.path(name), cached=500)
    assert enc.ids(texts) == [np.asarray(e.ids, "<u4").tobytes() for e in enc.whole.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_bit_packing_round_trip(bits, tmp_path):
    rng = np.random.default_rng(bits)
    docs = [rng.integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32) for n in (0, 1, 700, 3)]
    w = bitpack.ShardWriter(str(tmp_path / "x.idbits"), 2**bits, 100)
    w.add([5, 6, 7, 8], docs)
    w.close()
    s = bitpack.Shard(str(tmp_path / "x.idbits"))
    assert s.bits == bits
    assert all((s.document(i) == d).all() for i, d in enumerate(docs))
    assert all((x == d).all() for (_, _, x), d in zip(s.documents(), docs, strict=True))


def test_op2_and_op5_hold_every_id(spark):
    docs = sample(spark)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    path = public_tokenizers.path("word_bpe_49k.json")
    enc, start = Encoder(path), 0
    found = {r["doc_id"]: r for r in bitpack.round_trip(docs, path, 1).collect()}
    for d in sorted(texts):
        ids = enc.ids([texts[d]])[0] + np.array([1], "<u4").tobytes()
        assert (found[d]["start"], found[d]["n_tokens"], found[d]["ids_crc32"]) == (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc, pieces, sequences = Encoder(path), {}, {}
    for r in packing.pack_documents(docs, path, 0).collect():
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for d, t in texts.items():
        ids, at = enc.ids([t])[0] + np.array([0], "<u4").tobytes(), 0
        for p in sorted(pieces[d], key=lambda p: p["start"]):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + p["length"])]) and p["doc_tokens"] == len(ids) // 4
            at += p["length"]
        assert at == len(ids) // 4
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024 and (at & (at - 1)) == 0


def test_op1_recall_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8))
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(600, None), (601, [0.0] * 8), (602, [math.nan] * 8), (603, [1.0, None] + [0.0] * 6), (620, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    got = {}
    for r in permutation.search(df, df.where("vec_id % 20 = 0"), block_rows=200, least=60, depth=0.2).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert sorted(got) == list(range(0, 600, 20))
    hit = 0
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        best = sorted((j for j in range(600) if j != q), key=lambda j: (-s[j], j))[:20]
        assert [r for r, _ in sorted(found)] == list(range(1, 21))
        hit += len({v for _, v in found} & set(best))
    assert hit / (20 * len(got)) >= 0.9
    empty = df.where("vec_id < 0")
    assert permutation.search(empty, empty).count() == 0


def test_op3_rules_and_odd_urls(spark):
    given = [("https://Example.com/en/7?x", "example.com", "/en/7", "example.com/en/7", "allow"), ("http://a.b.com/en/x", "a.b.com", "/en/x", "com/en/", "block"), ("http://notcom/en/", "notcom", "/en/", None, None), (None, "", "", None, None), ("nothing", "", "", None, None), ("a://b://c?d", "b:", "//c", None, None), ("http://x.net/de/1", "x.net", "/de/1", "net/de/", "allow"), ("http://ÄX.example.net/de/8#f", "Äx.example.net", "/de/8", "example.net/de/8", "block")]
    df = spark.createDataFrame([(i, g[0], "h") for i, g in enumerate(given)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in urls.judge(df, trees=2).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(given):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if verdict else got[i]["verdict"] in ("allow", "block")
    assert urls.judge(df.limit(0)).count() == 0


def test_op4_finds_copies_and_edits(spark):
    item = "seven brave sailors crossed the frozen northern channel before dawn carrying maps drawn by candle light for hidden islands"
    edited = item.replace("brave", "bold").replace("candle", "lamp")
    docs = docs_of(spark, [f"noise words {item} more noise", f"x {edited} y", "seven brave people saw the frozen lake", None, "", item + " " + "filler " * 3000])
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny item")], "item_id long, text string").withColumn("doc_id", F.lit(9))
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(got) == {(0, 1), (1, 1), (5, 1)} and got[0, 1] == 1 and 0.6 <= got[1, 1] < 1
    assert sorted(r["doc_id"] for r in decontaminate.clean_documents(docs, bench).collect()) == [2, 3, 4]


def test_op4_items_with_equal_endings(spark):
    items = ["one two same last words", "three four same last words", "five six seven same last words", "eight same last words"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.find_leaks(docs_of(spark, [f"x {i} y" for i in items]), bench).collect()}
    assert {(i, i): 1.0 for i in range(len(items))}.items() <= got.items()


def leaks_by_alignment(items, text):
    """item_id and score of leaked items by Smith-Waterman over the whole text."""
    number, out = {}, {}
    doc = np.array([number.setdefault(w, len(number)) for w in text.split()])
    for k, item in enumerate(items):
        a = np.array([number.setdefault(w, len(number)) for w in item.split()])
        score = decontaminate.align(a, doc)[0] / (2 * len(a))
        if score >= decontaminate.THRESHOLD:
            out[k] = score
    return out


def found_leaks(items, text):
    return {k: score for k, score, _, _ in decontaminate.Seeds(list(enumerate(items))).leaks(text)}


def test_op4_edited_short_and_templated_items():
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)]
    noise = " ".join(rng.choice(words, 60))
    short = [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 9), ("b", 14), ("c", 20), ("d", 7), ("e", 4), ("f", 5))]
    head, tail = (" ".join(f"{c}{i}" for i in range(8)) for c in "gh")
    items = [*short, *(f"{head} name{k} {tail}" for k in range(12))]
    for item in items:
        w, every = item.split(), {len(item.split()) // 2}
        for gone in (every, set(range(4, len(w), 5)), set(range(3, len(w), 4)), set(range(len(w) // 4))):
            text = f"{noise} {' '.join('edit' if i in gone else x for i, x in enumerate(w))} {noise}"
            assert found_leaks(items, text) == leaks_by_alignment(items, text)
    assert {0, 5} <= {k for k in leaks_by_alignment(items, f"{noise} {short[0].replace('a4', 'edit')} {short[5]}")}


def test_op4_copies_with_insertions():
    rng = np.random.default_rng(12)
    item = [f"a{i}" for i in range(40)]
    noise = [f"n{i}" for i in range(100)]
    for k in range(0, 36):
        text = " ".join([*noise, *item[:20], *(f"x{i}" for i in range(k)), *item[20:], *noise])
        assert found_leaks([" ".join(item)], text) == leaks_by_alignment([" ".join(item)], text)
        assert bool(found_leaks([" ".join(item)], text)) == (k <= 32)
    items = [" ".join(rng.choice([f"v{i}" for i in range(size)], n)) for n in (2, 5, 6, 9, 16, 30) for size in (6, 60)]
    for item in items:
        w = item.split()
        for rate in (0.1, 0.3):
            edited = [y for x in w for y in (["x", x], [x], ["x"], [])[min(3, int(rng.choice(4, p=[rate, 1 - 1.5 * rate, rate / 4, rate / 4])))]]
            text = " ".join([*noise, *edited, *noise[:5], *rng.choice([f"v{i}" for i in range(6)], 30), *noise])
            assert found_leaks(items, text) == leaks_by_alignment(items, text)


def test_alignment_equals_full_table():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = rng.integers(1, 6, rng.integers(1, 12)), rng.integers(1, 6, rng.integers(1, 15))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.align(a, b)[0] == h.max()


@pytest.mark.parametrize("name, label", [("op6_quality_rules", "quality"), ("op7_toxicity_weak", "toxic")])
def test_scores_on_held_out_labels(spark, name, label):
    sf = "/root/testdata/sf0.1"
    rows = queries.queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r[label] for r in rows]) >= 0.97


def test_scores_without_labels_and_on_odd_texts(spark):
    docs, labels = docs_of(spark, ODD), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score_quality(docs, labels).collect()} == {0.5}
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels).collect()} == {0.0}
    assert toxicity.clean_documents(docs, labels).count() == len(ODD)


def test_lasso_drops_noise():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 10)).round().astype(np.float32)
    w, _ = learn.lasso_logistic(x, (x[:, 0] > 0.5).astype(float), 0.02)
    assert w[0] > 1 and np.abs(w[1:]).max() < 0.05


def test_suffix_order_equals_sorted():
    rng = np.random.default_rng(2)
    rows, length, group = rng.integers(97, 99, (300, 12)).astype(np.uint8), rng.integers(0, 13, 300), rng.integers(0, 4, 300)
    at, shared = suffixes.Suffixes(rows, length).sorted_with_common(group)
    text = [rows[i, : length[i]].tobytes() for i in range(300)]
    assert at.tolist() == sorted(range(300), key=lambda i: (group[i], text[i], i))
    for k in range(1, 300):
        a, b = at[k - 1], at[k]
        if group[a] == group[b]:
            assert text[a][: shared[k]] == text[b][: shared[k]] and (shared[k] == min(length[a], length[b]) or text[a][shared[k]] != text[b][shared[k]])


@pytest.mark.parametrize("crowd", [50_000, 5])
def test_op8_equals_brute_force(spark, crowd):
    docs, seen = sample(spark), set()
    got = {r["doc_id"]: r for r in substrings.removed_substrings(docs, crowd).collect()}
    for d, t in sorted((r["doc_id"], r["text"] or "") for r in docs.collect()):
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            w = data[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (len(data), int(gone.sum()), hashlib.sha256(kept).hexdigest())
        assert r["n_spans"] == int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())


@pytest.mark.parametrize("crowd", [50_000, 1])
def test_op8_repeated_rows(spark, crowd):
    rng = np.random.default_rng(8)
    a, b, c, d = ("".join(map(chr, rng.integers(97, 123, n))) for n in (700, 900, 300, 250))
    given = [(3, a), (5, b), (5, b), (5, a + c), (7, c), (7, c), (7, d + c), (8, "z" * 40 + b[:300]), (9, d), (9, d), (9, d), (11, None), (11, None)]
    docs = spark.createDataFrame(given, "doc_id long, text string").withColumn("copy", F.lit("clash")).repartition(3)
    want, seen = Counter(), set()
    # rows of equal doc_id and text are one document; other rows of a doc_id come in the order of their texts' hashes
    for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).distinct().orderBy("doc_id", "h").collect():
        gone = np.zeros(len(r["text"]), bool)
        for i in range(len(r["text"]) - 99):
            w = r["text"][i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        kept = "".join(x for x, g in zip(r["text"], gone, strict=True) if not g)
        want[r["doc_id"], r["text"], kept] += sum((k, t or "") == (r["doc_id"], r["text"]) for k, t in given)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in substrings.removed_substrings(docs, crowd).collect())
    assert got == Counter({(k, len(t), len(t) - len(x), hashlib.sha256(x.encode()).hexdigest()): n for (k, t, x), n in want.items()})
    left = substrings.without_repeats(docs, crowd)
    assert left.columns == docs.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in left.collect()) == Counter((k, x) for (k, _, x), n in want.items() for _ in range(n))
    assert [k for k, t, x in want if t == x] and want[5, b, b] == 2


def test_op9_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    base = ("alpha beta gamma delta " + " ".join(f"w{i}" for i in range(60))).split()
    near = [" ".join([*base[:k], f"edit{k}", *base[k + 1 :]]) for k in range(40)]
    docs = docs_of(spark, [*ODD, *near, *near[:5], "One", "ONE"])
    sets = {}
    for r in docs.collect():
        w = WORD.findall((r["text"] or "").encode().lower().decode())
        sets[r["doc_id"]] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def top(d):
        return d if up[d] == d else top(up[d])

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    for r in minhash.near_duplicates(docs, 3, 85).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), top(r["doc_id"]), top(r["doc_id"]) == r["doc_id"])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    given = [(3, a), (5, a), (5, b), (7, c), (7, c), (8, c.replace("c30", "edit")), (9, ""), (9, ""), (9, None)]
    docs = spark.createDataFrame(given, "doc_id long, text string").withColumn("copy", F.lit("clash"))
    rows = [(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()]
    assert Counter(rows) == Counter([(3, 3, True), (5, 3, False), (5, 5, True), (7, 7, True), (7, 7, False), (8, 7, False), *[(9, 9, True)] * 3])
    left = minhash.without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter([(3, a), (5, b), (7, c), *given[6:]])


def test_odd_sketches_estimate(spark):
    s = minhash.Sketcher(40)
    a = np.unique(np.random.default_rng(5).integers(0, 1 << 62, 1000).astype(np.uint64))
    b = np.concatenate([a[:-60], a[-60:] + np.uint64(1)])
    x, y = (np.frombuffer(s.odd_sketch(s.samples(v)), np.uint64) for v in (a, b))
    z = int(np.bitwise_count(x ^ y).sum())
    estimate = 1 + minhash.BITS / (4 * s.k) * np.log(1 - 2 * z / minhash.BITS)
    assert abs(estimate - 940 / 1060) < 0.08


def test_op10_base_equals_counts_and_model_helps(spark):
    docs = sample(spark)
    words = {r["doc_id"]: WORD.findall((r["text"] or "").encode().lower().decode()) + [hmm.END] for r in docs.collect()}
    count = Counter(w for d, ws in words.items() if zlib.crc32(str(d).encode()) % 10 for w in ws)
    n, v = sum(count.values()), len(count)
    rows = hmm.score_documents(docs).collect()
    assert len(rows) == len(words)
    for r in rows:
        ws = words[r["doc_id"]]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["n_tokens"] == len(ws) and r["train_tokens"] == n
        assert r["n_known"] == sum(count[w] > 0 for w in ws)
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])


def test_forward_equals_sum_over_paths():
    rng = np.random.default_rng(6)
    m = hmm.Model(*(x / x.sum(a, keepdims=True) for x, a in ((rng.random(2), 0), (rng.random((2, 2)), 1), (rng.random((3, 2)), 0))))
    seq = np.array([0, 2, 1, 1])
    total = 0.0
    for path in np.ndindex(2, 2, 2, 2):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for t in range(1, 4):
            p *= m.move[path[t - 1], path[t]] * m.emit[seq[t], path[t]]
        total += p
    assert np.allclose(hmm.forward(m, [seq, seq[:1]])[0], np.log10(total))


def test_pipeline_runs_and_keeps_ids(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    known = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert rows and {r["doc_id"] for r in rows} <= known


def test_long_texts_are_cut_into_pieces_that_hold_every_window_once(monkeypatch):
    from reliefspark.llm import substrings as S

    def windows(data, first, length):
        a, r, d, p = S.runs(data, first, length)
        start, n, left = S._unpacked(p)
        return sorted((int(k), int(s) + i, int(x), int(s) + int(m)) for x, k, s, n_, m in zip(a, d, start, n, left, strict=True) for i in range(n_))

    rng = np.random.default_rng(3)
    data = rng.integers(97, 101, 9_000).astype(np.uint8)
    first, length = np.array([0, 50, 8_000]), np.array([50, 7_950, 1_000])
    whole = windows(data, first, length)
    assert len(whole) == 7_851 + 901
    monkeypatch.setattr(S, "_BLOCK", 700)
    assert windows(data, first, length) == whole
