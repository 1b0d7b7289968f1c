"""Toxicity, search, language model, licences: odd tables, accuracy and plain Python versions."""

import math
import zlib

import numpy as np
import pandas as pd
import pytest
from brute import AZ, WORD, traced
from pyspark.sql import functions as F

from quarrylib.llm import licenses, topk
from quarrylib.llm import suffix_tree as st
from quarrylib.llm import toxicity as tox

D = "/root/testdata/sf0.01"


# ---------------------------------------------------------------- toxicity


def test_grams_stay_inside_texts():
    texts = ["abcdefg", None, "", "x", "Hello, WORLD!  again", "é" * 5]
    seen = set()
    for first, end, data, owner in tox.chunks(texts):
        text, bucket = tox.present(data, owner)
        seen |= {(first + t, b) for t, b in zip(text.tolist(), bucket.tolist())}
    alone = {(i, b) for i, t in enumerate(texts) for f, _, d, o in tox.chunks([t]) for _, b in zip(*map(np.ndarray.tolist, tox.present(d, o)))}
    assert seen == alone


def test_counting_grams_takes_little_memory():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "x1", "y22"], 400)) for _ in range(1000)]
    rows = pd.DataFrame({"text": texts, "label": np.arange(1000) % 2})
    whole, some = [], []
    assert traced(lambda: some.extend(tox._counts(iter([rows])))) < 130e6
    whole.extend(tox._counts(iter([rows[:300], rows[300:]])))
    assert some[0].equals(whole[0])


def test_held_out_accuracy(spark):
    got = tox.op2_toxicity(spark, D).join(spark.read.parquet(f"{D}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    caught = [r.predicted for r in got if r.toxic == 1]
    wrong = [r.predicted for r in got if r.toxic == 0]
    assert sum(caught) >= 0.75 * len(caught) and sum(wrong) <= 0.03 * len(wrong)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (2, "you idiot loser", 9), (2, "you idiot loser", 9), (None, "fine words", 9), (3, "you idiot loser " * 20_000, 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    texts = spark.createDataFrame([(i, "you idiot loser" if i % 4 == 0 else f"quiet words number {i}") for i in range(40)], "doc_id long, text string")
    model = tox.fit(tox.training_rows(texts, labels, F.lit(True)))
    rows = tox.score_toxicity(docs, model).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert sorted(r.predicted for r in rows) == [0, 0, 0, 1, 1, 1]
    assert len({r.score for r in rows if not r.text}) == 1
    assert tox.score_toxicity(docs.limit(0), model).count() == 0
    for keep, low, high in ((F.lit(False), 0.5, 0.5), (F.col("id") % 4 == 0, 0.99, 1), (F.col("id") % 4 == 1, 0, 0.01)):
        assert all(low <= r.score <= high for r in tox.score_toxicity(docs, tox.fit(tox.training_rows(texts, labels, keep))).collect())


def plain_buckets(text):
    t = b" ".join((text or "").encode().translate(tox.PLAIN).split())
    padded, out = b" " * 6 + t + b" " * 6, set()
    for n, m in zip(tox.SIZES, tox.MULTIPLIERS):
        out |= {(int.from_bytes(padded[i : i + n], "little") * m % 2**64) >> (64 - tox.BUCKET_BITS) for i in range(len(padded) - n + 1)}
    return out


def test_model_against_plain_python(spark):
    """Counts, features, ratios and the optimum of the loss, step by step."""
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    ids = sorted(d for d in docs if labels.get(d) is not None and zlib.crc32(str(d).encode()) % 3 != 1)
    sets, y = [plain_buckets(docs[d]) for d in ids], np.array([labels[d] for d in ids])
    n1, n0 = int(y.sum()), int((1 - y).sum())
    count = [{}, {}]
    for s, k in zip(sets, y):
        for b in s:
            count[k][b] = count[k].get(b, 0) + 1
    ratio = {}
    for b in set(count[0]) | set(count[1]):
        one, zero = count[1].get(b, 0), count[0].get(b, 0)
        rest1, rest0 = n1 - one, n0 - zero
        if one + zero >= tox.MIN_TEXTS and rest1 + rest0:
            chi2 = (n1 + n0) * (one * rest0 - zero * rest1) ** 2 / ((one + zero) * (rest1 + rest0) * n1 * n0)
            r = math.log((one + 1) / (n1 + 2)) - math.log((zero + 1) / (n0 + 2))
            if chi2 >= tox.MIN_CHI2 and r:
                ratio[b] = r
    model = tox.fit(tox.training_rows(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), ~tox.held_out(F.col("id"))))
    assert n1 and n0 and ratio and set(np.flatnonzero(model.weights).tolist()) <= set(ratio)
    scores = [1 / (1 + math.exp(-(model.bias + sum(model.weights[b] for b in s)))) for s in sets]
    assert np.allclose(model.scores([docs[d] for d in ids]), scores, atol=1e-9)
    # the loss is convex: its slope is nil at the optimum only
    miss = np.where(y > 0, (n0 / n1) ** tox.BALANCE * (np.array(scores) - 1), scores)
    slope = {b: sum(m for m, s in zip(miss, sets) if b in s) * r + model.weights[b] / r for b, r in ratio.items()}
    assert abs(miss.sum()) < 1e-2 and max(map(abs, slope.values())) < 1e-2


# ---------------------------------------------------------------- search


def best(rows, k=10):
    out = []
    for q, v in sorted({(i, tuple(x)) for i, x in rows if i % 100 == 0}):
        pad = lambda a, n: list(a) + [0] * (n - len(a))
        s = sorted((-sum(a * b for a, b in zip(pad(v, len(x)), pad(x, len(v)))), i) for i, x in rows if i != q)
        out += [(q, r + 1, i, -p) for r, (p, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize(("n", "block", "shard"), [(3, 4, 8), (700, 16, 100), (700, 128, 32_768)])
def test_search(spark, monkeypatch, n, block, shard):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "SHARD", shard)
    rng = np.random.default_rng(n)
    rows = [(i, rng.integers(-50, 50, 6).tolist() if i % 3 else [1, 2, 3, 4, 5, 6]) for i in range(n)]
    rows += [(100, [9, 9, 9]), (5, rows[1][1])]
    df = spark.createDataFrame([*rows, (7, None)], "vec_id long, x array<long>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect())
    assert got == best(rows)


def test_search_of_odd_vectors(spark):
    rows = [(0, [0.5, -0.0001]), (1, [float("nan"), 1.0]), (2, None), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (5, []), (6, [1.0, 1.0]), (200, [1e6, -1e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.integers(F.col("embedding")).alias("x"))
    assert {r.vec_id: r.x for r in df.collect() if r.x is not None} == {0: [512, -1], 5: [], 6: [1024, 1024], 200: [1024 * 10**6, -1024 * 10**6]}
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect())
    assert got == best([(0, [512, -1]), (5, []), (6, [1024, 1024]), (200, [1024 * 10**6, -1024 * 10**6])])
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0
    assert topk.top_k(df, F.lit(False)).count() == 0


def test_products_beyond_doubles():
    a, b = np.array([[2**40, 3]]), np.array([[2**21, 5], [1, 1]])
    assert topk.products(a, b).tolist() == [[2**61 + 15, 2**40 + 3]]


def test_search_of_extreme_components(spark):
    """Scores beyond 64 bits count as the nearest long, and bounds with them."""
    big = 2**63 - 1
    rows = [(0, [big, -big]), (100, [2**40, 2**41]), (200, [-big, 0]), (1, [big, 0]), (2, [-big - 1, 5]), (3, [2**62, 2**62]), (4, [7, -9]), (5, [0, big])]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, x array<long>"), F.col("vec_id") % 100 == 0).collect())
    want = []
    for q, v in rows:
        if q % 100 == 0:
            s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, x)))), i) for i, x in rows if i != q)
            want += [(q, r + 1, i, -p) for r, (p, i) in enumerate(s)]
    assert got == sorted(want)


def test_blocks_are_skipped(monkeypatch):
    rng = np.random.default_rng(0)
    blocks = [(np.arange(i * 10, i * 10 + 10), rng.integers(0, 10, (10, 4)) + 100 * (i == 3)) for i in range(50)]
    scored = []
    real = topk.products
    monkeypatch.setattr(topk, "products", lambda a, b: scored.append(len(b)) or real(a, b))
    topk.search(np.array([[1, 1, 1, 1]]), np.array([-1]), np.array([-(2**63)]), blocks, 5)
    assert sum(scored[1:]) == 10  # after the bounds


# ---------------------------------------------------------------- language model


def base(docs):
    words = lambda t: [*WORD.findall((t or "").translate(AZ)), "\n"]
    train = [w for d, t in docs if d is None or zlib.crc32(str(d).encode()) % 10 for w in words(t)]
    c: dict = {}
    for w in train:
        c[w] = c.get(w, 0) + 1
    n, v = len(train), len(c)
    for d, t in docs:
        w = words(t)
        yield d, d is not None and zlib.crc32(str(d).encode()) % 10 == 0, len(w), sum(x in c for x in w), n, sum(math.log10((c.get(x, 0) + 0.1) / (n + 0.1 * (v + 1))) for x in w)


def score(spark, docs):
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, score int")
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    return st.score_texts(df, ~held).collect()


def test_base_and_held_out_score(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    want = {d: x for d, *x in base(docs)}
    rows = st.op4_lm_scoring(spark, D).collect()
    assert len(rows) == len(want)
    for r in rows:
        held, n, known, train, s = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert abs(r.base_score - s) < 1e-6 * abs(s) and math.isfinite(r.score)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > 0.95 * sum(r.base_score for r in out)


def test_scores_of_odd_tables(spark):
    docs = [(1, None), (2, ""), (3, "A b  a"), (3, "A b  a"), (3, "other"), (None, "a é"), (5, "long words " * 60_000), (6, "\x1c \x85")]
    rows = score(spark, docs)
    key = lambda x: (-(2**63) if x is None else x)
    want = sorted((key(d), n, k, train, round(s, 6)) for d, _, n, k, train, s in base(docs))
    assert sorted((r.key, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == want
    assert score(spark, []) == []
    held = [d for d in range(200) if zlib.crc32(str(d).encode()) % 10 == 0][:3]
    rows = score(spark, [(d, "never learnt") for d in held])
    assert [(r.n_known, r.train_tokens, round(r.base_score, 9)) for r in rows] == [(0, 0, 0.0)] * 3


def plain_tree(docs):
    """The definition in plain Python: the score of each (doc_id, text)."""
    learnt = [WORD.findall((t or "").translate(AZ)) for d, t in docs if zlib.crc32(str(d).encode()) % 10 != 0]
    counts: dict = {}
    for words in learnt:
        for w in words:
            counts[w] = counts.get(w, 0) + 1
    n = sum(counts.values()) + len(learnt)
    own = max(1.0, st.FREQUENT * n)
    class_of = lambda w: zlib.crc32(w.encode()) % st.CLASSES
    symbol = lambda w: w if counts.get(w, 0) >= own else class_of(w)
    mass, once = {}, {}
    for w, c in counts.items():
        if c < own:
            mass[class_of(w)] = mass.get(class_of(w), 0) + c
            once[class_of(w)] = once.get(class_of(w), 0) + (c == 1)
    width = 1 + st.CLASSES + sum(c >= own for c in counts.values())

    def sequence(words):
        return ["", *map(symbol, words), ""]  # an empty string ends texts and stands before them

    root: dict = {}
    after: dict = {}
    for words in learnt:
        s = sequence(words)
        for i in range(1, len(s)):
            root[s[i]] = root.get(s[i], 0) + 1
            for k in range(1, min(st.DEPTH, i) + 1):
                seen = after.setdefault(tuple(s[i - k : i]), {})
                seen[s[i]] = seen.get(s[i], 0) + 1
    whole = sum(root.values())

    left = sum(c - 0.5 for c in root.values())
    weight = max(whole - left, 0.5)

    def of_root(x):
        return (max(root.get(x, 0) - 0.5, 0) + weight / width) / (left + weight)

    totals = {context: sum(seen.values()) for context, seen in after.items()}
    kept: dict = {}

    def p(context, x):
        """After a kept context or the empty one."""
        if not context:
            return of_root(x)
        total, seen = totals[context], after[context]
        return (max(seen.get(x, 0) - 0.5, 0) + 0.5 * len(seen) * p(context[1:], x)) / total

    for k in range(1, st.DEPTH + 1):
        for context, seen in after.items():
            total = totals[context]
            if len(context) != k or total < st.FLOOR or (k > 1 and context[1:] not in kept):
                continue
            below = {x: p(context[1:], x) for x in seen}
            rest = 0.5 * len(seen) / total
            divergence = sum(p(context, x) * math.log(p(context, x) / below[x]) for x in seen)
            divergence += rest * max(1 - sum(below.values()), 0) * math.log(rest)
            if total * divergence > 0.5 * len(seen) * math.log(total):
                kept[context] = True
    out = []
    for _, t in docs:
        words = WORD.findall((t or "").translate(AZ))
        s, score = sequence(words), 0.0
        for i in range(1, len(s)):
            state = next((tuple(s[i - k : i]) for k in range(min(st.DEPTH, i), 0, -1) if tuple(s[i - k : i]) in kept), ())
            score += math.log10(p(state, s[i]))
        for w in words:
            if counts.get(w, 0) < own:
                c, new = mass.get(class_of(w), 0), (once.get(class_of(w), 0) + 0.5) / (mass.get(class_of(w), 0) + 1)
                score += math.log10(counts[w] * (1 - new) / c) if w in counts else math.log10(new)
        out.append(score)
    return out, kept


@pytest.fixture(scope="module")
def small():
    import pyarrow.parquet as pq

    t = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    docs = list(zip(t["doc_id"], t["text"], strict=True))
    return docs, *plain_tree(docs)


def test_scores_are_those_of_a_plain_tree(spark, small):
    docs, want, kept = small
    assert {len(k) for k in kept} == {1, 2, 3}
    got = {r.key: r.score for r in score(spark, docs)}
    assert len(got) == len(docs)
    for (d, _), w in zip(docs, want, strict=True):
        assert abs(got[d] - w) <= 1e-6 * abs(w) + 1e-4


def test_scores_are_the_same_for_any_partitioning_and_size_of_buckets(spark, small):
    docs, *_ = small
    df = spark.createDataFrame(docs, "doc_id long, text string")
    learn = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    want = {r.key: r.score for r in st.score_texts(df.coalesce(1), learn).collect()}
    for parts, most in ((7, 500), (3, 5000), (13, 10**9)):  # in the first, nearly all frequent words are crowded
        got = {r.key: r.score for r in st.score_texts(df.repartition(parts), learn, most=most).collect()}
        assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 * abs(want[d]) + 1e-9 for d in want)


def lexicon_of(rows):
    counts: dict = {}
    for t in rows:
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
    return st.Lexicon(list(counts), list(counts.values()), 1.0)


def positions(lexicon, rows):
    """Contexts with the symbol after, latest first, of some texts, and the root's probabilities."""
    _, _, s, sizes = lexicon.read(rows)
    code = st.grams(st.ended(s, sizes))
    number = np.bincount(st.ended(s, sizes)[1:], minlength=lexicon.symbols) + 0.5
    return (code << np.uint64(16)) | (code >> np.uint64(48)), number / number.sum()


def test_tree_learns_contexts():
    rng = np.random.default_rng(0)
    rows = [b" ".join([b"a", b"b"][int(x)] + b" " + [b"c", b"d"][int(x)] for x in rng.integers(0, 2, 50)) for _ in range(60)]
    lexicon = lexicon_of(rows)
    code, root = positions(lexicon, rows)
    levels = st.grow(*st.summed(code, np.ones(len(code), np.int64)), root)
    assert len(levels[0].contexts) > 0
    log = np.log10(st.probabilities(levels, root, positions(lexicon, [b"a c b d"])[0]))
    assert log[1] > -0.05 and log[3] > -0.05  # c after a, d after b
    assert np.log10(st.probabilities(levels, root, positions(lexicon, [b"a d"])[0]))[1] < -1.5


def test_distributions_add_up():
    rng = np.random.default_rng(1)
    rows = [" ".join(rng.choice(["x", "y", "z", "x y", "z z"], 30)).encode() for _ in range(80)]
    lexicon = lexicon_of(rows)
    code, root = positions(lexicon, rows)
    levels = st.grow(*st.summed(code, np.ones(len(code), np.int64)), root)
    for past in np.unique(code >> np.uint64(16)):
        every = past << np.uint64(16) | np.arange(lexicon.symbols, dtype=np.uint64)
        assert abs(st.probabilities(levels, root, every).sum() - 1) < 1e-9


def test_positions_are_packed_whole():
    rng = np.random.default_rng(2)
    context = rng.integers(0, 5, (4000, 4)).astype(np.uint64) @ np.array([1 << 48, 1 << 32, 1 << 16, 1], np.uint64)
    doc, learnt = np.sort(rng.integers(0, 30, 4000)), rng.integers(0, 2, 30).astype(bool)
    dealing = st.Dealing.of(np.array([10, 900, 3000, 40, 50]), 1000)
    assert dealing.parts.tolist() == [1, 1, 3, 1, 1]
    got, owners = [], {}
    for bucket, data in st.deal(context, doc, learnt, dealing):
        steps, occurs, trained, docs, nexts, number = st.unpack(data)
        codes = np.cumsum(steps, dtype=np.uint64)
        got += list(zip(np.repeat(codes, occurs).tolist(), docs.tolist(), strict=True))
        for c, k in zip(codes.tolist(), trained.tolist(), strict=True):
            assert owners.setdefault(c, bucket) == bucket and k == int(learnt[doc[context == c]].sum())
        if codes[0] >> np.uint64(48) == 2:
            mine = (context >> np.uint64(48) == 2) & learnt[doc]
            want = np.bincount((context[mine] & np.uint64(0xFFFF)).astype(int), minlength=5)
            assert dict(zip(nexts.tolist(), number.tolist(), strict=True)) == {i: c for i, c in enumerate(want.tolist()) if c}
        else:
            assert not len(nexts)
    assert sorted(got) == sorted(zip(context.tolist(), doc.tolist(), strict=True))


def many_positions(n):
    symbols = (np.random.default_rng(3).zipf(1.2, (n, 4)).astype(np.float64) % 3000).astype(np.uint64)
    return symbols @ np.array([1 << 48, 1 << 32, 1 << 16, 1], np.uint64), np.bincount(symbols[:, 0].astype(int), minlength=3000)


def test_dealing_takes_few_bytes_a_position():
    n = 1 << 19
    context, number = many_positions(n)
    rng = np.random.default_rng(4)
    doc, learnt = np.sort(rng.integers(0, 3000, n)).astype(np.uint32), rng.integers(0, 2, 3000).astype(bool)
    dealing = st.Dealing.of(number * 30, 1_000_000)
    assert (dealing.parts > 1).any()
    assert traced(lambda: [None for _ in st.deal(context, doc, learnt, dealing)]) < 60 * n


def test_subtrees_grow_by_symbols():
    code, number = st.summed(many_positions(1 << 18)[0], np.ones(1 << 18, np.int64))
    root = np.full(3000, 1 / 3000)
    whole = st.grow(code, number, root)
    for most in (1, 1 << 12, 1 << 30):
        for a, b in zip(whole, st.grow_by_symbol(code, number, root, most), strict=True):
            assert all(np.array_equal(getattr(a, x), getattr(b, x)) for x in ("contexts", "rest", "keys", "p"))
    assert traced(lambda: st.grow_by_symbol(code, number, root, 1 << 12)) < 60 * len(code) < traced(lambda: st.grow(code, number, root))
    assert [len(x.keys) for x in st.grow_by_symbol(code[:0], number[:0], root)] == [0] * st.DEPTH


# ---------------------------------------------------------------- licences


@pytest.fixture(scope="module")
def scanner(spark):
    return licenses.train(spark.read.parquet(f"{D}/documents.parquet"))


def families(spark, scanner, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.families for r in licenses.scan_licenses(df, scanner).orderBy("doc_id").collect()]


def test_licences(spark, scanner):
    noise = "er the of thon onea shing wherea thent edou " * 40
    docs = [
        (1, "Released under the MIT License."), (2, f"{noise}\nLicensed under the Apache License, Version 2.0.\n{noise}"), (3, f"{noise} Licensed under CC BY-NC 4.0. {noise}"),
        (4, "He renewed his driving license in the city."), (5, None), (6, ""), (7, "!!!\n\n..."), (8, "All rights reserved.\nReleased under the BSD license."), (8, "nothing"), (8, "nothing"),
        (None, "SPDX-License-Identifier: GPL-3.0-or-later"), (9, "word " * 60_000), (10, "Released under the MIT License.\n ** \nplain words\n\nLicense: ISC"),
    ]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, families int, lines string")
    got = sorted(((r.doc_id, r.families, r.n_licensed, r.n_paragraphs) for r in licenses.scan_licenses(df, scanner).collect()), key=str)
    want = [
        (1, ["mit"], 1, 1), (2, ["apache-2.0"], 1, 1), (3, ["cc-by-nc"], 1, 1), (4, [], 0, 1), (5, [], 0, 0), (6, [], 0, 0), (7, [], 0, 0), (8, ["bsd", "proprietary"], 1, 1), (8, [], 0, 1),
        (8, [], 0, 1), (None, ["gpl"], 1, 1), (9, [], 0, 1), (10, ["isc", "mit"], 2, 3),
    ]
    assert got == sorted(want, key=str)
    assert licenses.scan_licenses(df.limit(0), scanner).count() == 0
    plan = licenses.scan_licenses(df, scanner)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights",
    "apache-2.0": " * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at",
    "gpl": "/* This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or */",
    "lgpl": "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either",
    "bsd": "// Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that the following conditions are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def test_wrapped_notices(spark, scanner):
    assert families(spark, scanner, list(WRAPPED.values())) == [[k] for k in WRAPPED]


def test_unfamiliar_wording(spark, scanner):
    """Sentences that no example holds: at least four of five are named rightly, none wrongly."""
    known = {
        "Use of this code is under the terms of the MIT licence": "mit", "Distributed under Apache-2.0": "apache-2.0", "This is GPL-3.0 licensed": "gpl", "Photos: CC-BY-SA 3.0": "cc-by-sa",
        "We chose the Mozilla Public License for the core.": "mpl-2.0", "text under CC BY 4.0": "cc-by", "see the GNU Affero General Public License for details": "agpl",
        "a 2-clause BSD library": "bsd", "dedicated to all under CC0": "cc0", "(c) 2007 Somebody. All rights reserved": "proprietary",
    }
    got = families(spark, scanner, list(known))
    assert sum(f == [k] for f, k in zip(got, known.values())) >= 8 and all(set(f) <= {k} for f, k in zip(got, known.values()))
    others = ["Boost Software License - Version 1.0", "Eclipse Public License v2.0 applies", "The museum reserved all rooms; rights of way apply.", "The Apache helicopter landed.", "MIT researchers published results.", *licenses.NO_LICENCE]
    assert not any(families(spark, scanner, others))


def test_examples_hold_no_sentence_of_the_corpus(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").collect()]
    lines = {" ".join(licenses._cut(x)) for t in texts for x in t.split("\n") if "icen" in x or "rights reserved" in x}
    learn, apart = licenses.examples([])
    made = [f" {' '.join(licenses._cut(t))} " for _, t in learn + apart]
    short = {"all rights reserved"}  # all of it is the phrase itself
    assert lines and not [x for x in lines - short for m in made if f" {x} " in m and len(x) < 200]


def test_scores_against_plain_python(spark, scanner):
    """Sums of weights, the bound above them, and that no window which could be named is passed over."""
    docs = spark.read.parquet(f"{D}/documents.parquet").filter("length(text) < 20000")
    got = licenses.windows(docs, "doc_id", "text").withColumns({"leads": scanner.leads(F.col("features")), "bound": scanner.bound(F.col("features"))}).collect()
    reach = set()
    for r in got:
        leads = [sum(w[x] for x in r.features) + b for w, b in zip(scanner.weights, scanner.bias)]
        assert max(abs(a - b) for a, b in zip(leads, r.leads)) < 1e-9 and r.bound >= max(leads) - 1e-9
        if 1 / (1 + math.exp(-(max(leads) * scanner.slope + scanner.shift))) >= licenses.MIN_PROBABILITY + 1e-9:
            reach.add((r.key, r.text_hash, r.paragraph, r.start))
    found = licenses.find_licenses(docs, scanner).collect()
    assert reach and reach == {(r.key, r.text_hash, r.paragraph, r.start) for r in found if r.probability >= licenses.MIN_PROBABILITY + 1e-9}


def test_licence_lines_of_documents(spark, scanner):
    rows = licenses.scan_licenses(spark.read.parquet(f"{D}/documents.parquet"), scanner).select("text", "families").collect()
    signs = {"apache-2.0": "Apache License, Version 2.0", "mit": "under the MIT License", "gpl": "GNU General Public License", "cc-by-nc": "CC BY-NC 4.0", "proprietary": "All rights reserved"}
    want = [sorted(k for k, s in signs.items() if s in r.text) for r in rows]
    licensed = [(r.families, w) for r, w in zip(rows, want) if w]
    assert sum(f == w for f, w in licensed) >= 0.95 * len(licensed) and not any(r.families for r, w in zip(rows, want) if not w)
