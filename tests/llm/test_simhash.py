import random

import numpy as np
import pytest
from brute import AZ, WORD, components, simhash

from quarrylib.llm import simhash as sh
from quarrylib.llm import similar as si


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, step=37)
    errors = sh._errors()[sh._syndrome(words)]
    assert np.bitwise_count(errors).max() == 3 and len(np.unique(sh._errors())) == 2048
    assert not sh._syndrome(words ^ errors).any()


def test_two_errors_share_an_index_and_a_key():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 1 << 23, 4000)
    near = w ^ (1 << rng.integers(0, 23, 4000)) ^ (1 << rng.integers(0, 23, 4000))
    assert all(set(a) & set(b) for a, b in zip(sh.near_indices(w), sh.near_indices(near)))
    assert {len(set(a)) for a in sh.near_indices(w)} == {1, 6}
    fps = rng.integers(-(2**63), 2**63, 2000)
    for a in range(64):
        other = (fps.view(np.uint64) ^ np.uint64((1 << a) | (1 << int(rng.integers(64))))).view(np.int64)
        (r1, k1), (r2, k2) = sh.golay_keys(fps), sh.golay_keys(other)
        shared = set(zip(r1.tolist(), k1.tolist())) & set(zip(r2.tolist(), k2.tolist()))
        assert {r for r, _ in shared} == set(range(2000))


def test_fingerprints_of_odd_texts():
    texts = [None, "", " \t\x0b ", "One", "one two", "A b  c", "É x y z é", "a b c d " * 40000, "x y z \x1c w", "💥 " * 5]
    for t in texts:
        assert sh.fingerprint(sh.hashes(t)) == simhash(t), t


def _rows(spark, docs):
    out = sh.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string, fp string, key int"))
    return sorted((r.doc_id, r.fingerprint, r.component_id) for r in out.collect())


def test_odd_tables(spark):
    docs = [(5, "a b c d", "x", 1), (3, "A  B c\td", None, 2), (3, "a b c d", "x", 1), (7, None, "q", 0), (9, " ", "q", None), (4, "solo words", "", 3), (4, "other thing here", "", 3)]
    brute = components([(d, simhash(t)) for d, t, _, _ in docs])
    assert _rows(spark, docs) == brute
    assert _rows(spark, []) == []
    got = sh.near_duplicates(spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, None), (1, None)}


def groups(docs, words=5, similarity=0.8):
    """The rows that stay: of each group of similar texts the least id."""
    sets = []
    for _, t in docs:
        w = WORD.findall((t or "").translate(AZ))
        sets.append({" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= similarity * (len(sets[i]) + len(sets[j]) - both) and both:
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[top(i)] = min(least.get(top(i), d), d)
    return sorted(least.values())


def near_copies(seed, n, crowd):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    docs, d = [], 0
    for size in [*([1] * n), *([2, 3, 5] * (n // 10)), crowd]:
        text = [word() for _ in range(rnd.choice((30, 120, 400)))]
        for k in range(size):
            w = list(text)
            for _ in range(rnd.choice((0, 1, len(w) // 100)) if k else 0):
                w[rnd.randrange(len(w))] = word()
            docs.append((d := d + rnd.randrange(1, 4), " ".join(w)))
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("crowd", [4, 90])
def test_similar_texts(spark, crowd):
    docs = near_copies(crowd, 60, crowd)
    df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, component string")
    kept = si.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == groups(docs)


def test_copies_that_only_their_original_is_like(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    text = [word() for _ in range(400)]
    docs = [(500, " ".join(text))]
    for k in range(120):
        w = list(text)
        for i in rnd.sample(range(5, 395, 5), 8):
            w[i] = word()
        docs.append((k, " ".join(w)))
    kept = si.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == groups(docs) == [0]


@pytest.mark.parametrize("block", [si.BLOCK, 40])
def test_edited_copies_without_their_original(spark, monkeypatch, block):
    """Similarities spread around 0.8: few pairs reach it, so most texts have no link to a leader of a band."""
    monkeypatch.setattr(si, "BLOCK", block)
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    text, docs = [word() for _ in range(400)], []
    for k in range(300):
        w = list(text)
        for i in rnd.sample(range(5, 395, 5), 5):
            w[i] = word()
        docs.append((k, " ".join(w)))
    kept = si.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == groups(docs)


def boilerplate(seed, n, own=40, share=0.9):
    """``n`` texts of one boilerplate with words of their own; half of them in pairs that share part of these.

    Pairs lie at a similarity of 0.81 to 0.95, all others at 0.7 to 0.79.
    """
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    common, texts = [word() for _ in range(300)], []
    for k in range(0, n, 2):
        extra = [word() for _ in range(own + rnd.randrange(0, 14))]
        texts.append([*common, *extra])
        if k % 4 == 0:  # a copy that shares some of its own words
            same = rnd.randrange(len(extra) // 3, len(extra))
            extra = [*extra[:same], *[word() for _ in range(len(extra) - same)]]
        else:
            extra = [word() for _ in range(own + rnd.randrange(0, 14))]
        texts.append([*common, *extra])
    docs = [(i, " ".join(w)) for i, w in enumerate(texts)]
    rnd.shuffle(docs)
    return docs


@pytest.mark.parametrize("n", [400, 4000])
def test_texts_around_one_boilerplate(spark, n):
    docs = boilerplate(n, n)
    kept = {r.doc_id for r in si.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    if n == 400:
        want = set(groups(docs))
    else:  # only neighbours may be alike, which the smaller table shows
        sets = {d: set(zip(*[t.split()[i:] for i in range(5)])) for d, t in docs}
        alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
        want = {d for d in sets if d % 2 == 0 or not alike(d - 1, d)}
    missed = len(kept - want)
    assert not want - kept and missed <= 0.02 * (n - len(want))


def test_overlaps():
    rng = np.random.default_rng(5)
    xs, ys = ([np.unique(rng.integers(0, 300, n)).astype(np.uint64) for n in sizes] for sizes in ((1, 50, 200), (3, 120)))
    want = [[len(np.intersect1d(x, y)) for y in ys] for x in xs]
    assert si.overlaps(xs, ys, 7).tolist() == si.overlaps(xs, ys).tolist() == want
    assert not si.overlaps(xs, [y + np.uint64(1000) for y in ys]).any()


def test_similar_texts_of_odd_tables(spark):
    docs = [(5, "a b c d"), (3, "A  B c\td"), (3, "a b c d"), (7, None), (9, " "), (4, "solo words"), (4, "other thing here"), (8, "w " * 50_000), (6, "W " * 40_000), (6, "W " * 40_000)]
    df = spark.createDataFrame([(d, t, None) for d, t in docs], "doc_id long, text string, sig int")
    got = [(r.doc_id, " ".join((r.text or "").lower().split())[:9]) for r in si.drop_near_duplicates(df).collect()]
    assert sorted(got) == [(3, "a b c d"), (4, "other thi"), (4, "solo word"), (6, "w w w w w"), (7, "")]
    assert si.drop_near_duplicates(df.limit(0)).count() == 0
    named = spark.createDataFrame([(None, "a b c"), (1, "a b c")], "doc_id long, text string")
    assert [r.doc_id for r in si.drop_near_duplicates(named).collect()] == [None]


@pytest.mark.parametrize("bucket", [sh.BUCKET, 2])
def test_links_of_crowded_fingerprints(spark, monkeypatch, bucket):
    """Fingerprints in a small ball: many share a bucket; both ways of linking give the same parts."""
    monkeypatch.setattr(sh, "BUCKET", bucket)
    rnd = random.Random(7)
    centres = [rnd.getrandbits(64) for _ in range(4)]
    fps = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.choice((0, 1, 2, 3, 5)))) for c in centres for _ in range(60)}
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    from quarrylib.operators.components import connected_components

    got = {r.node: r.component for r in connected_components(sh.links(df)).collect()}
    brute = components([(s, f) for s, f in zip(signed, fps)])
    assert {s: got.get(s, s) for s in signed} == {s: r for s, _, r in brute}


def test_documents_against_plain_python(spark):
    d = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in sh.op1_simhash(spark, d).collect())
    assert got == components([(i, simhash(t)) for i, t in texts])
