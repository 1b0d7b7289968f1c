"""Line dedup, mixing, decontamination: odd tables and plain Python versions."""

import hashlib
import random

import pytest
from brute import AZ, sha256
from pyspark.sql import functions as F
from test_pipeline import mix, windows

from quarrylib.llm import decontamination as dc
from quarrylib.llm import line_dedup as ld
from quarrylib.llm import mixing
from quarrylib.llm.common import word_count


def table(spark, rows, more="source string, n_dropped int, key int"):
    return spark.createDataFrame(rows, f"doc_id long, text string, {more}")


# ---------------------------------------------------------------- lines


def dedup(docs):
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(AZ)
    ids: dict = {}
    for d, t in docs:
        for x in (t or "").split("\n"):
            ids.setdefault(strip(x), set()).add(-(2**63) if d is None else d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        gone = [len(strip(x)) >= 10 and len(ids[strip(x)]) > 1 and min(ids[strip(x)]) != (-(2**63) if d is None else d) for x in lines]
        out.append((d, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


def test_lines(spark):
    long = "the same long line"
    docs = [
        (3, f"a\n{long}\nb\n  {long.upper()}\t\n\n"), (1, f"{long}\n{long}"), (5, f"x\n{long}"), (5, f"x\n{long}"), (5, f"{long}\nother text here"),
        (7, None), (8, ""), (None, f"{long}\nq"), (None, "q\r\nééééééééé\nééééééééé1"), (9, "ééééééééé\nééééééééé1\n\n\n"), (10, "ÉÉÉÉÉÉÉÉÉÉ"), (11, "éééééééééé"),
        (12, "only in one doc!\nonly in one doc!"), (13, "\n".join(f"line number {i}" for i in range(3000))), (14, "line number 7\nline number 9\nend"),
    ]
    got = ld.dedup_lines(table(spark, [(d, t, "s", 1, 2) for d, t in docs]))
    assert set(got.columns) == {"doc_id", "text", "source", "n_dropped", "key", "n_lines"}
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()], key=str) == dedup(docs)
    assert ld.dedup_lines(table(spark, [])).count() == 0


def test_lines_of_three_documents(spark):
    docs = [(i, "in all of them\n" + ("in two of them" if i < 2 else "alone in here")) for i in range(3)]
    got = {r.doc_id: r.text for r in ld.dedup_lines(table(spark, [(d, t, "", 0, 0) for d, t in docs]), min_docs=3).collect()}
    assert got == {0: docs[0][1], 1: "in two of them", 2: "alone in here"}


# ---------------------------------------------------------------- mixing


def mixed(spark, docs, **options):
    df = spark.createDataFrame([(d["doc_id"], d["text"], d["source"], 5.0) for d in docs], "doc_id long, text string, source string, target double")
    return mixing.mix_sources(df, word_count(F.col("text")), **options)


@pytest.mark.parametrize("seed", range(4))
def test_mixes(spark, seed):
    rnd = random.Random(seed)
    sources = [None, "", "Z", "a", "é", "b" * 40][: rnd.choice((1, 3, 6))]
    docs = [{"doc_id": i, "text": " ".join("w" * rnd.choice((0, 1, 3, 50))), "source": rnd.choice(sources)} for i in range(150)]
    docs += [{"doc_id": 500 + i, "text": None, "source": "void"} for i in range(2)] + [{"doc_id": 600, "text": "one huge " * 4000, "source": sources[0]}]
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in mixed(spark, docs).collect()}
    want = {d["doc_id"]: (n, s, t, k) for d, n, s, t, k in mix(docs)}
    assert {d: (n, s, k) for d, (n, s, _, k) in got.items()} == {d: (n, s, k) for d, (n, s, _, k) in want.items()}
    assert all(abs(got[d][2] - want[d][2]) < 1e-6 for d in got)
    assert all(k <= 2 * n for n, _, _, k in got.values())
    by: dict = {}
    for d in docs:
        by.setdefault(d["source"], []).append(got[d["doc_id"]])
    assert all(0 <= x[0][2] - sum(k for *_, k in x) < 1 for x in by.values())


def test_mix_of_odd_tables(spark):
    docs = [(1, "a b", "s", 7)] * 3 + [(None, "c", None, 7)] * 2 + [(9, None, "", 7), (None, "", "", 7)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, size int")
    rows = mixing.mix_sources(df, word_count(F.col("text"))).collect()
    # 8 words, 150 %: weights by source are 3 for the empty name, which has none, 1 for s and 2 for null
    assert sorted((r.source or str(r.source), r["size"], r.taken) for r in rows) == [("", 0, 0)] * 2 + [("None", 1, 2)] * 2 + [("s", 2, 2), ("s", 2, 2), ("s", 2, 4)]
    copies = mixing.mixed_copies(df, word_count(F.col("text")))
    assert copies.columns == df.columns and sorted(str(r.doc_id) for r in copies.collect()) == ["1"] * 4 + ["None"] * 4
    nothing = spark.createDataFrame([(1, "", "s", 1)], df.schema)
    assert mixing.mix_sources(nothing, word_count(F.col("text"))).first().taken == 0
    huge = spark.createDataFrame([(1, "w " * 300_000, "a", 1), (2, "x", "b", 1)], df.schema)
    assert {r.doc_id: r["size"] for r in mixing.mix_sources(huge, word_count(F.col("text"))).collect()} == {1: 300_000, 2: 1}
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(empty, word_count(F.col("text"))).count() == 0
    assert mixing.mixed_copies(empty, word_count(F.col("text"))).columns == ["doc_id", "text", "source"]


# ---------------------------------------------------------------- decontamination


def contaminated(docs, items, n=10):
    wins: dict = {}
    for i, t in items:
        w = windows(t)
        k = min(n, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            wins.setdefault(tuple(w[j : j + k]), set()).add("null" if i is None else str(i))
    out = []
    for d, t in docs:
        w, hit, ids = windows(t), set(), set()
        for k in {len(x) for x in wins}:
            for j in range(len(w) - k + 1):
                if (found := wins.get(tuple(w[j : j + k]))) is not None:
                    hit |= set(range(j, j + k))
                    ids |= found
        out.append((d, len(w), len(hit), len(ids), sha256(",".join(sorted(ids))), bool(hit)))
    return sorted(out, key=str)


PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, PASSAGE), (2, "Short, item!"), (3, None), (4, ""), (5, PASSAGE), (None, "lonely"), (6, "x x x x x x x x x x x"), (7, "ÉTÉ là"), (2, "Short, item!")]
DOCS = [
    (1, "before " + PASSAGE.upper().replace(" ", ", ") + " after"), (2, " ".join(PASSAGE.split()[:10])), (3, " ".join(PASSAGE.split()[:9])), (4, "a short-item b"), (5, "shortitem"),
    (6, None), (7, ""), (8, "!!! ..."), (9, "x " * 25), (10, "lonely lonely"), (None, "lonely"), (11, "ÉTÉ LÀ ÉtÉ là Été là"), (1, "lonely"), (1, "lonely"), (12, ("filler words here " * 3000) + PASSAGE + " end"),
    (13, PASSAGE + " " + PASSAGE), (14, "\x00one\x7ftwo"),
]


def test_contamination(spark):
    docs = spark.createDataFrame([(d, t, 1, "h") for d, t in DOCS], "doc_id long, text string, n_hit int, hash string")
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, words string")
    got = dc.contamination(docs, items).select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated", "hash")
    assert sorted([tuple(r)[:6] for r in got.collect()], key=str) == contaminated(DOCS, ITEMS)
    assert sorted([(r.doc_id, r.n_words, r.n_hit) for r in dc.contamination(docs, items.limit(0)).collect()], key=str) == sorted([(d, len(windows(t)), 0) for d, t in DOCS], key=str)
    assert dc.contamination(docs.limit(0), items).count() == 0


def test_large_benchmarks_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_WINDOWS", 0)
    test_contamination(spark)


def test_removal(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    clean = {d for d, *_, c in contaminated(DOCS, ITEMS) if not c}
    kept = dc.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean - {1, 10, None}
    cut = {(r.doc_id, r.text) for r in dc.remove_hits(docs, items).collect()}
    assert {(1, "before after"), (4, "a b"), (2, ""), (5, "shortitem"), (6, None), (11, "ÉTÉ LÀ Été là"), (8, "!!! ...")} <= cut


def test_rows_without_an_id_spread(spark):
    df = spark.createDataFrame([(None, f"word {i}", "s") for i in range(500)], "doc_id long, text string, source string")
    rows = mixing.mix_sources(df, word_count(F.col("text"))).collect()
    assert sum(r.taken for r in rows) == 1500 and {r.taken for r in rows} == {2, 4}
    again = mixing.mix_sources(df.repartition(3), word_count(F.col("text"))).collect()
    assert sorted((r.text, r.taken) for r in again) == sorted((r.text, r.taken) for r in rows)


def test_targets_of_many_sources(spark):
    docs = [{"doc_id": i, "text": "w " * (i % 17), "source": f"s{i * 7919 % 1000:04d}"} for i in range(1500)]
    got = {r.doc_id: r.taken for r in mixed(spark, docs).collect()}
    assert got == {d["doc_id"]: k for d, _, _, _, k in mix(docs)}


def test_key_is_the_stated_hash(spark):
    row = mixed(spark, [{"doc_id": 7, "text": "a", "source": "s"}]).first()
    assert row.taken in (1, 2) and hashlib.md5(b"mix:7").hexdigest()
