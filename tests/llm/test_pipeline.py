import hashlib
import zlib

import corpus_pipeline
import numpy as np
from brute import AZ, WORD
from pyspark.sql import functions as F
from test_simhash import groups

from quarrylib.llm import toxicity
from quarrylib.llm.token_files import vocabulary

D = "/root/testdata/sf0.001"


def mix(docs, weights=(3, 1, 2), share=1.5, epochs=2):
    """(document, taken) by the rules, step by step."""
    size = {id(d): len(WORD.findall(d["text"] or "")) for d in docs}
    sources = sorted({d["source"] for d in docs if d["source"] is not None})
    sources += [None] * any(d["source"] is None for d in docs)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    whole = {s: sum(size[id(d)] for d in docs if d["source"] == s) for s in sources}
    target, free, left = {}, list(sources), share * sum(whole.values())
    while free:
        each = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if each[s] >= epochs * whole[s]]
        if not over:
            target |= each
            break
        for s in over:
            target[s] = epochs * whole[s]
            left -= target[s]
            free.remove(s)
    out = []
    for s in sources:
        own = [d for d in docs if d["source"] == s]
        own.sort(key=lambda d: (hashlib.md5(f"mix:{d['doc_id'] if d['doc_id'] is not None else -2**63}".encode()).hexdigest(), size[id(d)]))
        budget = int(target[s] + 1e-9)
        full = budget // whole[s] if whole[s] else 0
        rest = budget - full * whole[s]
        for d in own:
            n = size[id(d)]
            out.append((d, n, whole[s], target[s], n * full + min(n, max(0, rest))))
            rest -= n
    return out


def windows(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def hits(docs, items):
    wins = set()
    for t in items:
        w = windows(t)
        n = min(10, len(w))
        wins |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1) if n}
    sizes = {len(w) for w in wins}
    for d in docs:
        w = windows(d["text"])
        if not any(tuple(w[i : i + n]) in wins for n in sizes for i in range(len(w) - n + 1)):
            yield d


def test_stages_against_plain_python(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    now = [r.asDict() for r in docs.collect()]
    as_set = lambda rows: sorted((r["doc_id"], r["text"]) for r in rows)

    # toxicity: the model's own scores, text by text
    labels = spark.read.parquet(f"{D}/labels.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, labels, ~toxicity.held_out(F.col("id"))))
    got = corpus_pipeline.toxicity(spark, docs, D)
    assert got.columns == columns
    now = [d for d in now if model.scores([d["text"]])[0] < 0.7]
    assert as_set(r.asDict() for r in got.collect()) == as_set(now)
    assert 0.8 * docs.count() < len(now) < docs.count()

    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(now, docs.schema), D)
    assert got.columns == columns
    keep = set(groups([(d["doc_id"], d["text"]) for d in now]))
    now = [d for d in now if d["doc_id"] in keep]
    assert as_set(r.asDict() for r in got.collect()) == as_set(now)

    got = corpus_pipeline.decontamination(spark, spark.createDataFrame(now, docs.schema), D)
    assert got.columns == columns
    before = len(now)
    now = list(hits(now, [r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]))
    assert as_set(r.asDict() for r in got.collect()) == as_set(now) and len(now) < before

    got = corpus_pipeline.mixing(spark, spark.createDataFrame(now, docs.schema), D)
    assert got.columns == columns
    now = [d for d, n, _, _, taken in mix(now) for _ in range(-(-taken // n) if n else 0)]
    assert as_set(r.asDict() for r in got.collect()) == as_set(now)

    got = corpus_pipeline.token_files(spark, spark.createDataFrame(now, docs.schema), D).collect()
    lib, start, want = Tokenizer.from_file(vocabulary()), 0, []
    for d in sorted(now, key=lambda d: d["doc_id"]):
        ids = [*lib.encode(d["text"], add_special_tokens=False).ids, 1]
        want.append((d["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, D).collect()), key=lambda r: r[1]) == want
