from brute import pii_base, sha256
from pyspark.sql import functions as F

from quarrylib.llm import pii

ODD = [
    None, "", "a@b.c", "x a@b.c_d@e.f y", "ü@x.de öö max.mu+s@mail-1.example.com, end",
    "1.2.3.4 300.1.1.1 001.002.3.4.5.6.7.8 1.2.3 99999999999999999999.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112; 41111111111111112222",
    "call +1 (524) 555-2896 now +49 30 1234 +123456789012345678", "a" * 30000, "9" * 30000, "a@" + ".b" * 20000,
    "💥 me@x.org 💥 10.0.0.1", "+1" + " 2" * 9 + " .", "1-2-3 12", "@.@..@a.b@c.d",
]


def test_base_spans_are_those_of_the_patterns(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.base] == pii_base(ODD[r.doc_id]), ODD[r.doc_id]
        assert all((ODD[r.doc_id] or "")[s.start : s.end] == s.text for s in r.spans)
        assert {(s.kind, s.start) for s in r.base} <= {(s.kind, s.start) for s in r.spans}


def test_documents_against_plain_python(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = pii.op6_pii(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = pii_base(texts[r.doc_id])
        assert r.base_sha256 == sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in base) for x in ("email", "ip", "card", "phone"))


def test_added_kinds_need_checksum_or_context(spark):
    texts = [
        "DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00", "GB82WEST12345698765432",
        "my ssn is 123-45-6789", "part 123-45-6789", "phone: (524) 555-2896", "no (524) 555-2896", "call +1 (524) 555-2896",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.spans] for r in pii.find_pii(df).collect()}
    assert got == {0: ["iban"], 1: [], 2: ["iban"], 3: ["ssn"], 4: [], 5: ["local_phone"], 6: [], 7: ["phone"]}


def test_redact_and_shape(spark):
    df = spark.createDataFrame([(1, "write a@b.c or 10.0.0.1!", "x"), (1, None, "y")], "doc_id long, text string, spans string")
    out = pii.redact(df)
    assert sorted(r.text or "" for r in out.collect()) == ["", "write [email] or [ip]!"]
    assert pii.find_pii(df.limit(0)).count() == 0
    plan = pii.find_pii(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and F
