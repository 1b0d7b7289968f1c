"""Personal data: patterns propose spans, checksums confirm them, context words move their score.

DataFrame functions only. All patterns use possessive runs, so long texts neither backtrack nor recurse.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty

SPAN = "array<struct<kind:string,start:long,end:long,score:double,text:string>>"
#: Spans of the added kinds stay from this score on.
MIN_SCORE = 0.5
#: How many code points before and after a span are looked at for context words.
BEFORE, AFTER = 40, 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def total(rev: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            d = F.substring(rev, i + 1, F.lit(1)).cast("int") * (1 + i % 2)
            return acc + F.when(d > 9, d - 9).otherwise(d)

        return F.aggregate(F.sequence(F.lit(0), F.length(rev) - 1), F.lit(0), step)

    return let(F.reverse(digits), total) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an IBAN (letters upper case, spaces allowed) leaves 1 when divided by 97."""

    def rest(s: Column) -> Column:
        turned = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, F.lit(1), F.lit(4)))

        def step(acc: Column, c: Column) -> Column:
            letter = F.ascii(c) - 55
            return F.when(c.rlike("^[0-9]$"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + letter) % 97)

        return F.aggregate(F.split(turned, ""), F.lit(0), step)

    return let(F.replace(text, F.lit(" "), F.lit("")), rest) == 1


def octets(text: Column) -> Column:
    return F.forall(
        F.split(text, "[.]"),
        lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) <= 3) & (F.coalesce(F.substring(q, F.lit(1), F.lit(3)).try_cast("int"), F.lit(0)) <= 255)),
    )


def long_between(text: Column, low: int, high: int) -> Column:
    return F.length(digits_of(text)).between(low, high)


@dataclass(frozen=True)
class Kind:
    """``hint``: without it in a text there's no match; ``context``: words that raise the score by 0.4."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str
    hint: str = ""
    base: bool = True


#: In the order that breaks ties between spans of one start. The first four are always kept.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda t: F.lit(True), 0.6, "mail|contact|write|kontakt|correo|courriel", "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", octets, 0.5, r"\bip\b|address|host|server|login", "."),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: long_between(t, 14, 19) & luhn(digits_of(t)), 0.6,
         "card|visa|master|credit|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: long_between(t, 10, 15), 0.6, r"phone|\btel|call|mobile|fax", "+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod97, 0.6,
         "iban|account|bank|konto|cuenta|compte", base=False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda t: F.lit(True), 0.3,
         r"\bssn\b|social security", "-", base=False),
    Kind("local_phone", r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
         lambda t: F.lit(True), 0.3, r"phone|\btel|call|mobile|fax", base=False),
)


def found(text: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind, leftmost first and apart: code points from 0, end exclusive."""

    def placed(both: Column) -> Column:
        # what the pattern matched and what stood between give the places by running sums
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(both["gaps"], i))
            end = start + F.length(F.get(both["hits"], i))
            span = F.struct(start.alias("start"), end.alias("end"), F.get(both["hits"], i).alias("text"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(both["hits"]) - 1), none, step)["out"]

    def spans(hits: Column) -> Column:
        gaps = F.split(text, kind.pattern, -1)
        places = let(F.struct(hits.alias("hits"), gaps.alias("gaps")), placed)
        return F.when(F.size(hits) > 0, F.filter(places, lambda s: kind.valid(s["text"])))

    def scored(s: Column) -> Column:
        near = F.lower(F.concat(
            F.substring(text, F.greatest(s["start"] - BEFORE, F.lit(0)) + 1, F.least(s["start"], F.lit(BEFORE))),
            F.lit(" "), F.substring(text, s["end"] + 1, F.lit(AFTER)),
        ))
        score = F.lit(kind.score) + F.when(near.rlike(kind.context), 0.4).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].cast("long").alias("start"), s["end"].cast("long").alias("end"), score.alias("score"), s["text"].alias("text"))

    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    out = F.transform(let(hits, spans), scored)
    if kind.hint:
        out = F.when(F.contains(text, F.lit(kind.hint)), out)
    return F.coalesce(out.cast(SPAN), F.array().cast(SPAN))


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of ``kind, start, end, score, text``.

    ``base`` are the e-mail addresses, IP addresses, card numbers and phone numbers that their patterns
    propose and the checks (octets, Luhn, number of digits) confirm; all are kept, with a score. The
    added kinds (IBAN by mod-97, US social security and local phone numbers) need a score of
    ``MIN_SCORE``, which for the last two takes a context word near by, and overlap no base span.
    ``spans`` has both, by start, then kind.

    A null or empty text has none; equal rows get equal results; an empty table gives none. Columns
    named ``base`` or ``spans`` are replaced. Each row is judged alone, without a shuffle.
    """
    order = F.array(*[F.lit(k.name) for k in KINDS])

    def sort(a: Column) -> Column:
        def before(x: Column, y: Column) -> Column:
            return F.when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).otherwise(
                (F.array_position(order, x["kind"]) - F.array_position(order, y["kind"])).cast("int")
            )

        return F.when(F.size(a) > 1, F.array_sort(a, before)).otherwise(a)

    text = F.col("_pii_text")
    base = F.concat(*[found(text, k) for k in KINDS if k.base])
    more = F.concat(*[found(text, k) for k in KINDS if not k.base])
    kept = F.filter("_pii_more", lambda m: (m["score"] >= MIN_SCORE) & ~F.exists("base", lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"])))
    return (
        docs.withColumn("_pii_text", text_or_empty(F.col(text_col)))
        .withColumns({"base": base, "_pii_more": more})
        .withColumn("spans", F.when(F.size("_pii_more") > 0, F.concat("base", kept)).otherwise(F.col("base")))
        .withColumns({"base": sort(F.col("base")), "spans": sort(F.col("spans"))})
        .drop("_pii_text", "_pii_more")
    )


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span's text replaced by its kind in brackets; overlapping spans by the first's."""
    def build(acc: Column, s: Column) -> Column:
        skip = s["start"] < acc["at"]
        piece = F.concat(acc["out"], F.substring(F.col(text_col), acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit("["), s["kind"], F.lit("]"))
        return F.when(skip, acc).otherwise(F.struct(s["end"].alias("at"), piece.alias("out")))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    end = lambda a: F.concat(a["out"], F.substring(F.col(text_col), a["at"].cast("int") + 1, F.length(text_col)))
    out = find_pii(docs, text_col)
    return out.withColumn(text_col, F.when(F.size("spans") > 0, F.aggregate("spans", start, build, end)).otherwise(F.col(text_col))).drop("base", "spans")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select(
        "doc_id", *[count(k.name) for k in KINDS if k.base],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )
