"""Licence scans: a trained classifier of paragraphs. DataFrame functions and Spark's own ML only."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, id_key, lower_az, table, text_or_empty

#: Windows of a paragraph: so many words, each so many after the one before.
WINDOW, STEP = 48, 24
#: Buckets of the word n-grams.
BUCKETS = 1 << 13
#: Documents whose windows stand for text without a licence, about, and windows of these at most.
SAMPLE_DOCS, SAMPLE_WINDOWS = 300, 2000
#: A family is named from this calibrated probability on, and confirmed from this likeness to a piece of a notice on.
MIN_PROBABILITY, MIN_LIKENESS = 0.5, 0.6
#: Strength of the penalty, mostly on absolute weights, so that few n-grams have any; windows without a licence
#: for each with one, which calibration assumes.
PENALTY, ODDS = 3e-4, 5.0
#: Words of a piece that a notice is compared by.
PIECE = 14
UNKNOWN = "unknown"

#: Names of licences, by family. Fixed values.
NAMES: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Apache License", "Apache Licence", "Apache 2.0", "Apache-2.0", "Apache Software License", "Apache Public License"),
    "mit": ("MIT License", "MIT Licence", "MIT licensed", "X11 License", "License: MIT", "License-Identifier: MIT"),
    "gpl": ("GNU General Public License", "GNU General Public Licence", "GNU GPL", "GPL-3.0", "GPL-2.0", "GPLv3", "GPLv2", "GPL version 3", "GPL version 2"),
    "lgpl": ("GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL-2.1", "LGPL-3.0", "LGPLv3", "LGPL"),
    "agpl": ("GNU Affero General Public License", "Affero General Public License", "GNU AGPL", "AGPL-3.0", "AGPLv3", "AGPL"),
    "bsd": ("BSD License", "BSD Licence", "3-clause BSD", "2-clause BSD", "BSD-3-Clause", "BSD-2-Clause", "BSD-style license"),
    "mpl-2.0": ("Mozilla Public License", "Mozilla Public Licence", "MPL-2.0", "MPL 2.0", "MPLv2"),
    "isc": ("ISC License", "ISC Licence", "License: ISC", "License-Identifier: ISC"),
    "cc0": ("CC0", "Creative Commons Zero", "CC0 1.0 Universal"),
    "cc-by": ("CC BY 4.0", "CC BY 3.0", "CC BY license", "Creative Commons Attribution 4.0", "Creative Commons Attribution 3.0", "Creative Commons Attribution License"),
    "cc-by-sa": ("CC BY-SA", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution Share Alike"),
    "cc-by-nc": ("CC BY-NC", "Creative Commons Attribution-NonCommercial", "Creative Commons Attribution Non Commercial"),
    "unlicense": ("Unlicense", "The Unlicense"),
    "proprietary": ("All rights reserved", "Proprietary and confidential", "Proprietary software"),
}
#: Ways to grant a licence by its name; the latter are for calibration.
GRANTS = (
    "This software is distributed under the {}.", "It is available under {} terms.", "The code is {}.", "SPDX-License-Identifier: {}", "License: {}",
    "You may use this work under the terms of the {}, see LICENSE.", "Copyright 2014 the contributors. Licensed: {}", "Published as open source, {}, since 2012.",
)
OTHER_GRANTS = ("The project is covered by the {}.", "Content is licensed {} unless noted otherwise.", "Dual use permitted, {} applies.")
#: Standard notices, by family. Fixed values.
NOTICES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        'you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. You should have received a copy of the GNU General Public License along with this program.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. You should have received a copy of the GNU Lesser General Public License along with this library.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",
    ),
    "cc-by": ("This work is made available under a Creative Commons Attribution 4.0 International License. You are free to share and adapt the material if you give appropriate credit.",),
    "cc-by-sa": ("This work is made available under a Creative Commons Attribution-ShareAlike 4.0 International License. If you remix the material you must distribute your contributions under the same license.",),
    "cc-by-nc": ("This work is made available under a Creative Commons Attribution-NonCommercial 4.0 International License. You may not use the material for commercial purposes.",),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "proprietary": (
        "Unauthorized copying of this file, via any medium, is strictly prohibited. This material is proprietary and confidential and may not be reproduced, distributed or disclosed without prior written consent of the owner.",
        "Copyright (c) 2019 Example Corporation and its affiliates. All rights reserved worldwide.",
        "Copyright by the publisher, 2003, all rights reserved, printed in Canada.",
        "No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
    ),
}
#: Sentences about licences that grant none.
NO_LICENCE = (
    "He lost his driving license on the way home.", "The license of the shop was renewed by the city in version 2 of the plan.",
    "Students of MIT released a report under the title of the year.", "A general public debate about the new version of the law.",
    "The Apache helicopter was released under the bridge.", "All rights and duties were reserved for the next meeting of members.",
    "We reserved a table under the name of the author.", "Permission to enter was granted free of charge to any person.",
    "The public domain name was registered.", "Creative common sense is what this work needs.", "The software is free and the library is open to the public.",
    "Which license should we choose for this work?", "The licensed driver is responsible.", "Version 2.0 of the program was released.",
)


# ---------------------------------------------------------------- words and windows


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_az(text), r"[^0-9a-z\x{80}-\x{10FFFF}]+"), lambda w: w != "")


def paragraphs_of(text: Column) -> Column:
    """The parts of a text between lines without a word; a line alone may be one, a wrapped notice is one."""
    return F.split(text, r"\n(?:[^0-9A-Za-z\x{80}-\x{10FFFF}\n]*\n)+", -1)


def has_words(text: Column) -> Column:
    return text.rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")


def pairs(words: Column) -> Column:
    rest = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.slice(F.zip_with(words, rest, lambda a, b: F.concat(a, F.lit(" "), b)), F.lit(1), F.size(rest))


def buckets(words: Column) -> tuple[Column, Column]:
    """The buckets of all words of an array, and of all words with the next, one fewer."""
    one = F.transform(words, lambda w: F.pmod(F.hash(w), F.lit(BUCKETS)))
    rest = F.slice(one, F.lit(2), F.greatest(F.size(one) - 1, F.lit(0)))
    two = F.zip_with(one, rest, lambda a, b: F.pmod(F.hash(a, b), F.lit(BUCKETS)))
    return one, F.slice(two, F.lit(1), F.size(rest))


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, text_hash, paragraph, start, words, features`` of each window; features are distinct buckets."""
    text = text_or_empty(F.col(text_col))
    each = docs.select(
        id_key(F.col(id_col)).alias("key"), F.xxhash64(text).alias("text_hash"), F.posexplode(paragraphs_of(text)).alias("paragraph", "one")
    ).select("key", "text_hash", "paragraph", words_of(F.col("one")).alias("all"))
    one, two = buckets(F.col("all"))
    each = each.filter(F.size("all") > 0).withColumns({"one": one, "two": two})
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (WINDOW - STEP), F.lit(1)), F.lit(STEP))
    window = lambda i: F.struct(
        i.alias("start"), F.slice("all", i, WINDOW).alias("words"),
        F.array_distinct(F.concat(F.slice("one", i, WINDOW), F.slice("two", i, WINDOW - 1))).alias("features"),
    )
    # made as one array, so that no window carries its whole paragraph
    return each.select("key", "text_hash", "paragraph", F.explode(F.transform(starts, window)).alias("w")).select("key", "text_hash", "paragraph", "w.*")


# ---------------------------------------------------------------- examples


def _cut(text: str) -> list[str]:
    return [w for w in "".join(c if c.isalnum() or ord(c) >= 128 else " " for c in text.lower()).split(" ") if w]


def examples(plain: list[str]) -> tuple[list[tuple[int, str]], list[tuple[int, str]]]:
    """Rows (class, text) to learn from and to calibrate by; class 0 has no licence.

    Families are told by grants of their names, by pieces of their notices, alone and among words of the
    corpus. Calibration has grants and names that aren't learnt from.
    """
    noise = [p.split(" ")[:20] for p in plain] or [["text"]]
    some = lambda i, n: " ".join(noise[i % len(noise)][:n])
    learn, apart = [], []
    for k, f in enumerate(NAMES, 1):
        names = NAMES[f]
        for j, name in enumerate(names):
            held = j % 3 == 2 and len(names) > 2
            for i, g in enumerate(OTHER_GRANTS if held else GRANTS):
                at = 31 * k + 7 * j + 3 * i
                (apart if held else learn).extend([(k, g.format(name)), (k, f"{some(at, 18)} {g.format(name)} {some(at + 1, 18)}")])
        for notice in NOTICES[f]:
            words = _cut(notice)
            for i in range(0, max(1, len(words) - PIECE // 2), PIECE // 2):
                piece = " ".join(words[i : i + 2 * PIECE])
                (apart if i % 3 == 2 else learn).extend([(k, piece), (k, f"{some(i + k, 10)} {piece} {some(i + k + 1, 10)}")])
    for i, p in enumerate(plain):
        (apart if i % 3 == 0 else learn).append((0, p))
    for i, p in enumerate(NO_LICENCE):
        (apart if i % 4 == 3 else learn).extend([(0, p), (0, f"{some(i, 12)} {p}")] * (1 if i % 4 == 3 else 3))
    return learn, apart


def rows_of(spark: SparkSession, rows: list[tuple[int, str]]) -> DataFrame:
    """A small table from one literal."""
    text = json.dumps([{"label": float(k), "text": t} for k, t in rows], ensure_ascii=False)
    each = F.from_json(F.lit(text), "array<struct<label: double, text: string>>")
    return spark.range(1, numPartitions=1).select(F.explode(each).alias("r")).select("r.*")


def named(names: list[tuple[str, ...]]) -> str:
    """A pattern for words, with a space at each end, that hold one of some names."""
    return " (?:" + "|".join(" ".join(_cut(n)) for group in names for n in group) + ") "


@dataclass
class Model:
    """Weights by family and bucket over the unknown class's; ``slope`` and ``shift`` calibrate a family's lead over it."""

    families: list[str]
    weights: list[list[float]]
    bias: list[float]
    slope: float = 1.0
    shift: float = 0.0

    def leads(self, features: Column) -> Column:
        """The logit of each family over the unknown class."""
        by_family = [literal(w) for w in self.weights]
        return F.array(*[total(features, w) + F.lit(b) for w, b in zip(by_family, self.bias, strict=True)])

    def bound(self, features: Column) -> Column:
        """No family's lead is above this: in each bucket the weight of the family that gains the most."""
        return total(features, literal([max(w) for w in zip(*self.weights, strict=True)])) + F.lit(max(self.bias))

    def probability(self, lead: Column) -> Column:
        return 1 / (1 + F.exp(-(lead * self.slope + self.shift)))

    def least_lead(self) -> float:
        """The lead from which on a probability is ``MIN_PROBABILITY``."""
        odds = math.log(MIN_PROBABILITY / (1 - MIN_PROBABILITY))
        return (odds - self.shift) / self.slope if self.slope > 0 else -math.inf


def literal(values: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def total(features: Column, weights: Column) -> Column:
    return F.aggregate(features, F.lit(0.0), lambda s, x: s + F.get(weights, x))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A multinomial logistic regression of hashed word n-grams (one and two words, present or not).

    It learns the families from ``examples``, and the unknown class from windows of a bounded sample of
    the corpus (those that name a licence left out) and from sentences about licences. A logistic
    regression of one variable, whether an example that was kept apart has a licence by its lead, calibrates.
    """
    spark = docs.sparkSession
    families = list(NAMES)
    share = int(min(1.0, SAMPLE_DOCS / max(1, docs.count())) * (1 << 30))
    some = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    some = some.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share).orderBy(F.xxhash64("text"), "text").limit(2 * SAMPLE_DOCS)
    plain = windows(some, "id", "text").select(F.array_join("words", " ").alias("t")).distinct()
    plain = plain.filter(~F.concat(F.lit(" "), "t", F.lit(" ")).rlike(named([*NAMES.values(), ("license", "licensed")])))
    plain = [r[0] for r in plain.orderBy(F.xxhash64("t"), "t").limit(SAMPLE_WINDOWS).collect()]
    learn, apart = examples(plain)
    one, two = buckets(words_of(F.col("text")))
    data = rows_of(spark, learn).select("label", F.array_distinct(F.concat(one, two)).cast("array<string>").alias("grams"))
    data = durable(data, "licence-examples").coalesce(1)
    vocabulary = CountVectorizerModel.from_vocabulary([str(i) for i in range(BUCKETS)], "grams", "vector")
    vocabulary.setBinary(True)
    fit = LogisticRegression(featuresCol="vector", labelCol="label", family="multinomial", regParam=PENALTY, elasticNetParam=0.9, maxIter=20, standardization=False)
    made = fit.fit(vocabulary.transform(data))
    coefficients, bias = made.coefficientMatrix, made.interceptVector
    width, values = coefficients.numCols, coefficients.toArray()
    weights = [[float(values[k + 1][i] - values[0][i]) for i in range(width)] for k in range(len(families))]
    model = Model(families, weights, [float(bias[k + 1] - bias[0]) for k in range(len(families))])
    held = rows_of(spark, apart).select("label", F.array_distinct(F.concat(one, two)).alias("features"))
    least = sum(k > 0 for k, _ in apart) / max(1, sum(k == 0 for k, _ in apart)) * ODDS
    held = held.select(
        (F.col("label") > 0).cast("double").alias("has"), F.array_max(model.leads(F.col("features"))).alias("lead"),
        F.when(F.col("label") > 0, 1.0).otherwise(least).alias("weight"),
    )
    line = LogisticRegression(featuresCol="x", labelCol="has", weightCol="weight", regParam=1e-3, maxIter=25)
    platt = line.fit(VectorAssembler(inputCols=["lead"], outputCol="x").transform(durable(held, "licence-apart")))
    model.slope, model.shift = float(platt.coefficients[0]), float(platt.intercept)
    return model


# ---------------------------------------------------------------- scans


def find_licenses(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, text_hash, paragraph, start, family, probability, likeness, confirmed``: findings of windows.

    Only windows in which some family's probability can reach ``MIN_PROBABILITY``, by a bound on the sums of its
    weights, are scored for each family; no other can be named. ``likeness`` is the largest share of the word
    pairs of a piece of the family's notices that the window has, 1 for one of its names. A family that
    reaches both limits is confirmed: that of the best score, and any other whose name stands there. A window without a
    confirmed family shows its best one, or ``unknown`` under ``MIN_PROBABILITY``. Paragraphs without words have no window.
    """
    near = windows(docs, id_col, text_col).filter(model.bound(F.col("features")) >= model.least_lead() - 1e-6)
    near = durable(near, "licence-windows")  # few
    leads = near.withColumns({"leads": model.leads(F.col("features")), "pairs": pairs(F.col("words")), "spaced": F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))})
    each = []
    for k, f in enumerate(model.families):
        pieces = [w[i : i + PIECE] for n in NOTICES[f] for w in [_cut(n)] for i in range(0, max(1, len(w) - PIECE // 2), PIECE)]
        shares = [F.size(F.array_intersect("pairs", F.lit(sorted({f"{a} {b}" for a, b in zip(p, p[1:])})))) / len(set(zip(p, p[1:]))) for p in pieces]
        name = F.col("spaced").rlike(named([NAMES[f]]))
        likeness = F.when(F.get("leads", F.lit(k)) < model.least_lead(), 0.0).when(name, 1.0).otherwise(F.greatest(*shares, F.lit(0.0)))
        each.append(F.struct(F.lit(f).alias("family"), F.get("leads", F.lit(k)).alias("lead"), name.alias("name"), likeness.alias("likeness")))
    scored = leads.withColumn("best", F.array_max("leads")).withColumn("each", F.filter(F.array(*each), lambda x: x["lead"] >= model.least_lead()))
    sure = F.filter("each", lambda x: (x["likeness"] >= MIN_LIKENESS) & (x["name"] | (x["lead"] == F.col("best"))))
    best = F.filter("each", lambda x: x["lead"] == F.col("best"))
    none = F.array(F.struct(F.lit(UNKNOWN).alias("family"), F.col("best").alias("lead"), F.lit(False).alias("name"), F.lit(0.0).alias("likeness")))
    found = F.when(F.size(sure) > 0, sure).when(F.size(best) > 0, F.slice(best, 1, 1)).otherwise(none)
    return scored.select("key", "text_hash", "paragraph", "start", F.explode(found).alias("f")).select(
        "key", "text_hash", "paragraph", "start", "f.family", model.probability(F.col("f.lead")).alias("probability"), "f.likeness",
        (F.col("f.likeness") >= MIN_LIKENESS).alias("confirmed"),
    )


def scan_licenses(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_paragraphs, n_licensed, families, probability``.

    ``n_paragraphs`` counts paragraphs with words, ``n_licensed`` those with a confirmed licence, ``families``
    are the confirmed ones, sorted; ``probability`` is the highest of any window that could be named, 0 without
    one. Null and empty texts have no paragraphs; rows of one id are judged each by its own text; an empty
    table gives none. Columns named as the new ones are replaced.
    """
    model = model or train(docs, id_col, text_col)
    names = {"n_paragraphs", "n_licensed", "families", "probability"}
    base = docs.drop(*[c for c in docs.columns if c.lower() in names])
    found = find_licenses(docs, model, id_col, text_col).groupBy(F.col("key").alias("_li_key"), F.col("text_hash").alias("_li_hash")).agg(
        F.collect_set(F.when(F.col("confirmed"), F.col("paragraph"))).alias("_li_paragraphs"),
        F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("_li_families"),
        F.max("probability").alias("_li_probability"),
    )
    text = text_or_empty(F.col(text_col))
    number = F.size(F.filter(paragraphs_of(text), has_words)).cast("long")
    marked = base.withColumns({"_li_key": id_key(F.col(id_col)), "_li_hash": F.xxhash64(text), "n_paragraphs": number})
    joined = marked.join(found, ["_li_key", "_li_hash"], "left")
    return joined.withColumns(
        {
            "n_licensed": F.coalesce(F.size("_li_paragraphs"), F.lit(0)).cast("long"),
            "families": F.coalesce("_li_families", F.array().cast("array<string>")),
            "probability": F.coalesce("_li_probability", F.lit(0.0)),
        }
    ).drop("_li_key", "_li_hash", "_li_paragraphs", "_li_families", "_li_probability")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_paragraphs", "n_licensed", F.array_join("families", ",").alias("families"), "probability")
