"""Licence scan with a trained paragraph classifier, in DataFrame functions only.

Texts are cut into lines and lines into sentences (*passages*).  Every passage is described by
its distinct word 1- to 3-grams, hashed to ``FEATURES`` features; a multinomial logistic regression, fitted here by
gradient descent written as joins and sums, gives each licence family and the class ``unknown`` a probability.  The
temperature of the probabilities is calibrated on passages that were kept from training.  A family is predicted if it
is likelier than every other class, and confirmed if the passage holds ``CONFIRM`` of the n-grams of one of its templates.

Training rows: the templates below with and without some words, ``unknown`` passages written here, and one passage from
each of at most ``SAMPLE`` documents without anchors, chosen by hashed id.  All training tables are bounded by that.

Every passage is judged.  A family can only win if some weights speak for it against ``unknown``: passages whose features, each at
its best for any family, do not add up to more than that are unknown for certain, and the probabilities of all others are
worked out.  Anchor words only keep licence passages out of the training rows for ``unknown``.  Null texts hold nothing; equal passages at the same place of rows with the same doc_id are reported once.
"""
from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracespool.plans.layout import settle

FEATURES = 1 << 13
SAMPLE = 512
ROUNDS = 8  #: of gradient descent; each reads the weights twice, so each writes them
STEP, SHRINK = 12.0, 0.002
TEMPERATURES = [0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
CONFIRM = 0.5
ROUNDING = 1e-9
UNKNOWN = "unknown"
#: Fragments of words of which every licence notice holds at least one.
ANCHORS = ["licen", "copyright", "rights reserved", "public domain", "redistribut", "permission", "warrant", "creative commons", "cc0", "cc by", "cc-by", "spdx"]
#: Short public notices of each family.
TEMPLATES = {
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "This program is free software under the terms of the GNU Affero General Public License.",
             "SPDX-License-Identifier: AGPL-3.0-only"],
    "all-rights-reserved": ["All rights reserved.", "Copyright, all rights reserved.", "No part of this publication may be reproduced without the prior written permission of the publisher."],
    "apache": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
               "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Released under the BSD License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
            "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
                 "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
                 "Text is available under the Creative Commons Attribution-ShareAlike License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 2 or later.",
            "You should have received a copy of the GNU General Public License along with this program.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software under the terms of the GNU Lesser General Public License.",
             "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
            "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.",
            "SPDX-License-Identifier: MPL-2.0"],
    "public-domain": ["This work is dedicated to the public domain.", "Released into the public domain.", "To the extent possible under law, the author has waived all copyright under CC0 1.0.",
                      "SPDX-License-Identifier: CC0-1.0"],
}
#: Passages that speak of licences without granting one.
OTHERS = [
    "You need a driving license to rent a car here.", "The licence fee was raised again this year.", "Copyright law is taught in the second term.",
    "She asked for permission to leave the room.", "The warranty covers repairs for two years.", "Please renew your fishing license before spring.",
    "A new license plate was fixed to the car.", "The committee discussed redistribution of income.", "Every license costs forty dollars a month.",
    "He lost his license after the accident.", "The public domain of debate has changed.", "Licensed premises must close at eleven.",
]


def passages(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns with paragraph, sentence (numbers from 0) and passage of each non-blank sentence."""
    lines = docs.select(*keep, F.posexplode(F.split("text", "\n")).alias("paragraph", "line"))
    cut = lines.select(*keep, "paragraph", F.posexplode(F.split("line", r"(?<=[.!?])\s+")).alias("sentence", "passage"))
    return cut.where(F.length(F.trim("passage")) > 0)


def anchored(text: Column) -> Column:
    low = F.lower(text)
    return reduce(Column.__or__, [F.contains(low, F.lit(a)) for a in ANCHORS])


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(words: Column) -> Column:
    """Hashed distinct 1- to 3-grams."""
    def tail(n: int) -> Column:
        return F.slice(words, n, F.greatest(F.size(words) - (n - 1), F.lit(0)))
    two = F.filter(F.zip_with(words, tail(2), lambda a, b: F.concat(a, F.lit(" "), b)), lambda g: g.isNotNull())
    three = F.filter(F.zip_with(two, tail(3), lambda a, b: F.concat(a, F.lit(" "), b)), lambda g: g.isNotNull())
    return F.array_distinct(F.transform(F.concat(words, two, three), lambda g: F.pmod(F.xxhash64(g), F.lit(FEATURES)).cast("int")))


def with_features(rows: DataFrame, *keep: str) -> DataFrame:
    """One row per feature of each passage; every passage has feature -1 as its bias.  value: rows have length 1."""
    some = rows.select(*keep, grams(words(F.col("passage"))).alias("g"))
    return some.select(*keep, F.explode(F.array_append("g", F.lit(-1))).alias("feature"), (1 / F.sqrt(F.size("g") + 1.0)).alias("value"))


def _every_fifth(k: int):
    """Leaves out the words at k, k + 5, ..."""
    return lambda _, i: (i % 5) != k


def training(docs: DataFrame) -> DataFrame:
    """row, family, passage, kept_out: templates, their thinned forms, and unknown passages."""
    spark = docs.sparkSession
    known = [(f, t) for f, some in TEMPLATES.items() for t in some] + [(UNKNOWN, t) for t in OTHERS]
    table = spark.sql("select * from values " + ", ".join(f"('{f}', '{t}')" for f, t in known) + " as t(family, passage)")
    thin = [F.col("passage")] + [F.array_join(F.filter(words(F.col("passage")), _every_fifth(k)), " ") for k in range(5)]
    forms = table.select("family", F.posexplode(F.array(*thin)).alias("form", "passage"))
    forms = forms.select("family", "passage", F.col("form").isin(2, 4).alias("kept_out"))
    plain = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    picks = settle(plain.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)).alias("bucket")).agg(F.min_by("doc_id", F.xxhash64("doc_id", F.lit(7))).alias("doc_id"))
                   .select("doc_id"))
    texts = plain.join(F.broadcast(picks), "doc_id").where(~anchored(F.col("text"))).groupBy("doc_id").agg(F.min(F.substring("text", 1, 400)).alias("text"))
    first = passages(texts, "doc_id").where("paragraph = 0 and sentence = 0")
    unknown = first.select(F.lit(UNKNOWN).alias("family"), "passage", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0).alias("kept_out"))
    rows = forms.union(unknown).repartition(1)  # bounded by the templates and SAMPLE
    return settle(rows.withColumn("row", F.monotonically_increasing_id()))


def families() -> list[str]:
    return [*sorted(TEMPLATES), UNKNOWN]


def with_chances(df: DataFrame, temperature: float | Column = 1.0) -> DataFrame:
    """Replace the scores s0, s1, ... by the array ``p`` of their probabilities."""
    scores = [f"s{k}" for k in range(len(families()))]
    out = df.withColumn("p", F.array(*scores)).drop(*scores)
    out = out.withColumn("p", F.transform("p", lambda x: F.exp((x - F.array_max("p")) / temperature)))
    return out.withColumn("p", F.transform("p", lambda x: x / F.aggregate("p", F.lit(0.0), lambda a, b: a + b)))


def scored(features: DataFrame, weights: DataFrame, *keys: str) -> DataFrame:
    """Sum of value times weight for each class, in columns s0, s1, ..."""
    n = len(families())
    return features.join(weights, "feature").groupBy(*keys).agg(*[F.sum(F.col("value") * F.col(f"w{k}")).alias(f"s{k}") for k in range(n)])


def fit(docs: DataFrame) -> tuple[DataFrame, float]:
    """(weights by feature, temperature)."""
    names = families()
    rows = training(docs)
    n = len(names)
    features = settle(with_features(rows.where(~F.col("kept_out")), "row", "family").repartition(1))
    weight = rows.where(~F.col("kept_out")).groupBy("family").agg((1.0 / F.count(F.lit(1))).alias("share"))
    truth = settle(features.select("row", "family").distinct().join(weight, "family").repartition(1))
    weights = settle(features.select("feature").distinct().select("feature", *[F.lit(0.0).alias(f"w{k}") for k in range(n)]).repartition(1))
    for _ in range(ROUNDS):
        p = with_chances(scored(features, weights, "row").join(truth, "row"))
        miss = p.select("row", *[(F.col("share") * (F.col("p")[k] - (F.col("family") == name).cast("double"))).alias(f"e{k}")
                                 for k, name in enumerate(names)])
        slope = features.select("row", "feature", "value").join(miss, "row").groupBy("feature").agg(
            *[F.sum(F.col("value") * F.col(f"e{k}")).alias(f"d{k}") for k in range(n)])
        weights = settle(weights.join(slope, "feature").select("feature", *[
            (F.col(f"w{k}") * (1 - STEP * SHRINK) - STEP * F.col(f"d{k}")).alias(f"w{k}") for k in range(n)]).repartition(1))
    held = scored(with_features(rows.where("kept_out"), "row", "family"), weights, "row", "family")
    held = held.withColumn("temperature", F.explode(F.array(*map(F.lit, TEMPERATURES))))
    right = F.element_at("p", F.array_position(F.array(*map(F.lit, names)), F.col("family")).cast("int"))
    loss = with_chances(held, F.col("temperature")).groupBy("temperature").agg(F.avg(-F.log(F.greatest(right, F.lit(1e-12)))).alias("loss"))
    best = loss.orderBy("loss", "temperature").first()
    return weights, best.temperature


def templates(spark: SparkSession) -> DataFrame:
    """template, family, size and feature of every n-gram of every template."""
    rows = [(f, t) for f, some in TEMPLATES.items() for t in some]
    table = spark.sql("select * from values " + ", ".join(f"({i}, '{f}', '{t}')" for i, (f, t) in enumerate(rows)) + " as t(template, family, passage)")
    g = table.select("template", "family", grams(words(F.col("passage"))).alias("g"))
    return g.select("template", "family", F.size("g").alias("size"), F.explode("g").alias("feature"))


def may_win(passage: Column, weights: DataFrame) -> Column:
    """False where no family can be likelier than ``unknown``: the sum of each feature's greatest lead over it is below zero."""
    last = len(families()) - 1
    lead = F.greatest(*[F.col(f"w{k}") for k in range(last)]) - F.col(f"w{last}")
    leads = {r.feature: r.lead for r in weights.select("feature", lead.alias("lead")).collect()}  # at most FEATURES + 1
    table = F.from_json(F.lit(json.dumps([leads.get(k, 0.0) for k in range(FEATURES)])), "array<double>")
    total = F.aggregate(grams(words(passage)), F.lit(leads.get(-1, 0.0)), lambda s, g: s + F.get(table, g))
    return total > -ROUNDING


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph, sentence, family, probability, similarity and confirmed of every passage predicted to be a licence."""
    names = families()
    weights, temperature = fit(docs)
    found = passages(docs, "doc_id").where(may_win(F.col("passage"), weights))
    key = ["doc_id", "paragraph", "sentence", "passage_hash"]
    found = found.withColumn("passage_hash", F.xxhash64("passage")).dropDuplicates(key)
    features = settle(with_features(found, *key))
    p = with_chances(scored(features, weights, *key), temperature)
    best = F.array_max(F.zip_with("p", F.array(*map(F.lit, names)), lambda q, name: F.struct(q.alias("probability"), name.alias("family"))))
    said = p.select(*key, best.alias("best")).select(*key, "best.*").where(F.col("family") != UNKNOWN)
    shared = (features.join(F.broadcast(templates(docs.sparkSession)), "feature")  # a fixed table
              .groupBy(*key, "template", "family").agg((F.count(F.lit(1)) / F.first("size")).alias("share"))
              .groupBy(*key, "family").agg(F.max("share").alias("similarity")))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*key, "family")]
    out = said.alias("a").join(shared.alias("b"), same, "left").select("a.*", F.coalesce("b.similarity", F.lit(0.0)).alias("similarity"))
    return out.select("doc_id", "paragraph", "sentence", "family", "probability", "similarity", (F.col("similarity") >= CONFIRM).alias("confirmed"))
