import math
import re

from tests.llm.data import docs
from tracespool.llm import licenses

NOTICES = {"mit": "This package is released under the MIT License.", "apache": "Code is licensed under the Apache License Version 2.0.",
           "gpl": "This file is licensed under the GNU General Public License version 3.", "cc-by-nc": "Images are licensed under CC BY-NC 4.0.",
           "cc-by-sa": "Our text is available under the Creative Commons Attribution-ShareAlike License", "all-rights-reserved": "(c) 2020 Someone. All rights reserved.",
           "mpl": "SPDX-License-Identifier: MPL-2.0", "public-domain": "All photos were released into the public domain."}
PLAIN = ["My fishing license is old.", "Copyright lawyers met in Geneva.", "They gave permission to build a bridge over the river near the town.", "licence", ""]


def table(spark):
    rows = [(i, f"Some first line.\n{t} Other words follow here.\nlast line", "en", "s", 1, 1, "w") for i, t in enumerate([*NOTICES.values(), *PLAIN])]
    filler = [(100 + i, f"Plain text number {i} about rivers and stones. It goes on.", "en", "s", 1, 1, "w") for i in range(60)]
    awkward = docs(spark)
    return docs(spark, rows + filler).union(awkward.withColumn("doc_id", awkward.doc_id + 1000))


def test_families_and_brute_force(spark):
    some = table(spark)
    got = licenses.scan(some).collect()
    sure = {r.doc_id: r.family for r in got if r.confirmed}
    assert sure == dict(enumerate(NOTICES))
    # the same scores from the fitted weights, feature by feature
    weights, temperature = licenses.fit(some)
    by_feature = {r.feature: [r[f"w{k}"] for k in range(len(licenses.families()))] for r in weights.collect()}
    cut = licenses.passages(some, "doc_id").select("doc_id", "paragraph", "sentence", "passage", licenses.grams(licenses.words("passage")).alias("g"))
    for r in cut.where("doc_id < 13").collect():
        features = [*r.g, -1]
        sums = [sum(by_feature.get(f, [0] * 14)[k] for f in features) / math.sqrt(len(features)) / temperature for k in range(14)]
        chance = [math.exp(s - max(sums)) for s in sums]
        best = max(range(14), key=lambda k: chance[k])
        hit = [x for x in got if (x.doc_id, x.paragraph, x.sentence) == (r.doc_id, r.paragraph, r.sentence)]
        anchor = any(a in r.passage.lower() for a in licenses.ANCHORS)
        assert bool(hit) == (anchor and licenses.families()[best] != licenses.UNKNOWN)
        for x in hit:
            assert x.family == licenses.families()[best] and abs(x.probability - max(chance) / sum(chance)) < 1e-6


def test_grams_and_templates(spark):
    row = spark.createDataFrame([("The the MIT-License, v2!",)], "t string").select(licenses.words("t").alias("w"), licenses.grams(licenses.words("t")).alias("g")).first()
    assert row.w == ["the", "the", "mit", "license", "v2"] and len(row.g) == 4 + 4 + 3
    assert all(any(a in t.lower() for a in licenses.ANCHORS) for some in licenses.TEMPLATES.values() for t in some)
    assert not any(re.search("'", t) for some in licenses.TEMPLATES.values() for t in some)


def test_native_and_empty(spark):
    out = licenses.scan(table(spark))
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert licenses.scan(docs(spark, [])).count() == 0


def test_passages_without_an_anchor_are_judged(spark):
    bare = "This Source Code Form is subject to the terms of the Mozilla Public, v. 2.0."
    assert not any(a in bare.lower() for a in licenses.ANCHORS)
    filler = [(100 + i, f"Plain text number {i} about rivers and stones. It goes on.", "en", "s", 1, 1, "w") for i in range(60)]
    got = licenses.scan(docs(spark, [(1, f"First line.\n{bare}", "en", "s", 1, 1, "w"), *filler])).collect()
    assert "mpl" in {r.family for r in got if (r.doc_id, r.paragraph) == (1, 1)}, got
