import random

import numpy as np

from tests.llm.data import docs
from tracespool.llm import latent, latentleaks

BENCH = "item_id long, text string, doc_id long"


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_lcs_against_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ([rng.randrange(1, 6) for _ in range(rng.randrange(1, 70))] for _ in range(2))
        assert latentleaks.lcs(latentleaks.places(a), len(a), b) == slow_lcs(a, b)


def test_basis_against_plain_svd(spark):
    rng = np.random.default_rng(3)
    matrix = rng.standard_normal((40, 6)) @ rng.standard_normal((6, 300)) * (rng.random((40, 300)) < 2)
    rows = [(list(range(300)), [float(x) for x in r]) for r in matrix]
    axes = latent.basis(spark.createDataFrame(rows, "ix array<int>, val array<float>").repartition(3), 300, 6)
    _, s, vt = np.linalg.svd(matrix, full_matrices=False)
    want = vt[:6].T / s[:6]
    assert axes.shape == (300, 6)
    assert np.allclose(np.abs((axes * s[:6]).T @ (want * s[:6])), np.eye(6), atol=1e-3)


def corpus(spark):
    """Clean texts and texts with a whole, a thinned, a reworded or half an item in their middle."""
    rng = random.Random(6)
    common = "the of and to in a is it for on".split()
    word = lambda: rng.choice(common) if rng.random() < 0.5 else f"w{rng.randrange(3000)}"
    prose = lambda n: [word() for _ in range(n)]
    items = [prose(rng.randrange(15, 60)) for _ in range(60)]
    texts, want = [], set()
    for i in range(400):
        host = prose(rng.randrange(0, 400))
        at = rng.randrange(len(host) + 1)
        item = items[i % 60]
        if i % 5 == 0:
            host[at:at] = item
        elif i % 5 == 1:
            host[at:at] = [w if rng.random() > 0.1 or k > len(item) - 6 else word() for k, w in enumerate(item)]
        elif i % 5 == 2:
            host[at:at] = item[:len(item) // 3]
        if i % 5 < 2:
            want.add((i, i % 60))
        texts.append((i, " ".join(host).capitalize() + ".", "en", "s", 1, 1, "w"))
    bench = [(i, " ".join(t), 1) for i, t in enumerate(items)] + [(90, "the of", 1), (91, None, 1), (92, "", 1), (None, "some text that has no name at all here", 1)]
    return docs(spark, texts), spark.createDataFrame(bench, BENCH), want


def test_planted_items_are_found_and_others_left(spark, monkeypatch):
    table, bench, want = corpus(spark)
    found = latentleaks.leaks(table, bench).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert len(want - got) <= 0.02 * len(want) and got <= want
    assert len({r.doc_id for r in latentleaks.remove(table, bench).collect()} & {d for d, _ in got}) == 0
    monkeypatch.setattr(latentleaks, "BLOCK_ITEMS", 9)
    assert {(r.doc_id, r.item_id) for r in latentleaks.leaks(table, bench).collect()} == got


def test_given_documents(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in latentleaks.leaks(table, bench).collect()}
    items = bench.collect()
    want = {(d.doc_id, b.item_id) for d in table.collect() for b in items if b.text in d.text}
    assert want <= got and len(got - want) <= 2


def test_awkward_and_empty(spark):
    table = docs(spark)
    _, bench, _ = corpus(spark)
    assert latentleaks.leaks(table, bench).count() == 0
    assert latentleaks.remove(table, bench).columns == table.columns and latentleaks.remove(table, bench).count() == table.count()
    none = spark.createDataFrame([], BENCH)
    assert latentleaks.leaks(table, none).count() == 0 and latentleaks.leaks(docs(spark, []), bench).count() == 0
    own = spark.createDataFrame([(7, table.where("doc_id = 5").first().text, 1)], BENCH)
    assert {r.doc_id for r in latentleaks.leaks(table, own).collect()} >= {5, 6, 8, 9}

def many_items(spark):
    """10,000 items of 40 words drawn by Zipf's law, and 400 texts that hold one item each, word for word."""
    rng = np.random.default_rng(9)
    share = 1 / np.arange(1, 30_001)
    word = lambda n: [f"w{x}" for x in rng.choice(30_000, n, p=share / share.sum())]
    items = [" ".join(word(40)) for _ in range(10_000)]
    texts = [(i, " ".join([*word(rng.integers(0, 100)), items[i * 25], *word(rng.integers(0, 100))]), "en", "s", 1, 1, "w") for i in range(400)]
    return docs(spark, texts), spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], BENCH), texts, items


def test_copies_are_found_among_many_items(spark):
    table, bench, texts, items = many_items(spark)
    want = {(d, i) for d, text, *_ in texts for i in [d * 25] if items[i] in text}
    got = {(r.doc_id, r.item_id) for r in latentleaks.leaks(table, bench).collect()}
    assert len(want) == 400 and len(want - got) == 0
