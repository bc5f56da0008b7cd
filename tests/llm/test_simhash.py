import random
import re

import xxhash

from tests.llm.data import docs
from tracespool.llm import simhash


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    """rows: (doc_id, fingerprint); every pair is compared."""
    label = {d: d for d, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, x in rows:
            for b, y in rows:
                if (x ^ y).bit_count() <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_fingerprints_and_groups(spark):
    table = docs(spark)
    got = simhash.group(table).collect()
    want = {r.doc_id: slow_print(r.text) for r in table.collect()}
    assert len(got) == table.count()
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == want
    assert {r.doc_id: r.component_id for r in got} == slow_components(sorted(want.items()))


def test_links_against_all_pairs(spark):
    """Chains, dense clusters and single values; shards cut into many trees give the same components."""
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(4):
        chain = [rng.getrandbits(64)]
        for _ in range(25):
            flips = rng.sample(range(64), rng.choice([1, 3, 4, 5]))
            chain.append(chain[-1] ^ sum(1 << f for f in flips))
        values += chain
    centre = rng.getrandbits(64)
    values += [centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    values = sorted(set(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    label = slow_components(list(zip(signed, values, strict=True)))
    want = {}
    for v, c in label.items():
        want.setdefault(c, set()).add(v)
    for shard_rows in (8192, 5):
        got = {}
        found = {r.node: r.component for r in simhash.components(simhash.links(prints, shard_rows)).collect()}
        for v in signed:
            got.setdefault(found.get(v, v), set()).add(v)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_keep_one_and_empty(spark):
    table = docs(spark)
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {0, 5}.issubset(ids) and not {1, 2, 6} & ids
    empty = docs(spark, [])
    assert simhash.group(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    assert simhash.keep_one(docs(spark, [(None, "a", None, None, None, 1, "w")])).count() == 1
