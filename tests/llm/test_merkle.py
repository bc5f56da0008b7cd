import random
import zlib
from hashlib import sha256

import pytest

from tests.llm.data import docs
from tracespool.llm import merkle


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def up(level):
    """All levels of a tree, and the siblings of each leaf as (left, right) pairs."""
    levels = [level]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([H(*now[i:i + 2]) for i in range(0, len(now), 2)])
    paths = []
    for i in range(len(level)):
        path = []
        for now in levels[:-1]:
            run = now[i // 2 * 2:i // 2 * 2 + 2]
            path.append(("".join(run[:i % 2]), "".join(run[i % 2 + 1:])))
            i //= 2
        paths.append(path)
    return levels[-1][0], paths


def slow(rows):
    leaf = lambda r, n: H(*map(enc, (r[0], r[3], r[2], n, r[1])))
    groups = {}
    for r in rows:
        groups.setdefault(None if r[2] is None else r[2].encode(), []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    langs = sorted(groups, key=lambda k: (k is not None, k or b""))
    trees = [up([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in langs] if langs else []
    root, tops = up([t[0] for t in trees]) if trees else ("", [])
    out = []
    for k, (sub, paths), top in zip(langs, trees, tops):
        for (_, _, h, r), path in zip(sorted(groups[k], key=lambda x: x[:3]), paths):
            now = h
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                now = leaf(r, r[4] + 1)
            for left, right in path + top:
                now = H(left, now, right)
            out.append((r[0], h, sub, root, H(*[a + b for a, b in path + top]), now, now == root))
    return sorted(out, key=str)


def many(n, langs):
    rng = random.Random(n)
    return [(i * 3 - 20, f"text {i} é\n", rng.choice(langs), rng.choice(["web", None, ""]), i % 50 or None, i, "w") for i in range(n)]


CASES = {
    "empty": [],
    "one": [(7, None, None, None, None, 0, "")],
    "long tree and many groups": many(150, ["en"]) + many(90, [None, "", "de", "é", "z", "aa", "a", "￿", "\U0001F600"]),
    "ties, repeats and null ids": [(1, "a", "en", "x", 1, 0, ""), (1, "b", "en", "x", 1, 0, ""), (1, "a", "en", "x", 1, 0, ""), (None, "a", "en", "x", 1, 0, ""),
                                   (None, "a", "en", "x", 1, 0, ""), (None, None, "en", "x", 2**63 - 1, 0, ""), (28, "w" * 300000, None, "x", 2**63 - 1, 0, "")],
}


@pytest.mark.parametrize("case", CASES)
def test_equals_plain_tree(spark, case):
    rows = CASES[case]
    table = docs(spark, rows).withColumnsRenamed({"hash": "h", "word": "node"})
    got = merkle.manifest(table.repartition(3), bits=3, slot_rows=40).collect()
    assert sorted([tuple(r) for r in got], key=str) == slow(rows)


def test_awkward_rows(spark):
    table = docs(spark)
    got = merkle.manifest(table).collect()
    assert sorted([tuple(r) for r in got], key=str) == slow([tuple(r) for r in table.collect()])


def test_a_block_holds_no_more_than_its_size(spark):
    nodes = spark.range(1000).selectExpr("'g' key", "id pos", "1000L n", "sha2(string(id), 256) h", "id load")
    tiers = merkle.climb(nodes, 3)
    assert [t.count() for t in tiers] == [125, 16, 2, 1]
    assert tiers[0].selectExpr("max(size(node.kids))").first()[0] == 2
