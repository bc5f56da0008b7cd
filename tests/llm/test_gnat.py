import math
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracespool.llm import gnat

SCHEMA = "vec_id long, embedding array<float>, label int, v string, key int, part int"


def plain(entries, queries):
    sq = ((queries[:, None, :] - entries[None]) ** 2).sum(axis=2)
    return sq.argmin(axis=1), sq.min(axis=1)


@settings(deadline=None, max_examples=150)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(0, 9), st.sampled_from([1, 2, 50, 10**7]))
def test_tree_finds_the_nearest_with_the_lower_index(seed, n, width, spread):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-spread, spread + 1, (n, width))
    queries = np.concatenate([rng.integers(-spread, spread + 1, (60, width)), entries, (entries + entries[::-1]) // 2])
    index, sq, measured = gnat.nearest(gnat.build(entries), entries, queries)
    want_index, want_sq = plain(entries, queries)
    assert (index == want_index).all() and (sq == want_sq).all() and measured <= n * len(queries)


def test_subtrees_are_eliminated():
    rng = np.random.default_rng(1)
    centres = rng.integers(-10**6, 10**6, (4, 8))
    entries = (centres[:, None] + rng.integers(-50, 50, (4, 4, 8))).reshape(-1, 8)
    queries = np.repeat(entries, 20, axis=0) + rng.integers(-50, 50, (320, 8))
    assert gnat.nearest(gnat.build(entries), entries, queries)[2] < 0.75 * len(entries) * len(queries)


def test_ties_at_rounding_distance_stay():
    big = 2**26
    entries = np.array([[big, 0], [0, big], [-big, 0], [0, -big], [big - 1, 0], [1 - big, 0]])
    queries = np.array([[0, 0], [1, 1], [-1, 1], [3, -3]])
    index, sq, _ = gnat.nearest(gnat.build(entries), entries, queries)
    assert (index == plain(entries, queries)[0]).all() and (sq == plain(entries, queries)[1]).all()


def slow(rows):
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max([len(r[1]) for r in good], default=0) // 8) * 8
    hold = lambda x: max(-gnat.LARGEST, min(gnat.LARGEST, math.floor(4096 * float(np.float32(x)))))
    kept = [(r[0], r[2], [hold(x) for x in r[1]] + [0] * (width - len(r[1])), [hold(x) for x in r[1]]) for r in good]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    step = width // 8
    parts = lambda v, p: np.array(v[p * step:(p + 1) * step], dtype=object)
    books = [[parts(r[2], p) for r in kept[:16]] for p in range(8)]

    def assign(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(parts(v, p), c)), e) for e, c in enumerate(books[p]))
    for _ in range(6):
        near = [[assign(r[2], p)[1] for r in kept] for p in range(8)]
        for p in range(8):
            for e in range(len(books[p])):
                mine = [parts(r[2], p) for r, x in zip(kept, near[p]) if x == e]
                if mine:
                    books[p][e] = sum(mine) // len(mine)
    digest = sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    last = [[assign(r[2], p) for p in range(8)] for r in kept]
    error = [sum(d for d, _ in x) for x in last]
    by = {}
    for r, e in zip(kept, error):
        by[r[1]] = by.get(r[1], 0) + e
    return sorted([(r[0], "".join(f"{e:02x}" for _, e in x), s, by[r[1]], digest) for r, x, s in zip(kept, last, error)], key=str)


def some(n, width, seed=3):
    rng = np.random.default_rng(seed)
    return [(int(i), rng.choice([-1.0, -0.5, 0.0, 0.25, 1e-4, 3.0], width).tolist(), int(i) % 3 if i % 4 else None) for i in rng.permutation(n)]


CASES = {
    "empty": [], "nothing kept": [(1, None, 1), (2, [1.0, None], 1)],
    "ties and copies": some(60, 16) + some(30, 16) + [(None, [0.5] * 16, None), (None, [-0.5] * 16, None)],
    "fewer rows than entries": some(5, 8),
    "broken rows": some(40, 8) + [(99, None, 1), (-5, [float("nan")] * 8, 1), (-4, [1.0] * 7 + [float("-inf")], 1), (-3, [None] * 8, 1), (-2, [3e38] * 8, 1)],
    "lengths": some(20, 3) + some(20, 10, 4) + [(0, [], 2)],
    "no components": [(1, [], 1), (2, [], None)],
}


@pytest.mark.parametrize("case", CASES)
def test_equals_plain_rounds(spark, case):
    rows = CASES[case]
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    assert sorted([tuple(r) for r in gnat.report(table).collect()], key=str) == slow(rows)
