"""Simple paths and detours against plain enumeration."""
import random

from tracespool.operators import paths


def walks(edges, origin, target):
    """All simple paths, depth first: later transitions ascending, then earlier ones descending."""
    nxt = {}
    for a, b in edges:
        nxt.setdefault(a, []).append(b)
    out, todo = [], [[origin]]
    while todo:
        path = todo.pop()
        if path[-1] == target:
            out.append(path)
            continue
        here = nxt.get(path[-1], [])
        turns = sorted(b for b in here if b > path[-1]) + sorted((b for b in here if b < path[-1]), reverse=True)
        todo += [[*path, b] for b in reversed(turns) if b not in path]
    return sorted(out, key=len)


def graphs(seed, both):
    rng = random.Random(seed)
    for t in range(40):
        n = rng.randrange(2, 9)
        yield t, n, [(a, b) for a in range(n) for b in range(n) if (b > a or both and b < a) and rng.random() < (0.35 if both else 0.5)]


def test_simple_paths_in_walking_order(spark):
    rows, ends, want = [], [], {}
    for both in (False, True):
        for t, n, edges in graphs(3, both):
            t = t + 100 * both
            rows += [(t, a, b) for a, b in edges]
            for a, b in {(0, n - 1), (n - 1, 0), (0, 0)}:
                ends.append((t, a, b))
                for r, p in enumerate(walks(edges, a, b) if a != b else []):
                    want[t, a, b, r] = p
    got = paths.simple_paths(spark.createDataFrame(rows, "trace long, origin long, target long"), spark.createDataFrame(ends, "trace long, origin long, target long"))
    assert {(r.trace, r.origin, r.target, r["rank"]): r.path for r in got.collect()} == want


def test_detours_follow_the_sequential_procedure(spark):
    rng = random.Random(8)
    rows, gaps, sizes, want = [], [], [], {}
    for t, n, edges in graphs(5, False):
        size = {(a, b): rng.random() if rng.random() < 0.7 else None for a in range(n) for b in range(a + 1, n)}
        rows += [(t, a, b) for a, b in edges]
        sizes += [(t, a, b, v) for (a, b), v in size.items()]
        for a in range(n - 1):
            if size[a, a + 1] is None:
                gaps.append((t, a, a + 1))
                found = sorted([p for c in range(a + 2, n) for p in walks(edges, a + 1, c)], key=len)
                for p in found:
                    steps = [size[x] for x in zip(p, p[1:])]
                    if walks(edges, a, p[-1]) and None not in steps and size[a, p[-1]] is not None:
                        want[t, a] = (p, size[a, p[-1]] - sum(steps))
                        break
    key = "trace long, origin long, target long"
    got = paths.shortest_detours(spark.createDataFrame(rows, key), spark.createDataFrame(gaps, key), spark.createDataFrame(sizes, key + ", dlc double"))
    got = {(r.trace, r.origin): (r.path, r.dlc) for r in got.collect()}
    assert got.keys() == want.keys() and len(got) > 3
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_no_transitions(spark):
    from tracespool.plans import layout
    s = layout.with_chunk(spark.createDataFrame([(1, i, 9, float(i)) for i in range(9)], "trace long, i long, n long, f double"))
    none = spark.createDataFrame([], "trace long, k long, at long")
    assert paths.valid_edges(s, none).count() == 0
    one = spark.createDataFrame([(1, 0, 4)], "trace long, k long, at long")
    assert paths.valid_edges(s, one).count() == 0
