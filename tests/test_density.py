"""Density clustering and its knee against plain numpy."""
import numpy as np
import pytest

from tracespool.operators import density


def plain(x, eps, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    near = d <= eps
    core = near.sum(axis=1) >= k
    label = np.full(len(x), -1)
    count = 0
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo, label[i] = [i], count
            while todo:
                for j in np.flatnonzero(near[todo.pop()]):
                    if label[j] < 0:
                        label[j] = count
                        if core[j]:
                            todo.append(j)
            count += 1
    return label, np.sort(d, axis=1)[:, k - 1] if len(x) >= k else None


def plain_knee(y):
    """The rule as published, read from the upper end of the sorted curve."""
    n = len(y)
    h = np.flip(1 - (y - y.min()) / (y.max() - y.min())) - np.arange(n) / (n - 1)
    ext = np.concatenate([[h[0]], h, [h[-1]]])
    top, bottom = (h >= ext[:-2]) & (h >= ext[2:]), (h <= ext[:-2]) & (h <= ext[2:])
    limit = at = None
    for p in range(n - 1):
        if top[p]:
            limit, at = h[p] - 1 / (n - 1), p
        if at is None:
            continue
        if bottom[p]:
            limit = 0.0
        if h[p + 1] < limit:
            return n - 1 - at
    return int(np.argmax(np.gradient(np.gradient(y))))


def table(spark, x):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, " + ", ".join(f"e{k} double" for k in range(x.shape[1])))


def clouds(seed, n, dims):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(c, s, (n // 4, dims)) for c, s in ((0, 0.3), (4, 0.5), (-5, 0.1))]
    return np.concatenate([*parts, rng.uniform(-8, 8, (n // 8, dims)), np.full((n // 8, dims), 1.25)])[rng.permutation(3 * (n // 4) + 2 * (n // 8))]


@pytest.mark.parametrize(("seed", "n", "dims", "eps", "k"), [(1, 400, 2, 0.3, 4), (4, 160, 4, 1.5, 3)])
def test_equals_brute_force(spark, seed, n, dims, eps, k):
    x = clouds(seed, n, dims)
    want, distances = plain(x, eps, k)
    cols = [f"e{j}" for j in range(dims)]
    got = {r["id"]: r["label"] for r in density.dbscan(table(spark, x), cols, eps, k).collect()}
    assert [got[i] for i in range(len(x))] == want.tolist()
    near = {r["id"]: r["distance"] for r in density.k_distances(table(spark, x), cols, k).collect()}
    assert np.allclose([near[i] for i in range(len(x))], distances, rtol=1e-12)


def test_crowded_neighbouring_cells(spark):
    # a lattice on which distances equal the radius, with many copies of some points
    g = np.array([(a, b) for a in range(12) for b in range(12)], float) * 0.5
    x = np.concatenate([g, np.repeat(g[:3], 200, axis=0), g + 100.0])
    for eps in (0.5, 0.7071):
        got = density.dbscan(table(spark, x), ["e0", "e1"], eps, 3).collect()
        assert [r["label"] for r in sorted(got, key=lambda r: r["id"])] == plain(x, eps, 3)[0].tolist()


def test_radius_at_the_knee(spark, tiny_chunks):
    x = clouds(7, 320, 2)
    y = np.sort(plain(x, 1, 3)[1])
    out, eps = density.cluster(table(spark, x), ["e0", "e1"], None, 3)
    assert abs(eps - y[plain_knee(y)]) < 1e-12
    assert [r["label"] for r in sorted(out.collect(), key=lambda r: r["id"])] == plain(x, eps, 3)[0].tolist()


def test_knee_of_plain_curves(spark, tiny_chunks):
    rng = np.random.default_rng(3)
    for y in (np.arange(50.0), np.sort(rng.pareto(1.2, 150)), np.array([0, 0, 0, 0, 5.0])):
        got = density.knee(spark.createDataFrame([(float(v),) for v in y], "distance double"))
        assert got == (plain_knee(y), y[plain_knee(y)])


def test_few_and_missing_points(spark):
    rows = [(0, 1.0), (1, None), (2, float("nan")), (3, 1.0), (4, float("inf"))]
    t = spark.createDataFrame(rows, "id long, e0 double")
    assert {r["id"]: r["label"] for r in density.dbscan(t, ["e0"], 0.1, 2).collect()} == {0: 0, 1: None, 2: None, 3: 0, 4: None}
    assert density.cluster(t, ["e0"], None, 3)[1] is None
    assert density.knee(spark.createDataFrame([(2.0,)] * 4, "distance double")) == (0, 2.0)
    assert density.dbscan(t.limit(0), ["e0"], 0.1).count() == 0
