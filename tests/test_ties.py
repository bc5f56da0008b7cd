"""Values that meet a limit or each other exactly, against exact fractions."""
import random
from fractions import Fraction as Q
from functools import reduce
from operator import add
from statistics import median

import pytest

from tracespool.operators import detect, drift, edits, filters, legs
from tracespool.plans import layout


def smoothed(xs, width):
    n = len(xs)
    at = lambda i: 2 * xs[0] - xs[-i] if i < 0 else 2 * xs[-1] - xs[2 * (n - 1) - i] if i >= n else xs[i]
    return [sum((width - abs(k)) * at(i + k) for k in range(1 - width, width)) / Q(width ** 2) for i in range(n)]


def table(spark, traces, value, **more):
    rows = [(t, i, len(xs), i // layout.CHUNK_ROWS, float(x), *more.values()) for t, xs in traces.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, f"trace long, i long, n long, chunk long, {value} double" + "".join(f", {k} string" for k in more))


@pytest.fixture
def ramps():
    rng = random.Random(5)
    return {t: [Q(rng.randrange(1, 51)) for _ in range(80)] for t in range(200)}


def climbed(xs, base, low):
    """First sample that does not increase after the first steep rise above ``low``."""
    s = smoothed(xs, 3)
    n = len(s)
    g = [s[1] - s[0], *[(s[i + 1] - s[i - 1]) / 2 for i in range(1, n - 1)], s[-1] - s[-2]]
    some = g[3:base + 1]
    mean = sum(some) / len(some)
    limit = float(mean) + 3 * float(sum((v - mean) ** 2 for v in some) / len(some)) ** 0.5
    first = next((i for i in range(n) if float(g[i]) > limit and s[i] > low), None)
    return s, 0 if first is None else next(i for i in range(first, n) if i == n - 1 or s[i + 1] <= s[i])


def test_smoothed_whole_forces_are_exact(spark, ramps):
    got = {(r.trace, r.i): r.f for r in filters.boxcar_smooth(table(spark, ramps, "f"), ["f"], 3).collect()}
    assert got == {(t, i): float(v) for t, xs in ramps.items() for i, v in enumerate(smoothed(xs, 3))}


def test_smoothed_force_meets_the_maximum(spark, ramps):
    got = detect.tether_rupture(table(spark, ramps, "f", curve_type="R"), "f", 10, 20.0, 3, max_force=25.0).collect()
    want = {}
    for t, xs in ramps.items():
        s, at = climbed(xs, 10, 20)
        want[t] = next((i for i in range(at, len(s)) if s[i] <= 25), len(s) - 1)
    assert {r.trace: r.rupture_index for r in got} == want


def test_level_top_ends_the_climb(spark, ramps):
    got = detect.tether_rupture(table(spark, ramps, "f", curve_type="R"), "f", 10, 20.0, 3).collect()
    want = {t: max(range(climbed(xs, 10, 20)[1], len(xs)), key=lambda i: (xs[i], -i)) for t, xs in ramps.items()}
    assert {r.trace: r.rupture_index for r in got} == want


def test_slope_over_unit_steps_is_half_the_difference(spark, ramps):
    low = filters.boxcar_smooth(table(spark, ramps, "f"), ["f"], 3)
    got = {(r.trace, r.i): r.slope for r in filters.derivative(low, "f").where("i > 0 and i < n - 1").collect()}
    want = {(t, i): (float(s[i + 1]) - float(s[i - 1])) / 2 for t, xs in ramps.items() for s in [smoothed(xs, 3)] for i in range(1, len(s) - 1)}
    assert got == want


def test_velocity_on_the_screening_limit_is_judged_as_in_sql(spark):
    """Sums of whole weights, divided once: the same doubles as the SQL's, so that ties fall on the same side."""
    rng = random.Random(7)
    traces = {t: [rng.randrange(0, 400) / 100 for _ in range(40)] for t in range(400)}
    got = {r.trace: r.drift for r in drift.velocity_drift(table(spark, traces, "x"), "x", 5.0, 1.0, 3.0, 1).where("i = 5").collect()}
    for t, xs in traces.items():
        s = [reduce(add, [(5 - abs(k)) * xs[i + k] for k in range(-4, 5)]) / 25 for i in range(5, 35)]  # sum() would compensate
        v = [(b - a) * 5 for a, b in zip(s, s[1:])]
        mid = median(v)
        limit = 3 * median(abs(x - mid) for x in v)
        good = [-x for x in v if abs(x - mid) < limit]
        assert abs(got[t] - sum(good) / len(good)) < 1e-9, t


def test_no_size_at_a_negative_force(spark):
    falls = [(0, i, 40, 0, 0.5 + i / 100, (5.0 - i if i < 20 else -14.0 + (i - 20))) for i in range(40)]
    s = spark.createDataFrame(falls, "trace long, i long, n long, chunk long, d double, f double")
    tr = spark.createDataFrame([(0, 0, 15), (0, 1, 39)], "trace long, k long, at long")
    steps, _ = legs.transition_sizes(s, tr, "d", "f", 1, nfit=5, navg=2, avg_range=2.0, fit_range=4.0)
    row = steps.first()
    assert row.force < 0 and row.dext > 0 and row.dlc is None and row.source == "missing"


def test_pooled_mean_joins_a_neighbour_of_equal_level(spark):
    """0.1, 0.2 and 0.3 have the mean 0.2 but for the last bit."""
    xs = [0.2, 0.2, 0.3, 0.2, 0.1, 5.0]
    s = table(spark, {0: xs}, "x")
    dwells = [(0, 0, 2, 0.2, 0.0, 1.0), (1, 2, 3, 0.3, 2.0, 2.0), (2, 3, 4, 0.2, 3.0, 3.0), (3, 4, 5, 0.1, 4.0, 4.0), (4, 5, 6, 5.0, 5.0, 5.0)]
    dw = spark.createDataFrame([(0, *d) for d in dwells], "trace long, k long, start long, stop long, level double, t_start double, t_stop double")
    out = edits.replace_dwells(dw, s, "x", spark.createDataFrame([(0, 0, 2.0, 4.0)], "trace long, seq long, t1 double, t2 double"))
    assert [(r.k, r.start, r.stop, round(r.level, 9)) for r in out.orderBy("k").collect()] == [(0, 0, 5, 0.2), (1, 5, 6, 5.0)]
