"""One small case for each finding on larger tables or odd inputs."""
from functools import reduce
from operator import add
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracespool.functions import wlc
from tracespool.operators import curves, drift, filters, legs
from tracespool.plans import layout


def table(spark, traces, value):
    rows = [(t, i, len(xs), i // layout.CHUNK_ROWS, float(x)) for t, xs in traces.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, f"trace long, i long, n long, chunk long, {value} double")


def test_short_traces_have_a_velocity_drift(spark):
    """Two widths and two samples give a velocity, as in the SQL."""
    traces = {n: [(7 * i * i + 3 * n * i) % 41 / 10 for i in range(n)] for n in range(8, 18)}
    out = drift.velocity_drift(table(spark, traces, "x"), "x", 5.0, 1.0, 3.0, 1).where("i = 5").collect()
    want = {}
    for n, xs in traces.items():
        s = [reduce(add, [(5 - abs(k)) * xs[i + k] for k in range(-4, 5)]) / 25 for i in range(5, n - 5)]
        v = [(b - a) * 5 for a, b in zip(s, s[1:])]
        mid = median(v) if v else 0
        limit = 3 * median(abs(x - mid) for x in v) if v else 0
        good = [-x for x in v if abs(x - mid) < limit]
        if good:
            want[n] = sum(good) / len(good)
    got = {r.trace: r.drift for r in out}
    assert min(want) < 16 and got.keys() == want.keys()
    assert all(abs(got[n] - want[n]) < 1e-9 for n in want)


@pytest.mark.parametrize("model", [((50, 1.2),), ((50, 0.69, 1200), (0.65, 0.5))])
def test_work_makes_no_row_per_grid_point(spark, model):
    rows = [(t, i, 30, 0, 0.1 * t + 0.02 * i, 3.0 + i) for t in range(3) for i in range(30)] + [(9, 0, 1, 0, 0.4, 2.0)]
    out = legs.transition_work(spark.createDataFrame(rows, "trace long, i long, n long, chunk long, d double, f double"), "d", "f", model, 501)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in out.collect():
        x = np.linspace(0.1 * r.trace, 0.1 * r.trace + 0.58, 501) if r.trace < 9 else np.full(501, 0.4)
        y = wlc.force_at(x, model)
        assert abs(r.model_area - float(((y[1:] + y[:-1]) / 2 * np.diff(x)).sum())) < 1e-6


def test_unwrapping_roots_on_a_grid_too_fine_to_write_out(spark):
    """900 million grid points a row: only stretches that run one way are searched."""
    rows = [(k, 2.0 * k - 10, 5.0 + k, 3.0 + k / 2) for k in range(12)]
    df = spark.createDataFrame(rows, "trace long, dx double, f double, f2 double")
    got = curves.unwrapping_roots(df, "dx", "f", "f2", 690.0, 50.0, 4.76, 0.0, 90.0, 1e-7).toPandas()
    x = np.linspace(0, 90, 90001)
    rate = (1.65 * 2 * np.pi) / 145 / (2 * 0.34)
    for k, dx, f1, f2 in rows:
        e1, e2 = (wlc._eps(np.array([f]), 50.0, None)[0][0] for f in (f1, f2))
        y = e2 * x + 690.0 * (e2 - e1) + 9.52 * np.cos(rate * x) - 9.52 - dx
        at = np.flatnonzero(y[:-1] * y[1:] < 0)
        roots = x[at] - y[at] * 0.001 / (y[at + 1] - y[at])
        mine = np.sort(got[got.trace == k].dlc.to_numpy())
        assert len(mine) == len(roots) and np.allclose(mine, roots, atol=1e-4), k
    assert len(got) >= 3


def test_a_window_is_sorted_once_for_its_median_and_once_for_its_deviation(spark):
    xs = [(7 * i * i) % 31 / 10 for i in range(40)]
    df = table(spark, {0: xs}, "x")
    out = filters.running_mad(df, "x", 21)
    for some in (out, filters.hampel(df, "x", 5)):
        assert some._jdf.queryExecution().optimizedPlan().toString().count("array_sort(") <= 6
    for r in out.collect():
        w = np.array(xs[max(0, r.i - 10):r.i + 11])
        assert abs(r.mad - np.median(abs(w - np.median(w)))) < 1e-12


def test_grids_are_judged_by_their_rows_before_the_first_is_written(spark):
    own = spark.newSession()
    assert float(own.conf.get("spark.sql.sources.fileCompressionFactor")) == 1.0
    rows = [(0, i, 5, 0, 1.0 + i, 2.0) for i in range(5)]
    grid = own.createDataFrame(rows, "trace long, i long, n long, chunk long, force double, loading_rate double")
    curves.rupture_distribution(grid, F.lit(0.1))
    assert float(own.conf.get("spark.sql.sources.fileCompressionFactor")) == layout.UNPACKED


def test_shuffles_start_from_many_partitions_unless_the_user_sets_them(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    for given, want in ((None, str(layout.PIECES)), ("7", "7")):
        own = spark.newSession()
        own.conf.unset(key)
        if given:
            own.conf.set(key, given)
        layout.slotted(own.range(10).selectExpr("id div 5 as trace", "id as t"), ["trace"], ["t"])
        assert own.conf.get(key) == want
