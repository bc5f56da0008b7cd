"""Fits and sequential detectors against brute force and planted truth, on both size paths."""
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_properties import noise, traces
from tracespool.functions import wlc
from tracespool.functions.kinetics import KB
from tracespool.operators import align, cluster, curves, huberpoly, legs, modelfit, pauses, robust, runs, rupturefit, spectrum
from tracespool.plans import layout, pipelines


def merged_by_loop(y, spans, tol):
    out = []
    for a, b in spans:
        if out and abs(np.median(y[a:b]) - out[-1][2]) <= tol:
            out[-1] = (out[-1][0], b, np.median(y[out[-1][0]:b]))
        else:
            out.append((a, b, np.median(y[a:b])))
    return [(a, b) for a, b, _ in out]


@pytest.mark.parametrize("limit", [None, 10])
def test_pause_fragments_merge_like_the_loop(spark, tiny_chunks, limit):
    y = np.repeat([0.0, 3.0, 3.2, 8.0], 25) + 0.4 * noise(100, 21)
    spans = [(2, 9), (12, 20), (27, 33), (36, 44), (52, 60), (80, 90)]
    s = traces(spark, {"a": y})
    found = spark.createDataFrame([("a", k, a, b) for k, (a, b) in enumerate(spans)], "trace string, k bigint, start bigint, stop bigint")
    got = pauses.merge_fragments(s, "y", found, 1.0, limit).orderBy("k").collect()
    assert [(r.start, r.stop) for r in got] == merged_by_loop(y, spans, 1.0)


def test_pauses_split_where_the_level_jumps(spark, tiny_chunks):
    y = np.repeat([0.0, 5.0], 60) + 0.1 * noise(120, 22)
    s = traces(spark, {"a": y})
    found = spark.createDataFrame([("a", 0, 0, 120)], "trace string, k bigint, start bigint, stop bigint")
    got = pauses.split_jumps(s, "y", found, 1.0, 5).orderBy("k").collect()
    bad = {i for i in range(5, 115) if abs(np.median(y[i:i + 5]) - np.median(y[i - 5:i])) > 1.0}
    assert {i for r in got for i in range(r.start, r.stop)} == set(range(120)) - bad


@pytest.mark.parametrize("limit", [None, 50])
def test_huber_line_ignores_outliers(spark, tiny_chunks, limit):
    x = np.linspace(0, 10, 200)
    y = 2.0 * x + 1.0 + 0.05 * noise(200, 23)
    y[::17] += 40
    s = traces(spark, {"a": y, "few": np.arange(5.0)}).withColumn("x", F.col("i") * (10 / 199))
    got = {r.trace: r for r in robust.huber_line(s, "x", "y", local_rows=limit).collect()}
    m, b = robust._line(x, y, 1.345, 50, 1e-8)
    assert abs(m - 2) < 0.02 and np.allclose([got["a"].slope, got["a"].intercept], [m, b], atol=1e-6)
    assert got["few"].slope is None


def test_rupture_likelihood_recovers_planted_rates(spark):
    k0, xd, speed, model = 0.02, 1.1, 0.2, ((50.0, 0.69, 1200.0),)
    grid = np.linspace(1e-3, 40, 8000)
    rows = []
    rng = np.random.default_rng(24)
    for keq in (150.0, 220.0):
        slope = 0.69 * wlc._eps(grid, 50, 1200)[1]
        hazard = k0 * np.exp(grid * xd / (KB * 298.15)) * (1 / keq + slope) / speed
        cdf = 1 - np.exp(-np.concatenate([[0], np.cumsum((hazard[1:] + hazard[:-1]) / 2 * np.diff(grid))]))
        rows += [("c", float(f), keq) for f in np.interp(rng.random(400), cdf, grid)]
    df = spark.createDataFrame(rows, "condition string, force double, keq double")
    fit = rupturefit.fit_rupture_forces(df, speed, model, grid_points=4000).first()
    assert abs(fit["x_dagger"] - xd) < 3 * fit["se_x_dagger"] and abs(math.log(fit["k0"] / k0)) < 3 * fit["se_ln_k0"]
    assert 0 < fit["se_x_dagger"] < 0.2


def test_kmeans_finds_the_planted_number_of_clusters(spark):
    rng = np.random.default_rng(25)
    pts = np.concatenate([rng.normal(c, 0.05, (60, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    df = spark.createDataFrame(pd.DataFrame(pts, columns=["a", "b"]))
    out, k, inertia = cluster.kmeans(df, ["a", "b"], k_max=5, tries=2)
    assert k == 3 and out.select("cluster").distinct().count() == 3
    assert inertia[1] == pytest.approx(((pts - pts.mean(0)) ** 2).sum())


def test_inverse_samples_follow_the_density(spark, tiny_chunks):
    x = np.linspace(0, 1, 101)
    grid = layout.with_chunk(spark.createDataFrame([("a", i, 101, float(v), float(2 * v)) for i, v in enumerate(x)],
                                                   "trace string, i bigint, n bigint, x double, p double"))
    got = curves.inverse_sample(grid, "x", "p", 2000, 3).toPandas()["value"]
    assert abs(got.mean() - 2 / 3) < 0.02 and got.between(0, 1).all()
    assert np.array_equal(np.sort(got), np.sort(curves.inverse_sample(grid, "x", "p", 2000, 3).toPandas()["value"]))


def test_short_trace_spectrum_uses_its_own_length(spark):
    y = np.sin(2 * np.pi * np.arange(20) / 5)
    got = spectrum.welch(traces(spark, {"a": y}), "y", 10.0, 64).toPandas().sort_values("power").iloc[-1]
    assert got["frequency"] == pytest.approx(2.0)


def test_unwrapping_roots_solve_the_equation(spark):
    rows = spark.createDataFrame([("a", 12.0, 8.0, 7.0)], "trace string, dx double, f1 double, f2 double")
    got = [r["dlc"] for r in curves.unwrapping_roots(rows, "dx", "f1", "f2", 690.0, 50.0, 4.76, 0.0, 90.0, 0.25).collect()]
    e1, e2 = (wlc._eps(np.array([f]), 50, None)[0][0] for f in (8.0, 7.0))
    turn = (1.65 * 2 * np.pi) / 145
    assert got
    for x in got:
        assert abs(e2 * x + 690 * (e2 - e1) + 2 * 4.76 * np.cos(turn / 0.68 * x) - 2 * 4.76 - 12.0) < 1e-8


def pull_with_steps():
    """Force ramp on a chain that lengthens twice, at 10 and 18 pN."""
    d, f, at = [], [], []
    for lc, lo, hi in ((0.69, 1, 10), (0.72, 8, 18), (0.80, 15, 25)):
        force = np.linspace(lo, hi, 400)
        d += list(lc * wlc._eps(force, 50, 1200)[0])
        f += list(force)
        at.append(len(f) - 1)
    return np.array(d), np.array(f), at


def test_transition_sizes_recover_planted_lengths(spark, tiny_chunks):
    d, f, at = pull_with_steps()
    s = traces(spark, {"a": f}).withColumnRenamed("y", "f")
    s = s.join(spark.createDataFrame([(i, float(v)) for i, v in enumerate(d)], "i bigint, d double"), "i")
    tr = spark.createDataFrame([("a", k, v) for k, v in enumerate(at)], "trace string, k bigint, at bigint")
    steps, whole = legs.transition_sizes(s, tr, lp=50, st=1200, nfit=20)
    got = {r.k: r for r in steps.collect()}
    assert abs(got[0].dlc - 0.03) < 2e-3 and abs(got[1].dlc - 0.08) < 2e-3
    # the last leg never comes back to the first transition's force, so there is no direct total
    assert whole.first()["total_dlc"] is None


def test_set_is_moved_by_its_first_and_second_ramp(spark):
    f = np.linspace(1, 30, 150)
    d = 0.69 * wlc._eps(f, 50, 1200)[0]
    moved = {"fecS00": 0.03, "fecS01": 0.03, "dct01": 0.03, "fecS02": 0.05, "fecS03": 0.05}
    rows = [(f"m_{r}", i, 150, "m", r, float(d[i] + o), float(f[i])) for r, o in moved.items() for i in range(150)]
    s = layout.with_chunk(spark.createDataFrame(rows, "trace string, i bigint, n bigint, base string, run string, d double, f double"))
    states = spark.createDataFrame([("m", "fecS01", 0.69, 149), ("m", "fecS02", 0.69, 149)],
                                   "base string, run string, state double, first_transition bigint")
    off = align.realign_beginning(s, states, ((50, 0.69, 1200),), ((0.1, 0.9), (5, 25)), ((0.1, 0.68), (5, 25)))
    got = {r.trace[2:]: r.doff for r in off.collect()}
    assert all(abs(got[r] + o) < 2e-3 for r, o in moved.items())


def test_monotonic_pieces_follow_the_loop(spark, tiny_chunks):
    y = np.round(noise(150, 26) * 2)
    s = traces(spark, {"a": y})
    whole = spark.createDataFrame([("a", 0, 0, 150)], "trace string, k bigint, start bigint, stop bigint")
    for sign in (1, -1):
        cuts = [0, *[i + 1 for i in np.flatnonzero(np.diff(y) * sign < 0)], 150]
        want = [(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if len(set(y[a:b])) > 1]
        got = [(r.start, r.stop) for r in runs.monotonic(s, "y", whole, sign).orderBy("k").collect()]
        assert got == want


@pytest.mark.parametrize("invert", [True, False])
def test_model_fit_recovers_parameters(spark, invert):
    f = np.linspace(1, 30, 150)
    rows = []
    for name, lc, off in (("a", 0.69, 0.4), ("b", 0.75, -0.3)):
        d = lc * wlc._eps(f, 45, 1200)[0]
        rows += [(name, i, 150, float(d[i]), float(f[i] + off)) for i in range(150)]
    s = layout.with_chunk(spark.createDataFrame(rows, "trace string, i bigint, n bigint, d double, f double"))
    got = {r.trace: r for r in modelfit.fit_model(s, ((50.0, 0.7, 1200.0),), [[False, False, True]], force_offset=True, invert=invert).collect()}
    for name, lc, off in (("a", 0.69, 0.4), ("b", 0.75, -0.3)):
        assert got[name].components[0][1] == pytest.approx(lc, abs=1e-4) and got[name].components[0][0] == pytest.approx(45, abs=0.5)
        assert got[name].force_offset == pytest.approx(off, abs=0.02) and got[name].points == 150


def test_shared_fit_and_fitted_contour_length(spark):
    f = np.linspace(1, 30, 120)
    d = 0.69 * wlc._eps(f, 50, 1200)[0]
    rows = [(t, "set", i, 120, float(d[i]), float(f[i] + 0.2)) for t in ("a", "b") for i in range(120)]
    s = layout.with_chunk(spark.createDataFrame(rows, "trace string, base string, i bigint, n bigint, d double, f double"))
    fits = modelfit.fit_model(s, ((50.0, 0.72, 1200.0),), [[True, False, True]], key="base", force_offset=True).collect()
    assert len(fits) == 1 and fits[0].components[0][1] == pytest.approx(0.69, abs=1e-5) and fits[0].points == 240
    lc = modelfit.fitted_contour_length(s, ((50.0, 0.72, 1200.0),)).toPandas()["lc"]
    assert np.allclose(lc, 0.69, atol=1e-4)


def test_model_fit_rejects_bad_bounds(spark):
    s = traces(spark, {"a": [1.0, 2.0]}).withColumn("d", F.col("y")).withColumn("f", F.col("y"))
    with pytest.raises(ValueError):
        modelfit.fit_model(s, ((50.0, 0.7),), bounds=(((60, 100), (0.1, 1.0)),))


def huber_plain(x, y, degree, epsilon=1.35, ridge=1e-4, rounds=4000):
    """Alternating reweighted steps, which always lower the loss."""
    a = np.vander(x, degree + 1)
    w = np.linalg.lstsq(a, y, rcond=None)[0]
    scale = np.sqrt(np.mean((y - a @ w) ** 2))
    pen = np.diag([ridge] * degree + [0.0])
    for _ in range(rounds):
        r = np.abs(y - a @ w)
        scale = np.sqrt(np.minimum(r**2, (epsilon * scale) ** 2).mean())
        k = 1 / np.maximum(r / (epsilon * scale), 1)
        w = np.linalg.solve(a.T @ (k[:, None] * a) + scale * pen, a.T @ (k * y))
    return w, scale


def test_huber_polynomial_reaches_the_joint_minimum(spark, tiny_chunks):
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for t, (n, degree) in enumerate([(150, 2), (90, 2), (60, 2), (200, 2)]):
        x = rng.uniform(0.2, 3, n)
        y = 1 - 2 * x + 0.7 * x**2 + rng.normal(0, 0.1, n) + (rng.random(n) < 0.1 * t) * rng.pareto(1.5, n) * 5
        want[t] = huber_plain(x, y, degree)
        rows += [(t, i, n, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    rows += [(7, i, 12, float(i), 3.0 + i) for i in range(12)] + [(8, i, 9, 1.0, float(i)) for i in range(9)]
    rows += [(7, 12, 12, None, 1.0), (7, 13, 12, 1.0, float("nan"))]
    s = layout.with_chunk(spark.createDataFrame(rows, "trace bigint, i bigint, n bigint, x double, y double"))
    got = {r.trace: r for r in huberpoly.huber_polynomial(s, "x", "y", 2).collect()}
    for t, (w, scale) in want.items():
        assert got[t].converged and np.allclose(got[t].coeffs, w, rtol=1e-6, atol=1e-7) and abs(got[t].scale - scale) < 1e-7 * scale
    assert np.allclose(got[7].coeffs, [0, 1, 3], atol=1e-9) and got[7].scale == 0 and got[7].points == 12
    assert got[8].coeffs is None and not got[8].converged


def test_one_trace_per_error_code(spark, tiny_chunks):
    rng = np.random.default_rng(4)
    n = 400
    trap = np.linspace(0, 1, n)
    table = lambda ids, cols, fn: layout.with_chunk(spark.createDataFrame(
        [(t, i, n, *map(float, fn(t, i))) for t in ids for i in range(n)], f"trace string, i bigint, n bigint, {cols}"))
    ramp = table(["good", "lost", "blurred"], "trap double, f1 double, f2 double", lambda t, i: (trap[i], 0.1 * trap[i] - 4 * trap[i] ** 3, 5 * trap[i] ** 3)).withColumn(
        "baseline", F.when(F.col("trace") == "lost", "nowhere").otherwise(F.concat(F.lit("b_"), "trace")))
    short = layout.with_chunk(spark.createDataFrame([("short", i, 2, 0.1 * i, 0.0, 0.0, "b_good") for i in range(2)], "trace string, i bigint, n bigint, trap double, f1 double, f2 double, baseline string"))
    base = table(["b_good", "b_blurred"], "trap double, f1 double, f2 double", lambda t, i: (trap[i], 0.1 * trap[i], 0.0))
    cal = spark.createDataFrame([(b, c, 0.2) for b in ("b_good", "b_blurred") for c in ("trap1", "trap2")], "baseline string, trap string, kappa double")
    noise_ = rng.normal(0, 1, n)
    cam = table(["b_good", "b_blurred"], "trap double, bead1 double, bead2 double", lambda t, i: (trap[i], 8 + 1.25 * trap[i] + noise_[i] * (t == "b_blurred"), 2.0))
    ramps = ramp.unionByName(short)
    ranges = base.groupBy(F.col("trace").alias("baseline")).agg(F.min("trap").alias("lo"), F.max("trap").alias("hi"))
    models = pipelines.camera_models(cam, ranges, (2.0, 2.0))
    m = {r.baseline: r for r in models.collect()}
    assert abs(m["b_good"].coeffs[1] - 1.25) < 1e-9 and abs(m["b_good"].intercept - 4) < 1e-9 and m["b_blurred"].r2 < 0.99
    plain = pipelines.preprocess(ramps, base, cal, 4, 100.0, 1)
    rows = layout.settle(pipelines.calibrated_by_camera(plain, models, offset=True))
    wanted = ramps.select("trace").distinct().unionByName(spark.createDataFrame([("gone",)], "trace string"))
    got = {r.trace: r.error_code for r in pipelines.error_codes(wanted, ramps, rows).collect()}
    assert got == {"good": 0, "lost": 1, "gone": 2, "blurred": 3, "short": 5}
    for r in rows.join(plain.select("trace", "i", F.col("trap").alias("t0"), F.col("d").alias("d0")), ["trace", "i"]).collect():
        if r.trace == "good":
            assert abs(r.cal_trap - (4 + 1.25 * r.t0)) < 1e-9 and abs(r.trap - r.t0 - 4) < 1e-9 and abs(r.d - r.d0 - 4) < 1e-9
            assert abs(r.cal_d - (r.cal_trap - r.bead_diff / 1000)) < 1e-9
        else:
            assert r.cal_trap is None and r.trap == r.t0
