"""Properties and planted truth that SQL on the given tables does not cover."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracespool.functions import physics, wlc
from tracespool.operators import align, detect, filters, polyfit, runs, stepfit, timejoin
from tracespool.operators.quantiles import exact_quantiles
from tracespool.operators.stats import by_bins, failures
from tracespool.plans import layout
from tracespool.sources import quality


def traces(spark, arrays):
    """Sample table from a dict trace -> values."""
    rows = [(t, i, len(v), float(x)) for t, v in arrays.items() for i, x in enumerate(v)]
    return layout.with_chunk(spark.createDataFrame(rows, "trace string, i bigint, n bigint, y double"))


def noise(size, seed):
    return np.random.default_rng(seed).normal(size=size)


@pytest.mark.parametrize("values", [noise(9000, 1), np.zeros(7000), np.round(noise(9000, 2)), np.r_[noise(5000, 3), [1e9] * 50]])
def test_quantiles_beyond_sketch_size(spark, values):
    df = spark.createDataFrame(pd.DataFrame({"k": 0, "v": values}))
    probs = [0.0, 0.25, 0.5, 0.995, 1.0]
    got = exact_quantiles(df, ["k"], "v", probs, by_bins(["k"]), accuracy=200).first()["q"]
    assert np.allclose(got, np.quantile(values, probs), rtol=0, atol=1e-12)


def test_model_inverse_is_the_inverse():
    model = ((50, 0.69, 1200), (0.65, 0.013))
    force = np.linspace(0.01, 60, 500)
    dist = sum(lc * wlc._eps(force, lp, rest[0] if rest else None)[0] for lp, lc, *rest in model)
    assert np.allclose(wlc.force_at(dist, model), force, atol=1e-7)
    assert wlc.force_at(np.array([-0.5]), model)[0] == 0.0
    assert np.isnan(wlc.force_at(np.array([np.nan]), model)[0])
    assert np.isnan(wlc.force_at(np.array([2.0]), ((50, 1.0),))[0])  # beyond an inextensible chain


def test_contour_length_needs_one_unknown_and_is_null_at_zero_force(spark):
    with pytest.raises(ValueError):
        wlc.contour_length(F.lit(1.0), F.lit(1.0), (50, None), (50, None))
    row = spark.range(1).select(wlc.contour_length(F.lit(0.3), F.lit(0.0), (50, None)).alias("lc")).first()
    assert row["lc"] is None


@pytest.mark.parametrize("local_rows", [None, 40])
def test_steps_recover_planted_levels(spark, tiny_chunks, local_rows):
    level = np.repeat([0.0, 5.0, 2.0, 9.0], [60, 45, 70, 50])
    s = traces(spark, {"a": level + 0.3 * noise(len(level), 5), "flat": 0.3 * noise(90, 6)})
    whole = s.groupBy("trace").agg(F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("start"), F.max("n").alias("stop"))
    got = stepfit.find_steps(s, "y", whole, 2.0, local_rows=local_rows).orderBy("trace", "start").collect()
    assert [(r.start, r.stop) for r in got if r.trace == "a"] == [(0, 60), (60, 105), (105, 175), (175, 225)]
    assert len([r for r in got if r.trace == "flat"]) == 1


def test_peak_thinning_equals_greedy_loop(spark, tiny_chunks):
    y = np.round(noise(400, 7) * 3)
    s = traces(spark, {"a": y, "ramp": np.arange(200) + 3 * noise(200, 8)})
    peaks = layout.settle(detect.local_maxima(s, "y"))
    want = set()
    for name, rows in peaks.toPandas().groupby("trace"):
        kept = []
        for _, p in rows.sort_values(["height", "at"], ascending=False).iterrows():
            if all(abs(p["at"] - q) >= 6 for q in kept):
                kept.append(p["at"])
        want |= {(name, int(q)) for q in kept}
    for limit in (None, 5):
        got = {(r["trace"], r["at"]) for r in detect.thin_peaks(peaks, 6, local_rows=limit).collect()}
        assert got == want


def test_flat_top_counts_once_in_the_middle(spark):
    s = traces(spark, {"a": [0, 1, 3, 3, 3, 1, 2, 0, 5]})
    assert [(r["at"], r["height"]) for r in detect.local_maxima(s, "y").orderBy("at").collect()] == [(3, 3.0), (6, 2.0)]


def reference_low_pass(x, b, a, pad):
    """Forward-backward filter by plain recursion on the extended signal."""
    ext = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-2 - pad:-1]]

    def run(v):
        past_x, past_y, out = [v[0]] * (len(b) - 1), [v[0]] * (len(a) - 1), []
        for value in v:
            y = b[0] * value + np.dot(b[1:], past_x) - np.dot(a[1:], past_y)
            past_x, past_y = [value] + past_x[:-1], [y] + past_y[:-1]
            out.append(y)
        return np.array(out)

    return run(run(ext)[::-1])[::-1][pad:-pad]


@pytest.mark.parametrize("kind,order", [("bessel", 4), ("butter", 4), ("bessel", 3)])
def test_low_pass_across_chunks(spark, tiny_chunks, kind, order):
    x = np.cumsum(noise(300, 9))
    got = filters.zero_phase_lowpass(traces(spark, {"a": x}), ["y"], 3, kind, order, decimate=False).orderBy("i").toPandas()["y"]
    b, a = filters.lowpass_design(kind, order, 0.8 / 3)
    pad = 3 * (2 * ((order + 1) // 2) + 1 - order % 2)
    assert np.allclose(got, reference_low_pass(x, b, a, pad), atol=1e-8)


def test_low_pass_designs():
    for kind in ("bessel", "butter"):
        b, a = filters.lowpass_design(kind, 4, 0.2)
        assert np.isclose(b.sum() / a.sum(), 1.0)
    z = np.exp(1j * np.pi * 0.2)
    b, a = filters.lowpass_design("butter", 4, 0.2)
    assert np.isclose(abs(np.polyval(b, z) / np.polyval(a, z)), np.sqrt(0.5))


def test_high_degree_fit_stays_stable(spark):
    x = np.linspace(0, 50000, 900)
    y = np.sin(x / 4000) + 1e-3 * noise(900, 10)
    s = traces(spark, {"a": y}).withColumn("x", F.col("i") * (50000 / 899))
    got = polyfit.predict(s, polyfit.fit(s, "x", "y", 31), "x", 31).orderBy("i").toPandas()["predicted"]
    want = np.polynomial.Legendre.fit(x, y, 31)(x)
    assert np.allclose(got, want, atol=1e-8)


def test_small_steps_merge_like_the_loop(spark, tiny_chunks):
    rng = np.random.default_rng(11)
    arrays = {f"t{k}": rng.integers(0, 12, 120).astype(float) for k in range(8)}
    got = runs.absorb_small(runs.dwells(traces(spark, arrays), "y"), 3.0).orderBy("trace", "k").collect()
    for name, v in arrays.items():
        kept, out = v[0], []
        for x in v:
            if abs(x - kept) >= 3.0:
                kept = x
            out.append(kept)
        mine = np.concatenate([[r.level] * (r.stop - r.start) for r in got if r.trace == name])
        assert np.array_equal(mine, out)


def test_intervals_and_complement_cover_the_trace(spark, tiny_chunks):
    s = traces(spark, {"a": noise(200, 12), "none": -np.ones(50), "all": np.ones(50)})
    on = runs.labelled(s, F.col("y") > 0)
    off = runs.complement(on, s.groupBy("trace").agg(F.max("n").alias("n")))
    length = on.unionByName(off, allowMissingColumns=True).groupBy("trace").agg(F.sum(F.col("stop") - F.col("start")).alias("m"))
    assert {r.trace: r.m for r in length.collect()} == {"a": 200, "none": 50, "all": 50}


def test_alignment_follows_a_shift_and_reports_empty_boxes(spark):
    f = np.linspace(1, 30, 200)
    d = 0.69 * wlc._eps(f, 50, 1200)[0]
    rows = [(t, i, 200, float(d[i] + o), float(f[i])) for t, o in (("a", 0.02), ("b", -0.05), ("far", 50.0)) for i in range(200)]
    s = layout.with_chunk(spark.createDataFrame(rows, "trace string, i bigint, n bigint, d double, f double"))
    off = {r.trace: r for r in align.align(s, ((0.1, 0.9), (5, 25)), model=((50, 0.69, 1200),)).collect()}
    assert abs(off["a"].doff + 0.02) < 1e-6 and abs(off["b"].doff - 0.05) < 1e-6
    assert off["a"].aligned and not off["far"].aligned and off["far"].doff == 0.0


def test_nearest_tie_takes_the_earlier_row(spark):
    src = spark.createDataFrame([("a", 0.0, 0), ("a", 2.0, 1)], "trace string, t double, j int")
    ask = spark.createDataFrame([("a", 1.0), ("a", 1.1), ("a", -9.0), ("a", 99.0)], "trace string, t double")
    got = {r.t: r.j for r in timejoin.nearest(ask, src, "t", ["j"]).collect()}
    assert got == {1.0: 0, 1.1: 1, -9.0: 0, 99.0: 1}


def test_off_grid_time_raises(spark):
    src = spark.createDataFrame([("a", 0.0, 0), ("a", 1.0, 1)], "trace string, t double, j int")
    ask = spark.createDataFrame([("a", 0.4)], "trace string, t double")
    with pytest.raises(Exception, match="off the source grid"):
        timejoin.exact_subset(ask, src, "t", ["j"], 1.0).collect()


def test_all_failed_rules_are_listed(spark):
    row = spark.range(1).select(failures({6: F.lit(False), 7: F.lit(True), 9: F.lit(None).cast("boolean")}).alias("c")).first()
    assert row["c"] == [6, 9]


def test_broken_positions_are_found(spark):
    df = spark.createDataFrame([("ok", 0), ("ok", 1), ("gap", 0), ("gap", 2), ("dup", 0), ("dup", 0)], "trace string, i bigint")
    assert {r.trace for r in quality.trace_violations(df).collect()} == {"gap", "dup"}


def test_decimation_factor():
    assert physics.decimation_factor(78125, 3125) == 25
    assert physics.decimation_factor(1000, 300) == 3
    with pytest.raises(ValueError):
        physics.decimation_factor(1000, 300, exact=True)


def test_short_traces_give_no_decimated_rows(spark):
    assert filters.boxcar_decimate(traces(spark, {"a": [1.0] * 15, "b": [2.0]}), ["y"], 5).count() == 0
    assert filters.boxcar_decimate(traces(spark, {"a": [1.0] * 16}), ["y"], 5).count() == 2
