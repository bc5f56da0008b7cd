"""One answer for every size: missing values, constants and short traces on either side of the local limit, bounded slots."""
import math
import random

import pytest
from pyspark.sql import functions as F

from tracespool.operators import detect, filters, pauses, robust, stepfit
from tracespool.plans import layout

SAMPLES = "trace string, i long, n long, chunk long, y double"


def table(spark, traces):
    rows = [(t, i, len(ys), i // layout.CHUNK_ROWS, y) for t, ys in traces.items() for i, y in enumerate(ys)]
    return spark.createDataFrame(rows, SAMPLES)


def stairs(seed, missing=()):
    rng = random.Random(seed)
    out = [float(level) + rng.gauss(0, 0.1) for level in (1, 5, 2, 8) for _ in range(60)]
    for k in missing:
        out[k] = rng.choice([None, float("nan")])
    return out


@pytest.fixture
def traces():
    return {"plain": stairs(1), "gaps": stairs(2, [0, 1, 30, 59, 60, 61, 200, 239]), "flat": [3.0] * 50, "one": [1.0], "none": [None, float("nan"), None]}


def rounded(rows, *cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in rows)


def test_steps_do_not_depend_on_the_limit(spark, tiny_chunks, traces):
    samples = table(spark, traces)
    segments = samples.groupBy("trace").agg(F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("start"), F.max("n").alias("stop"))
    cols = ("trace", "segment", "start", "stop", "level")
    small, large = (rounded(stepfit.find_steps(samples, "y", segments, local_rows=limit).collect(), *cols) for limit in (1 << 20, 2))
    assert small == large
    starts = [r[2] for r in small if r[0] == "gaps"]
    assert all(any(abs(s - at) <= 2 for s in starts) for at in (0, 60, 120, 180))
    assert not [r for r in small if r[0] == "none"]


def test_merged_pauses_do_not_depend_on_the_limit(spark, tiny_chunks, traces):
    samples = table(spark, {t: y for t, y in traces.items() if t in ("plain", "gaps")})
    found = spark.createDataFrame([(t, k, a, b) for t in ("plain", "gaps") for k, (a, b) in enumerate([(5, 25), (32, 55), (65, 100), (125, 170)])],
                                  "trace string, k long, start long, stop long")
    small, large = (rounded(pauses.merge_fragments(samples, "y", found, 0.5, limit).collect(), "trace", "k", "start", "stop") for limit in (1 << 20, 2))
    assert small == large == [(t, k, a, b) for t in ("gaps", "plain") for k, (a, b) in enumerate([(5, 55), (65, 100), (125, 170)])]


def test_lines_do_not_depend_on_the_limit(spark, tiny_chunks):
    rng = random.Random(3)
    rows = []
    for t in ("line", "flat", "short", "gaps"):
        for i in range(60 if t != "short" else 5):
            x = 1.0 if t == "flat" else i + rng.random()
            y = 2 * x + rng.gauss(0, 0.1)
            rows.append((t, i, 60, i // layout.CHUNK_ROWS, float("nan") if t == "gaps" and i % 7 == 0 else x, None if t == "gaps" and i % 5 == 0 else y))
    samples = spark.createDataFrame(rows, "trace string, i long, n long, chunk long, x double, y double")
    out = [{r.trace: r for r in robust.huber_line(samples, "x", "y", local_rows=limit).collect()} for limit in (1 << 20, 2)]
    for a, b in zip(out[0].values(), (out[1][t] for t in out[0]), strict=True):
        assert a.points == b.points and (a.slope is None) == (b.slope is None) == (a.trace in ("flat", "short"))
        assert a.slope is None or (math.isclose(a.slope, b.slope, rel_tol=1e-6) and math.isclose(a.intercept, b.intercept, rel_tol=1e-4, abs_tol=1e-5))


def test_peaks_do_not_depend_on_the_limit(spark, tiny_chunks):
    rng = random.Random(5)
    rows = [("a", i * 2, rng.choice([1.0, 2.0, 3.0, None, float("nan")])) for i in range(120)]
    peaks = spark.createDataFrame(rows, "trace string, at long, height double")
    small, large = (rounded(detect.thin_peaks(peaks, 5, local_rows=limit).collect(), "trace", "at", "height") for limit in (1 << 20, 3))
    assert small == large and small and all(h == h for _, _, h in small)


def test_short_traces_are_listed(spark):
    samples = table(spark, {"short": [1.0] * 9, "long": [1.0] * 40})
    assert [tuple(r) for r in filters.too_short(samples, filters.boxcar_least(5)).collect()] == [("short", 9, 16)]
    assert {r.trace for r in filters.boxcar_decimate(samples, ["y"], 5).collect()} == {"long"}


def test_slots_are_bounded_by_rows(spark, tiny_chunks):
    """One outlier, equal values and a trace with nine tenths of the rows leave no slot much larger than the others."""
    rows = [("big", random.Random(i).random()) for i in range(9000)] + [("big", 1e12)] + [(f"t{i % 20}", float(i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "trace string, x double")
    bound = layout.CHUNK_ROWS * layout.SLOT_CHUNKS
    cut = layout.add_slots(df, ["trace"], ["x"]).cache()
    assert cut.groupBy("trace", "_slot").count().agg(F.max("count")).first()[0] < 3 * bound
    order = cut.groupBy("trace", "_slot").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("trace", "_slot").collect()
    assert all(a.hi <= b.lo for a, b in zip(order, order[1:], strict=False) if a.trace == b.trace)
    got = sorted((r.i, r.x) for r in layout.index_samples(df, ["x"]).where("trace = 'big'").collect())
    assert [i for i, _ in got] == list(range(9001)) and [x for _, x in got] == sorted(x for _, x in got)
