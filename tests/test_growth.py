"""Figures that must not grow with the rows: passes over a table, calls of Python per group, shuffles, task sizes."""
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import GroupedData
from pyspark.sql.classic.dataframe import DataFrame

from tracespool.catalog import job_queries, path_queries
from tracespool.functions import wlc
from tracespool.operators import align, filters, legs, modelfit, pauses, rupturefit, runs, stats, stepfit
from tracespool.plans import layout
from tracespool.streaming import incremental


def jobs_of(spark, work):
    """Result of ``work`` and the number of Spark jobs it took."""
    sc = spark.sparkContext
    name = f"jobs-{id(work)}"
    sc.setJobGroup(name, "")
    try:
        out = work()
        return out, len(sc.statusTracker().getJobIdsForGroup(name))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("kind", ["bell", "CHS"])
def test_likelihood_of_rupture_forces_reads_the_rows_in_few_passes(spark, kind):
    rng = np.random.default_rng(7)
    rows = [(c, float(f), keq) for c in (0, 1) for keq in (150.0, 220.0) for f in rng.normal(14 + c, 2.5, 150).clip(1)]
    df = spark.createDataFrame(rows, "condition int, force double, keq double")
    model, speed = ((50.0, 0.69, 1200.0),), 0.2
    fit, jobs = jobs_of(spark, lambda: rupturefit.fit_rupture_forces(df, speed, model, kind, grid_points=4000, per_axis=5, max_rounds=12).toPandas())
    assert kind != "bell" or jobs < 15
    for r in fit.itertuples():
        theta = [math.log(r.k0), r.x_dagger] + ([r.dg] if kind == "CHS" else [])
        part = pd.DataFrame(rows, columns=["condition", "f", "keq"]).query(f"condition == {r.condition}")
        grid = np.linspace(0, max(f for _, f, _ in rows) * 1.0001, 4000)
        rate = rupturefit._rate(grid, theta, kind, 298.15)
        soft = 0.69 * wlc._eps(np.maximum(grid, 1e-6), 50.0, 1200.0)[1]
        a, b = (np.concatenate([[0], np.cumsum((y[1:] + y[:-1]) / 2 * np.diff(grid))]) for y in (rate, rate * soft))
        f, keq = part.f.to_numpy(), part.keq.to_numpy()
        want = np.sum(np.log(rupturefit._rate(f, theta, kind, 298.15)) + np.log((1 / keq + np.interp(f, grid, soft)) / speed)
                      - (np.interp(f, grid, a) / keq + np.interp(f, grid, b)) / speed)
        assert abs(r.log_likelihood - want) < 1e-7 * abs(want)
        assert r.events == len(part)


def test_positions_take_one_shuffle_after_the_rows_are_in_slots(spark):
    rows = spark.range(3000).selectExpr("id % 7 as trace", "id * 37 % 3001 as t", "id as x")
    out = layout.index_samples(rows, ["t"], 100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 2 and plan.count("Sort [") <= 4
    got = out.toPandas().sort_values(["trace", "t"])
    assert (got.i == got.groupby("trace").cumcount()).all() and (got.chunk == got.i // 100).all()
    assert (got.n == got.groupby("trace").x.transform("size")).all() and len(got) == 3000


def test_error_codes_rank_the_lines_once_and_write_no_calibrated_rows(spark, tmp_path, monkeypatch):
    ranked, written = [], []
    settle, index = layout.settle, layout.index_samples
    monkeypatch.setattr(layout, "settle", lambda df: written.append(df.columns) or settle(df))
    monkeypatch.setattr(layout, "index_samples", lambda *a, **k: ranked.append(1) or index(*a, **k))
    out = job_queries._codes(spark, "/root/testdata/sf0.001")
    assert len(ranked) == 1 and not any("cal_d" in c or "bead_diff" in c for c in written)
    assert {r.error_code for r in out.collect()} >= {0, 1, 2}


def test_segments_are_fitted_without_a_frame_each(spark, monkeypatch):
    """Thousands of segments of a trace, some over the border of an Arrow batch; frames are made per batch."""
    rng = np.random.default_rng(3)
    n = 6000
    y = np.repeat(rng.normal(0, 40, n // 5), 5) + rng.normal(0, 1, n)
    df = spark.createDataFrame([("t", i, n, 0, float(v)) for i, v in enumerate(y)], "trace string, i long, n long, chunk long, y double")
    seg = spark.createDataFrame([("t", k, 10 * k, 10 * k + 10 if k % 7 else 10 * k + 1) for k in range(n // 10)], "trace string, k long, start long, stop long")
    frames = []
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda *a, **k: frames.append(1))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "33")
    try:
        got = stepfit.find_steps(df, "y", seg, 1.0).toPandas().sort_values("start")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert not frames and set(got.segment) == set(range(n // 10))
    for r in got.itertuples():
        assert abs(r.level - y[r.start:r.stop].mean()) < 1e-9
    assert (got.groupby("segment").start.min() == 10 * np.arange(n // 10)).all()
    want = {(10 * k + a, 10 * k + b) for k in range(n // 10) for a, b in zip(*(lambda c: (c[:-1], c[1:]))(
        stepfit._fit_segment(y[10 * k:10 * k + (10 if k % 7 else 1)], 1.0)[0]))}
    assert {(r.start, r.stop) for r in got.itertuples()} == want


def test_small_steps_are_absorbed_without_taking_rows_out_of_arrow(spark, monkeypatch):
    levels = [0.0, 3.0, 5.5, 5.0, 30.0, 33.0, 36.0, 2.0, 40.0, 40.5]
    rows = [(("a", s), k, k, k + 1, v + s) for s in range(40) for k, v in enumerate(levels)]
    df = spark.createDataFrame(rows, "trace struct<trace: string, segment: int>, k long, start long, stop long, level double")
    used = []
    inner = DataFrame.mapInPandas
    monkeypatch.setattr(DataFrame, "mapInPandas", lambda *a, **k: used.append(1) or inner(*a, **k))
    got = runs.absorb_small(df, 5.0).toPandas()
    assert not used
    kept = [0.0, 5.5, 30.0, 36.0, 2.0, 40.0]
    for key, part in got.groupby(got.trace.map(lambda t: t["segment"])):
        assert part.sort_values("k").level.tolist() == [v + key for v in kept]


def test_model_fits_make_no_groups_of_their_own_in_a_batch(spark, monkeypatch):
    """Three hundred parts of a trace are fitted without a call of Python per part and salt."""
    rows = [(f"k{k}", 0.3 * (1 + k % 5) * float(wlc._eps(np.array([f]), 50.0, 1200.0)[0][0]), f) for k in range(300) for f in (2.0, 5.0, 9.0, 14.0)]
    df = spark.createDataFrame(rows, "part string, d double, f double")
    steps, inner = [], DataFrame.mapInPandas
    monkeypatch.setattr(DataFrame, "mapInPandas", lambda self, fn, *a, **k: steps.append(fn) or inner(self, fn, *a, **k))
    got = modelfit.fit_model(df, [[50.0, 0.7, 1200.0]], [[True, False, True]], key="part", invert=False).collect()
    assert len(got) == 300
    for r in got:
        assert r.points == 4 and abs(r.components[0][1] - 0.3 * (1 + int(r.part[1:]) % 5)) < 1e-6
    batch = pd.DataFrame([(k, d, f, 0.7, [50.0, 0.7, 1200.0, 0.0, 0.0]) for k, d, f in rows], columns=["key", "d", "f", "p0", "theta"])
    calls, eps = [], wlc._eps
    monkeypatch.setattr(modelfit.wlc, "_eps", lambda *a: calls.append(1) or eps(*a))
    out = next(iter(steps[0](iter([batch]))))
    assert len(calls) == 3 and len(out) == 300 and (out.m == 4).all()


def test_stages_to_clear_are_joined_in_many_partitions(spark):
    own = spark.newSession()
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    own.conf.unset(key)
    rows = own.range(10).selectExpr("id as trace", "'a' as stage", "'s' as signature")
    needs = own.sql("select 'b' as stage, 'a' as needs")
    assert incremental.stale_stages(rows, rows.where("trace > 3"), needs).count() == 4
    assert own.conf.get(key) == str(layout.PIECES)


def test_pair_distances_do_not_count_what_they_drop(spark, monkeypatch):
    counted = []
    monkeypatch.setattr(layout, "add_slots", lambda *a, **k: counted.append(1))
    df = spark.createDataFrame([("a", i, 3, 0, x) for i, x in enumerate((0.0, 1.0, 3.0))], "trace string, i long, n long, chunk long, x double")
    got = {r.bin: r.weight for r in stats.pair_distances(df, "x", 4.0, 4).collect()}
    assert not counted and got == {0: 3.0, 1: 2.0, 2: 2.0, 3: 2.0}


def test_short_traces_are_filtered_without_a_frame_each(spark, monkeypatch):
    """Hundreds of traces of several lengths, some over the border of an Arrow batch, give what each gives in chunks."""
    rng = np.random.default_rng(5)
    rows = [(f"t{t:03d}", i, 20 + t % 60, 0, float(v)) for t in range(300) for i, v in enumerate(rng.normal(0, 9, 20 + t % 60))]
    df = spark.createDataFrame(rows, "trace string, i long, n long, chunk long, y double")
    frames = []
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda *a, **k: frames.append(1))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "33")
    try:
        whole = filters.zero_phase_lowpass(df, ["y"], 2, cutoff=0.9).toPandas().set_index(["trace", "i"]).sort_index()
        parts = filters.zero_phase_lowpass(df, ["y"], 2, cutoff=0.9, rows=17).toPandas().set_index(["trace", "i"]).sort_index()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert not frames and whole.index.equals(parts.index)
    assert len(whole) == sum(-(-(20 + t % 60 - 4) // 2) for t in range(300))
    assert np.allclose(whole["y"], parts["y"], atol=1e-9) and (whole["src"] == parts["src"]).all() and (whole["n"] == parts["n"]).all()


def test_groups_are_whole_wherever_batches_end():
    for size in (1, 2, 3, 5, 50):
        keys = [None, None, 1, 1, 1, 2, 3, 3, 3, 3, 3, 3, 3, 4]
        table = pa.table({"trace": pa.array(keys, pa.int64()), "i": list(range(len(keys)))})
        got = [t.slice(a, b - a)["i"].to_pylist() for t, first in layout.whole_groups(table.to_batches(size), ("trace",))
               for a, b in zip(first[:-1], first[1:])]
        assert got == [[0, 1], [2, 3, 4], [5], [6, 7, 8, 9, 10, 11, 12], [13]], size


def test_pauses_are_merged_without_a_frame_each(spark, monkeypatch):
    """Hundreds of short traces, some over the border of an Arrow batch, merge as in distributed rounds."""
    rng = np.random.default_rng(9)
    rows, found = [], []
    for t in range(90):
        n = 25 + t % 30
        rows += [(f"t{t:02d}", i, n, 0, None if i % 6 == 5 and v < 0 else float(v)) for i, v in enumerate(rng.normal(0, 2, n))]
        found += [(f"t{t:02d}", k, 6 * k, 6 * k + 3 + k % 3) for k in range(n // 6)]
    df = spark.createDataFrame(rows, "trace string, i long, n long, chunk long, y double")
    marks = spark.createDataFrame(found, "trace string, k long, start long, stop long")
    frames = []
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda *a, **k: frames.append(1))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "33")
    try:
        got = pauses.merge_fragments(df, "y", marks, 0.7).collect()
        some = [f"t{t:02d}" for t in range(0, 90, 30)]
        want = pauses.merge_fragments(df.where(df.trace.isin(some)), "y", marks.where(marks.trace.isin(some)), 0.7, 1).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert not frames and len({r.trace for r in got}) == 90 and len(got) < len(found)
    assert {(r.trace, r.start, r.stop) for r in got if r.trace in some} == {(r.trace, r.start, r.stop) for r in want}
    assert all([r.k for r in sorted(got, key=lambda r: r.start) if r.trace == t] == list(range(sum(r.trace == t for r in got))) for t in some)


@pytest.mark.parametrize("boxes", [(((0.2, 0.8), (3, 30)), None), ((None, (2, 30)), ((0.2, 1.0), (0, 40)))])
def test_short_traces_are_aligned_in_one_pass(spark, boxes):
    """All rounds of a short trace run in one task, and give the offsets of the distributed rounds."""
    rng = np.random.default_rng(4)
    model = ((50, 0.7, 1200),) if boxes[1] is None else ((50, 1.2),)
    rows = []
    for t in range(24):
        n = 30 + t
        x = np.linspace(0.25, 0.65, n) + rng.normal(0, 0.01, n)
        y = wlc.force_at(x - 0.01 * (t % 5), model) + 0.3 * (t % 3)
        rows += [(t, i, n, 0, None if t == 5 and i % 2 else float(a), None if t == 6 else float(b) + 100 * (t == 7)) for i, (a, b) in enumerate(zip(x, y))]
    df = layout.settle(spark.createDataFrame(rows, "trace long, i long, n long, chunk long, d double, f double"))
    fields = ["n", "doff", "foff", "aligned", "rounds", "converged"]
    far = {r.trace: r for r in align.align(df, *boxes, model=model, local_rows=1).collect()}
    near, jobs = jobs_of(spark, lambda: {r.trace: r for r in align.align(df, *boxes, model=model).collect()})
    assert jobs < 12 and len(near) == 24 and not near[6].aligned and near[6].rounds == 1
    for t, r in near.items():
        assert [r[c] for c in fields if c not in ("doff", "foff")] == [far[t][c] for c in fields if c not in ("doff", "foff")], t
        assert abs(r.doff - far[t].doff) < 1e-9 and abs(r.foff - far[t].foff) < 1e-7, t


def test_aligned_samples_are_written_once_and_only_where_they_are_read(spark, monkeypatch):
    written = []
    inner = layout.settle
    monkeypatch.setattr(layout, "settle", lambda df: written.append(set(df.columns)) or inner(df))
    assert job_queries._postprocess(spark, "/root/testdata/sf0.001").count()
    assert written and not any("d_aln" in c or "f2" in c for c in written)
    written.clear()
    assert job_queries._contour(spark, "/root/testdata/sf0.001").count()
    assert [c for c in written if "d_aln" in c] == [{"trace", "i", "n", "chunk", "curve_type", "rupture_index", "d_aln", "f_aln"}]


def test_whole_sizes_read_two_legs_of_a_trace(spark, monkeypatch):
    asked = []
    inner = legs.sizes_of
    monkeypatch.setattr(legs, "sizes_of", lambda rows, paths, options: asked.append(rows) or inner(rows, paths, options))
    s = path_queries.ramps(spark, "/root/testdata/sf0.001")
    tr = path_queries.ends(s)
    near = lambda df: {tuple(v if v is None else round(v, 9) for v in r) for r in df.collect()}
    alone = near(legs.whole_sizes(s, tr, "d", "f", 3, **path_queries.SIZE_OPTIONS))
    assert len(asked) == 1 and asked[0].select("trace", "k").distinct().groupBy("trace").count().agg({"count": "max"}).first()[0] == 2
    assert alone == near(legs.transition_sizes(s, tr, "d", "f", 3, **path_queries.SIZE_OPTIONS)[1])
    assert path_queries._whole(spark, "/root/testdata/sf0.001").count() == len(alone) > 0 and len(asked) < 6
