"""Queries that run whole jobs over the given tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from tracespool.catalog.join_queries import calpars
from tracespool.catalog.registry import query
from tracespool.catalog.views import PULLS, pulls, signals, snap, sql_snap
from tracespool.operators import align, modelfit, sets
from tracespool.plans import layout, pipelines

MODEL = ((50.0, 0.69, 1200.0),)


def raw_ramps(spark, sf_dir):
    """Two-channel ramps; the supplier modulo 5 is the baseline."""
    s = pulls(spark, sf_dir, reuse=True).withColumnRenamed("d", "trap")
    return s.withColumn("baseline", F.col("trace") % 5)


def preprocessed(spark, sf_dir, ramps=None):
    ramps = raw_ramps(spark, sf_dir) if ramps is None else ramps
    # recordings of the first four traces double as baselines; baseline 4 is missing
    base = ramps.where("trace < 4").drop("baseline")
    cal = calpars(spark, sf_dir).where("baseline < 5")
    return pipelines.preprocess(ramps, base, cal, 2, 1000.0, 3)


def curves(spark, sf_dir, reuse=True):
    """Sorted into rising force, so that each trace looks like a pull."""
    s = pulls(spark, sf_dir, reuse)
    return s.withColumn("d", 0.3 + F.col("d") / 10 + F.col("i") / F.col("n") * 0.35).withColumn(
        "f", F.col("f") / 4 + F.col("i") / F.col("n") * 25 + 1).withColumn("curve_type", F.expr("if(trace % 2 = 0, 'S', 'R')"))


def postprocessed(spark, sf_dir):
    """Aligned samples, not yet written, and the table of traces."""
    s = curves(spark, sf_dir, reuse=False).select("trace", "i", "n", "chunk", "d", "f", "curve_type")
    s = layout.settle(sets.flip(s, F.col("curve_type") == "R"))
    return pipelines.postprocess(s, None, 3, MODEL, ((0.3, 0.9), (3, 30)), (((0.3, 0.9), (3, 30)), None), 20, 3.0)


@query("job_preprocess")
def _preprocess(spark, sf_dir):
    out = preprocessed(spark, sf_dir)
    return out.select("trace", "baseline", "i", *[snap(c).alias(c) for c in ("d", "f")], "error_code")


@query("job_postprocess")
def _postprocess(spark, sf_dir):
    _, per = postprocessed(spark, sf_dir)
    return per.select("trace", "curve_type", snap("doff").alias("doff"), "rupture_index", "keep")


@query("job_contour_length")
def _contour(spark, sf_dir):
    out, _ = postprocessed(spark, sf_dir)
    lc = pipelines.contour_length_traces(out, 3, ((50.0, None, 1200.0),))
    return lc.select("trace", "i", snap("lc").alias("lc"))


@query("job_annotate_consolidate")
def _annotate(spark, sf_dir):
    out, per = postprocessed(spark, sf_dir)
    lc = layout.settle(pipelines.contour_length_traces(out, 3, ((50.0, None, 1200.0),)))
    low = layout.settle(lc.select("trace", "i", "n", "chunk", F.col("d_aln").alias("d"), F.col("f_aln").alias("f")))
    ann = layout.settle(pipelines.annotate(low, per, 0.69, 2.0, 2.0, 5, 5, nfit=20, navg=3, avg_range=2.0, fit_range=3.0))
    samples = low.withColumnRenamed("d", "d_aln").withColumnRenamed("f", "f_aln")
    _, table = pipelines.consolidate([samples.where("trace % 2 = 0"), samples.where("trace % 2 = 1")], ann, MODEL,
                                     ((0.3, 0.9), (3, 30)), (-1.0, 1.0), 8.0, 40.0, 1.0)
    return table.select("trace", snap("size").alias("size"), snap("initial_force").alias("initial_force"),
                        snap("rmsd").alias("rmsd"), F.array_join("codes", ",").alias("codes"), "keep")


@query("job_motor_traces")
def _motor(spark, sf_dir):
    s = signals(spark, sf_dir, reuse=True)
    s = s.select("trace", "i", "n", "chunk", F.col("x").alias("trap"), (F.col("x") / 500 + F.floor(F.col("i") / 20) * 0.1).alias("d"),
                 (F.col("x") / 20 + 5).alias("f"))
    _, ideal, _ = pipelines.motor_traces(s, 100.0, 2, ((50.0, None, 1200.0),), min_dwell=2, min_step=5.0, tolerance=5.0,
                                         mode_options={"threshold": 10.0, "min_run": 2, "min_velocity": 1e5}, cutoff=0.9)
    return ideal.select("trace", "k", "start", "stop", snap("level").alias("level"))


def motor_sets(spark, sf_dir):
    """Four suppliers form a set: ramps S00 to S03 of one molecule."""
    s = curves(spark, sf_dir)
    return s.select("trace", "i", "n", "chunk", "d", "f", F.expr("trace div 4").alias("base"),
                    F.concat(F.lit("fecS0"), (F.col("trace") % 4).cast("string")).alias("run"))


@query("set_realignment")
def _realign(spark, sf_dir):
    s = layout.settle(motor_sets(spark, sf_dir))
    names = s.groupBy("base", "run").agg(F.max("n").alias("n"))
    states = names.select("base", "run", F.lit(0.65).alias("state"), F.expr("n div 2").alias("first_transition"))
    first = align.realign_beginning(s, states, MODEL, ((0.3, 0.9), (3, 12)), ((0.3, 0.68), (3, 20)))
    ends = s.groupBy("trace").agg(F.max("n").alias("n")).select("trace", F.explode(F.array(
        F.expr("n div 2"), F.col("n") - 1)).alias("at"))
    last = align.realign_end(s, ends, MODEL, None)
    return first.join(last.select("trace", F.col("doff").alias("end_doff")), "trace", "left").select(
        "trace", snap("doff").alias("doff"), (F.floor(F.col("foff") * 1e4 + 0.5) / 1e4).alias("foff"),
        snap("state_offset").alias("state_offset"), snap("end_doff").alias("end_doff"))


@query("fit_contour_length")
def _fit(spark, sf_dir):
    s = curves(spark, sf_dir)
    out = modelfit.fit_model(s, ((50.0, 0.7, 1200.0),), [[True, False, True]], ((((1, 100), (0.3, 2.0), (100, 5000))),),
                             box=((0.2, 0.9), (3, 30)), force_offset=False, invert=False)
    return out.select("trace", snap(F.col("components")[0][1]).alias("lc"), snap("rmse").alias("rmse"), "points")


CAMERA = f"""WITH {PULLS}, cam AS (SELECT trace, i, d AS trap, d * 1.5 + 3 + CASE WHEN trace % 3 = 0 THEN f / 200 ELSE f / 5000 END AS b1, CASE WHEN i % 17 = 4 THEN d * 1.5 + 3 + CASE WHEN trace % 3 = 0 THEN f / 200 ELSE f / 5000 END - 2.5 ELSE 0.4 END AS b2 FROM pulls),
  rg AS (SELECT trace, min(trap) + 0.1 AS lo, max(trap) - 0.1 AS hi FROM cam GROUP BY 1), g AS (SELECT trace, trap, b1 - b2 - (2.0 + 3.0) / 2 AS gap FROM cam JOIN rg USING (trace) WHERE trap > lo AND trap < hi),
  m AS (SELECT trace, regr_slope(gap, trap) AS a, regr_intercept(gap, trap) AS b, regr_r2(gap, trap) AS r2 FROM g WHERE gap <> 0 GROUP BY 1)"""


def camera(spark, sf_dir, ramps=None):
    """The camera sees the separation of the beads; every 17th frame has none, and every third baseline is noisy."""
    s = raw_ramps(spark, sf_dir) if ramps is None else ramps
    one = F.col("trap") * 1.5 + 3 + F.when(F.col("trace") % 3 == 0, F.col("f") / 200).otherwise(F.col("f") / 5000)
    s = layout.settle(s.select("trace", "i", "n", "chunk", "trap", one.alias("bead1"), F.when(F.col("i") % 17 == 4, one - 2.5).otherwise(0.4).alias("bead2")))
    ranges = s.groupBy(F.col("trace").alias("baseline")).agg((F.min("trap") + 0.1).alias("lo"), (F.max("trap") - 0.1).alias("hi"))
    return pipelines.camera_models(s, ranges, (2.0, 3.0))


@query("camera_models", f"""{CAMERA} SELECT trace AS baseline, {sql_snap('a', 'slope')}, {sql_snap('b', 'intercept')}, {sql_snap('r2', 'r2')},
  CASE WHEN r2 >= 0.99 THEN 0 ELSE 3 END AS error_code FROM m""")
def _camera(spark, sf_dir):
    return camera(spark, sf_dir).select("baseline", snap(F.col("coeffs")[1]).alias("slope"), *[snap(c).alias(c) for c in ("intercept", "r2")], "error_code")


@query("job_error_codes")
def _codes(spark, sf_dir):
    """Ramps asked for, one more than there are, with the codes of baselines, camera and length."""
    ramps = raw_ramps(spark, sf_dir)
    # read once and for its codes alone, so the calibrated rows are neither written nor shuffled whole
    rows = pipelines.calibrated_by_camera(preprocessed(spark, sf_dir, ramps), camera(spark, sf_dir, ramps), offset=True)
    wanted = ramps.select("trace").distinct().unionByName(ramps.agg((F.max("trace") + 1).alias("trace")))
    return pipelines.error_codes(wanted, ramps, rows)
