"""Queries on step finding and the ideal trace."""
from __future__ import annotations

from pyspark.sql import functions as F

from tracespool.catalog.registry import query
from tracespool.catalog.run_queries import BINARY, lengths
from tracespool.catalog.views import SIGNALS, signals, snap, sql_snap
from tracespool.operators import edits, pauses, runs, stepfit
from tracespool.plans import layout


def staircase(spark, sf_dir):
    """Signal with planted levels: a slow count plus a fifth of the value as noise."""
    return signals(spark, sf_dir, reuse=True).withColumn("y", F.floor(F.col("i") / 11) * 40 + F.col("x") / 5)


def whole(samples):
    return lengths(samples).select("trace", F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("start"),
                                   F.col("n").alias("stop"))


STAIRS = f"{SIGNALS}, y AS (SELECT trace, i, floor(i / 11) * 40 + x / 5 AS y FROM signals)"


def steps_sql(tag: str, segments: str, penalty: float) -> str:
    """CTE ``fit_<tag>`` with the dwells of segments ``trace, k, start, stop``: best-first splits of all pieces of a segment."""
    return f"""s_{tag} AS (SELECT g.trace, g.k AS sg, g.start, y.i - g.start AS p, y.y, avg(y.y) OVER w AS mean, count(*) OVER w AS m FROM {segments} g
    JOIN y ON y.trace = g.trace AND y.i >= g.start AND y.i < g.stop WINDOW w AS (PARTITION BY g.trace, g.k)),
  c_{tag} AS MATERIALIZED (SELECT trace, sg, p + 1 AS p, sum(y - mean) OVER (PARTITION BY trace, sg ORDER BY p) AS c FROM s_{tag}
    UNION ALL SELECT DISTINCT trace, sg, 0, 0.0 FROM s_{tag}),
  root_{tag} AS (SELECT trace, sg, any_value(m) AS m, sum(pow(y - mean, 2)) AS chi2 FROM s_{tag} GROUP BY 1, 2),
  node_{tag} AS MATERIALIZED (SELECT a.trace, a.sg, a.p AS a, b.p AS b, min({{'gain': pow(b.c - a.c, 2) / (b.p - a.p) - pow(x.c - a.c, 2) / (x.p - a.p) - pow(b.c - x.c, 2) / (b.p - x.p),
      'cut': x.p, 'a': a.p, 'b': b.p}}) AS best FROM c_{tag} a JOIN c_{tag} b ON b.trace = a.trace AND b.sg = a.sg AND b.p > a.p + 1
    JOIN c_{tag} x ON x.trace = a.trace AND x.sg = a.sg AND x.p > a.p AND x.p < b.p GROUP BY 1, 2, 3, 4),
  walk_{tag} AS (SELECT r.trace, r.sg, m, chi2, [0::BIGINT] AS cuts, CASE WHEN n.best IS NULL THEN [] ELSE [n.best] END AS open FROM root_{tag} r LEFT JOIN node_{tag} n ON n.trace = r.trace AND n.sg = r.sg AND n.a = 0 AND n.b = m
    UNION ALL SELECT w.trace, w.sg, m, chi2 + top.gain, list_append(cuts, top.cut), list_filter(list_concat(list_filter(open, lambda o: o <> top), [l.best, r.best]), lambda o: o IS NOT NULL)
    FROM (SELECT *, list_min(open) AS top FROM walk_{tag} WHERE len(open) > 0 AND chi2 > 0) w
    LEFT JOIN node_{tag} l ON l.trace = w.trace AND l.sg = w.sg AND l.a = top.a AND l.b = top.cut AND top.cut - top.a > 2
    LEFT JOIN node_{tag} r ON r.trace = w.trace AND r.sg = w.sg AND r.a = top.cut AND r.b = top.b AND top.b - top.cut > 2
    WHERE CASE WHEN 1 + top.gain / chi2 <= 0 THEN TRUE ELSE -0.5 * ln(m) * {penalty} - m / 2.0 * ln(1 + top.gain / chi2) > 0 END),
  last_{tag} AS (SELECT trace, sg, m, arg_max(cuts, len(cuts)) AS cuts FROM walk_{tag} GROUP BY 1, 2, 3),
  cut_{tag} AS (SELECT trace, sg, m, unnest(cuts) AS a FROM last_{tag}),
  piece_{tag} AS (SELECT trace, sg, a, lead(a, 1, m) OVER (PARTITION BY trace, sg ORDER BY a) AS b FROM cut_{tag}),
  fit_{tag} AS (SELECT trace, sg, any_value(start) + a AS start, any_value(start) + b AS stop, avg(y) AS level
    FROM piece_{tag} JOIN s_{tag} USING (trace, sg) WHERE p >= a AND p < b GROUP BY trace, sg, a, b)"""


STEPS = f"""WITH RECURSIVE {STAIRS}, seg AS (SELECT trace, 0 AS k, 0 AS start, max(n) AS stop FROM signals GROUP BY 1)"""


@query("find_steps", f"{STEPS}, {steps_sql('a', 'seg', 1.0)} SELECT trace, start, stop, {sql_snap('level', 'level')} FROM fit_a")
def _steps(spark, sf_dir):
    s = staircase(spark, sf_dir)
    out = stepfit.find_steps(s, "y", layout.settle(whole(s)))
    return out.select("trace", "start", "stop", snap("level").alias("level"))


@query("find_steps_between_pauses")
def _steps_between(spark, sf_dir):
    s = staircase(spark, sf_dir)
    held = stepfit.interval_means(s, runs.labelled(s, F.col("x") > 60), "y")
    gaps = runs.complement(runs.renumber(held.select("trace", "k", "start", "stop")), lengths(s))
    fitted = stepfit.clean_dwells(stepfit.find_steps(s, "y", gaps, 1.5), 2, 5.0)
    out = stepfit.ideal_trace(held.select("trace", "start", "stop", "level"), fitted, 8.0)
    return out.select("trace", "k", "start", "stop", snap("level").alias("level"), "is_pause")


@query("interval_means", f"""WITH {BINARY} SELECT v.trace, row_number() OVER (PARTITION BY v.trace ORDER BY v.start)-1 AS k, v.start, v.stop,
  {sql_snap('avg(s.x)','level')} FROM iv v JOIN signals s ON s.trace=v.trace AND s.i>=v.start AND s.i<v.stop GROUP BY v.trace, v.start, v.stop""")
def _levels(spark, sf_dir):
    s = signals(spark, sf_dir, reuse=True)
    out = stepfit.interval_means(s, runs.labelled(s, F.col("x") > 40), "x")
    return out.select("trace", "k", "start", "stop", snap("level").alias("level"))


@query("putative_pauses")
def _putative(spark, sf_dir):
    s = staircase(spark, sf_dir)
    out = pauses.putative_pauses(s, "y", 12.0, 1.0, 3, 4)
    return out.select("trace", "k", "start", "stop", snap("level").alias("level"))


@query("refit_dwells", f"""{STEPS}, {steps_sql('a', 'seg', 6.0)}, old AS (SELECT trace, row_number() OVER (PARTITION BY trace ORDER BY start) - 1 AS k, start, stop, level FROM fit_a),
  hit AS (SELECT * FROM old WHERE start <= 30 AND stop - 1 >= 12), {steps_sql('b', 'hit', 0.4)},
  spliced AS (SELECT trace, start, stop, level FROM fit_b UNION ALL SELECT trace, start, stop, level FROM old ANTI JOIN hit USING (trace, k)),
  fl AS (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY trace ORDER BY start) = level THEN 0 ELSE 1 END AS c FROM spliced),
  gr AS (SELECT *, sum(c) OVER (PARTITION BY trace ORDER BY start) - 1 AS r FROM fl)
  SELECT trace, CAST(r AS BIGINT) AS k, min(start) AS start, max(stop) AS stop, {sql_snap('min(level)', 'level')} FROM gr GROUP BY 1, 2""")
def _refit(spark, sf_dir):
    s = staircase(spark, sf_dir)
    coarse = stepfit.find_steps(s, "y", layout.settle(whole(s)), 6.0)
    old = layout.index_samples(coarse.select("trace", "start", "stop", "level"), ["start"]).withColumn("k", F.col("i"))
    old = layout.settle(old.select("trace", "k", "start", "stop", "level", F.col("start").alias("t_start"), (F.col("stop") - 1).alias("t_stop")))
    boxes = old.select("trace", F.lit(0).alias("seq"), F.lit(12).alias("t1"), F.lit(30).alias("t2")).distinct()
    out = edits.refit_dwells(old, s, "y", boxes, 0.4)
    return out.select("trace", "k", "start", "stop", snap("level").alias("level"))
