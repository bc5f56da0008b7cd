"""Queries on runs, dwells, intervals and modes."""
from __future__ import annotations

from pyspark.sql import functions as F

from tracespool.catalog.registry import query
from tracespool.catalog.views import SIGNALS, signals, snap, sql_snap
from tracespool.operators import runs

LEVELS = SIGNALS + """, lv AS (SELECT *, floor(x/25)*25 AS level FROM signals),
 ch AS (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY trace ORDER BY i)=level THEN 0 ELSE 1 END AS c FROM lv),
 rn AS (SELECT *, sum(c) OVER (PARTITION BY trace ORDER BY i)-1 AS k FROM ch),
 dw AS (SELECT trace, CAST(k AS BIGINT) AS k, min(i) AS start, max(i)+1 AS stop, min(level) AS level, max(n) AS n
   FROM rn GROUP BY 1,2)"""


def levels(spark, sf_dir):
    return signals(spark, sf_dir, reuse=True).withColumn("level", (F.floor(F.col("x") / 25) * 25).cast("double"))


def lengths(df):
    return df.groupBy("trace").agg(F.max("n").alias("n"))


@query("dwells", f"""WITH {LEVELS} SELECT trace, k, start, stop, level, stop-start AS duration,
  lead(level) OVER (PARTITION BY trace ORDER BY k)-level AS step FROM dw""")
def _dwells(spark, sf_dir):
    return runs.steps(runs.dwells(levels(spark, sf_dir), "level")).select(
        "trace", "k", "start", "stop", "level", "duration", "step")


BINARY = SIGNALS + """, b AS (SELECT trace,i,n, x>40 AS on_ FROM signals),
 g AS (SELECT *, i-row_number() OVER (PARTITION BY trace,on_ ORDER BY i) AS grp FROM b),
 iv AS (SELECT trace, min(i) AS start, max(i)+1 AS stop FROM g WHERE on_ GROUP BY trace, grp)"""


@query("intervals_from_labels", f"""WITH {BINARY} SELECT trace, row_number() OVER (PARTITION BY trace ORDER BY start)-1 AS k,
  start, stop-1 AS stop FROM iv""")
def _labels(spark, sf_dir):
    found = runs.labelled(signals(spark, sf_dir, reuse=True), F.col("x") > 40)
    return runs.inclusive(found).select("trace", "k", "start", "stop")


@query("complement_intervals", f"""WITH {BINARY} , off AS (SELECT trace, min(i) AS start, max(i)+1 AS stop FROM g WHERE NOT on_ GROUP BY trace, grp)
  SELECT trace, row_number() OVER (PARTITION BY trace ORDER BY start)-1 AS k, start, stop FROM off""")
def _complement(spark, sf_dir):
    s = signals(spark, sf_dir, reuse=True)
    return runs.complement(runs.labelled(s, F.col("x") > 40), lengths(s)).select("trace", "k", "start", "stop")


@query("labels_from_intervals", f"WITH {BINARY} SELECT trace, i, CASE WHEN on_ THEN 1 ELSE 0 END AS label FROM b")
def _assign(spark, sf_dir):
    s = signals(spark, sf_dir, reuse=True)
    out = runs.assign(s, runs.labelled(s, F.col("x") > 40))
    return out.select("trace", "i", F.col("segment").isNotNull().cast("int").alias("label"))


@query("segment_assignment", f"""WITH {BINARY}, seg AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY start)-1 AS k FROM iv)
  SELECT s.trace, seg.k AS segment, count(*) AS n, {sql_snap('avg(s.x)', 'mean')} FROM signals s JOIN seg
  ON s.trace=seg.trace AND s.i>=seg.start AND s.i<seg.stop GROUP BY 1,2""")
def _segments(spark, sf_dir):
    s = signals(spark, sf_dir, reuse=True)
    out = runs.assign(s, runs.labelled(s, F.col("x") > 40)).where("segment is not null")
    return out.groupBy("trace", "segment").agg(F.count("*").alias("n"), snap(F.avg("x")).alias("mean"))


# the first dwell or the latest dwell of at least two samples sets the level
@query("absorb_short_dwells", f"""WITH {LEVELS}, own AS (SELECT *, (SELECT max(e.k) FROM dw e WHERE e.trace=d.trace AND e.k<=d.k
    AND (e.k=0 OR e.stop-e.start>=2)) AS src FROM dw d),
  nl AS (SELECT o.trace,o.start,o.stop,o.k,s.level FROM own o JOIN dw s ON s.trace=o.trace AND s.k=o.src),
  fl AS (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY trace ORDER BY k)=level THEN 0 ELSE 1 END AS c FROM nl),
  gr AS (SELECT *, sum(c) OVER (PARTITION BY trace ORDER BY k)-1 AS r FROM fl)
  SELECT trace, CAST(r AS BIGINT) AS k, min(start) AS start, max(stop) AS stop, min(level) AS level FROM gr GROUP BY 1,2""")
def _short(spark, sf_dir):
    return runs.absorb_short(runs.dwells(levels(spark, sf_dir), "level"), 2).select(
        "trace", "k", "start", "stop", "level")


@query("absorb_small_steps", f"""WITH RECURSIVE {LEVELS}, w AS (
    SELECT trace, k, level AS kept FROM dw WHERE k=0
    UNION ALL SELECT d.trace, d.k, CASE WHEN abs(d.level-w.kept)<60 THEN w.kept ELSE d.level END
    FROM w JOIN dw d ON d.trace=w.trace AND d.k=w.k+1),
  nl AS (SELECT d.trace,d.k,d.start,d.stop,w.kept AS level FROM dw d JOIN w USING (trace,k)),
  fl AS (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY trace ORDER BY k)=level THEN 0 ELSE 1 END AS c FROM nl),
  gr AS (SELECT *, sum(c) OVER (PARTITION BY trace ORDER BY k)-1 AS r FROM fl)
  SELECT trace, CAST(r AS BIGINT) AS k, min(start) AS start, max(stop) AS stop, min(level) AS level FROM gr GROUP BY 1,2""")
def _small(spark, sf_dir):
    return runs.absorb_small(runs.dwells(levels(spark, sf_dir), "level"), 60.0).select(
        "trace", "k", "start", "stop", "level")


@query("absorb_large_steps", f"""WITH RECURSIVE {LEVELS}, nx AS (SELECT *, lead(level) OVER (PARTITION BY trace ORDER BY k) AS nxt FROM dw), w AS (
    SELECT trace, k, level AS kept, level AS own FROM nx WHERE k=0
    UNION ALL SELECT d.trace, d.k, CASE WHEN abs(d.level-w.kept)>25 THEN w.kept ELSE d.level END,
      CASE WHEN abs(d.level-w.kept)<=25 THEN d.level WHEN nxt IS NULL OR abs(d.level-w.kept)<=abs(d.level-nxt) THEN w.kept END
    FROM w JOIN nx d ON d.trace=w.trace AND d.k=w.k+1),
  nl AS (SELECT d.trace, d.k, d.start, d.stop, (SELECT arg_min(e.own, e.k) FROM w e WHERE e.trace=d.trace AND e.k>=d.k AND e.own IS NOT NULL) AS level FROM dw d),
  fl AS (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY trace ORDER BY k)=level THEN 0 ELSE 1 END AS c FROM nl),
  gr AS (SELECT *, sum(c) OVER (PARTITION BY trace ORDER BY k)-1 AS r FROM fl)
  SELECT trace, CAST(r AS BIGINT) AS k, min(start) AS start, max(stop) AS stop, min(level) AS level FROM gr GROUP BY 1,2""")
def _large(spark, sf_dir):
    return runs.absorb_large(runs.dwells(levels(spark, sf_dir), "level"), 25.0).select("trace", "k", "start", "stop", "level")


@query("monotonic_segments", f"""WITH {BINARY}, seg AS (SELECT *, row_number() OVER (PARTITION BY trace ORDER BY start) AS sk FROM iv),
  s AS (SELECT g.trace, g.i, x.x, seg.sk, lag(x.x) OVER (PARTITION BY g.trace, seg.sk ORDER BY g.i) AS px FROM g
     JOIN signals x USING (trace,i) JOIN seg ON seg.trace=g.trace AND g.i>=seg.start AND g.i<seg.stop),
  p AS (SELECT *, sum(CASE WHEN px IS NULL OR x<px THEN 1 ELSE 0 END) OVER (PARTITION BY trace ORDER BY i) AS pc FROM s),
  q AS (SELECT trace, min(i) AS start, max(i)+1 AS stop FROM p GROUP BY trace, pc HAVING min(x)<>max(x))
  SELECT trace, row_number() OVER (PARTITION BY trace ORDER BY start)-1 AS k, start, stop FROM q""")
def _monotonic(spark, sf_dir):
    s = signals(spark, sf_dir, reuse=True)
    return runs.monotonic(s, "x", runs.labelled(s, F.col("x") > 40)).select("trace", "k", "start", "stop")


CLASSES = SIGNALS + """, df AS (SELECT *, lead(x) OVER (PARTITION BY trace ORDER BY i)-x AS dx FROM signals),
 cl AS (SELECT trace,i,n, CASE WHEN dx>20 THEN 1 WHEN dx<-20 THEN -1 ELSE 0 END AS level FROM df WHERE i<n-1),
 c1 AS (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY trace ORDER BY i)=level THEN 0 ELSE 1 END AS c FROM cl),
 c2 AS (SELECT *, sum(c) OVER (PARTITION BY trace ORDER BY i)-1 AS k FROM c1),
 cr AS (SELECT trace, k, min(i) AS start, max(i)+1 AS stop, min(level) AS level FROM c2 GROUP BY 1,2),
 c3 AS (SELECT d.*, CASE WHEN (SELECT max(e.k) FROM cr e WHERE e.trace=d.trace AND e.k<=d.k AND e.stop-e.start>=2) IS NULL
      THEN coalesce((SELECT e.level FROM cr e WHERE e.trace=d.trace AND e.k=1), d.level)
      ELSE (SELECT e.level FROM cr e WHERE e.trace=d.trace AND e.k=(SELECT max(f.k) FROM cr f WHERE f.trace=d.trace AND f.k<=d.k AND f.stop-f.start>=2)) END AS nl FROM cr d),
 c4 AS (SELECT *, CASE WHEN lag(nl) OVER (PARTITION BY trace ORDER BY k)=nl THEN 0 ELSE 1 END AS c FROM c3),
 c5 AS (SELECT *, sum(c) OVER (PARTITION BY trace ORDER BY k)-1 AS r FROM c4),
 cm AS (SELECT trace, CAST(r AS BIGINT) AS k, min(start) AS start, max(stop) AS stop, min(nl) AS level FROM c5 GROUP BY 1,2)"""


@query("clean_short_runs", f"WITH {CLASSES} SELECT trace, k, start, stop, level FROM cm")
def _clean(spark, sf_dir):
    from tracespool.plans import layout
    s = layout.sliding(signals(spark, sf_dir, reuse=True), 0, 1, {"dx": lambda w, f: F.lead("x").over(w) - F.col("x")})
    s = s.where("i < n - 1").withColumn("cls", F.expr("case when dx > 20 then 1 when dx < -20 then -1 else 0 end"))
    out = runs.absorb_short(runs.dwells(s, "cls"), 2, lead_takes_next=True)
    return out.select("trace", "k", "start", "stop", "level")


@query("trap_modes", f"""WITH {CLASSES}, fit AS (SELECT m.trace, m.k, min(s.i) AS start, max(s.i) AS last, min(s.t) AS t_start, max(s.t) AS t_stop,
    regr_slope(s.x*1000, s.t) AS velocity FROM cm m JOIN signals s ON s.trace=m.trace AND s.i BETWEEN m.start AND m.stop GROUP BY 1,2)
  SELECT trace, k, start, last, t_start, t_stop, {sql_snap('velocity','velocity')}, CASE WHEN velocity>1 THEN 'stretch'
    WHEN velocity<-1 THEN 'relax' ELSE 'pause' END AS mode FROM fit""")
def _modes(spark, sf_dir):
    out = runs.modes(signals(spark, sf_dir, reuse=True), "t", "x", threshold=20.0, min_run=2, min_velocity=1.0)
    return out.select("trace", "k", "start", "last", "t_start", "t_stop", snap("velocity").alias("velocity"), "mode")


@query("segments_from_pauses", f"""WITH {BINARY}, lens AS (SELECT trace, max(n) AS n FROM signals GROUP BY 1),
  parts AS (SELECT trace, min(i) AS start, max(i)+1 AS stop, CASE WHEN on_ THEN 'passive' ELSE 'active' END AS mode
     FROM g WHERE trace%5<>0 GROUP BY trace, grp, on_ UNION ALL SELECT trace, 0, n, 'passive' FROM lens WHERE trace%5=0)
  SELECT trace, row_number() OVER (PARTITION BY trace ORDER BY start)-1 AS k, start, stop, mode FROM parts""")
def _pause_segments(spark, sf_dir):
    s = signals(spark, sf_dir, reuse=True)
    out = runs.segments_from_pauses(runs.labelled(s, F.col("x") > 40), lengths(s), F.expr("trace % 5 = 0"))
    return out.select("trace", "k", "start", "stop", "mode")
