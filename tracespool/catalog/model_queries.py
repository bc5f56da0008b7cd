"""Queries on incremental runs, robust fits, spectra, clusters and kinetics."""
from __future__ import annotations

from pyspark.sql import functions as F

from tracespool.catalog.join_queries import CAL, calpars
from tracespool.catalog.registry import query
from tracespool.catalog.views import PULLS, SIGNALS, pulls, signals, snap, sql_eps, sql_snap, table
from tracespool.functions import wlc
from tracespool.operators import cluster, density, huberpoly, robust, rupturefit, sets, spectrum, stats
from tracespool.plans import layout
from tracespool.streaming import incremental


@query("incremental_plan", """SELECT c_custkey AS trace, CASE WHEN r.rate IS NULL THEN 'new' WHEN abs(r.rate-10)<=1.1e-5 THEN 'reuse' ELSE 'recompute' END AS action
  FROM customer LEFT JOIN (SELECT o_custkey AS trace, CAST(count(*) AS DOUBLE) AS rate FROM orders WHERE o_orderstatus='F' GROUP BY 1) r ON r.trace=c_custkey WHERE c_nationkey<>3""")
def _plan(spark, sf_dir):
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey trace", "c_nationkey nation")
    saved = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("trace")).agg(
        F.count("*").cast("double").alias("rate"))
    return incremental.rate_plan(c, saved, 10.0, c.where("nation = 3"))


@query("stale_signatures", """SELECT c_custkey AS trace FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')""")
def _stale(spark, sf_dir):
    def signed(df, priority):
        return df.withColumn("signature", incremental.signature(F.struct(F.col("trace"), F.lit(25).alias("factor"), priority.alias("p"))))
    want = signed(table(spark, sf_dir, "customer").selectExpr("c_custkey trace"), F.lit("1"))
    have = signed(table(spark, sf_dir, "orders").selectExpr("o_custkey trace", "o_orderpriority"), F.substring("o_orderpriority", 1, 1))
    return incremental.stale(want, have).select("trace")


@query("stored_model", """SELECT s_suppkey AS trace, 'lc' AS stage, 50.0::DOUBLE AS lp, s_acctbal AS lc, 1200.0::DOUBLE AS st FROM supplier""")
def _stored(spark, sf_dir):
    part = F.struct(F.lit(50.0).alias("Lp"), F.col("s_acctbal").alias("Lc"), F.lit(1200.0).alias("St"))
    rec = incremental.parameter_record(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("trace"), F.array(part).alias("model")), "lc")
    back = rec.select("stage", "parameters", F.get_json_object("parameters", "$.trace").cast("bigint").alias("trace"))
    m = F.from_json(F.get_json_object("parameters", "$.model"), incremental.MODEL_SCHEMA)[0]
    return back.select("trace", "stage", m["Lp"].alias("lp"), m["Lc"].alias("lc"), m["St"].alias("st"))


@query("huber_line")
def _huber(spark, sf_dir):
    out = robust.huber_line(pulls(spark, sf_dir), "d", "f")
    return out.select("trace", "points", snap("slope").alias("slope"), snap("intercept").alias("intercept"))


@query("compliance_correction")
def _compliance(spark, sf_dir):
    s = pulls(spark, sf_dir, reuse=True).select("*", F.lit(10).alias("before"), (F.col("n") - 2).alias("after"), F.lit(0.7).alias("state"))
    s = s.withColumn("trap", F.col("f") * 0.004 + 0.7 * wlc.relative_extension(F.col("f"), 50, 1200) + F.col("d") / 50)
    lines, _ = robust.compliance(s, "trap", "f", ((50.0, None, 1200.0),), "before", "after", "state", padding=5, end_points=300)
    return lines.select("trace", snap("stiffness").alias("stiffness"))


@query("welch_spectrum", f"""WITH {SIGNALS}, sg AS (SELECT trace, n, unnest(range((n-16)//8+1)) AS seg FROM signals WHERE i=0 AND n>=16),
  sm AS (SELECT sg.trace, sg.seg, s.i-sg.seg*8 AS j, s.x FROM sg JOIN signals s ON s.trace=sg.trace AND s.i>=sg.seg*8 AND s.i<sg.seg*8+16),
  c AS (SELECT *, (x-avg(x) OVER (PARTITION BY trace, seg))*(0.5-0.5*cos(2*pi()*j/16)) AS y FROM sm), fb AS (SELECT unnest(range(9)) AS bin),
  p AS (SELECT trace, seg, bin, pow(sum(y*cos(2*pi()*bin*j/16)),2)+pow(sum(y*sin(2*pi()*bin*j/16)),2) AS p FROM c, fb GROUP BY 1,2,3)
  SELECT trace, bin, {sql_snap('bin*100.0/16','frequency')}, {sql_snap('avg(p)/(100*6)*(CASE WHEN bin IN (0,8) THEN 1 ELSE 2 END)','power')} FROM p GROUP BY 1,2""")
def _welch(spark, sf_dir):
    out = spectrum.welch(signals(spark, sf_dir), "x", 100.0, 16)
    return out.select("trace", "bin", snap("frequency").alias("frequency"), snap("power").alias("power"))


@query("kmeans_clusters")
def _kmeans(spark, sf_dir):
    names = [f"e{k}" for k in range(64)]
    e = table(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate(names)])
    out, _, _ = cluster.kmeans(stats.standardise(e, names), names, k_max=4, tries=2)
    return out.groupBy("cluster").agg(F.count("*").alias("n"), snap(F.avg("e0")).alias("e0"))


@query("rupture_force_likelihood")
def _likelihood(spark, sf_dir):
    cal = sets.stiffness_pivot(calpars(spark, sf_dir)).select(F.col("baseline").alias("trace"), (1000 / (1 / F.col("k1") + 1 / F.col("k2"))).alias("keq"))
    top = pulls(spark, sf_dir).where("f > 0").groupBy("trace", F.expr("i div 20").alias("pull")).agg(F.max(F.col("f") + F.col("d")).alias("force"))
    rows = layout.salted(top, cal, ["trace"], salt="pull").withColumn("condition", F.expr("trace % 2"))
    return rupturefit.fit_rupture_forces(rows, 0.1, ((50.0, 0.69, 1200.0),))


POINTS = "pts AS (SELECT c_custkey AS id, c_acctbal / 500 AS x, c_nationkey::DOUBLE AS y FROM customer)"
NEAR = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"


def points(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") / 500).alias("x"), F.col("c_nationkey").cast("double").alias("y"))


@query("density_clusters", f"""WITH RECURSIVE {POINTS}, pair AS (SELECT a.id, b.id AS other FROM pts a JOIN pts b ON {NEAR} <= 0.35),
  core AS (SELECT id FROM pair GROUP BY 1 HAVING count(*) >= 3), link AS (SELECT id, other FROM pair WHERE id IN (FROM core) AND other IN (FROM core)),
  reach AS (SELECT id, id AS root FROM core UNION SELECT l.other, r.root FROM reach r JOIN link l USING (id)),
  part_of AS (SELECT id, min(root) AS root FROM reach GROUP BY 1), numbered AS (SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS label FROM part_of),
  border AS (SELECT pair.id, min(label) AS label FROM pair JOIN numbered n ON n.id = other WHERE pair.id NOT IN (FROM core) GROUP BY 1)
  SELECT id, coalesce(n.label, b.label, -1) AS label FROM pts LEFT JOIN numbered n USING (id) LEFT JOIN border b USING (id)""")
def _density(spark, sf_dir):
    return density.dbscan(points(spark, sf_dir), ["x", "y"], 0.35, 3).select("id", "label")


@query("density_knee", f"""WITH {POINTS}, kth AS (SELECT a.id, list_sort(list({NEAR}))[3] AS y FROM pts a, pts b GROUP BY 1),
  s AS (SELECT y, row_number() OVER (ORDER BY y DESC) - 1 AS p, count(*) OVER () AS n, min(y) OVER () AS lo, max(y) OVER () AS hi FROM kth),
  h AS (SELECT *, 1 - (y - lo) / (hi - lo) - p::DOUBLE / (n - 1.0) AS h FROM s),
  e AS (SELECT *, lead(h) OVER w AS nxt, h >= coalesce(lead(h) OVER w, h) AND h >= coalesce(lag(h) OVER w, h) AS top,
    h <= coalesce(lead(h) OVER w, h) AND h <= coalesce(lag(h) OVER w, h) AS bottom FROM h WINDOW w AS (ORDER BY p)),
  f AS (SELECT *, last_value(CASE WHEN bottom THEN 0.0 WHEN top THEN h - 1.0 / (n - 1.0) END IGNORE NULLS) OVER w AS lim,
    last_value(CASE WHEN top THEN p END IGNORE NULLS) OVER w AS tp FROM e WINDOW w AS (ORDER BY p)),
  hit AS (SELECT arg_min(tp, p) AS tp FROM f WHERE tp IS NOT NULL AND nxt < lim)
  SELECT n - 1 - p AS position, {sql_snap('y', 'eps')} FROM s JOIN hit ON p = tp""")
def _knee(spark, sf_dir):
    found = density.knee(density.k_distances(points(spark, sf_dir), ["x", "y"], 3))
    return spark.createDataFrame([] if found is None else [found], "position bigint, y double").select("position", snap("y").alias("eps"))


def _huber_sql(rounds: int = 80) -> str:
    """Reweighted steps in turn for scale and coefficients, enough of them to stand still."""
    ctes = [PULLS, "h AS (SELECT trace, i, d AS x, f AS y FROM pulls)"]
    for k in range(rounds + 1):
        if k:
            ctes.append(f"""r{k} AS MATERIALIZED (SELECT trace, s AS s0, avg(least(pow(y - a0 - a1 * x - a2 * x * x, 2), pow(1.35 * s, 2))) AS s2
              FROM h JOIN c{k - 1} USING (trace) GROUP BY 1, 2)""")
        source = (f"(SELECT trace, x, y, 1 / greatest(abs(y - a0 - a1 * x - a2 * x * x) / (1.35 * sqrt(s2)), 1) AS w, sqrt(s2) AS s FROM h JOIN c{k - 1} USING (trace) JOIN r{k} USING (trace))"
                  if k else "(SELECT trace, x, y, 1.0 AS w, 0.0 AS s FROM h)")
        ctes.append(f"""m{k} AS (SELECT trace, any_value(s) AS s, sum(w) AS p0, sum(w*x) AS p1, sum(w*x*x) AS b2, sum(w*x*x) + any_value(s)*1e-4 AS p2, sum(w*x*x*x) AS p3,
              sum(w*x*x*x*x) + any_value(s)*1e-4 AS p4, sum(w*y) AS q0, sum(w*x*y) AS q1, sum(w*x*x*y) AS q2 FROM {source} GROUP BY 1)""")
        ctes.append(f"""d{k} AS (SELECT *, p0*(p2*p4-p3*p3)-p1*(p1*p4-p3*b2)+b2*(p1*p3-p2*b2) AS det FROM m{k})""")
        ctes.append(f"""e{k} AS (SELECT trace, s, (q0*(p2*p4-p3*p3)-p1*(q1*p4-p3*q2)+b2*(q1*p3-p2*q2))/det AS a0,
              (p0*(q1*p4-p3*q2)-q0*(p1*p4-p3*b2)+b2*(p1*q2-q1*b2))/det AS a1, (p0*(p2*q2-q1*p3)-p1*(p1*q2-q1*b2)+q0*(p1*p3-p2*b2))/det AS a2 FROM d{k})""")
        ctes.append(f"c{k} AS MATERIALIZED (SELECT trace, a0, a1, a2, s FROM e{k})" if k else
                    "c0 AS MATERIALIZED (SELECT trace, any_value(a0) AS a0, any_value(a1) AS a1, any_value(a2) AS a2, sqrt(avg(pow(y - a0 - a1 * x - a2 * x * x, 2))) AS s FROM h JOIN e0 USING (trace) GROUP BY 1)")
    return f"WITH {', '.join(ctes)} SELECT trace, {sql_snap('a2', 'a2')}, {sql_snap('a1', 'a1')}, {sql_snap('a0', 'a0')}, {sql_snap('s', 'scale')} FROM c{rounds}"


@query("huber_polynomial", _huber_sql())
def _huber_poly(spark, sf_dir):
    out = huberpoly.huber_polynomial(pulls(spark, sf_dir), "d", "f", 2)
    return out.select("trace", *[snap(F.col("coeffs")[k]).alias(f"a{2 - k}") for k in range(3)], snap("scale").alias("scale"))


PASSIVE = f"""WITH {PULLS}, s AS (SELECT trace, i, d, d * 0.9 + i / 1000.0 AS p, f2 AS f FROM pulls), seg AS (SELECT trace, i // 100 AS k, i, p, abs(f - 25) AS gap FROM s WHERE i % 100 < 40),
  near AS (SELECT trace, k, min({{'gap': gap, 'i': i, 'p': p}}) AS b FROM seg GROUP BY 1, 2),
  pair AS (SELECT trace, k, lead(k) OVER w AS next_k, CASE WHEN b.gap <= 0.5 AND (lead(b) OVER w).gap <= 0.5 THEN b END AS a, lead(b) OVER w AS z FROM near WINDOW w AS (PARTITION BY trace ORDER BY k)),
  o AS (SELECT pair.trace, k, next_k, CASE WHEN a IS NOT NULL THEN z.p - a.p END AS dext, x.d / {sql_eps('x.f', 50, 1200)} AS l1, y.d / {sql_eps('y.f', 50, 1200)} AS l2
    FROM pair LEFT JOIN s x ON x.trace = pair.trace AND x.i = a.i LEFT JOIN s y ON y.trace = pair.trace AND y.i = CASE WHEN a IS NOT NULL THEN z.i - 1 END WHERE next_k IS NOT NULL),
  q AS (SELECT *, dext / {sql_eps('25.0', 50, 1200)} AS pred, l2 - l1 AS obs FROM o)"""


@query("passive_metrics", f"""{PASSIVE} SELECT trace, k, next_k, {sql_snap('dext', 'dext')}, {sql_snap('pred', 'dlc_pred')}, {sql_snap('obs', 'dlc_obs')},
  {sql_snap('(obs - pred) / nullif(pred, 0) * 100', 'percent_error')}, {sql_snap('pred / nullif(obs, 0)', 'correction_factor')} FROM q""")
def _passive(spark, sf_dir):
    s = pulls(spark, sf_dir, reuse=True).withColumn("p", F.col("d") * 0.9 + F.col("i") / 1000.0)
    seg = s.where("i % 100 < 40").groupBy("trace", F.expr("i div 100").alias("k")).agg(F.min("i").alias("start"), (F.max("i") + 1).alias("stop"))
    out = stats.passive_metrics(s, layout.settle(seg), "p", "d", "f2", 25.0, 0.5, 50.0, 1200.0)
    return out.select("trace", "k", "next_k", *[snap(c).alias(c) for c in ("dext", "dlc_pred", "dlc_obs", "percent_error", "correction_factor")])


@query("stale_stages", """WITH RECURSIVE needs AS (SELECT * FROM (VALUES ('filter', 'load'), ('align', 'filter'), ('annotate', 'align'), ('length', 'filter'), ('merge', 'annotate'), ('merge', 'length')) t(stage, needs)),
  stages AS (SELECT DISTINCT stage FROM needs UNION SELECT 'load'), own AS (SELECT c_custkey AS trace, stage,
    CASE WHEN c_custkey % 7 = 3 AND stage = 'length' THEN 'forced' WHEN c_nationkey = 5 AND stage = 'align' THEN 'new'
      WHEN length(stage) = c_custkey % 11 THEN 'changed' END AS reason FROM customer, stages),
  mark AS (SELECT trace, stage FROM own WHERE reason IS NOT NULL UNION SELECT m.trace, n.stage FROM mark m JOIN needs n ON n.needs = m.stage)
  SELECT trace, stage, coalesce(reason, 'follows') AS reason FROM mark JOIN own USING (trace, stage)""")
def _stale_stages(spark, sf_dir):
    needs = spark.sql("select * from values ('filter', 'load'), ('align', 'filter'), ('annotate', 'align'), ('length', 'filter'), "
                      "('merge', 'annotate'), ('merge', 'length') t(stage, needs)")
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey trace", "c_nationkey nation")
    stages = F.array(*[F.lit(x) for x in ("load", "filter", "align", "annotate", "length", "merge")])
    every = c.withColumn("stage", F.explode(stages))
    sign = lambda df, factor: df.select("trace", "stage", incremental.signature(F.struct("stage", factor.alias("factor"))).alias("signature"))
    wanted = sign(every, F.lit(25))
    stored = sign(every.where("not (nation = 5 and stage = 'align')"), F.when(F.length("stage") == F.col("trace") % 11, 24).otherwise(25))
    forced = every.where("trace % 7 = 3 and stage = 'length'")
    return incremental.stale_stages(wanted, stored, needs, forced)
