"""Queries on distributions, robust statistics and trace filters."""
from __future__ import annotations

from pyspark.sql import functions as F

from tracespool.catalog.registry import query
from tracespool.catalog.views import PULLS, SIGNALS, pulls, signals, snap, sql_snap, table
from tracespool.functions import physics, wlc
from tracespool.operators import stats
from tracespool.plans import layout


@query("trace_mad", f"""WITH {SIGNALS}, m AS (SELECT trace, count(*) AS n, quantile_cont(x,0.5) AS median FROM signals GROUP BY 1)
  SELECT s.trace, m.n, {sql_snap('any_value(m.median)','median')}, {sql_snap('quantile_cont(abs(x-m.median),0.5)','mad')},
  {sql_snap('1.4826*quantile_cont(abs(x-m.median),0.5)','sigma')} FROM signals s JOIN m USING(trace) GROUP BY s.trace, m.n""")
def _mad(spark, sf_dir):
    out = stats.mad(signals(spark, sf_dir, reuse=True), ["trace"], "x", layout.spread)
    return out.select("trace", "n", *[snap(c).alias(c) for c in ("median", "mad", "sigma")])


@query("pooled_mad", f"""WITH m AS (SELECT quantile_cont(l_extendedprice,0.5) AS md FROM lineitem)
  SELECT count(*) AS n, {sql_snap('any_value(md)','median')}, {sql_snap('quantile_cont(abs(l_extendedprice-md),0.5)','mad')} FROM lineitem, m""")
def _pooled_mad(spark, sf_dir):
    df = stats.pooled(table(spark, sf_dir, "lineitem").select("l_extendedprice"))
    out = stats.mad(df, ["_all"], "l_extendedprice", stats.by_bins(["_all"]))
    return out.select("n", snap("median").alias("median"), snap("mad").alias("mad"))


@query("clip_to_quantile", f"""WITH {SIGNALS}, m AS (SELECT trace, quantile_cont(x,0.5) AS md FROM signals GROUP BY 1),
  t AS (SELECT s.trace, any_value(md) AS md, quantile_cont(abs(x-md),0.9) AS thr FROM signals s JOIN m USING(trace) GROUP BY 1)
  SELECT trace, i, {sql_snap('greatest(least(x,md+thr),md-thr)','x')} FROM signals JOIN t USING(trace)""")
def _clip(spark, sf_dir):
    s = signals(spark, sf_dir, reuse=True).select("trace", "i", "n", "chunk", "x")
    out = stats.clip_symmetric(s, ["trace"], "x", 0.9, layout.spread)
    return out.select("trace", "i", snap("clipped").alias("x"))


@query("tukey_fence", f"""WITH {SIGNALS}, q AS (SELECT trace, quantile_cont(x,0.25) AS a, quantile_cont(x,0.75) AS b FROM signals GROUP BY 1)
  SELECT trace, {sql_snap('a','q1')}, {sql_snap('a-1.5*(b-a)','lower')}, {sql_snap('b+1.5*(b-a)','upper')} FROM q""")
def _tukey(spark, sf_dir):
    out = stats.tukey_fence(signals(spark, sf_dir), ["trace"], "x", layout.spread)
    return out.select("trace", *[snap(c).alias(c) for c in ("q1", "lower", "upper")])


@query("empirical_cdf", f"""WITH {SIGNALS}, g AS (SELECT trace, x, count(*) AS c FROM signals GROUP BY 1,2)
  SELECT trace, x, {sql_snap('sum(c) OVER (PARTITION BY trace ORDER BY x)/sum(c) OVER (PARTITION BY trace)','cdf')} FROM g""")
def _ecdf(spark, sf_dir):
    return stats.ecdf(signals(spark, sf_dir), ["trace"], "x").select("trace", "x", snap("cdf").alias("cdf"))


@query("pooled_cdf", f"""WITH g AS (SELECT l_quantity AS x, count(*) AS c FROM lineitem GROUP BY 1)
  SELECT CAST(x AS DOUBLE) AS x, {sql_snap('sum(c) OVER (ORDER BY x)/sum(c) OVER ()','cdf')} FROM g""")
def _pooled_cdf(spark, sf_dir):
    df = stats.pooled(table(spark, sf_dir, "lineitem").select("l_quantity"))
    df = df.withColumn("l_quantity", F.col("l_quantity").cast("double"))
    return stats.ecdf(df, ["_all"], "l_quantity").select("x", snap("cdf").alias("cdf"))


@query("residence_time", f"""WITH {SIGNALS}, e AS (SELECT trace, min(x) AS lo, max(x) AS hi FROM signals GROUP BY 1),
  b AS (SELECT trace, lo, unnest(range(CAST(ceil((hi+7.5-lo)/7.5) AS BIGINT)-1)) AS bin FROM e)
  SELECT b.trace, b.bin, {sql_snap('any_value(0.5*((lo+bin*7.5)+(lo+(bin+1)*7.5)))','center')}, {sql_snap('count(s.x)*0.5','tau')} FROM b
  LEFT JOIN signals s ON s.trace=b.trace AND s.x>=lo+bin*7.5 AND s.x<lo+(bin+1)*7.5 GROUP BY 1,2""")
def _residence(spark, sf_dir):
    out = stats.residence_time(signals(spark, sf_dir, reuse=True), "x", 7.5, 0.5)
    return out.select("trace", "bin", snap("center").alias("center"), snap("tau").alias("tau"))


@query("histogram_sturges", f"""WITH e AS (SELECT count(*) AS n, min(value) AS lo, max(value) AS hi, CAST(ceil(log2(count(*)))+1 AS BIGINT) AS b FROM events),
  g AS (SELECT *, (hi-lo)/b AS w, unnest(range(b)) AS bin FROM e)
  SELECT bin, {sql_snap('any_value(lo+bin*w)','left_edge')}, count(value) AS count, {sql_snap('count(value)/any_value(n*w)','density')}
  FROM g LEFT JOIN events ON value>=lo+bin*w AND (value<lo+(bin+1)*w OR (bin=b-1)) GROUP BY bin""")
def _hist(spark, sf_dir):
    df = table(spark, sf_dir, "events").select(F.col("value").cast("double").alias("value"))
    out = stats.histogram(df, "value")
    return out.select("bin", snap("left_edge").alias("left_edge"), "count", snap("density").alias("density"))


@query("joint_histogram", """SELECT CAST(floor(l_quantity/10) AS BIGINT) AS bx, CAST(floor(l_extendedprice/20000) AS BIGINT) AS by, count(*) AS n
  FROM lineitem GROUP BY GROUPING SETS ((1,2),(1),(2))""")
def _joint(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return stats.joint_histogram(df, "l_quantity", "l_extendedprice", 10, 20000)


@query("binned_summary", f"""WITH e AS (SELECT unnest(range(5)) AS b), x AS (SELECT CAST(floor(l_quantity/10) AS INT) AS b, l_extendedprice AS v FROM lineitem WHERE l_quantity<50)
  SELECT CAST(e.b AS INT) AS bin, e.b*10.0+5 AS center, CASE WHEN count(v)>=11900 THEN {sql_snap('quantile_cont(v,0.5)')} END AS median,
   CASE WHEN count(v)>=11900 THEN {sql_snap('quantile_cont(v,0.25)')} END AS q25, CASE WHEN count(v)>=11900 THEN {sql_snap('quantile_cont(v,0.75)')} END AS q75,
   count(v) AS n FROM e LEFT JOIN x ON x.b=e.b GROUP BY e.b""")
def _binned(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("f"), F.col("l_extendedprice").alias("v"))
    out = stats.binned_summary(df, "f", "v", [0, 10, 20, 30, 40, 50], 11900)
    return out.select("bin", "center", *[snap(c).alias(c) for c in ("median", "q25", "q75")], "n")


SINGLE = "(4.11/50)*(0.25/((1-d/1.2)*(1-d/1.2))-0.25+d/1.2)"


@query("rmsd_to_model", f"""WITH {PULLS} SELECT trace, count(*) AS points, {sql_snap(f'sqrt(avg((f-{SINGLE})*(f-{SINGLE})))','rmsd')}
  FROM pulls WHERE d>0.1 AND d<0.9 AND f>5 AND f<45 GROUP BY 1""")
def _rmsd(spark, sf_dir):
    df = pulls(spark, sf_dir)
    d, f = F.col("d"), F.col("f")
    out = stats.rmsd(df, f, wlc.force_udf((50, 1.2))(d), physics.box(d, f, (0.1, 0.9), (5, 45)))
    return out.select("trace", "points", snap("rmsd").alias("rmsd"))


@query("force_from_extension", f"""WITH {PULLS}, near AS (SELECT trace, i, d*0.8 AS d FROM pulls)
  SELECT trace, i, {sql_snap(SINGLE,'force')} FROM near""")
def _inverse(spark, sf_dir):
    df = pulls(spark, sf_dir).withColumn("d", F.col("d") * 0.8)  # below the contour length everywhere
    return df.select("trace", "i", snap(wlc.force_single(F.col("d"), 50, 1.2)).alias("force"))


@query("extension_round_trip", f"WITH {PULLS} SELECT trace, i, {sql_snap('f','force')} FROM pulls")
def _round_trip(spark, sf_dir):
    model = ((50, 0.69, 1200), (0.65, 0.013))
    df = pulls(spark, sf_dir).withColumn("x", wlc.extension(F.col("f"), *model))
    return df.select("trace", "i", snap(wlc.force_udf(*model)(F.col("x"))).alias("force"))


@query("nominal_rate", f"""WITH {SIGNALS}, d AS (SELECT trace, t-lag(t) OVER (PARTITION BY trace ORDER BY i) AS dt FROM signals),
  m AS (SELECT trace, min(dt) AS lo FROM d WHERE dt>0 GROUP BY 1)
  SELECT trace, {sql_snap('1/quantile_cont(dt,0.5)','rate')} FROM d JOIN m USING(trace) WHERE dt>0 AND dt<=1.5*lo GROUP BY 1""")
def _rate(spark, sf_dir):
    return stats.nominal_rate(signals(spark, sf_dir), "t").select("trace", snap("rate").alias("rate"))


@query("filter_statistics", """SELECT o_orderstatus AS category, count(DISTINCT o_custkey) AS traces,
  count(*) FILTER (o_totalprice>200000) AS large FROM orders GROUP BY 1""")
def _filter_stats(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("category")).agg(
        F.countDistinct("o_custkey").alias("traces"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))


@query("trace_filter", f"""WITH {PULLS}, p AS (SELECT trace, max(d)-min(d) AS size, min_by(f,i) AS f0, max_by(f,i) AS f1, stddev_pop(d) AS r FROM pulls GROUP BY 1)
  SELECT trace, array_to_string(list_filter([CASE WHEN NOT size BETWEEN 0.95 AND 1.02 THEN 6 END, CASE WHEN NOT f0<40 THEN 7 END,
   CASE WHEN NOT f1>8 THEN 8 END, CASE WHEN NOT r<0.27 THEN 9 END], lambda c: c IS NOT NULL), ',') AS codes FROM p""")
def _filter(spark, sf_dir):
    per = pulls(spark, sf_dir).groupBy("trace").agg(
        (F.max("d") - F.min("d")).alias("size"), F.min_by("f", "i").alias("initial_force"),
        F.max_by("f", "i").alias("final_force"), F.stddev_pop("d").alias("rmsd"))
    out = stats.trace_filter(per, (0.95, 1.02), 40, 8, 0.27)
    return out.select("trace", F.array_join("codes", ",").alias("codes"))


@query("first_last_transition", """SELECT o_custkey AS trace, count(*) AS transitions, min(o_orderkey) AS first_at, max(o_orderkey) AS last_at,
  min_by(o_totalprice,o_orderkey) AS first_force, coalesce(max_by(CASE WHEN o_orderstatus='F' THEN NULL ELSE o_totalprice END,
   CASE WHEN o_orderstatus='F' THEN NULL ELSE o_orderkey END), max(o_totalprice)) AS total FROM orders GROUP BY 1""")
def _first_last(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ok = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice"))
    at = F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey"))
    return o.groupBy(F.col("o_custkey").alias("trace")).agg(
        F.count("*").alias("transitions"), F.min("o_orderkey").alias("first_at"), F.max("o_orderkey").alias("last_at"),
        F.min_by("o_totalprice", "o_orderkey").alias("first_force"),
        F.coalesce(F.max_by(ok, at), F.max("o_totalprice")).alias("total"))


@query("standardise_columns", f"""WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS s, avg(l_extendedprice) AS b, stddev_pop(l_extendedprice) AS r FROM lineitem)
  SELECT l_suppkey AS trace, {sql_snap('avg((l_quantity-a)/s)','q')}, {sql_snap('max((l_extendedprice-b)/r)','p')} FROM lineitem, m GROUP BY 1""")
def _standardise(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey trace", "cast(l_quantity as double) q", "l_extendedprice p")
    out = stats.standardise(df, ["q", "p"])
    return out.groupBy("trace").agg(snap(F.avg("q")).alias("q"), snap(F.max("p")).alias("p"))


def _pair_sql(col):
    return f"""WITH {SIGNALS}, pr AS (SELECT a.trace, CAST(floor(abs(a.x-b.x)/(100.0371/20)) AS INT) AS bin, (a.t+b.t)/2 AS w
    FROM signals a JOIN signals b USING(trace) WHERE abs(a.x-b.x)<=100.0371),
   g AS (SELECT DISTINCT trace, unnest(range(20))::INT AS bin FROM signals),
   h AS (SELECT g.trace, g.bin, coalesce({col},0) AS c FROM g LEFT JOIN pr USING(trace,bin) GROUP BY 1,2)
  SELECT trace, bin, {sql_snap('c/sum(c) OVER (PARTITION BY trace)/(100.0371/20)','density')} FROM h"""


@query("pair_distance_density", _pair_sql("count(w)"))
def _pairs(spark, sf_dir):
    out = stats.pair_distances(signals(spark, sf_dir), "x", 100.0371, 20)
    return out.select("trace", "bin", snap("density").alias("density"))


@query("pair_distance_density_weighted", _pair_sql("sum(w)"))
def _pairs_weighted(spark, sf_dir):
    out = stats.pair_distances(signals(spark, sf_dir), "x", 100.0371, 20, "t")
    return out.select("trace", "bin", snap("density").alias("density"))
