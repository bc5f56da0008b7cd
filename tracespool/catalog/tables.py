"""Queries on sources, checks and identifiers."""
from __future__ import annotations

from pyspark.sql import functions as F

from tracespool.catalog.registry import query
from tracespool.catalog.views import PULLS, SIGNALS, pulls, signals, table
from tracespool.functions import ids
from tracespool.sources import quality, records, scan

RAMP_IDS = """ids AS (SELECT strftime(o_orderdate,'%y%m%d')||'_'||(o_custkey%7)||'_'||o_orderkey
  ||'_fec'||CASE WHEN o_orderstatus='F' THEN 'R' ELSE 'S' END||'0'||(o_orderkey%4) AS name FROM orders)"""
MOTOR_IDS = """ids AS (SELECT strftime(o_orderdate,'%y%m%d')||'_'||(o_custkey%7)||'_'||o_custkey||'_'
  ||CASE WHEN o_orderkey%11=0 THEN 'x' WHEN o_orderkey%3=0 THEN 'fecS0' WHEN o_orderkey%3=1 THEN 'dct0'
    ELSE 'spm0' END||(o_orderkey%4) AS name FROM orders)"""


def _stem(name=None):
    return [F.date_format("o_orderdate", "yyMMdd"), F.lit("_"), F.col("o_custkey") % 7, F.lit("_")]


def ramp_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "R").otherwise("S")
    return o.select(F.concat(*_stem(), "o_orderkey", F.lit("_fec"), kind, F.lit("0"),
                             F.col("o_orderkey") % 4).alias("name"))


def motor_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    kind = (F.when(k % 11 == 0, "x").when(k % 3 == 0, "fecS0").when(k % 3 == 1, "dct0")
            .otherwise("spm0"))
    return o.select(F.concat(*_stem(), "o_custkey", F.lit("_"), kind, k % 4).alias("name"))


@query("scan_pruned", "SELECT l_suppkey AS trace, sum(CAST(l_quantity AS BIGINT))::BIGINT AS total, "
       "count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' GROUP BY 1")
def _scan(spark, sf_dir):
    df = scan.scan(spark, f"{sf_dir}/lineitem.parquet", ["l_suppkey", "l_quantity", "l_shipdate"])
    return (df.where("l_shipdate >= timestamp_ntz'1997-01-01'").groupBy(F.col("l_suppkey").alias("trace"))
            .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("total"), F.count("*").alias("n")))


@query("scan_many_datasets", "SELECT 'orders' AS source, count(*) AS n, count(DISTINCT o_custkey) AS traces "
       "FROM orders")
def _datasets(spark, sf_dir):
    root, leaf = sf_dir.rstrip("/").rsplit("/", 1)
    df = scan.scan_datasets(spark, [f"{root}/{leaf}"], "o*.parquet", ["o_custkey"], exclude=["_out.parquet"])
    stem = F.regexp_extract("source", r"([^/]+)\.parquet$", 1)
    return df.groupBy(stem.alias("source")).agg(F.count("*").alias("n"),
                                                F.countDistinct("o_custkey").alias("traces"))


@query("trace_violations", """WITH g AS (SELECT o_custkey AS trace, count(DISTINCT o_orderstatus) AS s,
  count(DISTINCT o_orderpriority) AS p FROM orders GROUP BY 1)
  SELECT trace, 'varying_o_orderstatus' AS rule FROM g WHERE s>1
  UNION ALL SELECT trace, 'varying_o_orderpriority' FROM g WHERE p>1""")
def _violations(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "trace")
    return quality.trace_violations(o, ["o_orderstatus", "o_orderpriority"])


@query("position_violations", f"WITH {SIGNALS} SELECT trace, 'broken_positions' AS rule FROM signals "
       "WHERE x > 3 GROUP BY trace HAVING min(i)<>0 OR max(i)<>count(*)-1")
def _positions(spark, sf_dir):
    return quality.trace_violations(signals(spark, sf_dir).where("x > 3"))


@query("unmatched_ids", """SELECT c_custkey AS trace, 'no_events' AS rule FROM customer
  WHERE c_custkey NOT IN (SELECT user_id FROM events)
  UNION ALL SELECT DISTINCT user_id, 'no_customer' FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)""")
def _unmatched(spark, sf_dir):
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("trace"))
    user = table(spark, sf_dir, "events").select(F.col("user_id").alias("trace"))
    return (quality.unmatched(cust, user, ["trace"], "no_events")
            .unionAll(quality.unmatched(user, cust, ["trace"], "no_customer")))


@query("union_by_name", """SELECT n_nationkey AS id, n_name AS name, CAST(NULL AS DOUBLE) AS bal FROM nation
  UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier
  UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer""")
def _union(spark, sf_dir):
    a = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) id", "n_name name")
    b = table(spark, sf_dir, "supplier").selectExpr("s_suppkey id", "s_name name", "s_acctbal bal")
    c = table(spark, sf_dir, "customer").selectExpr("c_acctbal bal", "c_name name", "c_custkey id")
    return scan.union_sources(a, b, c)


@query("record_round_trip", f"WITH {SIGNALS} SELECT trace, i, n, t AS time, x AS value FROM signals")
def _records(spark, sf_dir):
    rec = records.to_records(signals(spark, sf_dir), ["t", "x"])
    rows = records.to_rows(rec, ["i", "t", "x"], {"t": "time", "x": "value"})
    return rows.select("trace", "i", "n", "time", "value")


@query("kept_split", """SELECT s_nationkey%2=0 AS kept, count(*) AS n, count(DISTINCT l_suppkey) AS traces
  FROM lineitem JOIN supplier ON s_suppkey=l_suppkey GROUP BY 1""")
def _kept(spark, sf_dir):
    keep = table(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0").selectExpr("s_suppkey trace")
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey trace")
    return scan.mark_kept(rows, keep).groupBy("kept").agg(
        F.count("*").alias("n"), F.countDistinct("trace").alias("traces"))


@query("annotation_rows", """WITH o AS (SELECT o_custkey AS trace, o_orderkey AS pos, o_totalprice AS v,
    CASE WHEN o_custkey%2=0 THEN 'S' ELSE 'R' END AS curve_type FROM orders)
  SELECT trace, curve_type, CASE WHEN curve_type='S'
    THEN row_number() OVER (PARTITION BY trace ORDER BY pos)
    ELSE row_number() OVER (PARTITION BY trace ORDER BY pos DESC) END - 1 AS k, pos, v FROM o""")
def _annotation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_custkey trace", "o_orderkey pos", "o_totalprice v")
    per = o.groupBy("trace").agg(F.count("*").alias("expected")).withColumn(
        "curve_type", F.expr("if(trace % 2 = 0, 'S', 'R')"))
    return records.annotation_rows(o, per, "pos").select("trace", "curve_type", "k", "pos", "v")


@query("parse_ramp_ids", f"""WITH {RAMP_IDS} SELECT name AS trace, '20'||split_part(name,'_',1) AS date,
  CAST(split_part(name,'_',2) AS INT) AS bead_set, split_part(name,'_',3) AS mol_id,
  substr(split_part(name,'_',4),4,1) AS curve_type, substr(split_part(name,'_',4),5) AS curve_number FROM ids""")
def _ramp(spark, sf_dir):
    raw = ramp_ids(spark, sf_dir).select(F.concat(F.lit("rawdat/20:11 FD Curve "), "name", F.lit(".h5")).alias("name"))
    return raw.select(ids.parse_ramp(F.col("name")).alias("p")).select("p.*")


@query("parse_motor_ids", f"""WITH {MOTOR_IDS}, t AS (SELECT name, split_part(name,'_',4) AS tok FROM ids)
  SELECT name AS trace, '20'||split_part(name,'_',1) AS date, CAST(split_part(name,'_',2) AS INT) AS bead_set,
  split_part(name,'_',3) AS mol_id,
  CASE length(tok) WHEN 6 THEN substr(tok,1,4) WHEN 5 THEN substr(tok,1,3) END AS curve_type,
  CASE length(tok) WHEN 6 THEN substr(tok,5) WHEN 5 THEN substr(tok,4) END AS curve_number FROM t""")
def _motor(spark, sf_dir):
    return motor_ids(spark, sf_dir).select(ids.parse_motor(F.col("name")).alias("p")).select("p.*")


@query("baseline_ids", f"""WITH {MOTOR_IDS}, b AS (SELECT name, split_part(name,'_',1)||'_'||split_part(name,'_',2)||'_fec' AS stem,
    right(name,2) AS num FROM ids)
  SELECT name, stem||'00' AS ramp_bl,
   stem||CASE WHEN num IN ('00','01') THEN '01' WHEN num IN ('02','03') THEN '02' END AS motor_bl,
   stem||CASE WHEN name LIKE '%spm0_' OR name LIKE '%dct0_' THEN CASE WHEN num IN ('01','02') THEN num END END AS drift_bl,
   stem||'01'||','||stem||'02'||','||stem||'03' AS set_bl FROM b""")
def _baselines(spark, sf_dir):
    c = F.col("name")
    return motor_ids(spark, sf_dir).select(
        "name", ids.ramp_baseline(c).alias("ramp_bl"), ids.motor_baseline(c).alias("motor_bl"),
        ids.drift_baseline(c).alias("drift_bl"), F.array_join(ids.set_baselines(c), ",").alias("set_bl"))


SETS = MOTOR_IDS + """, s AS (SELECT DISTINCT name,
  split_part(name,'_',1)||'_'||split_part(name,'_',2)||'_'||split_part(name,'_',3) AS base, split_part(name,'_',4) AS run FROM ids)"""


@query("molecule_sets", f"""WITH {SETS} SELECT base, count(*) FILTER (run LIKE 'fecS%') AS ramps,
  count(*) FILTER (run LIKE 'dct%' OR run LIKE 'spm%') AS passive, min(run) AS first_run FROM s GROUP BY base""")
def _sets(spark, sf_dir):
    c = F.col("name")
    s = motor_ids(spark, sf_dir).distinct().select(ids.trace_base(c).alias("base"), ids.run_type(
        F.substring_index(c, "_", -1)).alias("run"))
    return s.groupBy("base").agg(
        F.count_if(F.col("run").startswith("fecS")).alias("ramps"),
        F.count_if(F.col("run").rlike("^(dct|spm)")).alias("passive"), F.min("run").alias("first_run"))
