"""Written tables are judged by the size of their rows, not by that of their files."""
from tracespool.plans import layout


def test_small_files_with_many_rows_are_not_broadcast(spark):
    rows = spark.range(1_000_000).selectExpr("id div 4 as trace", "0L as i", "id % 4 as k")
    table = layout.settle(layout.index_samples(rows.where("trace < 3"), ["i", "k"]).limit(1).select("trace"))  # any ordered table
    large = layout.settle(rows.select("trace", "k"))
    plan = large.join(large.withColumnRenamed("k", "k2"), "trace")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" not in plan
    small = large.join(table, "trace")._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in small
