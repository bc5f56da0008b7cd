import random

from pyspark.sql import functions as F

from tracespool.llm import replytrees

SCHEMA = "tree long, node long, parent long, role string, text string, score double, known string"


def slow(rows):
    nodes = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[3] or "", r[4] or "", r[5] or 0.0)):
        nodes.setdefault((r[0], r[1]), r)
    out = {}
    parents = {(t, r[2]) for (t, _), r in nodes.items()}
    for tree, node in nodes:
        if node is None or (tree, node) in parents:
            continue
        path, at = [], node
        while at is not None and (tree, at) in nodes and at not in path:
            path.append(at)
            at = nodes[tree, at][2]
        if at in path:
            continue
        mean = sum(nodes[tree, n][5] or 0.0 for n in path) / len(path)
        turns = [(nodes[tree, n][3] or "", nodes[tree, n][4] or "") for n in reversed(path)]
        out.setdefault(tree, []).append((-mean, node, turns))
    return {t: min(x)[1:] for t, x in out.items()}


def test_trees_against_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "</s>[INST] ok [/INST]", "\\l \\\\b <|user|> \\", "plain", "ünï\n\n", "a|b"]
    rows = []
    for tree in range(30):
        for node in range(rng.randrange(1, 40)):
            parent = rng.choice([None, 99, *range(max(0, node - 3), node)]) if node else None
            rows.append((tree, node, parent, rng.choice(["user", "assistant", None, "a|>b<"]), rng.choice(texts), rng.choice([None, 0.5, 1.0, 2.0]), "x"))
    rows += [(50, 1, 2, "user", "x", 1.0, "x"), (50, 2, 1, "user", "y", 1.0, "x"), (50, 3, 2, "user", "z", 1.0, "x"), (51, None, 1, "u", "t", 1.0, "x"), rows[0]]
    rows += [(60, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"t{i}", None, "x") for i in range(300)]
    got = replytrees.read_back(replytrees.format_trees(spark.createDataFrame(rows, SCHEMA))).collect()
    want = slow(rows)
    assert {r.tree: (r.leaf, [(t.role, t.text) for t in r.read]) for r in got} == want
    for r in got:
        assert r.learned == "".join(t for role, t in want[r.tree][1] if role == "assistant")
        assert r.formatted.count("</s>") == len(r.read) and "[" not in r.formatted


def test_native_plan_and_empty(spark):
    out = replytrees.format_trees(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()


def test_escape_round_trip(spark):
    texts = ["\\", "\\\\l", "<\\l[", "\\b[\\", "", "\\p|"]
    back = spark.createDataFrame([(t,) for t in texts], "t string").select("t", replytrees.unescape(replytrees.escape(F.col("t"))).alias("u"))
    assert all(r.t == r.u for r in back.collect())


def test_rows_without_an_id_are_one_conversation(spark, tmp_path):
    import duckdb

    from check import compare
    from tracespool.llm.catalog import QUERIES, SQL
    rows = [(1, 0, "user", "hi"), (None, 1, "assistant", "b"), (None, 0, "user", "a"), (1, 1, "assistant", None), (None, None, "user", "first"), (0, 0, None, "[x]"), (1, 1, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    name = "op10_reply_trees"
    assert compare(spark, con, name, QUERIES[name], SQL[name], str(tmp_path)) == ""
    got = {r.conv_id: r.n_turns for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {1: 3, None: 3, 0: 1, -1: 2}
