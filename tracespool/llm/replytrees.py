r"""Reply trees to conversations: root-to-leaf paths by iterative self-joins, ranked by score, formatted as chats.

Only DataFrame functions run here.  Nodes are ``tree, node, parent, role, text, score``; a root has a null parent.  A
node whose parent is missing counts as a root, cycles are left out (they have no root), and repeated node ids keep
the row that sorts first by role, text and score.  Null roles and texts are empty, null scores zero.

Paths are found by doubling: ancestor tables of distance 1, 2, 4, ... need log2(depth) self-joins, and every table is
written to the shared folder, so lost executors cost one step at most.

Format: each turn is ``<|role|>text</s>``.  In texts the characters ``\ < [`` are escaped as ``\\ \l
\b``, so no control string (``</s>``, ``[INST]``, ``<|user|>``) can occur in a text, and `unescape` restores it;
roles also escape ``|`` as ``\\p``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracespool.plans.layout import settle

OPEN, CLOSE, END = "<|", "|>", "</s>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("<"), F.lit("\\l"))
    return F.replace(out, F.lit("["), F.lit("\\b"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("|"), F.lit("\\p"))


def unescape(text: Column) -> Column:
    """Read the text in pieces between doubled escapes, so that a plain backslash before a letter stays."""
    def piece(part: Column) -> Column:
        for code, char in (("\\l", "<"), ("\\b", "["), ("\\p", "|")):
            part = F.replace(part, F.lit(code), F.lit(char))
        return part
    return F.array_join(F.transform(F.split(text, r"\\\\"), piece), "\\")


def ancestors(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(tree, leaf, node, above) of every leaf's path; above: steps from the leaf.  Leaves below a cycle are left out."""
    jump = settle(nodes.where("parent is not null").select("tree", "node", F.col("parent").alias("up")))
    size, jumps = jump.count(), []
    while (1 << len(jumps)) <= size and not jump.isEmpty():
        jumps.append(jump)
        nxt = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"))
        jump = settle(jump.join(nxt, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up")))
    # a chain as long as the table has nodes can only run in a cycle
    bad = jump.select("tree", F.col("node").alias("leaf"))
    paths = (leaves.join(bad, ["tree", "leaf"], "left_anti")
             .select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("above")))
    for k in range(len(jumps) - 1, -1, -1):
        here, there = F.struct("node", "above"), F.struct(F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        both = F.when(F.col("up").isNull(), F.array(here)).otherwise(F.array(here, there))
        paths = (paths.join(jumps[k], ["tree", "node"], "left").select("tree", "leaf", F.explode(both).alias("at"))
                 .select("tree", "leaf", "at.node", "at.above"))
    return paths


def chain(rows: DataFrame, tree: str, order: str) -> DataFrame:
    """Nodes of linear conversations: rows by ``order`` (ties by role, then text), each the reply to the one before."""
    by = Window.partitionBy(tree).orderBy(order, F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    numbered = rows.select(F.col(tree).alias("tree"), F.row_number().over(by).cast("long").alias("node"), "role", "text")
    return numbered.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text",
                           F.lit(0.0).alias("score"))


def clean(nodes: DataFrame) -> DataFrame:
    """One row per (tree, node) with no null role, text or score."""
    one = nodes.where("tree is not null and node is not null").groupBy("tree", "node").agg(F.min(F.struct(
        "parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))).alias("row"))
    return one.select("tree", "node", "row.*")


def linked(nodes: DataFrame) -> DataFrame:
    """tree, node, parent and score, the parent null where no such node exists."""
    bare = nodes.select("tree", "node", "parent", "score")
    known = bare.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    return (bare.join(known, ["tree", "parent"], "left")
            .select("tree", "node", F.when(F.col("known"), F.col("parent")).alias("parent"), "score"))


def paths(nodes: DataFrame, top: int = 1) -> DataFrame:
    """tree, leaf, rank and nodes (array of position, role, text from the root) of the ``top`` best branches per tree.

    A branch scores the mean of its nodes' scores; ties go to the smaller leaf id.
    """
    tree = settle(linked(nodes))
    parents = tree.where("parent is not null").select("tree", F.col("parent").alias("node"))
    leaves = tree.join(parents, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"))
    links = settle(ancestors(tree, leaves))
    scored = (links.join(tree.select("tree", "node", "score"), ["tree", "node"])
              .groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score"), F.max("above").alias("depth")))
    order = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return (links.join(best, ["tree", "leaf"]).join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
            .groupBy("tree", "leaf", "rank", "branch_score").agg(F.sort_array(F.collect_list(F.struct(
                (F.col("depth") - F.col("above")).alias("at"), "role", "text"))).alias("turns")))


def render(chats: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Add ``segments`` (text, loss) and ``formatted``, their concatenation; loss marks the texts of ``trained_role``."""
    def pieces(t: Column) -> Column:
        return F.array(
            F.struct(F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(CLOSE)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (t["role"] == trained_role).alias("loss")),
            F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    out = chats.withColumn("segments", F.flatten(F.transform("turns", pieces)))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(chats: DataFrame) -> DataFrame:
    """Add ``read`` (role, text) parsed from ``formatted`` and ``learned``, the unescaped text under the loss mask."""
    turns = F.filter(F.split("formatted", "</s>"), lambda p: p != "")
    parse = lambda p: F.struct(
        unescape(F.regexp_extract(p, r"(?s)^<\|(.*?)\|>", 1)).alias("role"),
        unescape(F.regexp_extract(p, r"(?s)^<\|.*?\|>(.*)$", 1)).alias("text"))
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return chats.withColumn("read", F.transform(turns, parse)).withColumn("learned", F.array_join(loss, ""))


def format_trees(nodes: DataFrame, top: int = 1) -> DataFrame:
    """Best branches of each tree as formatted conversations: tree, leaf, rank, turns, segments, formatted."""
    return render(paths(settle(clean(nodes)), top))
