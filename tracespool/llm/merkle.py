"""Merkle manifest of a table: a leaf per row, a tree per group, a tree of the group roots, and a proof for every leaf.

Leaves are ranked within their group by range partitions with running counts. The rank is split into a block number and
`BITS` binary digits. Inside a block, which one row may hold as its size is bounded, the digits are grouped away one
after the other, the lowest first: each grouping nests the child structs below their parent's digest. Rows are dealt by
(group, block) once, and all groupings of a block run in that one stage. The digests of the blocks are the leaves of
the next, 2**BITS times smaller tier, up to one block per group; the group roots go through the same steps.
Proofs come back down without joins: the path above a block is united and grouped with it, `transform` hands
it to the children level by level, and `explode` gives the leaves with their steps.

A step is the pair (left siblings, right siblings) of one level; folding a leaf through its steps gives the root.

Defined results: null values are encoded as `-`, so they differ from empty ones; a null group is a group of its own and
comes first; null ids come first in their group. Rows equal in id are ordered by digest, and equal rows are leaves of
their own. An empty table gives no rows. Texts of any length are hashed whole. Extra columns are neither hashed nor
returned, whatever their names. A row without an id is never a tampered one.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracespool.plans.layout import settle

BITS = 8  #: binary digits of a rank inside one block
SLOT_ROWS = 1 << 15  #: rows of one range partition while leaves are ranked
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
NO_STEPS = "cast(array() as array<struct<left: string, right: string>>)"


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def ranked(rows: DataFrame, group: str, order: list[str], slot_rows: int) -> DataFrame:
    """Add ``pos`` (0-based rank in ``order`` within the group) and ``n`` (rows of the group).

    ``order`` must tell rows apart. Slots are range partitions, written so that a lost task cannot draw other bounds.
    """
    parts = max(1, -(-rows.count() // slot_rows))
    cut = settle(rows.repartitionByRange(parts, group, *order).withColumn("_slot", F.spark_partition_id()))
    sizes = cut.groupBy(group, "_slot").agg(F.count(F.lit(1)).alias("_m"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(group, "_slot", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_base"), F.sum("_m").over(whole).alias("n"))
    inner = Window.partitionBy(group, "_slot").orderBy(*order)
    return (cut.join(base, [group, "_slot"]).withColumn("pos", F.col("_base") + F.row_number().over(inner) - 1)
            .drop("_slot", "_base"))


def roll_up(nodes: DataFrame, bits: int) -> DataFrame:
    """One row per block of 2**bits neighbours: (key, block, n, node), ``node`` nesting (h, kids) down to the given nodes.

    ``nodes`` has (key, pos, n, h, load); a level exists while the group still has several nodes.
    """
    digits = [f"_d{k}" for k in range(bits)]
    rows = nodes.select("key", "n", F.expr(f"pos >> {bits}").alias("block"), F.struct("h", "load").alias("node"),
                        *[F.expr(f"cast((pos >> {k}) & 1 as tinyint)").alias(d) for k, d in enumerate(digits)])
    rows = rows.repartition("key", "block")
    for level in range(bits):
        child = F.struct(F.col(digits[level]).alias("digit"), "node")
        rows = rows.groupBy("key", "block", "n", *digits[level + 1:]).agg(F.sort_array(F.collect_list(child)).alias("_kids"))
        kids = F.transform("_kids", lambda c: c["node"])
        joined = F.sha2(F.array_join(F.transform("_kids", lambda c: c["node"]["h"]), ""), 256)
        h = F.when(F.col("n") > 2 ** level, joined).otherwise(F.col("_kids")[0]["node"]["h"])
        rows = rows.select("key", "block", "n", *digits[level + 1:], F.struct(h.alias("h"), kids.alias("kids")).alias("node"))
    return rows


def climb(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """Tiers of blocks from the given nodes up to one block per group; only the longest group's length reaches the driver."""
    longest = nodes.agg(F.max("n")).first()[0] or 0
    tiers = [settle(roll_up(nodes, bits))]
    while longest > 2 ** bits:
        longest = -(-longest // 2 ** bits)
        above = tiers[-1].select("key", F.col("block").alias("pos"), F.expr(f"(n + {2 ** bits - 1}) >> {bits}").alias("n"),
                                 F.col("node.h").alias("h"), F.lit(0).alias("load"))
        tiers.append(settle(roll_up(above, bits)))
    return tiers


def _handed_down(entries: Column, level: int) -> Column:
    """The children of entries (node, steps, n), each with its siblings before the steps; ``level`` counts from the leaves."""
    def children(entry: Column) -> Column:
        kids = F.transform(entry["node"]["kids"], lambda c: c["h"])

        def child(c: Column, i: Column) -> Column:
            left = F.array_join(F.slice(kids, F.lit(1), i), "")
            right = F.array_join(F.slice(kids, i + 2, F.size(kids)), "")
            step = F.array(F.struct(left.alias("left"), right.alias("right")))
            steps = F.when(entry["n"] > 2 ** level, F.concat(step, entry["steps"])).otherwise(entry["steps"])
            return F.struct(c.alias("node"), steps.alias("steps"), entry["n"].alias("n"))
        return F.transform(entry["node"]["kids"], child)
    return F.flatten(F.transform(entries, children))


def descend(tiers: list[DataFrame], tops: DataFrame, bits: int) -> DataFrame:
    """Steps of every leaf: (key, pos, h, load, steps, above), from ``tops`` (key, steps, above) of the group roots.

    Blocks and the paths that end in them are united and grouped, so no join is needed and each group is one block.
    """
    paths = tops.select("key", F.lit(0).cast("long").alias("block"), F.struct("steps", "above").alias("path"))
    for tier in reversed(tiers):
        both = tier.select("key", "block", F.struct("node", "n").alias("tree")).unionByName(paths, allowMissingColumns=True)
        rows = both.groupBy("key", "block").agg(F.first("tree", True).alias("tree"), F.first("path", True).alias("path"))
        first = F.struct(F.col("tree.node").alias("node"), F.col("path.steps").alias("steps"), F.col("tree.n").alias("n"))
        rows = rows.select("key", "block", F.col("path.above").alias("above"), F.array(first).alias("entries"))
        for level in reversed(range(bits)):
            rows = rows.withColumn("entries", _handed_down(F.col("entries"), level))
        rows = rows.select("key", "block", "above", F.posexplode("entries").alias("at", "entry"))
        rows = rows.select("key", F.expr(f"(block << {bits}) + at").alias("pos"), F.col("entry.node.h").alias("h"),
                           F.col("entry.node.load").alias("load"), F.col("entry.steps").alias("steps"), "above")
        paths = rows.select("key", F.col("pos").alias("block"), F.struct("steps", "above").alias("path"))
    return rows


def proofs(leaves: DataFrame, bits: int = BITS, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Proofs for ``leaves`` (group, h, order, load): adds nothing to a leaf but ``steps``, ``subroot`` and ``root``.

    ``group`` must not be null; ``order`` sorts the leaves of a group, ties go by digest.
    """
    leaves = settle(leaves.withColumn("_row", F.monotonically_increasing_id()))
    placed = ranked(leaves, "group", ["order", "h", "_row"], slot_rows)
    lower = climb(placed.select(F.col("group").alias("key"), "pos", "n", "h", "load"), bits)
    roots = lower[-1].select(F.lit("").alias("key"), F.col("key").alias("load"), F.col("node.h").alias("h"))
    upper = climb(ranked(roots, "key", ["load"], slot_rows).select("key", "pos", "n", "h", "load"), bits)
    root = upper[-1].select("key", F.expr(NO_STEPS).alias("steps"), F.col("node.h").alias("above"))
    tops = descend(upper, root, bits).select(
        F.col("load").alias("key"), "steps", F.struct(F.col("h").alias("subroot"), F.col("above").alias("root")).alias("above"))
    return descend(lower, tops, bits).select("h", "load", "steps", "above.*")


def fold(start: Column, steps: Column) -> Column:
    """The root that a leaf digest and its steps give."""
    return F.aggregate(steps, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def manifest(docs: DataFrame, bits: int = BITS, slot_rows: int = SLOT_ROWS) -> DataFrame:
    """Proof and check of every row of ``docs``: leaf, subroot and root as they were, and the root that the row now gives.

    Where 7 divides the CRC-32 of the id, the row is changed after the manifest was made (``n_chars`` grows by 1).
    """
    changed = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 7 = 0")
    now = digest(*[F.col(c).cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in FIELDS])
    h = digest(*[F.col(c) for c in FIELDS])
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("group"), h.alias("h"), F.col("doc_id").alias("order"),
        F.struct("doc_id", F.when(changed & F.col("n_chars").isNotNull(), now).alias("now")).alias("load"))
    out = proofs(leaves, bits, slot_rows)
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    folded = fold(F.coalesce(F.col("load.now"), F.col("h")), F.col("steps"))
    out = out.select(F.col("load.doc_id").alias("doc_id"), F.col("h").alias("leaf"), "subroot", "root",
                     F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
