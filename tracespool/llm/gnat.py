"""Product quantisation with integer codebooks, whose entries are searched through a GNAT.

Every component becomes floor(4096 * x), vectors are cut into `PARTS` equal parts, and each part position has a codebook
of at most `ENTRIES` integer vectors, refined in `ROUNDS` rounds of assignment and componentwise floor of the mean.

The nearest entry is found with a geometric near-neighbour access tree over the entries of a codebook: a node has up to
`DEGREE` split points, spread far apart; every other entry belongs to the child of its nearest split; and for each pair
of a split and a child the node keeps the least and greatest distance from the split to the child's entries. A query
measures its distance d to one split after the other. With r the distance to the nearest entry so far, a child goes
with its whole subtree where its range lies strictly outside [d - r, d + r]. Distances are square roots in double
precision: ranges are rounded outwards, and so are d - r and d + r, so that rounding never drops an entry that is as near. What is
compared at last are exact integer squared distances, and among equal ones the lower index wins.

The codebooks (a number of integers that the parameters bound) are all that reaches the driver; a task returns the sums
of its batches, at most one row per part, entry and batch. Each pass reads the kept vectors from one written table.

Defined results: vectors that are null or hold null, NaN or infinite components are dropped. Components beyond
+-`LARGEST` are held there, so that squared distances fit 64 bits; a label whose errors
do not add up within 64 bits has a null sum. Vectors are filled up with zero components to the
least multiple of `PARTS` that holds the longest of them. Null ids come last among the first `ENTRIES` ids, and
equal ids are ordered by their components; repeated rows are rows of their own. With fewer rows than entries there are as many
entries as rows; an empty table gives no rows. Extra columns are ignored, whatever their names.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracespool.plans.layout import salted, settle

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
DEGREE = 4  #: split points of a node
LARGEST = 1 << 26
OUT = 1 + 2.0 ** -48  #: a factor beyond all rounding of the few operations on a distance
SUMS = "part int, entry int, n long, total array<long>"
CODES = "vec_id long, label string, code string, error long"


def squared(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    d = points - centre
    return np.einsum("ij,ij->i", d, d)


def build(entries: np.ndarray, members: np.ndarray | None = None) -> dict | None:
    """The tree over ``entries`` (rows of int64): splits, children, and ranges[j, i] of split j to child i."""
    members = np.arange(len(entries)) if members is None else members
    if not len(members):
        return None
    splits = [int(members[0])]
    nearest = squared(entries[members], entries[splits[0]])
    while len(splits) < min(DEGREE, len(members)):
        free = ~np.isin(members, splits)
        far = int(members[free][np.argmax(nearest[free])])
        splits.append(far)
        nearest = np.minimum(nearest, squared(entries[members], entries[far]))
    between = np.stack([squared(entries[members], entries[s]) for s in splits])
    home = np.argmin(between, axis=0)
    for i, s in enumerate(splits):
        home[members == s] = i
    away = np.sqrt(between.astype(float))
    low = np.array([[away[j, home == i].min() for i in range(len(splits))] for j in range(len(splits))]) / OUT
    high = np.array([[away[j, home == i].max() for i in range(len(splits))] for j in range(len(splits))]) * OUT
    kids = [build(entries, members[(home == i) & ~np.isin(members, splits)]) for i in range(len(splits))]
    return {"splits": splits, "low": low, "high": high, "kids": kids}


def nearest(tree: dict | None, entries: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of the nearest entry of each query, and how many distances were measured."""
    best = np.full(len(queries), np.iinfo(np.int64).max)
    index = np.full(len(queries), len(entries))
    measured = 0
    todo = [(tree, np.arange(len(queries)))] if tree else []
    while todo:
        node, rows = todo.pop()
        alive = np.ones((len(rows), len(node["splits"])), bool)
        for j, split in enumerate(node["splits"]):
            at = np.flatnonzero(alive[:, j])
            who = rows[at]
            sq = squared(queries[who], entries[split])
            measured += len(at)
            better = (sq < best[who]) | ((sq == best[who]) & (split < index[who]))
            best[who[better]], index[who[better]] = sq[better], split
            d, r = np.sqrt(sq.astype(float)), np.sqrt(best[who].astype(float))
            reach, gap = (d + r) * OUT, d / OUT - r * OUT
            gone = (node["low"][j] > reach[:, None]) | (node["high"][j] < gap[:, None])
            gone[:, j] = False  # its own subtree is looked at below
            alive[at] &= ~gone
        for i, kid in enumerate(node["kids"]):
            if kid and alive[:, i].any():
                todo.append((kid, rows[alive[:, i]]))
    return index, best, measured


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch as rows of ``width`` components, shorter ones filled up with zeros."""
    column = batch.column(batch.schema.get_field_index("v"))
    size = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < size[:, None]] = np.asarray(column.flatten())
    return out


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): the kept vectors with integer components, written once."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    held = F.transform("embedding", lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(
        F.greatest(F.lit(-1e6), F.least(F.lit(1e6), x.cast("double"))) * float(SCALE)))).cast("int"))
    kept = vectors.where(F.col("embedding").isNotNull() & finite)
    return settle(kept.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), held.alias("v")))


def _plain(books: list[np.ndarray]) -> tuple[list[np.ndarray], list[dict | None]]:
    return books, [build(b) for b in books]


def refine(kept: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """One round: entries become the floor of the mean of their parts; entries without parts stay."""
    books, trees = _plain(books)
    step = width // len(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch, width)
            rows = []
            for p, (book, tree) in enumerate(zip(books, trees)):
                part = v[:, p * step:(p + 1) * step]
                index, _, _ = nearest(tree, book, part)
                count = np.bincount(index, minlength=len(book))
                total = np.zeros((len(book), step), np.int64)
                np.add.at(total, index, part)
                rows += [(p, e, int(count[e]), total[e].tolist()) for e in np.flatnonzero(count).tolist()]
            yield pa.RecordBatch.from_pylist([dict(zip(("part", "entry", "n", "total"), r)) for r in rows], schema=pa.schema(
                [("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))

    total = F.array(*[F.sum(F.col("total")[i]).alias(f"_{i}") for i in range(step)])
    found = kept.select("v").mapInArrow(sums, SUMS).groupBy("part", "entry").agg(F.sum("n").alias("n"), total.alias("total"))
    books = [b.copy() for b in books]
    for row in found.collect():  # at most PARTS * ENTRIES rows
        books[row["part"]][row["entry"]] = [t // row["n"] for t in row["total"]]
    return books


def encode(kept: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """(vec_id, label, code, error) of every kept vector."""
    books, trees = _plain(books)
    step = width // len(books)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch, width)
            found = [nearest(t, b, v[:, p * step:(p + 1) * step])[:2] for p, (b, t) in enumerate(zip(books, trees))]
            digits = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([bytes(row).hex() for row in digits], pa.string()),
                 pa.array(sum(sq for _, sq in found), pa.int64())], names=["vec_id", "label", "code", "error"])

    return kept.select("vec_id", "label", "v").mapInArrow(codes, CODES)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of ``vectors`` (vec_id, embedding, label) and the final codebooks, by part."""
    kept = quantised(vectors)
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts) * parts
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    seeds = np.zeros((len(first), width), np.int64)
    for i, row in enumerate(first):
        seeds[i, :len(row["v"])] = row["v"]
    books = np.split(seeds, parts, axis=1)
    for _ in range(rounds if len(first) else 0):
        books = refine(kept, books, width)
    return encode(kept, books, width), books


def report(vectors: DataFrame) -> DataFrame:
    """Per vector: vec_id, code, error, the error of its label, and the digest of the codebooks."""
    codes, books = compress(vectors)
    codes = settle(codes)
    digest = F.sha2(F.lit(",".join(str(x) for b in books for x in b.ravel().tolist())), 256)
    key = [F.coalesce("label", F.lit("")).alias("key"), F.col("label").isNull().alias("none")]
    of_label = codes.groupBy(*key).agg(F.try_sum("error").alias("label_error"))
    out = salted(codes.select("vec_id", "code", "error", *key), of_label, ["key", "none"])
    return out.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
