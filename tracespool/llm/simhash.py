"""Near-duplicates by SimHash: BK-trees on shards of the fingerprints, then connected components.

Fingerprint: words are runs of other bytes than ASCII white space of the text with A-Z lower-cased; each 4-word
shingle (the whole sequence if shorter) is hashed with XXH64, seed 42; a bit is set if it is set in over half the
hashes.  No words: fingerprint zero, which links like any other.  Null texts count as empty.

Links (at most ``RADIUS`` differing bits) are found between *distinct* fingerprints, so exact copies cost nothing.  The
64 bits are cut into RADIUS + 1 blocks; two linked fingerprints agree on a whole block, so every (block, value) is a
shard that is searched on its own, and no tree of the whole corpus is ever built or sent.  A shard that holds more than
``SHARD_ROWS`` fingerprints is cut into numbered trees, and each of its fingerprints also visits the trees after its
own: nothing is dropped and no task grows with the shard.  Each search task reports a spanning forest of the links it
saw (at most one link per fingerprint), never all pairs of a group; that keeps the components.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tracespool.llm.textblock import Block, slices, tidy
from tracespool.plans.layout import settle

RADIUS = 4
SHINGLE = 4
SEED = 42
SHARD_ROWS = 8192


def fingerprint_block(column: pa.Array) -> np.ndarray:
    """Fingerprints of a slice of texts as signed 64-bit numbers."""
    block = Block(column, lower=True)
    block.cut_words()
    first, starts, ends = block.first, block.starts, block.ends
    size = ends - starts
    # words joined by single spaces, doc by doc: a shingle is then one byte range
    at = np.concatenate([[0], np.cumsum(size + 1)])
    joined = np.full(int(at[-1]), 32, np.uint8)
    joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = block.raw[block.inside]
    n_words = np.diff(first)
    n = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
    doc = np.repeat(np.arange(block.docs), n)
    base = np.concatenate([[0], np.cumsum(n)])
    word = np.arange(int(base[-1])) - np.repeat(base[:-1], n) + np.repeat(first[:-1], n)
    last = np.minimum(word + SHINGLE, np.repeat(first[1:], n))
    view, digest = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(view[a:b], SEED) for a, b in zip(at[word].tolist(), (at[last] - 1).tolist(), strict=True)),
                         np.uint64, len(word))
    out = np.zeros(block.docs, np.uint64)
    for lo, hi in _runs(base):  # bits of a bounded number of hashes at a time
        bits = np.unpackbits(hashes[base[lo]:base[hi]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows = np.flatnonzero(n[lo:hi]) + lo
        if len(rows):
            ones = np.add.reduceat(bits, base[rows] - base[lo], axis=0, dtype=np.int64)
            out[rows] = np.packbits(2 * ones > n[rows, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    assert len(doc) == len(hashes)
    return out.view(np.int64)


def _runs(base: np.ndarray, limit: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Runs of whole documents with at most ``limit`` hashes, or one document."""
    lo = 0
    while lo < len(base) - 1:
        hi = max(lo + 1, int(np.searchsorted(base, base[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi


@F.arrow_udf(LongType())
@tidy
def fingerprint(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in texts:
        parts = [fingerprint_block(column.slice(lo, hi - lo)) for lo, hi in slices(column)]
        yield pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))


class BKTree:
    """Children of a node are keyed by their integer Hamming distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Add a value that is not in the tree; its number."""
        number = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while number:
            d = (self.values[at] ^ value).bit_count()
            nxt = self.children[at].setdefault(d, number)
            if nxt == number:
                break
            at = nxt
        return number

    def within(self, value: int, radius: int) -> list[int]:
        """Numbers of the values at most ``radius`` away; only edges that can lead there are followed."""
        found, open_, values, children = [], [0] if self.values else [], self.values, self.children
        while open_:
            at = open_.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            lo, hi = d - radius, d + radius
            open_.extend([c for e, c in children[at].items() if lo <= e <= hi])
        return found


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def forest(own: list[int], guests: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``own`` and between ``guests`` and ``own``."""
    tree, values = BKTree(), own + guests
    parent = list(range(len(values)))
    links = []
    for number, value in enumerate(values):
        for other in tree.within(value, radius):
            a, b = _find(parent, number), _find(parent, other)
            if a != b:
                parent[a] = b
                links.append((value, values[other]))
        if number < len(own):
            tree.add(value)
    return links


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, guest, fp) sorted by shard and guest, so a shard's own values come before its guests."""
    def out(links: list[tuple[int, int]]) -> pa.RecordBatch:
        a = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

    shard, own, guests, links = None, [], [], []
    for batch in batches:
        shards = batch.column(0).to_pylist()
        fps = np.asarray(batch.column(2)).view(np.uint64).tolist()
        for s, is_guest, fp in zip(shards, batch.column(1).to_pylist(), fps, strict=True):
            if s != shard:
                links += forest(own, guests) if len(own) + len(guests) > 1 else []
                shard, own, guests = s, [], []
            (guests if is_guest else own).append(fp)
        if len(links) > 10_000:
            yield out(links)
            links = []
    links += forest(own, guests)
    yield out(links)


def links(prints: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that connect every component."""
    width, blocks = divmod(64, RADIUS + 1)[0], RADIUS + 1
    keys = [F.struct(F.lit(i).alias("block"),
                     F.expr(f"shiftrightunsigned(fp, {i * width}) & {(1 << (width if i < blocks - 1 else 64 - i * width)) - 1}L").alias("value"))
            for i in range(blocks)]
    cut = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    hot = (cut.groupBy("key").count().where(F.col("count") > shard_rows)
           .select("key", F.expr(f"(count - 1) div {shard_rows} + 1").alias("trees")))
    rows = cut.join(hot, "key", "left").withColumn("trees", F.coalesce("trees", F.lit(1).cast("long")))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")))
    rows = rows.select("fp", "key", "own", F.explode(F.expr("sequence(own, trees - 1)")).alias("tree"))
    rows = rows.select(F.concat_ws(":", "key.block", "key.value", "tree").alias("shard"), (F.col("tree") != F.col("own")).alias("guest"), "fp")
    parts = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return (rows.repartition(parts, "shard").sortWithinPartitions("shard", "guest", "fp")
            .mapInArrow(tidy(_search), "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edge table (a, b); the component is its smallest node.

    Each round gives a node the smallest label among itself and its neighbours, then the label of that label, so
    the rounds grow with the logarithm of a component's diameter.  Tables are written each round.
    """
    both = settle(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))).distinct())
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        nxt = settle(least.join(jump, "new", "left").select(
            "node", F.least("new", F.coalesce("far", "new")).alias("label"), (F.least("new", F.coalesce("far", "new")) != F.col("label")).alias("moved")))
        if nxt.where("moved").isEmpty():
            return nxt.select("node", F.col("label").alias("component"))
        labels = nxt.drop("moved")


def group(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fp (signed) and component_id, the smallest doc_id that links reach, for every row of (doc_id, text).

    Rows that repeat a doc_id are kept.  An empty table gives an empty result.
    """
    prints = settle(docs.select("doc_id", fingerprint("text").alias("fp")))
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = settle(components(links(distinct, shard_rows)))
    root = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    least = root.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = root.join(least, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, but those whose group has a smaller doc_id.

    Rows that share a doc_id are one document and stay or go together; rows without one stay.
    """
    gone = settle(group(docs).where("doc_id > component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
