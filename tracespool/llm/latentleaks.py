"""Benchmark decontamination by latent semantic retrieval.

1. Inverse document frequencies of hashed words are counted over all passages of all documents.
2. A distributed randomised SVD of the benchmark's TF-IDF passages gives a latent space; documents are folded in.
3. Every window of ``2 * UNIT`` words, in steps of ``UNIT``, is compared with every benchmark item by cosine, however
   little of the window lies in the latent space: that share shrinks as the benchmark grows.
4. Candidates are checked by the longest common subsequence of words, within windows a quarter longer than the item: a
   share of ``COPY`` is a copy, of ``PARAPHRASE`` with the answer (the item's last words) a paraphrase.

Words are runs of letters, digits and other than ASCII characters, ASCII letters in lower case.  Items of fewer than
``MIN_WORDS`` words cannot be told from common phrases and match nothing; those of fewer than ``SURE_WORDS`` must occur
whole.  Benchmarks are sent in blocks of ``BLOCK_ITEMS`` items, one search over all documents each.  Null texts count as
empty, repeated rows are searched each on its own, repeated item ids each as an item of its own; items
without an id or text match nothing.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from tracespool.llm.latent import basis
from tracespool.llm.textblock import MARKS, Block, slices, tidy
from tracespool.plans.layout import settle

BUCKET_BITS = 14
RANK = 64
UNIT = 16
CANDIDATE = 0.6  #: least cosine in the latent space
COPY, PARAPHRASE = 0.8, 0.6
ANSWER_WORDS, ANSWER_SHARE = 5, 0.6
MIN_WORDS, SURE_WORDS = 5, 13
IDF_POWER = 1.5
BLOCK_ITEMS = 4_000
TEXT_BLOCK = 1 << 18

BUCKETS = 1 << BUCKET_BITS


class Words:
    """Words of a slice of texts: hashes, buckets, units of ``UNIT`` words and the doc of each unit."""

    def __init__(self, column: pa.Array):
        block = Block(column, lower=True)
        block.cut_words(MARKS)
        self.first = block.first
        self.hash = block.range_hash(block.starts, block.ends)
        self.bucket = (self.hash >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        units = (np.diff(self.first) + UNIT - 1) // UNIT
        self.unit_doc = np.repeat(np.arange(block.docs), units)
        base = np.concatenate([[0], np.cumsum(units)])[:-1]
        self.unit_start = self.first[:-1][self.unit_doc] + (np.arange(len(self.unit_doc)) - base[self.unit_doc]) * UNIT
        self.unit_of_word = np.repeat(np.arange(len(self.unit_doc)), np.diff(np.append(self.unit_start, len(self.hash))))


def idf(docs: DataFrame) -> np.ndarray:
    """log((passages + 1) / (passages with the bucket + 1)) over all documents, to the power that sets rare words apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                words = Words(batch.column(0).slice(lo, hi - lo))
                key = np.sort(words.unit_of_word * BUCKETS + words.bucket)
                once = key[np.flatnonzero(np.diff(key, prepend=-1))]
                count[:BUCKETS] += np.bincount(once % BUCKETS, minlength=BUCKETS)
                count[BUCKETS] += len(words.unit_doc)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at])], ["bucket", "n"])

    total = np.zeros(BUCKETS + 1)
    for r in docs.select("text").mapInArrow(tidy(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r.bucket] = r.n  # at most BUCKETS + 1 rows
    return (np.log((total[BUCKETS] + 1) / (total[:BUCKETS] + 1)) + 0.01) ** IDF_POWER


def vectors(items: DataFrame, weight: np.ndarray) -> DataFrame:
    """Sparse TF-IDF rows of unit length."""
    weights = items.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                words = Words(batch.column(0).slice(lo, hi - lo))
                ix, val = [], []
                for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                    at, n = np.unique(words.bucket[a:b], return_counts=True)
                    v = n * weights.value[at]
                    ix.append(at.astype(np.int32))
                    val.append((v / max(np.linalg.norm(v), 1e-12)).astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array(ix, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], ["ix", "val"])

    return items.select("text").mapInArrow(run, "ix array<int>, val array<float>")


def lcs(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence with an item given as bit masks of its words' places."""
    full = (1 << size) - 1
    v = full
    for w in words:
        if w in masks:
            u = v & masks[w]
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def places(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Item:
    def __init__(self, item_id: int, words: list[int]):
        self.id, self.words, self.size = item_id, words, len(words)
        self.masks = places(words)
        self.answer = words[-ANSWER_WORDS:]
        self.least = self.size if self.size < SURE_WORDS else math.ceil(PARAPHRASE * self.size)

    def best(self, region: list[int]) -> tuple[int, int]:
        """(LCS, offset) of the best window of the region, or (0, 0) if none can reach the least."""
        region = [w if w in self.masks else 0 for w in region]
        if lcs(self.masks, self.size, region) < self.least:  # no window can do better than the region
            return 0, 0
        width, step = math.ceil(1.25 * self.size) + 1, max(1, self.size // 8)
        starts = [*range(0, max(len(region) - width, 0), step), max(len(region) - width, 0)]
        best = max((lcs(self.masks, self.size, region[s:s + width]), -s) for s in starts)
        return best[0], -best[1]

    def verdict(self, region: list[int]) -> tuple[str, float, int] | None:
        found, at = self.best(region)
        share = found / self.size
        if found < max(self.least, 1):
            return None
        if share >= COPY:
            return "copy", share, at
        window = region[at:at + math.ceil(1.25 * self.size) + 1]
        if lcs(places(self.answer), len(self.answer), window) >= ANSWER_SHARE * len(self.answer):
            return "paraphrase", share, at
        return None


class Index:
    """A block of benchmark items with their latent vectors, and the weights to fold texts in."""

    def __init__(self, items: list[tuple[int, str]], weight: np.ndarray, axes: np.ndarray):
        words = Words(pa.array([t for _, t in items], pa.string()))
        self.items, rows = [], []
        self.fold = (axes * weight[:, None]).astype(np.float32)
        for i, (item_id, _) in enumerate(items):
            a, b = int(words.first[i]), int(words.first[i + 1])
            if b - a >= MIN_WORDS:
                self.items.append(Item(item_id, words.hash[a:b].tolist()))
                rows.append(self.fold[words.bucket[a:b]].sum(axis=0))
        matrix = np.array(rows, np.float32).reshape(len(rows), self.fold.shape[1])
        self.matrix = (matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)).T.copy()

    def folded(self, words: Words, u: int) -> np.ndarray:
        """Latent vectors of up to 4096 units from unit u."""
        starts = words.unit_start[u:u + 4096]
        end = words.unit_start[u + 4096] if u + 4096 < len(words.unit_start) else len(words.hash)
        return np.add.reduceat(self.fold[words.bucket[starts[0]:end]], starts - starts[0], axis=0)

    def search(self, column: pa.Array) -> list[list[dict]]:
        """Hits of each text: item, kind, cosine, share of the item and word where it begins."""
        words = Words(column)
        out: list[list[dict]] = [[] for _ in range(len(column))]
        if not len(words.hash) or not self.items:
            return out
        unit = np.concatenate([self.folded(words, u) for u in range(0, len(words.unit_start), 4096)])
        follows = np.append(words.unit_doc[1:] == words.unit_doc[:-1], False)
        alone = ~follows & ~np.insert(follows[:-1], 0, False)
        pair = np.where(follows)[0]
        unit[pair] = unit[pair] + unit[pair + 1]
        length = np.linalg.norm(unit, axis=1)
        at = np.flatnonzero((follows | alone) & (length > 0))
        near = (unit[at] / length[at, None]) @ self.matrix
        row, item = np.nonzero(near >= CANDIDATE)
        best: dict[tuple[int, int], dict] = {}
        done: dict[tuple[int, int], int] = {}
        for r, i in zip(row.tolist(), item.tolist(), strict=True):
            u = int(at[r])
            doc, thing = int(words.unit_doc[u]), self.items[i]
            lo = max(int(words.first[doc]), int(words.unit_start[u]) - thing.size)
            hi = min(int(words.first[doc + 1]), int(words.unit_start[u]) + 2 * UNIT + thing.size)
            known = best.get((doc, i))
            if known and known["share"] >= 0.95:
                continue
            lo = max(lo, done.get((doc, i), lo) - math.ceil(1.25 * thing.size) - 1)
            done[doc, i] = hi
            said = thing.verdict(words.hash[lo:hi].tolist())
            if said and (not known or said[1] > known["share"]):
                best[doc, i] = {"item_id": thing.id, "kind": said[0], "cosine": float(near[r, i]), "share": said[1],
                                "word": lo + said[2] - int(words.first[doc])}
        for (doc, _), hit in sorted(best.items(), key=lambda x: x[0]):
            out[doc].append(hit)
        return out


HITS = ArrayType(StructType([StructField("item_id", LongType()), StructField("kind", StringType()), StructField("cosine", DoubleType()),
                             StructField("share", DoubleType()), StructField("word", LongType())]))
ARROW_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("kind", pa.string()), ("cosine", pa.float64()), ("share", pa.float64()), ("word", pa.int64())]))


def _searcher(index):
    @F.arrow_udf(HITS)
    @tidy
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([h for lo, hi in slices(column, TEXT_BLOCK) for h in index.value.search(column.slice(lo, hi - lo))], ARROW_HITS)
    return search


def searchers(docs: DataFrame, benchmark: DataFrame) -> list:
    """For each block of the benchmark (item_id, text) a column function text -> hits."""
    items = settle(benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")))
    n = items.count()
    if not n:
        return []
    weight = idf(docs)
    axes = basis(settle(vectors(items, weight)), BUCKETS, RANK)
    blocks = -(-n // BLOCK_ITEMS)
    out = []
    for b in range(blocks):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about BLOCK_ITEMS items
        index = docs.sparkSession.sparkContext.broadcast(Index(sorted((r.item_id, r.text) for r in some if r.item_id is not None), weight, axes))

        out.append(_searcher(index))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, kind, cosine, share and word (where the window begins) of every benchmark item found in a document."""
    parts = [docs.select("doc_id", F.explode(search("text")).alias("hit")).select("doc_id", "hit.*") for search in searchers(docs, benchmark)]
    empty = docs.sparkSession.createDataFrame([], StructType([StructField("doc_id", LongType()), *HITS.elementType.fields]))
    return reduce(DataFrame.unionByName, parts) if parts else empty


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item."""
    for search in searchers(docs, benchmark):
        docs = docs.where(F.size(search("text")) == 0)
    return docs
