"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text has three groups of terms: hashed words, pairs of neighbouring character classes, and words equal to one of the
two before them.  Each group is weighted by the root of its relative frequencies and by inverse document frequency, and
projected on the leading singular vectors of the labelled sample.  Every document is compared with *all* labelled vectors
by exact cosines, block by block; its ``NEIGHBOURS`` nearest vote with their similarity.

The sample holds at most ``BUCKETS`` documents of each class, one per bucket of their hashed ids, among labelled rows
that are not held out; so the space and the broadcast vectors are bounded (``2 * BUCKETS * RANK`` numbers).  A document
with conflicting labels has the lower one.  A text without words scores 0; so does everything if there are no labels.
Equal similarities are taken in the sample's order of ids.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tracespool.llm.crossparse import held_out
from tracespool.llm.textblock import Block, slices
from tracespool.plans.layout import settle

BUCKETS = 2048
RANK = 32
NEIGHBOURS = 15
POWER = 8  #: votes weigh similarity to this power, so that near neighbours decide
WORD_TERMS, CLASSES, REPEATS = 4096, 32, 3
TERMS = WORD_TERMS + CLASSES * CLASSES + REPEATS
ROWS = 256  #: documents whose term vectors a task holds at a time
SEED = 9

KIND = np.full(256, 31, np.int64)  # other characters
for _number, _chars in enumerate(["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r", "\n", ".", ",", ";:", "!", "?", "'\"`",
                                  "()", "[]{}", "<>", "/\\", "|", "#", "$", "%", "&", "*", "+=~^", "-_", "@"]):
    KIND[[ord(c) for c in _chars]] = _number
KIND[128:] = 0  # bytes of letters beyond ASCII count as lower-case letters


def terms(column: pa.Array) -> np.ndarray:
    """Rows of term weights of a slice of texts, each group of length 1 or 0."""
    block = Block(column)
    block.cut_words()
    n = block.docs
    word = block.range_hash(block.starts, block.ends)
    words = np.bincount(block.word_doc * WORD_TERMS + (word >> np.uint64(52)).astype(np.int64), minlength=n * WORD_TERMS)
    doc = np.repeat(np.arange(n), np.diff(block.off))
    kind = KIND[block.raw]
    same = doc[1:] == doc[:-1]
    pairs = np.bincount((doc[1:] * CLASSES * CLASSES + kind[:-1] * CLASSES + kind[1:])[same], minlength=n * CLASSES * CLASSES)
    again = np.zeros((n, REPEATS))
    again[:, 0] = np.diff(block.first)
    for back in (1, 2):
        hit = (word[back:] == word[:-back]) & (block.word_doc[back:] == block.word_doc[:-back])
        again[:, back] = np.bincount(block.word_doc[back:][hit], minlength=n)
    groups = [words.reshape(n, -1), pairs.reshape(n, -1), again]
    return np.concatenate([np.sqrt(g / np.maximum(g.sum(axis=1, keepdims=True), 1)) for g in groups], axis=1).astype(np.float32)


def pieces(column: pa.Array) -> Iterator[pa.Array]:
    """Slices of at most ROWS rows and a bounded number of bytes."""
    for lo, hi in slices(column):
        for at in range(lo, hi, ROWS):
            yield column.slice(at, min(ROWS, hi - at))


def sample(docs: DataFrame, labels: DataFrame) -> list:
    """(doc_id, quality, text) of the sampled labelled documents, in order of ids."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picks = settle(known.groupBy("quality", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("bucket"))
                   .agg(F.min_by("doc_id", F.xxhash64("doc_id", F.lit(7))).alias("doc_id"))
                   .groupBy("doc_id").agg(F.min("quality").alias("quality")))
    texts = (docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picks), "doc_id")  # at most 2 * BUCKETS rows
             .groupBy("doc_id", "quality").agg(F.min("text").alias("text")))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.concatenate([terms(p) for p in pieces(batch.column(2))]) if batch.num_rows else np.zeros((0, TERMS), np.float32)
            hit = [np.flatnonzero(r).astype(np.int32) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.list_(pa.int32())),
                                              pa.array([r[h] for r, h in zip(rows, hit, strict=True)], pa.list_(pa.float32()))],
                                             ["doc_id", "quality", "ix", "val"])

    rows = texts.mapInArrow(project, "doc_id long, quality int, ix array<int>, val array<float>")
    return sorted(rows.collect(), key=lambda r: r.doc_id)  # bounded sample, terms only


class Model:
    def __init__(self, rows: list):
        matrix = np.zeros((len(rows), TERMS), np.float32)
        for i, r in enumerate(rows):
            matrix[i, r.ix] = r.val
        self.labels = np.array([r.quality for r in rows], np.float64)
        idf = np.log((len(rows) + 1) / (1 + (matrix > 0).sum(axis=0))) + 1
        matrix *= idf.astype(np.float32)
        axes = self._axes(matrix)
        self.fold = (axes * idf[:, None]).astype(np.float32)
        self.vectors = self.unit(matrix @ axes.astype(np.float32)).T.copy()

    @staticmethod
    def _axes(matrix: np.ndarray) -> np.ndarray:
        """Leading right singular vectors, by a randomised range finder."""
        q = np.random.default_rng(SEED).standard_normal((TERMS, RANK + 8)).astype(np.float32)
        for _ in range(3):
            q, _ = np.linalg.qr(matrix.T @ (matrix @ q))
        values, vectors = np.linalg.eigh((b := matrix @ q).T @ b)
        return q @ vectors[:, np.argsort(-values)[:RANK]]

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def score(self, column: pa.Array) -> np.ndarray:
        """Share of the nearest neighbours' similarity that label 1 holds."""
        rows = terms(column)
        out = np.zeros(len(rows))
        some = np.flatnonzero(rows[:, :WORD_TERMS].any(axis=1))
        if len(some) and len(self.labels):
            near = self.unit(rows[some] @ self.fold) @ self.vectors
            k = min(NEIGHBOURS, near.shape[1])
            best = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1)
            weight = np.maximum(np.take_along_axis(near, best, axis=1), 1e-6).astype(np.float64) ** POWER
            out[some] = np.clip((weight * self.labels[best]).sum(axis=1) / weight.sum(axis=1), 0, 1)
        return out


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text), learned from ``labels`` (doc_id, quality)."""
    model = docs.sparkSession.sparkContext.broadcast(Model(sample(docs, labels)))

    @F.arrow_udf(DoubleType())
    def vote(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(np.concatenate([np.zeros(0), *(model.value.score(p) for p in pieces(column))]))

    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), vote("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
