"""Latent semantic spaces: randomised SVD of a sparse TF-IDF matrix whose rows are a DataFrame.

Tasks multiply their rows with a thin matrix and add up their share of the product; only matrices of
``columns x (rank + OVERSAMPLE)`` numbers travel and reach the driver, whatever the number of rows.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

OVERSAMPLE = 8
ROUNDS = 2
SEED = 20
STRIPE = 1024  #: matrix rows that travel as one record


def _summed(rows: DataFrame, shape: tuple[int, int], part: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """Sum over the partitions of ``rows`` (ix array<int>, val array<float>) of the matrices that ``part`` adds to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(shape), False
        for batch in batches:
            ix, val = batch.column(0), batch.column(1)
            size = np.diff(np.asarray(ix.offsets))
            row = np.repeat(np.arange(len(size)), size)
            part(total, row, np.asarray(ix.flatten()), np.asarray(val.flatten(), np.float64))
            some = some or len(row) > 0
        stripes = range(0, shape[0], STRIPE) if some else []
        yield pa.RecordBatch.from_arrays([pa.array([s for s in stripes], pa.int32()),
                                          pa.array([total[s:s + STRIPE].tobytes() for s in stripes], pa.binary())], ["stripe", "data"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(d) for d in group["data"])
        return pd.DataFrame({"stripe": group["stripe"].iloc[:1], "data": [total.tobytes()]})

    parts = rows.mapInArrow(run, "stripe int, data binary").groupBy("stripe").applyInPandas(add, "stripe int, data binary")
    out = np.zeros(shape)
    for r in parts.collect():  # one matrix of this shape
        out[r.stripe:r.stripe + STRIPE] = np.frombuffer(r.data).reshape(-1, shape[1])
    return out


def times(row: np.ndarray, ix: np.ndarray, val: np.ndarray, thin: np.ndarray, rows: int) -> np.ndarray:
    """Sparse rows times a thin matrix."""
    out = np.zeros((rows, thin.shape[1]))
    np.add.at(out, row, val[:, None] * thin[ix])
    return out


def basis(rows: DataFrame, columns: int, rank: int) -> np.ndarray:
    """The first ``rank`` right singular vectors (columns x rank), each divided by its singular value.

    Fewer if the matrix has a lower rank.  The division gives every direction of the rows the same spread.
    """
    spark = rows.sparkSession
    thin = rank + OVERSAMPLE
    q = np.random.default_rng(SEED).standard_normal((columns, thin))
    for _ in range(ROUNDS):
        here = spark.sparkContext.broadcast(q)  # columns x thin numbers

        def normal(total: np.ndarray, row: np.ndarray, ix: np.ndarray, val: np.ndarray, here=here) -> None:
            if len(row):
                np.add.at(total, ix, val[:, None] * times(row, ix, val, here.value, row[-1] + 1)[row])

        q, _ = np.linalg.qr(_summed(rows, (columns, thin), normal))
    last = spark.sparkContext.broadcast(q)

    def gram(total: np.ndarray, row: np.ndarray, ix: np.ndarray, val: np.ndarray) -> None:
        if len(row):
            b = times(row, ix, val, last.value, row[-1] + 1)
            total += b.T @ b

    values, vectors = np.linalg.eigh(_summed(rows, (thin, thin), gram))
    order = np.argsort(-values)[:rank]
    order = order[values[order] > 1e-9 * max(values.max(), 1e-300)]
    return q @ vectors[:, order] / np.sqrt(values[order])
