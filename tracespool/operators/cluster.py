"""k-means on scaled columns with a forced or chosen number of clusters."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracespool.plans import layout


def elbow(ks: Sequence[int], inertia: Sequence[float]) -> int:
    """Knee of a falling convex curve: largest distance below its normalised chord.

    Without a knee, the largest second difference decides.
    """
    k, y = np.asarray(ks, float), np.asarray(inertia, float)
    if len(k) < 3 or y[0] == y.min():
        return int(k[0])
    gap = (1 - (y - y.min()) / (y.max() - y.min())) - (k - k[0]) / (k[-1] - k[0])
    if gap.max() > 0:
        return int(k[int(np.argmax(gap))])
    return int(k[int(np.argmax(np.gradient(np.gradient(y))))])


def kmeans(scaled: DataFrame, cols: Sequence[str], k: int | None = None, k_min: int = 1, k_max: int = 8,
           tries: int = 20, seed: int = 0) -> tuple[DataFrame, int, dict[int, float]]:
    """Rows with ``cluster``, the number of clusters, and within-cluster squares per k tried."""
    rows = layout.settle(VectorAssembler(inputCols=list(cols), outputCol="_features").transform(scaled).select(
        *scaled.columns, "_features"))
    models, inertia = {}, {}
    for q in ([k] if k else range(k_min, k_max + 1)):
        if q == 1:  # a single cluster needs no search
            inertia[1] = float(sum(rows.agg(*[F.var_pop(c) * F.count(c) for c in cols]).first()))
            continue
        fits = [KMeans(k=q, seed=seed + t, featuresCol="_features", predictionCol="cluster", maxIter=100).fit(rows)
                for t in range(tries)]
        models[q] = min(fits, key=lambda m: m.summary.trainingCost)
        inertia[q] = float(models[q].summary.trainingCost)
    best = k or elbow(list(inertia), list(inertia.values()))
    out = rows.withColumn("cluster", F.lit(0)) if best == 1 else models[best].transform(rows)
    return out.drop("_features"), best, inertia
