"""Density clustering (DBSCAN) on scaled columns, with a given radius or the knee of the k-distances.

Points fall into cells so narrow that all points of one cell are neighbours.  A cell with ``min_samples`` points or more
therefore holds core points only, however many they are, and never has its pairs looked at; points of other cells are few
per cell, and only they are measured against their surroundings.  Cells with core points are linked where two of those are
near enough: boxes around them decide most pairs, the others are halved until boxes decide, so two crowded cells
never meet point by point.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracespool.plans import layout

NARROW = 1 - 1e-9  #: keeps the diagonal of a cell below the radius in spite of rounding
SALTS = 4  #: for crowded cells
INDEXED = 2  #: leading columns whose cells are joined; the others are compared afterwards


def distance(a: str, b: str) -> Column:
    return F.expr(f"sqrt(aggregate(zip_with({a}, {b}, (p, q) -> (p - q) * (p - q)), 0D, (s, v) -> s + v))")


def _box_distance(far: bool) -> Column:
    """Least (or greatest) distance between points of the boxes ``lo, hi`` and ``lo2, hi2``."""
    if far:
        gap = "zip_with(zip_with(hi, lo2, (p, q) -> p - q), zip_with(hi2, lo, (p, q) -> p - q), (p, q) -> greatest(p, q))"
    else:
        gap = "zip_with(zip_with(lo, hi2, (p, q) -> p - q), zip_with(lo2, hi, (p, q) -> p - q), (p, q) -> greatest(p, q, 0D))"
    return F.expr(f"sqrt(aggregate({gap}, 0D, (s, v) -> s + v * v))")


def _cell(width: Column | float) -> Column:
    w = width if isinstance(width, Column) else F.lit(width)
    return F.transform("x", lambda v: F.floor(v / w))


def _width(eps: float, dims: int) -> float:
    return eps / math.sqrt(dims) * NARROW


def _boxes(points: DataFrame, dims: int, *keys: str) -> DataFrame:
    side = lambda fn: F.array(*[fn(F.col("x")[k]) for k in range(dims)])
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), side(F.min).alias("lo"), side(F.max).alias("hi"))


def _around(cells: DataFrame, dims: int, reach: int) -> DataFrame:
    """Pairs of cells at most ``reach`` apart in every column; the second has its columns marked with 2."""
    index = [f"c{k}" for k in range(min(dims, INDEXED))]
    left, right = cells, cells.select(*[F.col(c).alias(f"{c}2") for c in cells.columns])
    for k, c in enumerate(index):
        left = left.withColumn(c, F.explode(F.expr(f"transform(sequence(-{reach}, {reach}), o -> cell[{k}] + o)")))
        right = right.withColumn(c, F.col("cell2")[k])
    near = F.forall(F.zip_with("cell", "cell2", lambda p, q: F.abs(p - q) <= reach), lambda v: v)
    return left.join(right, index).where(near).drop(*index)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, root``: the least node linked with each node by ``edges`` (``a, b``, in both directions)."""
    label = layout.settle(nodes.select("node", F.col("node").alias("root")))
    while True:
        seen = edges.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("_r"))
        low = layout.settle(label.join(seen, "node", "left").select("node", F.least("root", F.coalesce("_r", "root")).alias("_low"), "root"))
        jump = low.select(F.col("node").alias("_low"), F.col("_low").alias("_next"))
        new = layout.settle(low.join(jump, "_low", "left").select("node", F.col("_next").alias("_new"), "root"))
        label = new.select("node", F.col("_new").alias("root"))
        if new.where("_new < root").isEmpty():
            return label


def _linked(core: DataFrame, cells: DataFrame, dims: int, eps: float, reach: int) -> DataFrame:
    """Pairs ``a, b`` of cells that hold two core points within ``eps`` (both directions)."""
    boxes = layout.settle(_boxes(core, dims, "cell"))
    todo = _around(boxes.withColumn("part", F.col("cell")), dims, reach).where("cell < cell2")
    found, width = None, _width(eps, dims)
    parts = core.select("cell", "x", F.col("cell").alias("part"))
    while True:
        todo = layout.settle(todo.withColumn("_near", _box_distance(False)).where(F.col("_near") <= eps).withColumn("_sure", _box_distance(True) <= eps))
        sure = layout.settle(todo.where("_sure").select("cell", "cell2").distinct())
        found = sure if found is None else found.unionByName(sure)
        open_ = layout.settle(todo.join(sure, ["cell", "cell2"], "left_anti").select("cell", "cell2", "part", "part2"))
        if open_.isEmpty():
            both = found.unionByName(found.select(F.col("cell2").alias("cell"), F.col("cell").alias("cell2")))
            return layout.settle(both.select(F.col("cell").alias("a"), F.col("cell2").alias("b")))
        width /= 2
        live = open_.select("cell", "part").unionByName(open_.select(F.col("cell2").alias("cell"), F.col("part2").alias("part"))).distinct()
        parts = layout.settle(layout.salted(parts, live, ["cell", "part"], salt="x").select("cell", "x", F.col("part").alias("_up"), _cell(width).alias("part")))
        small = layout.settle(_boxes(parts, dims, "cell", "_up", "part").drop("m"))
        one = small.select("cell", F.col("_up").alias("_a"), "part", "lo", "hi")
        two = small.select(F.col("cell").alias("cell2"), F.col("_up").alias("_b"), F.col("part").alias("part2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        todo = (open_.withColumnsRenamed({"part": "_a", "part2": "_b"}).join(one, ["cell", "_a"]).join(two, ["cell2", "_b"]))


def dbscan(points: DataFrame, cols: Sequence[str], eps: float, min_samples: int = 3, key: str = "id") -> DataFrame:
    """``points`` with ``label``: clusters numbered from 0 by their least core ``key``, -1 for noise.

    A core point has ``min_samples`` points within ``eps``, itself included.  Other points within ``eps`` of a core point
    take the lowest label among those.  Rows with a missing or infinite value have no label.  ``key`` must be unique.
    """
    layout.unpacked_sizes(points.sparkSession)
    dims = len(cols)
    reach = math.floor(math.sqrt(dims)) + 1
    whole = F.array(*[F.col(c).cast("double") for c in cols])
    rows = layout.settle(points.select(F.col(key).alias("_id"), whole.alias("x")).where(
        F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))).withColumn(
            "cell", _cell(_width(eps, dims))))
    cells = layout.settle(_boxes(rows, dims, "cell"))
    near = layout.settle(_around(cells, dims, reach).where(_box_distance(False) <= eps))
    if not cells.where(distance("lo", "hi") > eps).isEmpty():
        raise ValueError("coordinates are too large for cells of this radius; scale the columns first")
    dense = cells.where(F.col("m") >= min_samples).select("cell")
    few = layout.settle(layout.salted(rows, dense, ["cell"], "left_anti", "_id"))
    inside = near.withColumn("_all", _box_distance(True) <= eps)
    by_cell = few.join(inside.where("_all").groupBy("cell").agg(F.sum("m2").alias("_whole")), "cell", "left").select("_id", "x", "cell", "_whole")
    part = few.join(inside.where("not _all").select("cell", "cell2"), "cell").select("_id", "x", "cell2")
    other = rows.select(F.col("cell").alias("cell2"), F.col("x").alias("x2"), F.col("_id").alias("_id2"))
    single = layout.salted(other, part, ["cell2"], salt="_id2", salts=SALTS).where(distance("x", "x2") <= eps)
    count = by_cell.join(single.groupBy("_id").agg(F.count(F.lit(1)).alias("_some")), "_id", "left")
    count = layout.settle(count.select("_id", "x", "cell", (F.coalesce("_whole", F.lit(0)) + F.coalesce("_some", F.lit(0)) >= min_samples).alias("core")))
    core = layout.settle(layout.salted(rows, dense, ["cell"], "left_semi", "_id").unionByName(count.where("core").drop("core")))
    first = core.groupBy("cell").agg(F.min("_id").alias("_first"))
    parts = components(first.select(F.col("cell").alias("node")), _linked(core, cells, dims, eps, reach))
    roots = layout.settle(parts.join(first.withColumnRenamed("cell", "node"), "node"))
    order = roots.groupBy("root").agg(F.min("_first").alias("_first")).withColumn("trace", F.lit(0))
    numbers = layout.index_samples(order, ["_first"]).select("root", F.col("i").alias("label"))
    of_cell = layout.settle(roots.join(numbers, "root").select(F.col("node").alias("cell"), "label"))
    edge = count.where("not core").join(near.select("cell", "cell2"), "cell").join(of_cell.withColumnRenamed("cell", "cell2"), "cell2").select("_id", "x", "cell2", "label")
    other = core.select(F.col("cell").alias("cell2"), F.col("x").alias("x2"), F.col("_id").alias("_id2"))
    border = layout.salted(other, edge, ["cell2"], salt="_id2", salts=SALTS).where(distance("x", "x2") <= eps).groupBy("_id").agg(F.min("label").alias("label"))
    labels = layout.salted(core, of_cell, ["cell"], salt="_id").select("_id", "label").unionByName(
        count.where("not core").select("_id").join(border, "_id", "left").select("_id", F.coalesce("label", F.lit(-1)).alias("label")))
    return points.join(labels.withColumnRenamed("_id", key), key, "left")


def k_distances(points: DataFrame, cols: Sequence[str], k: int = 3, key: str = "id") -> DataFrame:
    """``key, distance`` to the k-th nearest point, the point itself counted first; NULL with fewer than k points.

    Cells are halved as long as they hold k points, which bounds the distance by the cell's diagonal; a point is then measured
    against the cells of that width around its own.  A cell of equal points needs no measuring.
    """
    layout.unpacked_sizes(points.sparkSession)
    dims = len(cols)
    reach = math.floor(math.sqrt(dims)) + 1
    rows = layout.settle(points.select(F.col(key).alias("_id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x")).where(
        F.forall("x", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))))
    box = _boxes(rows, dims).first()
    if box["m"] < k:
        return rows.select(F.col("_id").alias(key), F.lit(None).cast("double").alias("distance"))
    width = max([max(abs(a), abs(b)) for a, b in zip(box["lo"], box["hi"])] + [1e-300]) * 2
    todo, done = rows.withColumn("_w", F.lit(math.inf)), None
    while True:
        at = layout.settle(todo.withColumn("cell", _cell(width)))
        size = layout.settle(_boxes(at, dims, "cell").where(f"m >= {k}").select("cell", (F.col("lo") == F.col("hi")).alias("_same")))
        marked = layout.settle(layout.salted(at, size, ["cell"], "left", "_id"))
        zero = marked.where("_same").select("_id", F.lit(0.0).alias("distance"))
        rest = marked.where("_same is null").select("_id", "x")
        found = zero.unionByName(_measured(rest, rows, 2 * width, dims, reach, k))
        found = layout.settle(found)
        done = found if done is None else done.unionByName(found)
        todo = marked.where("not _same").select("_id", "x")
        if todo.isEmpty():
            return done.select(F.col("_id").alias(key), "distance")
        width /= 2


def _measured(queries: DataFrame, rows: DataFrame, width: float, dims: int, reach: int, k: int) -> DataFrame:
    """k-th distances of points whose cell of this width holds k points."""
    index = [f"c{j}" for j in range(min(dims, INDEXED))]
    q = queries.withColumn("cell", _cell(width))
    for j, c in enumerate(index):
        q = q.withColumn(c, F.explode(F.expr(f"transform(sequence(-{reach}, {reach}), o -> cell[{j}] + o)")))
    other = rows.select(F.col("_id").alias("_id2"), F.col("x").alias("x2"), F.transform("x", lambda v: F.floor(v / width)).alias("cell2"))
    other = other.select("_id2", "x2", "cell2", *[F.col("cell2")[j].alias(c) for j, c in enumerate(index)])
    pairs = layout.salted(other, q, index, salt="_id2", salts=SALTS).where(
        F.forall(F.zip_with("cell", "cell2", lambda p, r: F.abs(p - r) <= reach), lambda v: v)).select("_id", distance("x", "x2").alias("distance"))
    nth = F.row_number().over(Window.partitionBy("_id").orderBy("distance"))
    return pairs.withColumn("_n", nth).where(F.col("_n") <= k).groupBy("_id").agg(F.max("distance").alias("distance"))


def knee(distances: DataFrame, value: str = "distance", sensitivity: float = 1.0) -> tuple[int, float] | None:
    """Position and value of the knee of the rising convex curve of sorted values (the Kneedle rule); NULLs are left out.

    Both axes are scaled to one and the curve is read from its upper end.  A local maximum of its height over the diagonal is a knee
    once the height falls below it by ``sensitivity`` mean steps before the next maximum (below zero after a minimum).
    Without one, the greatest second difference decides.
    """
    curve = distances.where(F.col(value).isNotNull()).select(F.lit(0).alias("trace"), F.col(value).cast("double").alias("y"))
    curve = layout.settle(layout.index_samples(curve.withColumn("_tie", F.monotonically_increasing_id()), ["y", "_tie"]).drop("_tie"))
    n, low, high = curve.agg(F.count(F.lit(1)), F.min("y"), F.max("y")).first()
    if not n:
        return None
    if n > 1 and high > low:
        # position p from the upper end: i = n - 1 - p
        h = (1 - (F.col("y") - low) / (high - low)) - (F.lit(n - 1.0) - F.col("i")) / (n - 1.0)
        line = layout.sliding(curve.withColumn("h", h), 1, 1, {"_before": lambda w, f: F.lead("h").over(w), "_after": lambda w, f: F.lag("h").over(w)})
        top = (F.col("h") >= F.coalesce("_before", "h")) & (F.col("h") >= F.coalesce("_after", "h"))
        bottom = (F.col("h") <= F.coalesce("_before", "h")) & (F.col("h") <= F.coalesce("_after", "h"))
        limit = F.when(bottom, 0.0).when(top, F.col("h") - sensitivity / (n - 1.0))
        line = line.withColumn("_limit", limit).withColumn("_top", F.when(top, F.col("i")))
        filled = layout.fill(line, {"_l": "_limit", "_t": "_top"}, backward=True)
        hit = filled.where("_t is not null and _after < _l").agg(F.max_by("_t", "i")).first()[0]
        if hit is not None:
            return int(hit), float(curve.where(F.col("i") == hit).first()["y"])
    slope = lambda c: lambda w, f: (F.coalesce(F.lead(c).over(w), F.col(c)) - F.coalesce(F.lag(c).over(w), F.col(c))) / F.when(
        F.lead(c).over(w).isNull() | F.lag(c).over(w).isNull(), 1.0).otherwise(2.0)
    bent = layout.sliding(layout.sliding(curve, 1, 1, {"_d": slope("y")}), 1, 1, {"_dd": slope("_d")})
    at = bent.agg(F.min_by("i", F.struct(-F.col("_dd"), F.col("i")))).first()[0]
    return int(at), float(curve.where(F.col("i") == at).first()["y"])


def cluster(points: DataFrame, cols: Sequence[str], eps: float | None = None, min_samples: int = 3, key: str = "id") -> tuple[DataFrame, float | None]:
    """`dbscan` with the radius given, or taken at the knee of the distances to the ``min_samples``-th point."""
    if eps is None:
        found = knee(k_distances(points, cols, min_samples, key))
        if found is None:
            return points.withColumn("label", F.lit(-1).cast("bigint")), None
        eps = found[1]
    return dbscan(points, cols, eps, min_samples, key), eps
