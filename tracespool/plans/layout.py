"""Chunked layout of ordered traces.

Window functions partitioned by trace put a whole trace into one task.  Traces differ
in length by orders of magnitude, so everything that needs order is expressed over
``(trace, chunk)`` instead:

* finite windows copy a few *halo* rows into the neighbouring chunks (`sliding`),
* running totals add the totals of all earlier chunks (`running_sum`),
* fills carry the last value of earlier chunks (`fill`),
* per-trace values travel to the samples keyed by chunk (`spread`), so that the join
  stays balanced when one trace dominates.

The table of chunk totals has one row per chunk, so the only window over a whole trace
runs on data ``rows`` times smaller than the samples.
"""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 16
SALTS = 16
SLOT_CHUNKS = 4  #: chunks per slot of ordered work
PIECES = 1024  #: partitions of a shuffle before they are merged by size
PIECE_BYTES = "16m"
UNPACKED = 32.0  #: bytes of rows per byte of a written table, for the planner's choice of joins


def settle(df: DataFrame) -> DataFrame:
    """Write a table that later steps read more than once, and read it back.

    Without this each two-pass step doubles the work below it.  The table goes to the
    shared folder of ``spark.checkpoint.dir`` (survives lost executors, keeps column
    pruning and real sizes for join planning); local sessions without one get their own.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/tracespool-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unpacked_sizes(spark: SparkSession) -> None:
    """Let the planner judge files by the size of their rows.

    Sorted numbers shrink up to seventyfold on disk, so a written table below the broadcast threshold would be sent
    whole to the driver and take hundreds of megabytes there.  A factor that the user has set stays.
    """
    key = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(key)) == 1.0:
        spark.conf.set(key, str(UNPACKED))


def bounded_tasks(spark: SparkSession) -> None:
    """Let shuffles start from many partitions, which the planner merges by their size.

    A fixed number of partitions gives each task a fixed share of the input, so its memory grows with the table; merged ones
    hold up to ``PIECE_BYTES`` each, as sorted rows take tens of times their shuffled bytes.  Numbers that the user has set stay.
    """
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(max(PIECES, int(spark.conf.get("spark.sql.shuffle.partitions")))))
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", PIECE_BYTES)
        spark.conf.set("spark.sql.files.maxPartitionBytes", PIECE_BYTES)


def by_group(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle rows for a grouped Python step at full shuffle parallelism.

    Such steps are bound by computation, not bytes, so small inputs must not be merged
    into few partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys)


def whole_groups(batches, keys: Sequence[str]):
    """Cut Arrow batches sorted by ``keys`` into tables of whole groups, with the row at which each group begins and the end.

    For grouped Python steps over many small groups: one table comes and goes per batch, not per group.
    """
    def row(batch, at):
        return [batch.column(k)[at].as_py() for k in keys]

    held, key = [], None  # rows of the one group that may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        last = row(batch, -1)
        same = bool(held) and last == key
        held.append(batch)
        if same or (len(held) == 1 and row(batch, 0) == last):
            key = last
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        first = _firsts(table, keys)
        yield table.slice(0, first[-1]), first
        held, key = table.slice(first[-1]).to_batches(), last
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), np.array([0, sum(b.num_rows for b in held)])


def _firsts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Row at which each group begins; missing keys are equal."""
    new = np.zeros(table.num_rows - 1, dtype=bool)
    for k in keys:
        column = table.column(k)
        a, b = column.slice(1), column.slice(0, table.num_rows - 1)
        differ = pc.coalesce(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
        new |= differ.to_numpy().astype(bool)
    return np.r_[0, np.flatnonzero(new) + 1]


def with_chunk(df: DataFrame, rows: int | None = None) -> DataFrame:
    rows = rows or CHUNK_ROWS
    return df.withColumn("chunk", F.expr(f"i div {rows}L"))


def sliding(df: DataFrame, left: int, right: int, outputs: dict[str, Callable],
            rows: int | None = None) -> DataFrame:
    """Add columns computed over the frame ``[i-left, i+right]`` of each trace.

    Each output is a function of the ordered, unframed window and the framed one.
    """
    rows = rows or CHUNK_ROWS
    lo = f"greatest(0L, (i - {right}L) div {rows}L)"
    hi = f"(i + {left}L) div {rows}L"  # a copy past the last chunk is dropped below
    wide = (df.withColumn("_home", F.expr(f"i div {rows}L"))
              .withColumn("chunk", F.explode(F.expr(f"sequence({lo}, {hi})"))))
    order = Window.partitionBy("trace", "chunk").orderBy("i")
    frame = order.rowsBetween(-left, right)
    wide = wide.select("*", *[fn(order, frame).alias(name) for name, fn in outputs.items()])
    return wide.where("chunk = _home").drop("_home")


def _earlier(keys: Sequence[str], block: str, backward: bool) -> Window:
    order = F.col(block).desc() if backward else F.col(block).asc()
    return (Window.partitionBy(*keys).orderBy(order)
            .rowsBetween(Window.unboundedPreceding, -1))


def running_sum(df: DataFrame, sums: dict[str, str | Column], keys: Sequence[str] = ("trace",),
                block: str = "chunk", order: Sequence = ("i",)) -> DataFrame:
    """Inclusive running totals per key; the expressions may not contain windows."""
    exprs = {k: (F.expr(v) if isinstance(v, str) else v) for k, v in sums.items()}
    totals = df.groupBy(*keys, block).agg(*[F.sum(e).alias(f"_t_{k}") for k, e in exprs.items()])
    w = _earlier(keys, block, False)
    base = totals.select(*keys, block, *[F.sum(f"_t_{k}").over(w).alias(f"_b_{k}") for k in exprs])
    inner = (Window.partitionBy(*keys, block).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, 0))
    joined = df.join(base, [*keys, block])
    out = [(F.coalesce(F.col(f"_b_{k}"), F.lit(0)) + F.coalesce(F.sum(e).over(inner), F.lit(0)))
           .alias(k) for k, e in exprs.items()]
    return joined.select("*", *out).drop(*[f"_b_{k}" for k in exprs])


def fill(df: DataFrame, values: dict[str, str], keys: Sequence[str] = ("trace",),
         block: str = "chunk", order: str = "i", backward: bool = False,
         inclusive: bool = True) -> DataFrame:
    """Nearest non-null value at or before each row (at or after when ``backward``).

    ``order`` must be unique per key; ``values`` maps output name to source column.
    """
    pick = F.min_by if backward else F.max_by
    pos = {k: F.when(F.col(v).isNotNull(), F.col(order)) for k, v in values.items()}
    ends = df.groupBy(*keys, block).agg(
        *[pick(F.col(v), pos[k]).alias(f"_e_{k}") for k, v in values.items()])
    w = _earlier(keys, block, backward)
    base = ends.select(*keys, block, *[F.last(f"_e_{k}", ignorenulls=True).over(w).alias(f"_c_{k}")
                                       for k in values])
    direction = F.col(order).desc() if backward else F.col(order).asc()
    inner = (Window.partitionBy(*keys, block).orderBy(direction)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    out = [F.coalesce(F.last(v, ignorenulls=True).over(inner), F.col(f"_c_{k}")).alias(k)
           for k, v in values.items()]
    return df.join(base, [*keys, block]).select("*", *out).drop(*[f"_c_{k}" for k in values])


def spread(df: DataFrame, per_trace: DataFrame, how: str = "inner",
           rows: int | None = None) -> DataFrame:
    """Join per-trace values to chunked rows, one copy per chunk.

    The number of chunks comes from ``_last`` (highest chunk) if present, else from the
    trace length ``n``; both are dropped.
    """
    rows = rows or CHUNK_ROWS
    last = "_last" if "_last" in per_trace.columns else f"greatest(0L, (n - 1) div {rows}L)"
    wide = per_trace.withColumn("chunk", F.explode(F.expr(f"sequence(0L, {last})"))).drop("n", "_last")
    return df.join(wide, ["trace", "chunk"], how)


def salted(df: DataFrame, per_key: DataFrame, keys: Sequence[str], how: str = "inner",
           salt: str | None = None, salts: int = SALTS) -> DataFrame:
    """Equi-join whose left side may be dominated by one key and carries no chunk.

    The salt is a hash of the row (or of ``salt``), so a recomputed task sends its rows to
    the same places.
    """
    seed = [F.expr(salt)] if salt else [F.col(c) for c in df.columns]
    left = df.withColumn("_salt", F.pmod(F.xxhash64(*seed), F.lit(salts)).cast("int"))
    right = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def slotted(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int | None = None) -> DataFrame:
    """Add ``_slot``, which cuts each key's rows into pieces in ``order``, and write the table.

    Slots are the partitions of a range partitioning by key and order, whose bounds come from a sample of
    the rows: a slot holds about ``SLOT_CHUNKS`` chunks whatever the spread of the values, and only rows equal in
    ``order`` must share one.  The table is written, so that a lost task cannot draw other bounds.
    """
    unpacked_sizes(df.sparkSession)
    bounded_tasks(df.sparkSession)
    rows = (rows or CHUNK_ROWS) * SLOT_CHUNKS
    parts = -(-df.count() // rows)
    if parts > 1:
        df = df.repartitionByRange(parts, *keys, *order)
        return settle(df.withColumn("_slot", F.spark_partition_id().cast("long")))
    return settle(df.withColumn("_slot", F.lit(0).cast("long")))


def add_slots(df: DataFrame, keys: Sequence[str], order: Sequence[str], salt: str | None = None,
              rows: int | None = None) -> DataFrame:
    """Add ``n`` (rows per key) and ``_slot``, as `slotted` does."""
    cut = slotted(df, keys, order, rows)
    return salted(cut, cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, salt=salt)


def index_samples(df: DataFrame, order: Sequence[str], rows: int | None = None) -> DataFrame:
    """Give unordered rows of each trace their position ``i`` in ``order`` and length ``n``.

    A long trace is cut into slots, so ranking happens inside a slot and slot counts give the offset.
    """
    cut = slotted(df, ["trace"], order, rows)
    sizes = cut.groupBy("trace", "_slot").agg(F.count(F.lit(1)).alias("_m"))
    base = sizes.select("trace", "_slot", F.sum("_m").over(Window.partitionBy("trace")).alias("n"),
                        F.coalesce(F.sum("_m").over(_earlier(["trace"], "_slot", False)), F.lit(0)).alias("_before"))
    # lengths and offsets travel together, in the one shuffle that ranking needs
    inner = Window.partitionBy("trace", "_slot").orderBy(*order)
    ranked = cut.join(base, ["trace", "_slot"]).withColumn("i", F.col("_before") + F.row_number().over(inner) - 1)
    return with_chunk(ranked.drop("_before", "_slot").select(*df.columns, "n", "i"), rows)


def reindex(df: DataFrame, rows: int | None = None, keep: str | None = None) -> DataFrame:
    """Close the gaps of ``i`` after a filter; ``keep`` names a copy of the old position."""
    if keep:
        df = df.withColumn(keep, F.col("i"))
    size = df.groupBy("trace", "chunk").agg(F.count(F.lit(1)).alias("_m"))
    span = size.groupBy("trace").agg(F.sum("_m").alias("n"), F.max("chunk").alias("_last"))
    span = span.withColumn("chunk", F.explode(F.expr("sequence(0L, _last)"))).drop("_last")
    ranked = running_sum(df.drop("n"), {"_rank": F.lit(1)})
    ranked = ranked.join(span, ["trace", "chunk"])
    return with_chunk(ranked.withColumn("i", F.expr("cast(_rank - 1 as bigint)")).drop("_rank"), rows)
