"""Reading, combining and writing sample tables."""
from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None,
         schema: StructType | str | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """Read sample files with an explicit schema and only the needed columns."""
    reader = spark.read.format(fmt).options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load([paths] if isinstance(paths, str) else list(paths))
    return df.select(*columns) if columns else df


def scan_datasets(spark: SparkSession, roots: Sequence[str], relative: str,
                  columns: Sequence[str] | None = None, exclude: Iterable[str] = (),
                  fmt: str = "parquet", **options) -> DataFrame:
    """Read the same file of several dataset folders; ``source`` tells the file.

    A missing required file fails at once.  Paths matching an ``exclude`` suffix, such as
    a job's own earlier output, are left out.
    """
    paths = [f"{r.rstrip('/')}/{relative}" for r in roots]
    df = spark.read.format(fmt).options(**options).load(paths)
    df = df.withColumn("source", F.col("_metadata.file_path"))
    for suffix in exclude:
        df = df.where(~F.endswith(F.col("source"), F.lit(suffix)))
    return df.select(*columns, "source") if columns else df


def first_existing(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet",
                   **options) -> DataFrame:
    """The first of several candidate files that exists."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        path = fs_path(p)
        if path.getFileSystem(conf).exists(path):
            return spark.read.format(fmt).options(**options).load(p)
    raise FileNotFoundError(f"none of {list(paths)} exists")


def union_sources(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by column name; missing columns are NULL, order is first seen."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def mark_kept(samples: DataFrame, kept: DataFrame) -> DataFrame:
    """Flag samples of kept traces (``trace``, optional offsets are ignored)."""
    ids = kept.select("trace").distinct().withColumn("kept", F.lit(True))
    return samples.join(ids, "trace", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def write_split(marked: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One pass over the samples writes kept and discarded rows to separate folders."""
    marked.write.mode(mode).partitionBy("kept").parquet(path)
