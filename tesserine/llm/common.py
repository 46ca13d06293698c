"""What the operators share: reading tables, cutting lineage through the shared folder, splitting batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python operator turns into one output batch.
SLICE_BYTES = 4 << 20
#: Bytes of the longest word that a worker's caches keep.
LONG_WORD = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of our own only on a single machine that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tesserine-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tesserine/{uuid.uuid4().hex}-{label}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.cut_to = path
    return written


def drop_cut(*frames: DataFrame | None) -> None:
    """Delete the files of tables that ``cut`` wrote and that no later result reads."""
    for df in frames:
        if folder := getattr(df, "cut_to", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the strings in ``column`` of one slice take about ``limit`` bytes; a longer row stands alone."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = size = 0
        for row, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(start, row - start)
                start, size = row, 0
            size += int(n) + 64
        if len(lengths) > start:
            yield batch.slice(start)


def fold_case(text):
    """Lower-case A-Z alone, as a column."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

