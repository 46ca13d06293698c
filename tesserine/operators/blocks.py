"""All pairs of two tables of vectors within a group, block by block: bounded memory, and tasks dealt by pairs of blocks.

Products are summed in double precision from the first coordinate on, as ``retrieval.dot`` does, so equal vectors have equal
products wherever they lie.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.operators.spreading import spread

#: Rows of a block on average; rows of one tile of products, which stays in a core's cache.
BLOCK_ROWS, TILE = 2_048, 64
#: Tasks at most; more pairs of blocks than that share them.
MOST_TASKS = 5_000


def sized(rows: DataFrame, by: str, name: str) -> DataFrame:
    return rows.where(F.col(by).isNotNull()).groupBy(by).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(name))


def met(left: DataFrame, right: DataFrame, by: str, left_id: Column, right_id: Column, pair: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What ``pair`` gives for each block of ``left`` with each block of ``right`` of the same group ``by``.

    A row belongs to a block by its id's hash, and goes to each block of the other side.
    """
    sizes = sized(left, by, "__nl").join(sized(right, by, "__nr"), by)

    def dealt(rows: DataFrame, own: str, other: str, key: Column) -> DataFrame:
        placed = rows.where(key.isNotNull()).join(sizes, by).withColumn("__g", F.col(by)).withColumn(own, F.expr("__n" + own[-1]))
        placed = placed.withColumn(own, F.pmod(F.xxhash64(key), F.col(own)).cast("int"))
        placed = placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("__n" + other[-1]) - 1))).drop("__nl", "__nr")
        # columns of its own, as both sides may come from one table
        return placed.select(*(F.col(c).alias(c) for c in placed.columns))

    keys = ["__g", "__l", "__r"]
    a, b = dealt(left, "__l", "__r", left_id), dealt(right, "__r", "__l", right_id)
    # rows are few for the work they make, so their bytes must not decide on the number of tasks
    pairs = sizes.agg(F.sum(F.col("__nl").cast("long") * F.col("__nr"))).first()[0] or 1
    n = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(pairs, MOST_TASKS))
    a, b = (spread(x, *keys, n=n) for x in (a, b))
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(pair, schema)


def matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of doubles, and which of them are there; one with a null in it is not, nor is one of another length."""
    values = column.combine_chunks()
    lengths = np.array(values.value_lengths().fill_null(-1), np.int64)
    size = int(lengths.max(initial=0))
    if len(values) and values.null_count == 0 and values.flatten().null_count == 0 and (lengths == size).all():
        return np.asarray(values.flatten(), np.float64).reshape(-1, size), np.ones(len(values), bool)
    listed = values.to_pylist()
    there = np.array([v is not None and len(v) == size and None not in v for v in listed], bool)
    return np.array([v if t else [0.0] * size for v, t in zip(listed, there, strict=True)], np.float64).reshape(-1, size), there


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b`` (given as columns), summed in order."""
    if a.shape[1] != len(b):
        raise ValueError(f"vectors of {a.shape[1]} and of {len(b)} numbers have no product")
    out, term = np.zeros((len(a), b.shape[1])), np.empty((len(a), b.shape[1]))
    for k in range(a.shape[1]):
        np.multiply(a[:, k, None], b[k], out=term)
        out += term
    return out
