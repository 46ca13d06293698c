"""Winnowing fingerprints: rolling k-gram hashes, the least of each window (rightmost of ties), positions kept.

Any passage of ``k + window - 1`` or more code points that two texts share leaves at least one common fingerprint.
A text of fewer than ``k`` code points is one gram.  An empty or null text has no fingerprint; two empty fingerprints
are alike (1.0), an empty and a full one are not (0.0).

``edit_likeness`` needs each document's neighbour in descending order of ids.  Ids alone are range-partitioned to find
bucket bounds; each bucket then gets its rows and, as a last row, the head of the next bucket, so no task sees more than
one bucket and nothing is ordered globally.  Rows with equal ids follow each other by text, and are one bucket together, as
are all null ids, which come last.  An empty table gives an empty result; columns but the key and the text are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

K, WINDOW = 12, 20
BASE = 0x9E3779B97F4A7C15 | 1
#: Rows of a bucket where the table is large, and buckets for each shuffle partition where it is small.
BUCKET_ROWS, BUCKETS = 20_000, 4


def grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all k-grams, modulo 2**64, by doubling."""
    power, length, block = BASE, 1, codes + np.uint64(1)
    done, done_length = None, 0
    while True:
        if k & length:
            if done is None:
                done, done_length = block, length
            else:  # done covers the first part, block the part after it
                n = len(codes) - done_length - length + 1
                done = done[:n] * np.uint64(power) + block[done_length : done_length + n]
                done_length += length
        if length * 2 > k:
            return done
        n = len(block) - length
        block = block[:n] * np.uint64(power) + block[length:]
        power, length = power * power & (1 << 64) - 1, length * 2


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes and their positions, in order."""
    if not text:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    values = grams(codes, min(k, len(codes)))
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    keys = (values & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(values), dtype=np.uint64))
    least, span, want = keys, 1, min(window, len(keys))
    while span * 2 <= want:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    if span < want:
        least = np.minimum(least[: len(least) - (want - span)], least[want - span :])
    least = least[np.concatenate([[True], least[1:] != least[:-1]])]
    return (least >> np.uint64(32)).astype(np.uint32), (0xFFFFFFFF - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of distinct sorted hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """``key``, ``hashes array<bigint>`` and ``positions array<bigint>`` (code points) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            both = [winnow(t or "", k, window) for t in part.column(1).to_pylist()]
            columns = [pa.array([x[i].astype(np.int64) for x in both], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["key", "hashes", "positions"])

    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, hashes array<bigint>, positions array<bigint>").withColumnRenamed("key", key)


def written(hashes: np.ndarray) -> str:
    """Eight hexadecimal digits a hash, in order of position."""
    return hashes.astype(">u4").tobytes().hex()


def shared(hashes: np.ndarray, positions: np.ndarray, others: np.ndarray, k: int) -> tuple[int | None, int | None]:
    """Where in a text the grams lie that another fingerprint holds too: the first one's start and the last one's end."""
    met = positions[np.isin(hashes, others)]
    return (int(met[0]), int(met[-1]) + k) if len(met) else (None, None)


def heads(ids: DataFrame, buckets: int) -> list[int]:
    """The greatest id of each of about ``buckets`` ranges of ids, descending."""
    parts = ids.where("id IS NOT NULL").repartitionByRange(buckets, F.desc("id"))
    found = parts.groupBy(F.spark_partition_id().alias("part")).agg(F.max("id").alias("id"))
    return sorted((r["id"] for r in found.collect()), reverse=True)


def edit_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each document against its edited text (its last third replaced from the next document) and the next document.

    ``positions`` are those of the fingerprint's hashes; ``kept_from`` and ``kept_to`` bound the grams met in the edited text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    ids = rows.select("id")
    shuffles, n = int(spark.conf.get("spark.sql.shuffle.partitions")), ids.count()
    tops = heads(ids, max(math.ceil(n / bucket_rows), min(math.ceil(n / 200), BUCKETS * shuffles), 1))
    ascending = np.array(tops[::-1] or [0], np.int64)

    @F.pandas_udf("int")
    def bucket(id: pd.Series) -> pd.Series:
        place = np.searchsorted(ascending, id.fillna(ascending[0]).astype(np.int64).to_numpy(), "left")
        return pd.Series((len(ascending) - 1 - place).clip(0).astype(np.int32))

    own = rows.select(bucket("id").alias("bucket"), F.lit(False).alias("guest"), "id", "text")
    # one row a bucket, and buckets hold bucket_rows rows: at 10**11 documents some tens of MB
    to = spark.createDataFrame([((i - 1) % len(tops), t) for i, t in enumerate(tops)] or [(0, 0)], "bucket int, id long")
    guests = rows.join(F.broadcast(to), "id").select("bucket", F.lit(True).alias("guest"), "id", "text")
    if not tops:  # every id is null: the first row by text follows the last
        guests = rows.orderBy("text").limit(1).select(F.lit(0).alias("bucket"), F.lit(True).alias("guest"), "id", "text")
    order = ["bucket", "guest", F.desc_nulls_last("id"), F.asc_nulls_first("text")]
    dealt = own.unionByName(guests).repartition(max(shuffles, 1), "bucket").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions", "kept_from", "kept_to"]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64(), pa.list_(pa.int32()), pa.int64(), pa.int64()]
        out, size, waiting, closed = [], 0, None, None
        for part in slices(batches, 3):
            for at, guest, id, value in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if guest and closed == at:
                    continue  # one neighbour is enough
                value = value or ""
                hashes, places = winnow(value, k, window)
                known = np.unique(hashes)
                if waiting and waiting[0] == at:
                    _, own_id, own_text, own_hashes, own_known, own_places = waiting
                    third = len(own_text) // 3
                    edited = own_text[: len(own_text) - third] + value[:third]
                    edited_hashes = winnow(edited, k, window)[0]
                    span = shared(own_hashes, own_places, edited_hashes, min(k, len(own_text)))
                    row = (own_id, len(own_text), hashlib.sha256(edited.encode()).hexdigest(), written(own_hashes), written(edited_hashes), likeness(own_known, np.unique(edited_hashes)), likeness(own_known, known), own_places.astype(np.int32), *span)
                    out.append(row)
                    size += len(row[3]) + len(row[4]) + 4 * len(own_places) + 150
                waiting = None if guest else (at, id, value, hashes, known, places)
                closed = at if guest else None
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    result = dealt.mapInArrow(run, "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>, kept_from long, kept_to long")
    return result.withColumnRenamed("key", key)
