"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's length.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairs of features interact
through rank-``FACTORS`` vectors, in time linear in the features.  Words are hashed into ``WORDS`` slots, weighted by the
root of their count and scaled to length 1; each statistic falls into one of ``BINS`` quantile bins, one feature a bin.

Fitted on at most ``TRAIN_ROWS`` labelled rows, those with the smallest hash of their id, never on held-out ones; labels,
language, source and id are no inputs of a score.  A null text scores as an empty one; a null id counts as held out.
Without labelled rows every score is 0.5.  Repeated rows give repeated rows; an empty table gives an empty result; columns
that are not named in a call are ignored, whatever they are called, and long texts are read whole in batches of bounded bytes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LONG_WORD, slices

TRAIN_ROWS = 12_000
WORDS, FACTORS, BINS = 1 << 13, 8, 8
#: Passes over the sample at least, and steps at least: a small sample is passed over more often.
EPOCHS, UPDATES, BATCH, RATE, DECAY = 10, 1_200, 128, 0.1, 1e-5
ACCEPT = 0.3
REMEMBERED = 200_000
UPPER, DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
SYMBOLS = b"!#$%&*+/<=>?@[\\]^_`{|}~"
STOPS = b".,;:"
STATS = 12


class Slots(dict):
    """Word to slot, kept as words come, but for long ones."""

    def __missing__(self, word: bytes) -> int:
        slot = xxhash.xxh32_intdigest(word) & (WORDS - 1)
        if len(word) <= LONG_WORD:
            if len(self) > REMEMBERED:
                self.clear()
            self[word] = slot
        return slot


def features(text: str, slots: Slots) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Slots of the words, their weights, and the statistics of a whole text."""
    raw = text.encode()
    words = raw.lower().split()
    n, m = max(len(raw), 1), max(len(words), 1)
    ids, counts = np.unique(np.fromiter(map(slots.__getitem__, words), np.int64, len(words)), return_counts=True)
    weights = np.sqrt(counts / m)  # of length 1
    lines = text.split("\n")
    left = lambda drop: len(raw.translate(None, drop))
    stats = [
        math.log1p(len(text)),
        math.log1p(len(words)),
        (n - left(UPPER)) / n,
        (n - left(DIGIT)) / n,
        (n - left(SYMBOLS)) / n,
        (n - left(STOPS)) / n,
        (n - left(bytes(range(128, 256)))) / n,
        len(raw) / m,
        len(set(words)) / m,
        len(set(lines)) / len(lines),
        math.log1p(len(lines)) - math.log1p(len(words)),
        float(np.max(counts)) / m if len(counts) else 0.0,
    ]
    return ids, weights, stats


@dataclass
class Model:
    edges: np.ndarray  # of the bins, STATS x (BINS - 1)
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def encode(self, ids: np.ndarray, weights: np.ndarray, stats: list[float]) -> tuple[np.ndarray, np.ndarray]:
        bins = (np.asarray(stats)[:, None] > self.edges).sum(1) + WORDS + np.arange(STATS) * BINS
        return np.concatenate([ids, bins]), np.concatenate([weights, np.full(STATS, 1 / math.sqrt(STATS))])

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.factors[at] * x[:, None]
        return float(self.bias + self.linear[at] @ x + 0.5 * ((vx.sum(0) ** 2).sum() - (vx**2).sum()))

    def score(self, text: str, slots: Slots) -> float:
        z = self.raw(*self.encode(*features(text, slots)))
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, list[float]]], labels: np.ndarray, seed: int = 7) -> Model:
    """Logistic loss, AdaGrad, small batches."""
    rng = np.random.default_rng(seed)
    size = WORDS + STATS * BINS
    stats = np.array([r[2] for r in rows]) if rows else np.zeros((1, STATS))
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T
    model = Model(edges, 0.0, np.zeros(size), rng.normal(0, 0.05, (size, FACTORS)))
    if not rows:
        model.factors[:] = 0
        return model
    rate = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    model.bias = math.log(rate / (1 - rate))
    coded = [model.encode(*r) for r in rows]
    square_w, square_v, square_b = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    for _ in range(max(EPOCHS, -(-UPDATES * BATCH // len(coded)))):
        order = rng.permutation(len(coded))
        for start in range(0, len(order), BATCH):
            batch = order[start : start + BATCH]
            at, x = (np.concatenate([coded[i][j] for i in batch]) for j in (0, 1))
            ends = np.cumsum([len(coded[i][0]) for i in batch])
            first = np.concatenate([[0], ends[:-1]])
            row = np.repeat(np.arange(len(batch)), ends - first)
            vx = model.factors[at] * x[:, None]
            sums = np.add.reduceat(vx, first)
            z = model.bias + np.add.reduceat(model.linear[at] * x, first) + 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), first))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[batch]) / len(batch)
            slot, where = np.unique(at, return_inverse=True)
            push = error[row] * x
            grad_w = np.bincount(where, push, len(slot)) + DECAY * model.linear[slot]
            each = push[:, None] * (sums[row] - vx)
            grad_v = np.stack([np.bincount(where, each[:, f], len(slot)) for f in range(FACTORS)], 1) + DECAY * model.factors[slot]
            square_w[slot] += grad_w**2
            square_v[slot] += grad_v**2
            square_b += error.sum() ** 2
            model.linear[slot] -= 2 * RATE * grad_w / np.sqrt(square_w[slot])
            model.factors[slot] -= RATE * grad_v / np.sqrt(square_v[slot])
            model.bias -= RATE * error.sum() / math.sqrt(square_b)
    model.linear, model.factors = model.linear.astype(np.float32), model.factors.astype(np.float32)
    return model


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents that aren't held out; their features, not their texts, reach the driver.

    Where rows that repeat a key would make them more than twice ``rows``, the text with the smallest hash stands for a key.
    """
    chosen = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & ~held_out(F.col("key")))
    chosen = chosen.orderBy(F.xxhash64("key"), "key", "label").limit(rows)
    found = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "key").select("key", "label", "text")
    if found.count() > 2 * rows:
        of = F.struct(F.xxhash64("text").alias("mark"), "text")
        found = found.groupBy("key", "label").agg(F.min(of).alias("of")).select("key", "label", "of.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for part in slices(batches, 2):
            done = [features(t or "", slots) for t in part.column(2).to_pylist()]
            columns = [pa.array([d[0].astype(np.int32) for d in done], pa.list_(pa.int32())), pa.array([d[1].astype(np.float32) for d in done], pa.list_(pa.float32())), pa.array([d[2] for d in done], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["key", "label", "ids", "weights", "stats"])

    kind = found.schema["key"].dataType.simpleString()
    got = found.mapInArrow(run, f"key {kind}, label int, ids array<int>, weights array<float>, stats array<double>").toArrow().combine_chunks()
    # the same order however tasks end, so the same model
    order = sorted(range(len(got)), key=lambda i: (str(got["key"][i]), got["label"][i].as_py(), got["stats"][i].as_py()))
    rows_ = [(got["ids"][i].values.to_numpy(), got["weights"][i].values.to_numpy().astype(float), got["stats"][i].as_py()) for i in order]
    return fit(rows_, np.array([got["label"][i].as_py() for i in order], float))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the columns to ``carry``, ``held_out``, ``score``, ``predicted``; a text to carry travels once."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # WORDS + STATS * BINS vectors of FACTORS + 1 numbers

    kept = text in carry and docs.schema[text].dataType.typeName() == "string"
    source = docs.select(F.col(key), *carry) if kept else docs.select(F.col(key), *carry, F.col(text).cast("string").alias("__scored"))
    at = source.columns.index(text) if kept else len(source.columns) - 1
    fields = source.schema.fields if kept else source.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, known = Slots(), held.value
        for part in slices(batches, at):
            scores = [known.score(t or "", slots) for t in part.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[: len(fields)], pa.array(scores, pa.float64())], names=[*part.schema.names[: len(fields)], "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    scored = source.mapInArrow(run, f"{schema}, score double")
    return scored.select(key, *carry, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
