"""Nearest neighbours by inner product: a hierarchical navigable small-world graph per shard, shard results merged.

Rows are dealt to shards by a hash of id and vector.  A shard keeps each distinct vector once, with the ids that bear it (no
more than a query can need: the smallest ``k + 1``), and gives it a level from a geometric distribution.  On each level a
node's candidates are its nearest among the nodes of that level, found by blocked matrix products, since a shard is bounded
(this stands for the searches of one insertion after another, and finds no worse candidates); the usual heuristic then keeps
those that no kept neighbour is nearer to, and links are made mutual.  The graph is stored as flat arrays: neighbours, their
number, and the nodes of each level.  Inner products become distances by one more coordinate that gives all vectors of a
shard the same length.

Queries are sent to the index, not the index to the queries: a block of at most ``BLOCK_BYTES`` of query vectors is
broadcast, and each task walks the graphs of its part of the index, which it reads where they lie, and gives the best ``k``
of all its shards.  So what is shuffled is ``k`` rows a query and task.  A block walks a graph together: greedily on the
upper levels, then a beam of ``EF`` nodes on level 0; with it a full shard of random directions, the hardest case, is
searched at a recall of 0.92 (``tests``).  Scores are computed from the original vectors in double precision, coordinate by
coordinate, so equal vectors score alike.

Vectors that are null, empty, all zero, or hold a null, NaN or infinite component take no part, nor do null ids.  Vectors of
another length than a query's are no candidates of it.  Rows that repeat id and vector count once, and are told apart before
they are dealt to shards; where an id has several vectors, each is a candidate and the least of them is the query.  Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop_cut

K, LINKS, EF, CANDIDATES = 20, 24, 256, 64
#: Rows of a shard, shards at least (so that several cores share a small table), bytes of query vectors that are broadcast
#: at once.
SHARD_ROWS, SHARDS, BLOCK_BYTES = 16_384, 12, 32 << 20
SEED = 97


def scaled(vectors: np.ndarray, by: np.ndarray | float) -> np.ndarray:
    """Single precision suffices to walk a graph, once no component is beyond its range."""
    return (vectors / by).astype(np.float32)


def lengthened(vectors: np.ndarray) -> np.ndarray:
    """One more coordinate, so that all have the longest one's length and nearest is largest inner product."""
    vectors = scaled(vectors, np.abs(vectors).max())
    squares = np.einsum("ij,ij->i", vectors, vectors)
    return np.concatenate([vectors, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]], 1).astype(np.float32)


def nearest(vectors: np.ndarray, members: np.ndarray, count: int) -> np.ndarray:
    """For each member its ``count`` nearest other members, nearest first."""
    own = vectors[members]
    count = min(count, len(members) - 1)
    found = np.empty((len(members), count), np.int64)
    for at in range(0, len(members), 512):
        likeness = own[at : at + 512] @ own.T
        likeness[np.arange(len(likeness)), np.arange(at, at + len(likeness))] = -np.inf
        part = np.argpartition(-likeness, count - 1, axis=1)[:, :count] if count < len(members) - 1 else np.argsort(-likeness, axis=1)[:, :count]
        order = np.argsort(-np.take_along_axis(likeness, part, 1), axis=1, kind="stable")
        found[at : at + 512] = np.take_along_axis(part, order, 1)
    return members[found]


def linked(vectors: np.ndarray, members: np.ndarray, links: int) -> np.ndarray:
    """Neighbour lists of one level, ``2 * links`` wide, filled with -1; rows follow ``members``."""
    out = np.full((len(members), 2 * links), -1, np.int32)
    if len(members) < 2:
        return out
    near = nearest(vectors, members, CANDIDATES)
    place = np.full(len(vectors), -1, np.int64)
    place[members] = np.arange(len(members))
    kept = np.zeros(near.shape, bool)
    count = np.zeros(len(members), np.int64)
    for at in range(0, len(members), 1024):
        part = near[at : at + 1024]
        points = vectors[part]
        to_own = np.einsum("nd,ncd->nc", vectors[members[at : at + 1024]], points)
        among = points @ points.transpose(0, 2, 1)
        ok = kept[at : at + 1024]
        for c in range(part.shape[1]):
            # keep a candidate unless a kept one is nearer to it than the node itself
            shadowed = (ok[:, :c] & (among[:, c, :c] > to_own[:, c, None])).any(1)
            ok[:, c] = ~shadowed & (ok[:, :c].sum(1) < links)
    # the rest of the places go to the nearest that the heuristic passed over
    short = links - kept.sum(1)
    rank = np.cumsum(~kept, axis=1)
    kept |= ~kept & (rank <= (short // 2)[:, None])
    row, col = np.nonzero(kept)
    target = place[near[row, col]]
    pair_a, pair_b = np.concatenate([row, target]), np.concatenate([target, row])
    own = np.concatenate([np.zeros(len(row), np.int8), np.ones(len(row), np.int8)])
    like = np.einsum("ij,ij->i", vectors[members[pair_a]], vectors[members[pair_b]])
    order = np.lexsort((-like, own, pair_a))  # a node's own links, then those that others made, nearest first
    pair_a, pair_b = pair_a[order], pair_b[order]
    _, first = np.unique(pair_a * len(members) + pair_b, return_index=True)
    first.sort()
    pair_a, pair_b = pair_a[first], pair_b[first]
    count = np.bincount(pair_a, minlength=len(members))
    rank = np.arange(len(pair_a)) - np.repeat(np.cumsum(count) - count, count)
    fits = rank < 2 * links
    out[pair_a[fits], rank[fits]] = members[pair_b[fits]]
    return out


class Graph:
    """A shard: distinct vectors, the ids that bear them, and the levels' neighbour arrays."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int = K):
        order = np.lexsort((ids,))
        ids, vectors = ids[order], vectors[order]
        _, first, which = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        which = which.ravel()
        order = np.lexsort((ids, which))
        ids, which = ids[order], which[order]
        again = np.concatenate([[False], (ids[1:] == ids[:-1]) & (which[1:] == which[:-1])])
        ids, which = ids[~again], which[~again]
        count = np.bincount(which, minlength=len(first))
        rank = np.arange(len(ids)) - np.repeat(np.cumsum(count) - count, count)
        few = rank <= k  # k and the query's own
        self.vectors = vectors[first]
        self.ids, self.count = ids[few], np.bincount(which[few], minlength=len(first))
        self.start = np.cumsum(self.count) - self.count
        self.long = lengthened(self.vectors)
        rng = np.random.default_rng(SEED)
        level = np.floor(-np.log(rng.random(len(first)).clip(1e-12)) / math.log(LINKS)).astype(int)
        level[rng.integers(len(first))] = max(level.max(), 1)
        self.levels = [np.nonzero(level >= i)[0] for i in range(level.max() + 1)]
        self.neighbours = [linked(self.long, members, LINKS) for members in self.levels]

    def search(self, queries: np.ndarray, ef: int = EF) -> np.ndarray:
        """For each query the nodes of the beam, likeliest first, -1 where there are fewer."""
        q = scaled(np.concatenate([queries, np.zeros((len(queries), 1))], 1), np.abs(queries).max(1, keepdims=True))
        here = np.full(len(q), self.levels[-1][0])
        score = np.einsum("ij,ij->i", q, self.long[here])
        for members, lists in zip(self.levels[:0:-1], self.neighbours[:0:-1], strict=True):
            place = np.full(len(self.long), -1, np.int64)
            place[members] = np.arange(len(members))
            active = np.arange(len(q))
            while len(active):
                options = lists[place[here[active]]]
                like = np.where(options >= 0, np.einsum("nd,ncd->nc", q[active], self.long[options]), -np.inf)
                best = like.argmax(1)
                value = like[np.arange(len(active)), best]
                better = value > score[active]
                active, best, value, options = active[better], best[better], value[better], options[better]
                here[active], score[active] = options[np.arange(len(active)), best], value
        beam = np.full((len(q), ef), -1, np.int64)
        likes = np.full((len(q), ef), -np.inf, np.float32)
        done = np.ones((len(q), ef), bool)
        beam[:, 0], likes[:, 0], done[:, 0] = here, score, False
        seen = np.zeros((len(q), len(self.long)), bool)
        seen[np.arange(len(q)), here] = True
        lists, active = self.neighbours[0], np.arange(len(q))
        while len(active):
            open_ = np.where(done[active], -np.inf, likes[active])
            pick = np.argpartition(-open_, 3, axis=1)[:, :4]  # the four best of the open ones at a time
            valid = np.take_along_axis(open_, pick, 1) > -np.inf
            going = valid.any(1)
            active, pick, valid = active[going], pick[going], valid[going]
            if not len(active):
                break
            node = np.where(valid, beam[active[:, None], pick], 0)
            done[active[:, None], pick] = True
            options = np.where(valid[:, :, None], lists[node], -1).reshape(len(active), -1)
            row = np.broadcast_to(active[:, None], options.shape)
            fresh = options >= 0
            fresh[fresh] = ~seen[row[fresh], options[fresh]]
            like = np.full(options.shape, -np.inf, np.float32)
            r, c = np.nonzero(fresh)
            # one place for a node that several lists name
            _, one = np.unique(r * len(self.long) + options[r, c], return_index=True)
            r, c = r[one], c[one]
            new = options[r, c]
            seen[active[r], new] = True
            like[r, c] = np.einsum("ij,ij->i", q[active[r]], self.long[new])
            all_like = np.concatenate([likes[active], like], 1)
            all_node = np.concatenate([beam[active], options], 1)
            all_done = np.concatenate([done[active], np.zeros(options.shape, bool)], 1)
            best = np.argpartition(-all_like, ef - 1, axis=1)[:, :ef]
            likes[active] = np.take_along_axis(all_like, best, 1)
            beam[active] = np.where(likes[active] > -np.inf, np.take_along_axis(all_node, best, 1), -1)
            done[active] = np.take_along_axis(all_done, best, 1) | (likes[active] == -np.inf)
        order = np.argsort(-likes, axis=1, kind="stable")
        return np.take_along_axis(beam, order, 1)

    def answer(self, query_ids: np.ndarray, queries: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query ids, ids and scores of the ``k`` nearest in this shard, the query's own id left out."""
        found = []
        for at in range(0, len(queries), 512):
            nodes = self.search(queries[at : at + 512])
            row, col = np.nonzero(nodes >= 0)
            found.append(np.stack([row + at, nodes[row, col]]))
        row, node = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
        score = np.zeros(len(row))
        for j in range(queries.shape[1]):
            score += queries[row, j].astype(float) * self.vectors[node, j].astype(float)
        count = self.count[node]
        row, score = np.repeat(row, count), np.repeat(score, count)
        within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        ids = self.ids[np.repeat(self.start[node], count) + within]
        other = ids != query_ids[row]
        row, score, ids = row[other], score[other], ids[other]
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        many = np.bincount(row, minlength=len(queries))
        rank = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        return query_ids[row[rank < k]], ids[rank < k], score[rank < k]

    def pack(self) -> dict[str, bytes | int | list]:
        """The graph as flat arrays."""
        return {
            "dim": self.vectors.shape[1],
            "kind": self.vectors.dtype.str,
            "vectors": self.vectors.tobytes(),
            "ids": self.ids.astype("<i8").tobytes(),
            "counts": self.count.astype("<i4").tobytes(),
            "levels": [x.astype("<i4").tobytes() for x in self.levels],
            "neighbours": [x.astype("<i4").tobytes() for x in self.neighbours],
        }

    @classmethod
    def unpack(cls, row: dict) -> Graph:
        g = cls.__new__(cls)
        g.vectors = np.frombuffer(row["vectors"], row["kind"]).reshape(-1, row["dim"])
        g.ids, g.count = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["counts"], "<i4").astype(np.int64)
        g.start = np.cumsum(g.count) - g.count
        g.long = lengthened(g.vectors)
        g.levels = [np.frombuffer(x, "<i4").astype(np.int64) for x in row["levels"]]
        g.neighbours = [np.frombuffer(x, "<i4").reshape(-1, 2 * LINKS) for x in row["neighbours"]]
        return g


INDEX = "dim int, shard int, kind string, vectors binary, ids binary, counts binary, levels array<binary>, neighbours array<binary>"


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & good & F.exists(vector, lambda x: x != 0)


def build(rows: DataFrame, shards: int) -> DataFrame:
    """One row a shard and vector length, from ``id, vector``."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        graph = Graph(pdf["id"].to_numpy(), np.stack(pdf["vector"].to_numpy()))
        return pd.DataFrame([graph.pack() | {"shard": int(pdf["shard"].iloc[0])}])[["dim", "shard", "kind", "vectors", "ids", "counts", "levels", "neighbours"]]

    placed = rows.select("id", "vector", F.size("vector").alias("dim"), F.pmod(F.xxhash64("id", "vector", F.lit(SEED)), F.lit(shards)).cast("int").alias("shard"))
    # a shard is work for seconds, so few of them are a task, however few bytes they have
    tasks = 4 * max(1, min(shards, rows.sparkSession.sparkContext.defaultParallelism))
    return placed.repartition(tasks, "dim", "shard").groupBy("dim", "shard").applyInPandas(one, INDEX)


class Best:
    """The ``k`` best so far of each query: larger scores, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.rows = k, [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]

    def add(self, query: np.ndarray, id: np.ndarray, score: np.ndarray) -> None:
        query, id, score = (np.concatenate([old, new]) for old, new in zip(self.rows, (query, id, score), strict=True))
        order = np.lexsort((id, -score, query))
        query, id, score = query[order], id[order], score[order]
        first = np.concatenate([[True], query[1:] != query[:-1]]) if len(query) else np.zeros(0, bool)
        rank = np.arange(len(query)) - np.nonzero(first)[0][np.cumsum(first) - 1]
        self.rows = [x[rank < self.k] for x in (query, id, score)]


def search(index: DataFrame, ids: np.ndarray, vectors: list[np.ndarray], k: int = K) -> DataFrame:
    """``query_id, vec_id, score``: the ``k`` nearest of each query (``ids``, ``vectors``) in each part of the index."""
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for length in {len(v) for v in vectors}:
        here = [i for i, v in enumerate(vectors) if len(v) == length]
        by_length[length] = ids[here], np.stack([vectors[i] for i in here])
    held = index.sparkSession.sparkContext.broadcast(by_length)

    def walk(batches):
        best = Best(k)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("dim", "kind", "vectors", "ids", "counts", "levels", "neighbours")}
                if row["dim"] in held.value:
                    best.add(*Graph.unpack(row).answer(*held.value[row["dim"]], k))
        for at in range(0, len(best.rows[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in best.rows], names=["query_id", "vec_id", "score"])

    return index.mapInArrow(walk, "query_id long, vec_id long, score double")


def blocks(queries: DataFrame, size: int) -> list[DataFrame]:
    """Parts of ``queries`` of about ``BLOCK_BYTES``, by a hash of the id."""
    n = max(1, math.ceil(size / BLOCK_BYTES))
    return [queries.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(n)) == i) for i in range(n)]


def neighbours(rows: DataFrame, asked: Column, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for each row that ``asked`` picks, among all other rows."""
    usable_rows = rows.where(asked.isNotNull() & usable(F.col(vector)) & F.col(key).isNotNull())
    double = rows.schema[vector].dataType.elementType.typeName() not in ("float", "integer", "short", "byte")
    points = cut(usable_rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>" if double else "array<float>").alias("vector"), asked.alias("asked")), "points")
    again = cut(points.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id"), "again")
    if again.take(1):
        whole = points
        points = cut(whole.join(again, "id", "left_anti").unionByName(whole.join(again, "id", "left_semi").dropDuplicates(["id", "vector"])), "points")
        drop_cut(whole)
    n, size = points.agg(F.count(F.lit(1)), F.sum(F.when(F.col("asked"), 8 * F.size("vector").cast("long") + 8))).first()
    index = cut(build(points.select("id", "vector"), max(SHARDS, math.ceil(n / SHARD_ROWS))), "index")
    queries = cut(points.where("asked").groupBy("id").agg(F.min("vector").alias("vector")), "queries")
    found = None
    for block in blocks(queries, size or 0):
        sent = block.toArrow()  # BLOCK_BYTES, whatever the table's size
        part = search(index, sent["id"].to_numpy(), [v.values.to_numpy() for v in sent["vector"]], k)
        found = part if found is None else found.unionByName(part)
    drop_cut(points, again, queries)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
