"""Near-duplicates by b-bit MinHash.

1. Each text becomes its set of distinct word shingles (64-bit hashes), and the set a signature: minima of ``rows * bands``
   hash functions.  Whole minima make the band keys; of each minimum only the low ``BITS`` bits are kept, packed into longs.
2. Equal sets are one node, read from the row of their smallest id, however many rows there are.
3. Nodes that share a band key are candidates.  The share of equal low bits, counted by bit operations and corrected for
   chance collisions (2**-BITS), estimates a candidate's similarity; those ``MARGIN`` standard errors below are let go.
4. What is left is compared on full shingle sets.  Rows: (a) each node with its likeliest bucket head; (b) the other
   heads, between components still apart; (c) in every bucket that still holds more than one component, all nodes outside
   its largest component against all nodes of other components.  Links within a component add nothing, so no pair that
   could join two components is left out, and a bucket of one component of any size costs one comparison a node.
   In (c) two nodes are compared only if they could be alike: by the shingles that are common among such nodes alone, or
   because they share a rare one (held by at most ``RARE`` of these nodes) among the first of either, in order of rarity.
   So the rim of a large family, whose texts differ by edits of their own, is told apart without comparing all its pairs:
   a node's common shingles say which sizes of another node could be enough, and only those are met.
5. Components by large and small stars (``graph``), each round in the shared folder.

A link of the least similarity is missed if no band agrees: with ``bands_for`` in fewer than 1 case in 10**8.

Texts that are null or hold no word have an empty set and link with nothing.  A null key links with nothing and is kept.
Each row is judged by its own text: rows that repeat key and text have the same result, and a key with several texts is in
several components.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LONG_WORD, cut, drop_cut, slices
from .graph import components

ROWS, BITS, MISS, MARGIN = 5, 4, 1e-8, 6.0
#: Words, and keys with their texts' hashes, that a task remembers.
REMEMBERED, MET = 200_000, 50_000
#: Nodes of open buckets that share a shingle, for it to count as rare among them.
RARE = 10
#: Nodes of an open bucket that are compared whatever their sizes, and steps of the sizes' logarithm in larger ones.
SMALL, STEPS = 128, 34
#: Bits of the filter that picks the texts of candidates; it is as large at every size of the input.
FILTER_BITS = 1 << 24
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """Word to 64-bit hash, kept as words come; long words are not kept, so ``REMEMBERED`` bounds the bytes too."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= LONG_WORD:
            if len(self) > REMEMBERED:
                self.clear()
            self[word] = value
        return value


def shingles(text: str | None, words: Words, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text, A-Z lower-cased; a shorter text is one shingle."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    width = min(k, len(parts))
    n = len(parts) - width + 1
    total = np.full(n, width, np.uint64)
    for i in range(width):
        total = mixed(total * M2 + hashes[i : i + n])
    return np.unique(total)


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands that leave a pair of just ``percent`` similarity without a common one in fewer than ``miss`` cases."""
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


class Signer:
    """Signatures under one family of hash functions."""

    def __init__(self, bands: int, rows: int = ROWS):
        self.bands, self.rows, self.size = bands, rows, bands * rows
        rng = np.random.default_rng(20_240_229)
        self.factor = rng.integers(0, 1 << 63, (self.size, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.twist = rng.integers(0, 1 << 63, (self.size, 1), np.uint64)
        self.buffer = np.empty((self.size, 512), np.uint64)
        self.padded = -(-self.size // 16) * 16

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        least = np.full(self.size, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), 512):
            part = hashes[None, at : at + 512]
            out = self.buffer[:, : part.shape[1]]
            np.bitwise_xor(part, self.twist, out=out)
            np.multiply(out, self.factor, out=out)
            np.minimum(least, out.min(axis=1), out=least)
        return mixed(least)

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band keys, and the packed low bits; both as signed longs."""
        least = self.minima(hashes)
        key = np.arange(self.bands, dtype=np.uint64) * M1
        for row in least.reshape(self.bands, self.rows).T:
            key = mixed(key * M3 + row)
        low = np.zeros(self.padded, np.uint64)
        low[: self.size] = least & np.uint64((1 << BITS) - 1)
        packed = np.bitwise_or.reduce(low.reshape(-1, 64 // BITS) << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)), axis=1)
        return key.view(np.int64), packed.view(np.int64)


def set_name(found: np.ndarray) -> tuple[int, int]:
    """Two longs that stand for a set of shingles as a whole."""
    whole = xxhash.xxh128_intdigest(found.tobytes())
    return (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63)


def signatures(docs: DataFrame, key: str, text: str, k: int, bands: int) -> DataFrame:
    """``id, mark, n, hi, lo, bands, sig`` of each row; ``mark`` is its text's hash, ``hi`` and ``lo`` stand for its set as a whole.

    Where a task meets a key's text again, the row bears no signature: a key that repeats millions of times costs a
    signature a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sign, met = Words(), Signer(bands), OrderedDict()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for part in slices(batches, 2):
            rows = []
            for id, mark, value in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if known := met.get((id, mark)):
                    rows.append((*known, None, None))
                    continue
                found = shingles(value, words, k)
                if len(found):
                    about = (len(found), *set_name(found))
                    rows.append((*about, *sign(found)))
                else:
                    about = (0, 0, 0)
                    rows.append((*about, None, None))
                met[id, mark] = about
                if len(met) > MET:
                    met.popitem(last=False)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], *columns], names=["id", "mark", "n", "hi", "lo", "bands", "sig"])

    source = marked(docs, key, text)
    return source.mapInArrow(run, "id long, mark long, n long, hi long, lo long, bands array<long>, sig array<long>")


def marked(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id, mark, text`` of each row."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows.select("id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")


def estimate(a: Column, b: Column, size: int) -> Column:
    """Similarity estimated from two packed signatures of ``size`` minima: equal groups of bits, less what chance gives."""
    ones = F.lit(0x1111111111111111)
    longs = -(-size * BITS // 64)

    def differing(i: int) -> Column:
        x = F.element_at(a, i + 1).bitwiseXOR(F.element_at(b, i + 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return F.bit_count(x.bitwiseAND(ones))

    unequal = sum((differing(i) for i in range(1, longs)), differing(0))
    chance = 2.0**-BITS
    return ((1 - unequal / F.lit(float(size))) - chance) / (1 - chance)


def close_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def verified(pairs: DataFrame, keys: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The ``pairs`` (``a``, ``b``) whose full shingle sets are similar enough, as ``u, v``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, known = Words(), OrderedDict()

        def of(id: int, text: str | None) -> np.ndarray:
            if id not in known:
                known[id] = shingles(text, words, k)
                if len(known) > 256:
                    known.popitem(last=False)
            return known[id]

        for batch in batches:
            for part in slices(iter([batch]), 2):
                u, v = [], []
                for a, b, x, y in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    p, q = of(a, x), of(b, y)
                    if not len(p) or not len(q):
                        continue
                    common = len(np.intersect1d(p, q, assume_unique=True))
                    if 100 * common >= percent * (len(p) + len(q) - common):
                        u.append(a)
                        v.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    def with_text(frame: DataFrame, column: str, name: str) -> DataFrame:
        named = frame.join(keys.withColumnRenamed("id", column), column)
        return named.join(texts.withColumnRenamed("text", name), ["doc", "mark"]).drop("doc", "mark")

    both = with_text(with_text(pairs, "a", "x"), "b", "y").select("a", "b", "x", "y")
    return both.mapInArrow(run, "u long, v long")


def chosen_texts(docs: DataFrame, key: str, text: str, keys: DataFrame) -> DataFrame:
    """``doc, mark, text`` of the ``keys`` (``doc, mark``) and of a few others, one row each.

    A fixed-size filter spares the rest a shuffle; of rows with the same key and text a task keeps one.
    """
    slot = F.pmod(F.xxhash64("doc", "mark"), F.lit(FILTER_BITS))
    bits = keys.select(slot.alias("slot")).selectExpr("cast(shiftright(slot, 5) as int) AS word", "shiftleft(1L, cast(slot % 32 as int)) AS bit")
    found = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS // 32, np.uint32)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(table)

    def wanted(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        met = OrderedDict()
        for slots, ids, marks in batches:
            at = slots.to_numpy()
            out = (held.value[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) == 1
            for i in np.nonzero(out)[0].tolist():
                pair = (ids.iat[i], marks.iat[i])
                if pair in met:
                    out[i] = False
                    continue
                met[pair] = None
                if len(met) > MET:
                    met.popitem(last=False)
            yield pd.Series(out)

    first_met = F.pandas_udf(wanted, "boolean").asNondeterministic()
    rows = marked(docs, key, text).select(F.col("id").alias("doc"), "mark", "text").where("doc IS NOT NULL")
    few = cut(rows.where(first_met(slot, F.col("doc"), F.col("mark"))), "few")
    # several tasks may have met the same key and text
    again = cut(few.groupBy("doc", "mark").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc", "mark"), "again")
    if not again.take(1):
        drop_cut(again)
        return few
    once = few.join(again, ["doc", "mark"], "left_semi").groupBy("doc", "mark").agg(F.first("text").alias("text"))
    texts = cut(few.join(again, ["doc", "mark"], "left_anti").unionByName(once), "texts")
    drop_cut(few, again)
    return texts


def shingle_rows(keys: DataFrame, texts: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``id, shingle``: the distinct shingles of each of the nodes ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in slices(batches, 1, 1 << 20):
            found = [shingles(t, words, k) for t in part.column(1).to_pylist()]
            ids = np.repeat(part.column(0).to_numpy(), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate(found).view(np.int64))], names=["id", "shingle"])

    named = keys.join(ids, "id", "left_semi").join(texts, ["doc", "mark"])
    return named.select("id", "text").mapInArrow(run, "id long, shingle long")


def rare_shingles(keys: DataFrame, texts: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``id, shingle, df`` of the shingles that at most ``RARE`` of the nodes ``ids`` have, as a table of its own."""
    rows = cut(shingle_rows(keys, texts, ids, k), "shingles")
    few = cut(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= RARE), "few")
    rare = cut(rows.join(few, "shingle").select("id", "shingle", "df"), "rare")
    drop_cut(rows, few)
    return rare


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id``, ``kept`` of each row of ``docs``.

    Two documents link if 100 * common shingles >= ``percent`` * all their shingles; a component's id is its smallest key.
    """
    bands = bands_for(percent)
    size = bands * ROWS
    share = percent / 100
    least = share - MARGIN * math.sqrt(share * (1 - share) / size) / (1 - 2.0**-BITS)
    signed = cut(signatures(docs, key, text, k, bands), "signed")
    # a node is a set of shingles, numbered; it is read from the row of its smallest key
    held = signed.where("n > 0 AND id IS NOT NULL")
    sets = held.groupBy("hi", "lo").agg(F.min(F.struct("id", "mark")).alias("of")).select("hi", "lo", F.col("of.id").alias("id"), F.col("of.mark").alias("mark"))
    one = held.where("sig IS NOT NULL").join(sets, ["hi", "lo", "id", "mark"], "left_semi").dropDuplicates(["hi", "lo"])
    one = one.select(F.col("id").alias("doc"), "mark", "n", "hi", "lo", "bands", "sig")
    nodes = cut(one.withColumn("id", F.monotonically_increasing_id()), "nodes")
    rows = nodes.select("id", F.explode("bands").alias("band"))

    # buckets of two nodes or more; the head of each is the node that meets most others, as the centre of a family does
    sizes = cut(rows.groupBy("band").agg(F.count(F.lit(1)).alias("all")).where("all > 1"), "sizes")
    members = cut(rows.join(sizes, "band"), "members")
    met = members.join(members.groupBy("id").agg(F.sum("all").alias("met")), "id")
    heads = cut(met.groupBy("band").agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("head")), "heads")
    pairs = cut(members.join(heads, "band").where("id != head").select("id", "head").distinct(), "pairs")
    about = nodes.select("id", "n", "sig", "bands")
    judged = pairs.join(about, "id").join(about.select(F.col("id").alias("head"), F.col("n").alias("m"), F.col("sig").alias("other")), "head")
    judged = judged.where(close_sizes(F.col("n"), F.col("m"), percent)).select(F.col("id").alias("a"), F.col("head").alias("b"), estimate(F.col("sig"), F.col("other"), size).alias("like"))
    likely = cut(judged.where(F.col("like") >= least), "likely")
    keys = cut(nodes.select("id", "doc", "mark").join(members.select("id"), "id", "left_semi"), "keys")
    texts = chosen_texts(docs, key, text, keys)

    best = cut(likely.groupBy("a").agg(F.max_by("b", F.struct("like", -F.col("b"))).alias("b")), "best")
    links = cut(verified(best, keys, texts, k, percent), "links")
    stars = components(links)

    # heads that would join components still apart
    def at(frame: DataFrame, column: str, name: str) -> DataFrame:
        named = stars.select(F.col("node").alias(column), F.col("component").alias("__c"))
        return frame.join(named, column, "left").select(*frame.columns, F.coalesce("__c", column).alias(name))

    rest = at(at(likely.join(best, ["a", "b"], "left_anti").select("a", "b"), "a", "p"), "b", "q").where("p != q").select("a", "b")
    rest = cut(rest, "rest")
    stars = joined(stars, verified(rest, keys, texts, k, percent))

    # buckets that still hold several components
    inside = cut(at(members.select("band", "id"), "id", "c"), "inside")
    counts = inside.groupBy("band", "c").agg(F.count(F.lit(1)).alias("rows"))
    open_ = counts.groupBy("band").agg(F.max_by("c", F.struct("rows", -F.col("c"))).alias("main"), F.count(F.lit(1)).alias("parts"), F.sum("rows").alias("all"))
    open_ = cut(open_.where("parts > 1 AND all > 2").select("band", "main", (F.col("all") > SMALL).alias("large")), "open")
    around = cut(inside.join(open_, "band"), "around")
    rare = rare_shingles(keys, texts, around.select("id").distinct(), k)
    single = rare.groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    spread = around.join(nodes.select("id", "n", "sig", "bands"), "id").join(single, "id", "left").withColumn("common", F.col("n") - F.coalesce("own", F.lit(0)))
    spread = cut(spread, "spread")

    # nodes alike by common shingles alone; a node that could not be alike to any of its own size or above, or to any below,
    # meets no bin of such sizes, so most of a large bucket's rim is not compared
    able = spread.where(F.col("common") * 100 >= F.col("n") * percent)
    step = lambda n: F.when(F.col("large"), F.floor(F.log(n.cast("double")) * STEPS)).otherwise(F.lit(0)).cast("int")
    smallest, greatest = F.ceil(F.col("n") * percent / 100), F.floor(F.col("common") * (100 + percent) / percent) - F.col("n")
    bins = F.when(greatest >= smallest, F.sequence(step(smallest), step(greatest)))
    left = able.where("c != main").select("band", F.explode(bins).alias("bin"), F.col("id").alias("a"), F.col("c").alias("p"), F.col("n").alias("na"), F.col("common").alias("ca"), F.col("sig").alias("sa"), F.col("bands").alias("ba"))
    right = able.select("band", step(F.col("n")).alias("bin"), F.col("id").alias("b"), F.col("c").alias("q"), F.col("n").alias("nb"), F.col("common").alias("cb"), F.col("sig").alias("sb"), F.col("bands").alias("bb"), (F.col("c") == F.col("main")).alias("of_main"))
    apart = (F.col("p") != F.col("q")) & (F.col("of_main") | (F.col("a") < F.col("b")))
    most = F.least("ca", "cb")
    near = apart & (100 * most >= percent * (F.col("na") + F.col("nb") - most)) & (estimate(F.col("sa"), F.col("sb"), size) >= least)
    once = F.array_min(F.array_intersect("ba", "bb")) == left["band"]  # of the buckets that two nodes share, one counts
    more = left.join(right, (left["band"] == right["band"]) & (left["bin"] == right["bin"]) & near & once).select("a", "b")

    # what the bound above leaves out shares a rare shingle, and the first that two nodes share stands in both their prefixes
    place = Window.partitionBy("id").orderBy("df", "shingle")
    known = spread.select("id", "c", "n", "sig").distinct()
    first = rare.withColumn("at", F.row_number().over(place)).join(known, "id")
    first = cut(first.where((F.col("df") > 1) & (F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)), "first")
    x = first.select("shingle", F.col("id").alias("a"), F.col("c").alias("p"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    y = first.select("shingle", F.col("id").alias("b"), F.col("c").alias("q"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    alike = (F.col("a") < F.col("b")) & (F.col("p") != F.col("q")) & close_sizes(F.col("na"), F.col("nb"), percent)
    alike = alike & (estimate(F.col("sa"), F.col("sb"), size) >= least)
    more = more.unionByName(x.join(y, (x["shingle"] == y["shingle"]) & alike).select("a", "b")).distinct()
    more = more.join(likely.select("a", "b"), ["a", "b"], "left_anti").join(likely.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    more = cut(more, "more")
    stars = joined(stars, verified(more, keys, texts, k, percent))

    # a component bears its smallest key
    found = at(nodes.select("id", "doc", "hi", "lo"), "id", "component")
    named = cut(found.join(found.groupBy("component").agg(F.min("doc").alias("least")), "component").select("hi", "lo", "least"), "named")
    drop_cut(nodes, sizes, heads, members, pairs, likely, keys, texts, best, links, rest, inside, open_, around, rare, first, spread, more, stars)
    known = signed.select("id", "n", "hi", "lo").join(named, ["hi", "lo"], "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")))
    return known.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def joined(stars: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links; as they were, if there are none."""
    links = cut(links, "links")
    found = stars
    if links.take(1):
        found = components(stars.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(links))
        drop_cut(stars)
    drop_cut(links)
    return found
