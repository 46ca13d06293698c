"""Brown class-based n-grams: exchange clustering puts words into classes, and a text's probability is the product of
class transitions and word emissions, log10 P(w | before) = log10 P(class(w) | class(before)) + log10 P(w | class(w)).

Counts of words and of neighbouring pairs cover every training text and are summed by Spark.  Every training word has a class
that its own neighbours chose, in three steps.  First the most frequent words (``ITEMS``, and more as the vocabulary grows:
``most_items``) are exchanged on the driver, where each in turn moves to the class that raises the likelihood of the training
pairs most, until a sweep moves nothing or ``SWEEPS`` are done; the other words count there by their shape (a hash of their
ending), which is also the class they start from.  Then the other words of the dictionary, and then all words outside it, are
moved once each to their best class, by the classes of all their neighbours, in a step that Spark distributes over the words.
The end of a text keeps a class of its own.  Only words that training does not hold keep the class of their shape.

A word is emitted with (c + 0.1) / (n + 0.1 v) of its class's n tokens; v is the class's words and one unseen word a shape.
A dictionary of the ``HEAD`` most frequent words at most is sent to the workers; counts and classes of all other words are found by a join on the word.

Null and empty texts are their end alone.  A null id counts as held out.  Repeated rows are scored, and counted, each for
itself.  Without training texts all counts are 0 and a text of n tokens scores as under uniform shares.  An empty table gives
an empty result; columns but the key and the text are ignored; long texts are read whole, in batches of bounded bytes, and
what a row gives (a byte and a class a token, and its words outside the dictionary) is linear in its length.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LONG_WORD, cut, drop_cut, slices

ITEMS, SHAPES, CLASSES, SWEEPS = 1_000, 512, 48, 8
HEAD, FLUSH, FLUSH_BYTES, REMEMBERED = 250_000, 200_000, 64 << 20, 200_000
GROUP = 256  # dictionary words whose neighbour counts travel as one row; times 2 CLASSES, below 65,536
END = b"\n"  # no word holds a line end
ADD = 0.1


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 10 == 0, F.lit(True))


def tokens(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """The tokens of all texts in a row, and where each text's end token stands."""
    out, ends = [], []
    for text in texts:
        if text:
            out += text.encode().lower().split()
        ends.append(len(out))
        out.append(END)
    return out, np.array(ends, np.int64)


def shape(word: bytes) -> int:
    """The shape of a word: of its last letters, without punctuation."""
    bare = word.strip(b".,;:!?\"'()[]{}*#%$&|-") or word[:1]
    return crc32(bare[-3:]) % SHAPES


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over the column ``text``; the end token is a word here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(counter: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counter), pa.binary()), pa.array(list(counter.values()), pa.int64())], names=["word", "n"])

        counter: Counter = Counter()
        size = 0  # a bound of the bytes of new words
        for part in slices(batches, 0):
            before = len(counter)
            words = tokens(part.column(0).to_pylist())[0]
            counter.update(words)
            size += (len(counter) - before) * max(map(len, words))
            if len(counter) > FLUSH or size > FLUSH_BYTES:
                yield flushed(counter)
                counter, size = Counter(), 0
        if counter:
            yield flushed(counter)

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Lexicon:
    """Words that have an entry of their own, as a dictionary that a worker makes once."""

    made: dict[str, dict[bytes, int]] = {}

    def __init__(self, words: list[bytes]):
        self.name, self.words = uuid.uuid4().hex, END.join(w.replace(END, b"") for w in words)
        self.size, self.end = len(words), words.index(END) if END in words else -1

    def entries(self) -> dict[bytes, int]:
        if self.name not in self.made:
            self.made.clear()
            table = {w: i for i, w in enumerate(self.words.split(END))} if self.size else {}
            if self.end >= 0:
                del table[b""]
                table[END] = self.end
            self.made[self.name] = table
        return self.made[self.name]


class Codes(dict):
    """Word to code: its number in the lexicon, or -1 minus its shape."""

    def __init__(self, entries: dict[bytes, int]):
        super().__init__()
        self.entries = entries

    def __missing__(self, word: bytes) -> int:
        code = self.entries.get(word)
        if code is None:
            code = -1 - shape(word)
        if len(word) <= LONG_WORD:
            if len(self) > REMEMBERED:
                self.clear()
            self[word] = code
        return code


def pair_counts(docs: DataFrame, items: Lexicon) -> np.ndarray:
    """How often each item follows each, over the column ``text``: words, then shapes, then the end."""
    width = items.size + SHAPES + 1
    held = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        codes, total = Codes(known.entries()), np.zeros(width * width, np.int64)
        for part in slices(batches, 0):
            words, ends = tokens(part.column(0).to_pylist())
            at = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
            at = np.where(at < 0, known.size - 1 - at, at)
            at[ends] = width - 1
            before = np.concatenate([[width - 1], at[:-1]])
            pair, n = np.unique(before * width + at, return_counts=True)
            total[pair] += n
        pair = np.nonzero(total)[0]
        for at in range(0, len(pair), 100_000):
            some = pair[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["pair", "n"])

    got = docs.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.zeros(width * width)
    matrix[got["pair"].to_numpy()] = got["n"].to_numpy()  # width squared cells at most, however large the corpus
    return matrix.reshape(width, width)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each item; the last item, the end, has class 0 to itself."""
    n = len(pairs)
    weight = pairs.sum(0) + pairs.sum(1)
    order = np.argsort(-weight[:-1], kind="stable")
    of = np.zeros(n, np.int64)
    of[order] = np.arange(n - 1) % (classes - 1) + 1
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    between = member.T @ pairs @ member
    for _ in range(sweeps):
        moved = 0
        for v in order:
            if not weight[v]:
                continue
            a, own = of[v], pairs[v, v]
            out, into = np.bincount(of, pairs[v], classes), np.bincount(of, pairs[:, v], classes)
            out[a] -= own
            into[a] -= own
            between[a] -= out
            between[:, a] -= into
            between[a, a] -= own
            left, right = between.sum(1), between.sum(0)
            gain_row = xlogx(between + out) - xlogx(between)
            gain_col = xlogx(between.T + into) - xlogx(between.T)
            diagonal = np.diagonal(between)
            gain = gain_row.sum(1) - np.diagonal(gain_row) + gain_col.sum(1) - np.diagonal(gain_col)
            gain += xlogx(diagonal + out + into + own) - xlogx(diagonal)
            total_out, total_in = out.sum() + own, into.sum() + own
            gain -= xlogx(left + total_out) - xlogx(left) + xlogx(right + total_in) - xlogx(right)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            of[v] = b
            between[b] += out
            between[:, b] += into
            between[b, b] += own
        if not moved:
            break
    return of


def most_items(distinct: int) -> int:
    """How many words the driver exchanges: more as the vocabulary grows, by its cube root, as their pairs are a matrix there."""
    return max(ITEMS, int(10 * distinct ** (1 / 3)))


def least_count(counts: DataFrame) -> int:
    """The least count of which, and above which, there are at most ``HEAD`` words; from a histogram, not from a sort of all."""
    held = 0
    for row in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(HEAD + 1).collect():
        held += row["words"]
        if held > HEAD:
            return row["n"] + 1
    return 1


def best_classes(word: np.ndarray, side: np.ndarray, n: np.ndarray, own: np.ndarray, between: np.ndarray) -> np.ndarray:
    """The class of each word that raises the likelihood most, where word i is in ``own[i]`` and all others stay.

    An entry (``word`` ascending, ``side``, ``n``) says how often a class follows the word, or, from ``len(between)`` on, stands before it.
    """
    classes, gain = len(between), np.zeros((len(own), len(between)))
    facing = np.concatenate([between.T, between])
    for at in range(0, len(word), 50_000):
        w, x = word[at : at + 50_000], n[at : at + 50_000].astype(float)
        cells = facing[side[at : at + 50_000]]
        cells[np.arange(len(w)), own[w]] -= x
        cells = np.maximum(cells, 0)
        start = np.nonzero(np.concatenate([[True], w[1:] != w[:-1]]))[0]
        gain[w[start]] += np.add.reduceat(xlogx(cells + x[:, None]) - xlogx(cells), start)
    for follows, total in ((True, between.sum(1)), (False, between.sum(0))):
        here = (side < classes) == follows
        x = np.bincount(word[here], n[here], len(own))
        rest = np.tile(total, (len(own), 1))
        rest[np.arange(len(own)), own] -= x
        rest = np.maximum(rest, 0)
        gain -= xlogx(rest + x[:, None]) - xlogx(rest)
    gain[:, (between.sum(0) + between.sum(1) == 0) | (np.arange(classes) == 0)] = -np.inf  # words of all kinds would meet in an empty class
    best, row = gain.argmax(1), np.arange(len(own))
    return np.where(gain[row, best] > gain[row, own] + 1e-9, best, own)


def placed_head(docs: DataFrame, head: Lexicon, own: np.ndarray, shape_class: np.ndarray, between: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """The classes of the dictionary after all its words but those of ``fixed`` moved once, over the column ``text``."""
    held = docs.sparkSession.sparkContext.broadcast((head, own, shape_class, between, fixed))
    groups = -(-head.size // GROUP)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes, of_shape, _, stays = held.value
        codes, total = Codes(known.entries()), np.zeros(groups * GROUP * 2 * CLASSES, np.int32)
        for part in slices(batches, 0):
            words, ends = tokens(part.column(0).to_pylist())
            at = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
            at[ends] = -1
            kind = np.where(at < 0, of_shape[np.where(at < 0, -1 - at, 0)], classes[np.where(at < 0, 0, at)])
            kind[ends] = 0
            moves = np.nonzero((at >= 0) & ~stays[np.where(at < 0, 0, at)])[0]
            cell = at[moves] * 2 * CLASSES
            cell, n = np.unique(np.concatenate([cell + kind[moves + 1], cell + CLASSES + kind[moves - 1]]), return_counts=True)
            total[cell] += n.astype(np.int32)
        total = total.reshape(groups, -1)
        for group in range(groups):
            cell = np.nonzero(total[group])[0]
            if len(cell):
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([cell.astype(np.uint16).tobytes()]), pa.array([total[group][cell].tobytes()])], names=["group", "cells", "n"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes, _, pairs, _ = held.value
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for group, cells, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group not in sums:
                    sums[group] = np.zeros(GROUP * 2 * CLASSES, np.int64)
                sums[group][np.frombuffer(cells, np.uint16)] += np.frombuffer(n, np.int32)
        for group, total in sums.items():
            cell = np.nonzero(total)[0]
            first = group * GROUP
            best = best_classes(cell // (2 * CLASSES), cell % (2 * CLASSES), total[cell], np.resize(classes[first : first + GROUP], GROUP), pairs)
            met = np.unique(cell // (2 * CLASSES))
            yield pa.RecordBatch.from_arrays([pa.array((first + met).astype(np.int32)), pa.array(best[met].astype(np.int32))], names=["word", "class"])

    got = docs.select("text").mapInArrow(count, "group int, cells binary, n binary").repartition("group").mapInArrow(place, "word int, class int").toArrow()
    out = own.copy()
    out[got["word"].to_numpy()] = got["class"].to_numpy()  # HEAD words at most
    return out


class Places:
    """What a worker needs to turn a text into classes: the dictionary, its counts and classes, and the classes of the shapes."""

    def __init__(self, head: Lexicon, counts: np.ndarray, classes: np.ndarray, shape_class: np.ndarray, n: int, distinct: int, ends: int):
        self.lexicon, self.head_class, self.shape_class = head, classes, shape_class
        self.head_seen = np.log10(counts + ADD)
        self.scale = float(np.log10(n + ADD * (distinct + 1)))
        self.end_seen, self.end_known = float(np.log10(ends + ADD)), int(ends > 0)

    def sequences(self, texts: list[str | None], codes: Codes) -> list[tuple]:
        """Of each text: tokens, dictionary tokens, log10 counts of those, classes (shapes' for other words), and its other words
        with their place and the classes after and before it."""
        words, ends = tokens(texts)
        at = np.fromiter(map(codes.__getitem__, words), np.int64, len(words))
        is_end = np.zeros(len(words), bool)
        is_end[ends] = True
        tail = (at < 0) & ~is_end
        kind = self.shape_class[np.where(at < 0, -1 - at, 0)]
        seen = np.zeros(len(words))
        if self.lexicon.size:
            slot = np.where(at < 0, 0, at)
            kind, seen = np.where(at < 0, kind, self.head_class[slot]), np.where(at < 0, 0.0, self.head_seen[slot])
        kind[is_end], seen[is_end] = 0, self.end_seen
        first = np.concatenate([[0], ends[:-1] + 1])
        n, seen = ends - first + 1, np.add.reduceat(seen, first)
        in_head = np.add.reduceat(np.where(is_end, self.end_known, at >= 0).astype(np.int64), first)
        kind = kind.astype(np.uint8)
        rare = np.nonzero(tail)[0]
        cuts = np.searchsorted(rare, np.concatenate([first, [len(words)]]))
        out = []
        for i, (a, b) in enumerate(zip(first, ends, strict=True)):
            mine = rare[cuts[i] : cuts[i + 1]]
            sides = kind[mine + 1].astype(int) * CLASSES + kind[mine - 1]  # before the first word stands an end, of class 0 as the last one's
            out.append((int(n[i]), int(in_head[i]), float(seen[i]), kind[a : b + 1].tobytes(), [{"word": words[j], "at": j - a, "sides": s} for j, s in zip(mine.tolist(), sides.tolist(), strict=True)]))
        return out


def transitions(rows: DataFrame) -> np.ndarray:
    """How often each class follows each in the column ``classes``; before a text stands an end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            kind = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).astype(np.int64)
            total += np.bincount(np.concatenate([[0], kind[:-1]]) * CLASSES + kind, minlength=CLASSES * CLASSES) if len(kind) else 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES * CLASSES, dtype=np.int32)), pa.array(total)], names=["pair", "n"])

    got = rows.select("classes").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    between = np.zeros(CLASSES * CLASSES)
    between[got["pair"].to_numpy()] = got["n"].to_numpy()
    return between.reshape(CLASSES, CLASSES)


def placed_rare(scored: DataFrame, shape_class: np.ndarray, between: np.ndarray) -> DataFrame:
    """``word, class, n`` of the training words outside the dictionary: each moved from its shape's class to its best one.

    Such a word is rarer than every word of the dictionary, so that its neighbours fit in a list.
    """
    held = scored.sparkSession.sparkContext.broadcast((shape_class, between))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_shape, pairs = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                part = batch.slice(at, 4_096)
                words, lists = part.column(0), part.column(1)
                n = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                word, sides = np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                cell = word * 2 * CLASSES
                cell, x = np.unique(np.concatenate([cell + sides // CLASSES, cell + CLASSES + sides % CLASSES]), return_counts=True)
                own = of_shape[np.fromiter(map(shape, words.to_pylist()), np.int64, len(n))]
                best = best_classes(cell // (2 * CLASSES), cell % (2 * CLASSES), x, own, pairs)
                yield pa.RecordBatch.from_arrays([words, pa.array(best.astype(np.int32)), pa.array(n)], names=["word", "class", "n"])

    sides = scored.where("training").select(F.explode("rare").alias("r")).select("r.word", "r.sides")
    return sides.groupBy("word").agg(F.collect_list("sides").alias("sides")).mapInArrow(place, "word binary, class int, n long")


class Model:
    """Log10 tables for scoring."""

    def __init__(self, places: Places, between: np.ndarray, rare_distinct: np.ndarray):
        self.head_class, self.shape_class = places.head_class, places.shape_class
        self.transition = np.log10((between + 0.5) / (between.sum(1, keepdims=True) + 0.5 * CLASSES))
        words = np.bincount(self.head_class, minlength=CLASSES) + np.bincount(self.shape_class, minlength=CLASSES) + rare_distinct
        words[0] = 1  # the end, whether the dictionary holds it or not
        self.total = np.log10(between.sum(0) + ADD * np.maximum(words, 1))
        self.head_share = places.head_seen - self.total[self.head_class]
        self.shape_share = -self.total[self.shape_class]  # and log10(c + 0.1)


def learn(docs: DataFrame, counts: DataFrame) -> tuple[Places, int]:
    """Classes of the dictionary and of the shapes from training texts (column ``text``), and the number of their tokens."""
    n, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = counts.where(F.col("n") >= least_count(counts)).toArrow()
    order = sorted(zip((-n for n in top["n"].to_pylist()), map(bytes, top["word"].to_pylist()), strict=True))
    words, found = [w for _, w in order], np.array([-n for n, _ in order], float)
    items = [w for w in words if w != END][: most_items(distinct)]
    rank = {w: i for i, w in enumerate(items)}
    pairs = pair_counts(docs, Lexicon(items))
    of = exchange(pairs)
    member = np.zeros((len(of), CLASSES))
    member[np.arange(len(of)), of] = 1
    shape_class = of[len(items) : len(items) + SHAPES]
    fixed = np.array([w in rank or w == END for w in words], bool)
    own = np.array([0 if w == END else of[rank[w]] if w in rank else shape_class[shape(w)] for w in words], np.int64)
    head = Lexicon(words)
    if not fixed.all():
        own = placed_head(docs, head, own, shape_class, member.T @ pairs @ member, fixed)
    ends = counts.where(F.col("word") == F.lit(bytearray(END))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return Places(head, found, own, shape_class, n, distinct, ends), n


def placed_texts(numbered: DataFrame, places: Places) -> tuple[DataFrame, Model]:
    """``row, key, training, n_tokens, n_known, seen, classes`` of each row (``row, key, text, training``), and the model of the training ones."""
    held = numbered.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        codes = Codes(known.lexicon.entries())
        rare = pa.list_(pa.struct([("word", pa.binary()), ("at", pa.int32()), ("sides", pa.int32())]))
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.binary(), rare]
        for part in slices(batches, 3):
            done = known.sequences(part.column(3).to_pylist(), codes)
            columns = [pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], *columns], names=["row", "key", "training", "n_tokens", "in_head", "seen", "classes", "rare"])

    kind = numbered.schema["key"].dataType.simpleString()
    first = cut(numbered.select("row", "key", "training", "text").mapInArrow(run, f"row long, key {kind}, training boolean, n_tokens long, in_head long, seen double, classes binary, rare array<struct<word:binary,at:int,sides:int>>"), "scored")
    words = cut(placed_rare(first, places.shape_class, transitions(first.where("training"))), "places")
    rare_distinct = np.zeros(CLASSES)
    for r in words.groupBy("class").agg(F.count(F.lit(1)).alias("v")).collect():
        rare_distinct[r["class"]] = r["v"]

    met = first.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.at").join(words, "word", "left")
    met = met.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("n", F.lit(0)) + ADD)).alias("rare_seen"),
        F.count("n").alias("rare_known"),
        F.collect_list(F.when(F.col("n").isNotNull(), F.col("at").cast("long") * CLASSES + F.col("class"))).alias("moved"),
    )

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for classes, cells in zip(batch.column("classes").to_pylist(), batch.column("moved"), strict=True):
                if cells.is_valid and len(cells):
                    of, to = np.frombuffer(classes, np.uint8).copy(), cells.values.to_numpy()
                    of[to // CLASSES] = to % CLASSES
                    classes = of.tobytes()
                out.append(classes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out, pa.binary())], names=[*batch.schema.names[:6], "classes"])

    whole = first.join(met, "row", "left").select("row", "key", "training", "n_tokens", (F.col("in_head") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), (F.col("seen") + F.coalesce("rare_seen", F.lit(0.0))).alias("seen"), "classes", "moved")
    done = cut(whole.mapInArrow(moved, f"row long, key {kind}, training boolean, n_tokens long, n_known long, seen double, classes binary"), "classes")
    drop_cut(first, words)
    return done, Model(places, transitions(done.where("training")), rare_distinct)


def fit(docs: DataFrame, counts: DataFrame) -> tuple[Model, int]:
    """The model of the training texts alone (column ``text``) and the number of their tokens."""
    places, n = learn(docs, counts)
    return placed_texts(docs.select(F.monotonically_increasing_id().alias("row"), F.lit(0).alias("key"), F.lit(True).alias("training"), "text"), places)[1], n


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of each row."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    training = rows.where(~held_out(F.col("key"))).select("text")
    counts = cut(word_counts(training), "words")
    places, n = learn(training, counts)
    drop_cut(counts)
    done, model = placed_texts(rows.select(F.monotonically_increasing_id().alias("row"), "key", "text", (~held_out(F.col("key"))).alias("training")), places)
    held = docs.sparkSession.sparkContext.broadcast((model.transition - model.total).ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            out = []
            for classes in batch.column("classes").to_pylist():
                of = np.frombuffer(classes, np.uint8).astype(np.int64)
                out.append(float(table[np.concatenate([[0], of[:-1]]) * CLASSES + of].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(out, pa.float64())], names=[*batch.schema.names[:5], "model"])

    kind = done.schema["key"].dataType.simpleString()
    found = done.select("key", "training", "n_tokens", "n_known", "seen", "classes").mapInArrow(run, f"key {kind}, training boolean, n_tokens long, n_known long, seen double, model double")
    return found.select(
        F.col("key").alias(key),
        (~F.col("training")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("seen") - F.col("n_tokens") * places.scale).alias("base_score"),
        (F.col("seen") + F.col("model")).alias("score"),
        F.pow(F.lit(10.0), -(F.col("seen") + F.col("model")) / F.col("n_tokens")).alias("perplexity"),
    )
