"""Scores of runs: sets against a reference, agreement, coverage, counts.  A set is a table of (keys..., term)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.operators import blocks as BL
from tesserine.operators.retrieval import dot
from tesserine.operators.spreading import spread, tasks_for
from tesserine.operators.validation import ERROR, NO_EVIDENCE, OK, SILENT

# Fixed values
AXES = ("natureza", "objetivos", "abordagem", "procedimento", "coleta", "analise")
COVERED_AXES = ("abordagem", "procedimento", "coleta", "analise")
STATUSES = (OK, NO_EVIDENCE, SILENT, ERROR)
#: Answers of a task whose axes are counted; they are a few bytes each.
COVERED_ROWS = 500_000


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def scored(counts: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall and F1 from ``predicted, expected, hits_p, hits_r``.

    Nothing predicted: all 1 if nothing was mandatory, else all 0.  Nothing mandatory: recall 1.
    """
    none = F.col("predicted") == 0
    empty = F.when(F.col("expected") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    p = F.when(none, empty).otherwise(F.col("hits_p") / F.col("predicted"))
    r = F.when(none, empty).otherwise(F.when(F.col("expected") == 0, F.lit(1.0)).otherwise(F.col("hits_r") / F.col("expected")))
    rows = counts.select(*by, p.alias("precision"), r.alias("recall"), "hits_p", "predicted", "hits_r", "expected")
    return rows.select(*by, "precision", "recall", F.when(F.col("predicted") == 0, F.col("precision")).otherwise(f1(F.col("precision"), F.col("recall"))).alias("f1"), "hits_p", "predicted", "hits_r", "expected")


def told_terms(predicted: DataFrame, reference: DataFrame, by: list[str], term: str) -> DataFrame:
    """``by..., term, __p, __m``: each term once, with 1 where it was predicted, and 1 or 0 where the reference has it."""
    said = predicted.select(*by, term, F.lit(1).alias("__p"), F.lit(None).cast("int").alias("__m"))
    known = reference.select(*by, term, F.lit(None).cast("int").alias("__p"), F.col("mandatory").cast("int").alias("__m"))
    return said.unionByName(known).groupBy(*by, term).agg(F.max("__p").alias("__p"), F.max("__m").alias("__m"))


def scoreboard(predicted: DataFrame, reference: DataFrame, keys: DataFrame, by: list[str], term: str = "term") -> DataFrame:
    """A row for each of ``keys``; ``reference`` has ``mandatory`` (false: acceptable, which only saves precision)."""
    met = told_terms(predicted, reference, by, term)
    counts = met.groupBy(*by).agg(
        F.count("__p").alias("predicted"),
        F.count(F.when(F.col("__m") == 1, 1)).alias("expected"),
        F.count(F.when(F.col("__m").isNotNull() & F.col("__p").isNotNull(), 1)).alias("hits_p"),
        F.count(F.when((F.col("__m") == 1) & F.col("__p").isNotNull(), 1)).alias("hits_r"),
    )
    names = ["predicted", "expected", "hits_p", "hits_r"]
    return scored(keys.select(*by).distinct().join(counts, by, "left").fillna(0, names), by)


def scoreboard_by_axis(predicted: DataFrame, reference: DataFrame, by: list[str], axis: str = "axis", term: str = "term") -> DataFrame:
    """As ``scoreboard`` for each axis; an axis with nothing predicted and nothing mandatory has no row, nor has none."""
    said, known = predicted.where(F.col(axis).isNotNull()), reference.where(F.col(axis).isNotNull())
    keys = said.select(*by, axis).unionByName(known.where("mandatory").select(*by, axis)).distinct()
    return scoreboard(said, known.join(keys, [*by, axis], "left_semi"), keys, [*by, axis], term)


def set_counts(said: str = "said", mandatory: str = "mandatory", known: str = "known") -> dict[str, Column]:
    """The counts of ``scored`` from sets in one row; ``known`` has the mandatory and the acceptable terms."""
    met = lambda c: F.size(F.array_intersect(said, c)).cast("long")
    return {"predicted": F.size(said).cast("long"), "expected": F.size(mandatory).cast("long"), "hits_p": met(known), "hits_r": met(mandatory)}


def scoreboard_of_sets(sets: DataFrame, by: list[str]) -> DataFrame:
    """``scoreboard`` where a row has all of its key's terms (arrays ``said, mandatory, known``): no term leaves its row."""
    return scored(sets.select(*by, *(c.alias(n) for n, c in set_counts().items())), by)


def scoreboard_of_sets_by_axis(sets: DataFrame, by: list[str], axis_of: Callable[[Column], Column], axis: str = "axis") -> DataFrame:
    """``scoreboard_by_axis`` of such rows; a term's axis is found by the term, and counts instead of terms are shuffled."""
    terms = {"predicted": F.col("said"), "expected": F.col("mandatory"), "hits_p": F.array_intersect("said", "known"), "hits_r": F.array_intersect("said", "mandatory")}

    def marked(terms: Column, i: int) -> Column:
        return F.transform(terms, lambda x: F.struct(axis_of(x).alias("a"), F.lit(i).alias("i")))

    each = [marked(t, i) for i, t in enumerate(terms.values())]
    rows = sets.select(*by, F.explode(F.concat(*each)).alias("x")).select(*by, F.col("x.a").alias(axis), F.col("x.i").alias("__i")).where(F.col(axis).isNotNull())
    return scored(rows.groupBy(*by, axis).agg(*(F.count(F.when(F.col("__i") == i, 1)).alias(n) for i, n in enumerate(terms))), [*by, axis])


def missing_and_extra_of_sets(sets: DataFrame, by: list[str]) -> DataFrame:
    """``missing_and_extra`` of such rows; a row without any term gives none."""
    rows = sets.where((F.size("said") > 0) | (F.size("known") > 0))
    return rows.select(*by, F.sort_array(F.array_except("mandatory", "said")).alias("missing"), F.sort_array(F.array_except("said", "known")).alias("extra"))


def macro_and_micro(board: DataFrame, by: list[str]) -> DataFrame:
    """``macro`` and ``micro`` in one grouping, so that the board is made once."""
    sums = ("hits_p", "predicted", "hits_r", "expected")
    rows = board.groupBy(*by).agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in sums))
    rows = rows.withColumns({"micro_precision": ratio(F.col("hits_p"), F.col("predicted")), "micro_recall": ratio(F.col("hits_r"), F.col("expected"))}).drop(*sums)
    return rows.withColumn("micro_f1", f1(F.col("micro_precision"), F.col("micro_recall")))


def macro(board: DataFrame, by: list[str]) -> DataFrame:
    return board.groupBy(*by).agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), F.count(F.lit(1)).alias("n"))


def micro(board: DataFrame, by: list[str]) -> DataFrame:
    sums = board.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("hits_p", "predicted", "hits_r", "expected")))
    rows = sums.select(*by, ratio(F.col("hits_p"), F.col("predicted")).alias("micro_precision"), ratio(F.col("hits_r"), F.col("expected")).alias("micro_recall"))
    return rows.withColumn("micro_f1", f1(F.col("micro_precision"), F.col("micro_recall")))


def missing_and_extra(predicted: DataFrame, reference: DataFrame, by: list[str], term: str = "term") -> DataFrame:
    """``by..., missing, extra``: mandatory terms not predicted, predicted ones not in the reference; sorted arrays."""
    met = told_terms(predicted, reference, by, term)
    return met.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.when((F.col("__m") == 1) & F.col("__p").isNull(), F.col(term)))).alias("missing"),
        F.array_sort(F.collect_list(F.when(F.col("__m").isNull(), F.col(term)))).alias("extra"),
    )


def jaccard(a: Column, b: Column) -> Column:
    """Two arrays as sets; two empty ones agree."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def pair_similarity(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Two unordered pairs of vectors: the better of the two ways to match them; a null vector counts 0."""
    s = lambda x, y: F.coalesce(dot(x, y), F.lit(0.0))
    return F.greatest((s(a1, b1) + s(a2, b2)) / 2, (s(a1, b2) + s(a2, b1)) / 2)


def theme_hits(pairs: DataFrame, by: str) -> DataFrame:
    """Baseline, margin and strict hit@1 of each ``by``, from similarities of every answer ``i`` with every reference ``j``."""
    own, other = F.col("i") == F.col("j"), F.col("i") != F.col("j")
    rows = pairs.groupBy(by, "i").agg(F.max(F.when(own, F.col("similarity"))).alias("own"), F.max(F.when(other, F.col("similarity"))).alias("best"), F.sum(F.when(other, F.col("similarity"))).alias("others"), F.count(F.when(other, 1)).alias("n"))
    return told_hits(rows, by)


def told_hits(rows: DataFrame, by: str) -> DataFrame:
    """``by, documents, baseline, margin, hit_at_1`` from ``by, i, own, best, others, n``."""
    sums = rows.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), (F.sum("others") / F.sum("n")).alias("baseline"), F.avg("own").alias("mean_own"), F.avg((F.col("own") > F.col("best")).cast("double")).alias("hit_at_1"))
    enough = F.col("documents") > 1
    return sums.select(by, "documents", F.when(enough, F.col("baseline")).alias("baseline"), F.when(enough, F.col("mean_own") - F.col("baseline")).alias("margin"), F.when(enough, F.col("hit_at_1")).alias("hit_at_1"))


def theme_hits_of(own: DataFrame, references: DataFrame, by: str) -> DataFrame:
    """``theme_hits`` of answers (``by, i, a1, a2``) with all references (``by, j, b1, b2``) of their ``by``.

    Every pair is looked at, as the baseline is defined so; a block of answers meets a block of references in one task, which
    gives a row an answer instead of a row a pair.
    """

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        i, j = (np.asarray(t.column(n).combine_chunks(), dtype=np.int64) for t, n in ((left, "i"), (right, "j")))
        a, b = ([BL.matrix(t.column(n)) for n in names] for t, names in ((left, ("a1", "a2")), (right, ("b1", "b2"))))
        columns = [np.ascontiguousarray(m.T) for m, _ in b]
        found = {c: np.full(len(i), np.nan) for c in ("own", "best", "others")} | {"n": np.zeros(len(i), np.int64)}
        has_own, total = np.zeros(len(i), bool), np.zeros(len(i))
        best = np.full(len(i), -np.inf)
        for at in range(0, len(i), BL.TILE):
            rows = slice(at, at + BL.TILE)
            for start in range(0, len(j), 8 * BL.TILE):
                part = slice(start, start + 8 * BL.TILE)
                s = {}
                for x in (0, 1):
                    for y in (0, 1):
                        p = BL.products(a[x][0][rows], columns[y][:, part])
                        s[x, y] = np.where(a[x][1][rows, None] & b[y][1][part], p, 0.0)
                similarity = np.maximum((s[0, 0] + s[1, 1]) / 2, (s[0, 1] + s[1, 0]) / 2)
                same = i[rows, None] == j[part]
                for r, c in zip(*np.nonzero(same), strict=True):
                    k, v = at + r, similarity[r, c]
                    found["own"][k] = v if not has_own[k] else np.maximum(found["own"][k], v)
                    has_own[k] = True
                best[rows] = np.maximum(best[rows], np.where(same, -np.inf, similarity).max(axis=1))
                total[rows] += np.where(same, 0.0, similarity).sum(axis=1)
                found["n"][rows] += (~same).sum(axis=1)
        none = found["n"] == 0
        group = pa.repeat(left.column(by)[0], len(i))
        return pa.table({by: group, "i": i, "own": pa.array(found["own"], mask=~has_own), "best": pa.array(best, mask=none), "others": pa.array(total, mask=none), "n": found["n"]})

    kind = own.schema[by].dataType.simpleString()
    left = own.select(by, F.col("i").cast("long").alias("i"), "a1", "a2")
    right = references.select(by, F.col("j").cast("long").alias("j"), "b1", "b2")
    parts = BL.met(left, right, by, F.col("i"), F.col("j"), pair, f"{by} {kind}, i long, own double, best double, others double, n long")
    rows = parts.groupBy(by, "i").agg(F.max("own").alias("own"), F.max("best").alias("best"), F.sum("others").alias("others"), F.sum("n").alias("n"))
    return told_hits(rows, by)


def status_counts(fields: DataFrame, by: list[str], status: str = "status", statuses=STATUSES) -> DataFrame:
    """``by..., status, n``: a row for every status, those not seen with 0."""
    spark = fields.sparkSession
    listed = spark.createDataFrame(pa.table({status: pa.array(statuses, pa.string())}))
    seen = fields.select(*by, F.coalesce(status, F.lit(OK)).alias(status)).groupBy(*by, status).agg(F.count(F.lit(1)).alias("n"))
    every = fields.select(*by).distinct().join(F.broadcast(listed), F.lit(True)) if by else listed  # as many rows as statuses
    return every.join(seen, [*by, status], "full").select(*by, status, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def time_summary(times: DataFrame, by: list[str], seconds: str) -> DataFrame:
    """Mean, exact median, maximum, total and number; no row where there is no time."""
    rows = times.where(F.col(seconds).isNotNull())
    return rows.groupBy(*by).agg(F.avg(seconds).alias("mean_s"), F.median(seconds).alias("median_s"), F.max(seconds).alias("max_s"), F.sum(seconds).alias("total_s"), F.count(seconds).alias("n"))


def coverage(methods: DataFrame, answers: DataFrame, run: str, document: str, axis: str, axes=COVERED_AXES, n: int | None = None) -> DataFrame:
    """``run, mean_axes, answers_<axis>``: how many of the axes the answers that did not fail cover.

    Rows come together once, by answer, in ``n`` tasks (as many as the answers ask for without it).
    """
    named = methods.where(F.col(axis).isin(*axes)).select(run, document, F.col(axis).alias("__axis"), F.lit(0).alias("__in"))
    rows = answers.select(run, document, F.lit(None).cast("string").alias("__axis"), F.lit(1).alias("__in")).unionByName(named)
    n = n or tasks_for(answers, COVERED_ROWS)
    per = spread(rows, run, document, n=n).groupBy(run, document).agg(F.max("__in").alias("__in"), *(F.coalesce(F.max((F.col("__axis") == a).cast("int")), F.lit(0)).alias(a) for a in axes))
    told = per.where("__in = 1")
    return told.groupBy(run).agg(F.avg(sum(F.col(a) for a in axes)).alias("mean_axes"), *(F.sum(a).cast("long").alias(f"answers_{a}") for a in axes))


def item_format(items: DataFrame, by: list[str]) -> DataFrame:
    """Items, words an item, share of exact items and of items that name several methods (``words, exact, methods``)."""
    return items.groupBy(*by).agg(F.count(F.lit(1)).alias("items"), F.avg("words").alias("words_per_item"), F.avg(F.col("exact").cast("double")).alias("exact_items"), F.avg((F.col("methods") > 1).cast("double")).alias("several_methods"))


def agreement(sets: DataFrame, run: str, document: str, terms: str) -> DataFrame:
    """``a, b, document, jaccard`` of every pair of runs that answered a document (``run, document, terms``: sorted arrays)."""
    right = sets.select(F.col(run).alias("b"), document, F.col(terms).alias("__t"))
    left = sets.select(F.col(run).alias("a"), document, F.col(terms).alias("__s"))
    met = left.join(right, document).where("a < b")
    return met.select("a", "b", document, jaccard(F.col("__s"), F.col("__t")).alias("jaccard"))


def comparison(parts: list[DataFrame], run: str) -> DataFrame:
    """One wide row a run; parts without a run leave nulls."""
    return reduce(lambda a, b: a.join(b, run, "full"), parts)


def histogram(rows: DataFrame, value: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values and their counts; ties by value."""
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), value).limit(k)
