"""Uncertainty: bootstrap intervals and paired differences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.functions import text as T

# Fixed values
RESAMPLES, SEED = 5_000, 42
LOW, HIGH = 0.025, 0.975
TIE = 1e-9
ATTRIBUTES = ("modelo", "tecnica", "versao_prompt")


def interval(values: np.ndarray, resamples: int = RESAMPLES, seed: int = SEED) -> tuple[float, float]:
    """The 95 % interval of the mean by resampling with replacement."""
    draw = np.random.default_rng(seed)
    n = len(values)
    means = np.sort([values[draw.integers(0, n, n)].mean() for _ in range(resamples)])
    return float(means[int(LOW * resamples)]), float(means[int(HIGH * resamples) - 1])


def bootstrap(rows: DataFrame, by: str, order: str, value: str, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """``by, n, mean, low, high``: a group is a run's documents, and one task resamples it."""
    kind = rows.schema[by].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf.sort_values(order)[value].to_numpy(float)
        low, high = interval(values, resamples, seed)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [len(values)], "mean": [float(values.mean())], "low": [low], "high": [high]})

    wanted = rows.where(F.col(value).isNotNull()).select(by, order, F.col(value).cast("double").alias(value))
    return wanted.groupBy(by).applyInPandas(one, f"{by} {kind}, n long, mean double, low double, high double")


def differences(a: DataFrame, b: DataFrame, by: list[str], document: str, value: str) -> DataFrame:
    """``by..., document, difference`` of the documents that both sides have."""
    left, right = a.select(*by, document, F.col(value).alias("__a")), b.select(*by, document, F.col(value).alias("__b"))
    return left.join(right, [*by, document]).select(*by, document, (F.col("__a") - F.col("__b")).alias("difference"))


def paired(rows: DataFrame, by: list[str]) -> DataFrame:
    """``n, mean, won, lost, tied`` of differences."""
    d = F.col("difference")
    aggs = [F.count(d).alias("n"), F.avg(d).alias("mean"), F.count(F.when(d > TIE, 1)).alias("won"), F.count(F.when(d < -TIE, 1)).alias("lost"), F.count(F.when(F.abs(d) <= TIE, 1)).alias("tied")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def run_pairs(runs: DataFrame) -> DataFrame:
    """``a, b, changes``: pairs of runs (``execucao`` and its attributes) that differ in just one of them, the later one as a.

    Runs are compared by their full name, so two of one folder name in different places stay apart.
    """
    left = runs.select(F.col("execucao").alias("a"), *(F.col(c).alias(f"{c}_a") for c in ATTRIBUTES))
    right = runs.select(F.col("execucao").alias("b"), *(F.col(c).alias(f"{c}_b") for c in ATTRIBUTES))
    differs = [~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in ATTRIBUTES]
    one = sum((d.cast("int") for d in differs[1:]), differs[0].cast("int")) == 1
    # runs are dozens of rows: what folders there are, not what they hold
    met = left.join(right, (F.col("a") < F.col("b")) & one)
    what = F.coalesce(*(F.when(d, F.lit(c)) for d, c in zip(differs, ATTRIBUTES, strict=True)))
    later = F.coalesce(*(F.when(d, T.natural_key(F.col(f"{c}_b")) > T.natural_key(F.col(f"{c}_a"))) for d, c in zip(differs, ATTRIBUTES, strict=True)))
    return met.select(F.when(later, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(later, F.col("a")).otherwise(F.col("b")).alias("b"), what.alias("changes"))


def paired_differences(documents: DataFrame, runs: DataFrame, value: str = "f1", interval_of_mean: bool = True) -> DataFrame:
    """``a, b, changes, n, mean, won, lost, tied`` and the interval, from ``execucao, dissertacao_id, value`` rows."""
    pairs = run_pairs(runs)
    side = lambda name: documents.select(F.col("execucao").alias(name), "dissertacao_id", F.col(value).alias(f"__{name}"))
    rows = pairs.join(side("a"), "a").join(side("b"), ["b", "dissertacao_id"])
    rows = rows.select("a", "b", "changes", "dissertacao_id", (F.col("__a") - F.col("__b")).alias("difference"))
    found = pairs.join(paired(rows, ["a", "b", "changes"]), ["a", "b", "changes"], "left").fillna(0, ["n", "won", "lost", "tied"])
    if not interval_of_mean:
        return found
    keyed = rows.select(F.concat_ws("\n", "a", "b").alias("pair"), "dissertacao_id", "difference")
    intervals = bootstrap(keyed, "pair", "dissertacao_id", "difference").select("pair", "low", "high")
    return found.withColumn("pair", F.concat_ws("\n", "a", "b")).join(intervals, "pair", "left").drop("pair")


def prompt_decision(paired_rows: DataFrame, guards: DataFrame) -> DataFrame:
    """Whether a new prompt is taken over: mean paired difference of F1 not below 0, and every guard not worse.

    ``paired_rows``: one row a combination (``f1_difference``); ``guards``: ``name, old, new``, higher being better.
    """
    mean = paired_rows.agg(F.avg("f1_difference").alias("mean_difference"))
    held = guards.agg(F.min((F.col("new") >= F.col("old") - TIE).cast("int")).alias("__g"))
    return mean.join(held, F.lit(True)).select("mean_difference", (F.col("mean_difference") >= 0).alias("f1_holds"), (F.coalesce("__g", F.lit(1)) == 1).alias("guards_hold"), ((F.col("mean_difference") >= 0) & (F.coalesce("__g", F.lit(1)) == 1)).alias("accepted"))


def diagnostics(terms: DataFrame, by: list[str]) -> DataFrame:
    """Shares behind a score, from exploded terms: ``predicted, mandatory, in_base, offered`` flags and the entry ``id``."""
    said, wanted = F.col("predicted"), F.col("mandatory")
    c = lambda x, name: F.count_if(x).alias(name)
    return terms.groupBy(*by).agg(
        c(said & wanted & F.col("in_base"), "exact_hits"),
        c(said & ~wanted & (F.col("id") == "estudo_de_caso"), "invented_case_studies"),
        c(wanted & (F.col("eixo") == "coleta"), "sources_wanted"),
        c(said & wanted & (F.col("eixo") == "coleta"), "sources_found"),
        c(said & wanted & ~F.col("in_base"), "found_outside_base"),
        c(said & ~wanted & F.col("offered"), "invented_among_offered"),
    )
