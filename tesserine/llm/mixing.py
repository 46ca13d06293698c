"""Soft-membership mixing: document rates whose expected token totals match target weights of the domains.

1. A naive Bayes classifier over hashed words is fitted on a table of labelled documents (``key``, ``domain``), at most
   ``TRAIN_ROWS`` of them, those with the smallest hash of their key.
2. Every document gets a posterior over the domains, from all its words.  Log-likelihoods are divided by the root of the
   number of words, as words of one document are not independent.
3. Rates x >= 0 solve min 1/2 r' G^-1 r, where r_d = sum_i x_i tokens_i p_id - T_d and G_de = sum_i tokens_i p_id p_ie, by
   projected gradient steps from x = 1.  In this metric the curvature is at most 1, so whole steps never overshoot, and a
   step that meets no bound ends at the targets.  Later steps take G over the documents that are off the bound (the
   two-metric form), and are taken back where the loss rises.  Steps go on until every total is within ``TOLERANCE`` of its
   target, or a step lowers the loss by less than ``PROGRESS``; what is then missed is reported (``Fit``), with a warning.
   A step takes one aggregation of a few sums; rates are functions of the steps so far, and the table is rewritten with
   them every ``REWRITE`` steps.

Rows that share a key are one document, their words counted together; so are rows whose key is null.  A document without
words has the prior as posterior and the rate 1: it has no tokens to weigh.  Domains outside ``targets`` are not fitted.
Very long texts are split into words like any other, and counted before anything is shuffled.  An empty table gives an empty
result; without labelled rows all documents have the same posterior.  Of the columns only key and text are read.
Only DataFrame functions run on the executors; what is broadcast is ``SLOTS`` rows.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, fold_case

TRAIN_ROWS = 8_000
SLOTS = 4096
#: Steps between two writings of the rates; the relative distance at which a target is met; the share of the loss that a
#: step must take off for another to follow.
REWRITE, TOLERANCE, PROGRESS = 15, 1e-4, 0.05
#: How far above the least covering size a covering mixture lies, so that rates of at least 1 can reach the targets.
COVER = 1.02
#: Weights of the languages in the mixture of the production query.
TARGETS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}


def words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key`` and ``slot``, one row a word; a text without words gives one row with a null slot."""
    parts = F.split(fold_case(F.coalesce(F.col(text).cast("string"), F.lit(""))), "[\\x20\\x09-\\x0D]+")
    rows = docs.select(F.col(key).alias("key"), F.explode(parts).alias("word"))
    return rows.select("key", F.when(F.col("word") != "", F.pmod(F.xxhash64("word"), F.lit(SLOTS)).cast("int")).alias("slot"))


def fit_classifier(docs: DataFrame, labelled: DataFrame, domains: list[str], key: str, text: str, rows: int = TRAIN_ROWS) -> tuple[DataFrame, list[float]]:
    """Log-probabilities of the slots in each domain (``SLOTS`` rows: ``slot``, ``l0``, ``l1``, ...) and log priors."""
    chosen = labelled.where(F.col("domain").isin(*domains) & F.col("key").isNotNull()).select("key", "domain").distinct()
    chosen = chosen.orderBy(F.xxhash64("key"), "key", "domain").limit(rows)
    one = docs.join(F.broadcast(chosen.withColumnRenamed("key", key)), key).select(key, "domain", text)
    counted = words(one.select(F.struct("domain").alias("k"), text), "k", text).select("key.domain", "slot").where("slot IS NOT NULL").groupBy("domain", "slot").count()
    counted = cut(counted, "slots")
    totals = {r["domain"]: r["n"] for r in counted.groupBy("domain").agg(F.sum("count").alias("n")).collect()}
    seen = sum(totals.values())
    prior = [math.log((totals.get(d, 0) + 1) / (seen + len(domains))) for d in domains]
    count = lambda d: F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("count"))), F.lit(0))
    log = lambda d: F.log((count(d) + 0.1) / (totals.get(d, 0) + 0.1 * SLOTS))
    slots = docs.sparkSession.range(SLOTS).select(F.col("id").cast("int").alias("slot"))
    found = slots.join(counted, "slot", "left").groupBy("slot").agg(*(log(d).alias(f"l{i}") for i, d in enumerate(domains)))
    return found, prior


def posteriors(docs: DataFrame, model: DataFrame, prior: list[float], key: str, text: str) -> DataFrame:
    """``key``, ``tokens``, ``p0``, ``p1``, ... of every document."""
    d = range(len(prior))
    rows = words(docs, key, text).join(F.broadcast(model), "slot", "left")
    sums = rows.groupBy("key").agg(F.count("slot").alias("tokens"), *(F.sum(f"l{i}").alias(f"s{i}") for i in d))
    scale = F.sqrt(F.greatest(F.col("tokens"), F.lit(1)))
    z = [F.coalesce(F.col(f"s{i}"), F.lit(0.0)) / scale + prior[i] for i in d]
    sums = sums.select("key", "tokens", *(z[i].alias(f"z{i}") for i in d))
    top = F.greatest(*(F.col(f"z{i}") for i in d)) if len(prior) > 1 else F.col("z0")
    sums = sums.select("key", "tokens", *(F.exp(F.col(f"z{i}") - top).alias(f"e{i}") for i in d))
    whole = sum((F.col(f"e{i}") for i in d), F.lit(0.0))
    return sums.select("key", "tokens", *((F.col(f"e{i}") / whole).alias(f"p{i}") for i in d))


def stepped(x: Column, moves: list[list[float]], least: float) -> Column:
    """Rates after projected gradient steps; a move is what a step subtracts for each unit of posterior."""
    for move in moves:
        gradient = sum((F.col(f"p{i}") * m for i, m in enumerate(move)), F.lit(0.0))
        x = F.greatest(F.lit(least), x - gradient)
    return x


@dataclass
class Fit:
    """How a fit of rates ended: its steps, the token totals it reached and those it should reach, by domain."""

    steps: int
    reached: list[float]
    wanted: list[float]

    def missed(self) -> float:
        """The largest distance of a total from its target, relative to the target (to a thousandth of all, if that is more)."""
        whole = sum(self.wanted)
        return max((abs(r - w) / max(w, 1e-3 * whole, 1e-9) for r, w in zip(self.reached, self.wanted, strict=True)), default=0.0)


def fit_rates(docs: DataFrame, weights: list[float], cover: bool = False, tolerance: float = TOLERANCE) -> tuple[DataFrame, Fit]:
    """``docs`` (``key``, ``tokens``, ``p0``, ...) with ``rate``, and how well the targets were met.

    The mixture has as many tokens as the documents.  With ``cover`` no rate is below 1, and it has as many as that takes.
    """
    d = range(len(weights))
    sums = [F.sum(F.col("tokens") * F.col(f"p{i}")) for i in d] + [F.sum(F.col("tokens") * F.col(f"p{i}") * F.col(f"p{j}")) for i in d for j in d]
    mass = np.array([x or 0.0 for x in docs.agg(*(c.alias(f"s{i}") for i, c in enumerate(sums))).first()])
    natural, gram = mass[: len(weights)], mass[len(weights) :].reshape(len(weights), -1)
    whole = natural.sum()
    if cover:
        whole = max((COVER * t / w for t, w in zip(natural, weights, strict=True) if w > 0), default=whole)
    goal, least = np.array(weights) * whole, 1.0 if cover else 0.0
    inverse = np.linalg.pinv(gram, rcond=1e-9, hermitian=True)
    state, moves, written, steps = docs.withColumn("rate", F.lit(1.0)), [], None, 0
    before, last, sharp = math.inf, None, False  # the loss and residual before the last move, and whether that was a sharp one
    while True:
        rate = stepped(F.col("rate"), moves, least)
        row = state.withColumn("__x", rate).agg(*(F.sum(F.col("__x") * F.col("tokens") * F.col(f"p{i}")).alias(f"t{i}") for i in d), *(F.sum(F.when(F.col("__x") > least, F.col("tokens") * F.col(f"p{i}") * F.col(f"p{j}"))).alias(f"m{i}_{j}") for i in d for j in d)).first()
        found = np.array([x or 0.0 for x in row])
        residual = found[: len(weights)] - goal
        loss, fit = float(residual @ inverse @ residual), Fit(steps, found[: len(weights)].tolist(), goal.tolist())
        if fit.missed() < tolerance or not whole:
            break
        if sharp and loss > before:  # a sharp move may overshoot; a whole one in its place does not
            moves[-1], sharp = (inverse @ last).tolist(), False
            continue
        if not sharp and loss > before * (1 - PROGRESS):
            break
        if len(moves) >= REWRITE:
            new = cut(state.withColumn("rate", rate), "rates")
            drop_cut(written)
            state, written, moves = new, new, []
        # documents at the bound can't follow a step; one in the metric of the others goes as far as it takes
        sharp = loss <= before * (1 - PROGRESS) or last is None
        metric = np.linalg.pinv(found[len(weights) :].reshape(len(weights), -1), rcond=1e-9, hermitian=True) if sharp and steps else inverse
        sharp = sharp and bool(steps)
        before, last = loss, residual
        moves.append((metric @ residual).tolist())
        steps += 1
    if fit.missed() >= tolerance:
        warnings.warn(f"mixture: {steps} steps leave a domain {fit.missed():.2%} off its target", stacklevel=2)
    return state.withColumn("rate", F.when(F.col("tokens") > 0, stepped(F.col("rate"), moves, least)).otherwise(1.0)), fit


def mix(docs: DataFrame, labelled: DataFrame, targets: Mapping[str, float] = TARGETS, key: str = "doc_id", text: str = "text", cover: bool = False) -> DataFrame:
    """``key``, ``tokens``, ``posteriors map<string,double>``, ``rate``, ``copies`` of each document.

    ``copies`` rounds the rate up with the probability of its fraction, drawn from a hash of the key.
    """
    domains = sorted(targets)
    whole = sum(targets.values())
    if not domains or min(targets.values()) < 0 or whole <= 0:
        raise ValueError("targets must name domains with weights of at least 0, not all 0")
    model, prior = fit_classifier(docs, labelled, domains, key, text)
    model = cut(model, "classifier")
    state = cut(posteriors(docs, model, prior, key, text), "posteriors")
    rated, _ = fit_rates(state, [targets[d] / whole for d in domains], cover)
    draw = F.pmod(F.xxhash64(F.lit("mixing"), F.col("key")), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("long")
    shown = F.create_map(*(x for i, d in enumerate(domains) for x in (F.lit(d), F.col(f"p{i}"))))
    return rated.select(F.col("key").alias(key), "tokens", shown.alias("posteriors"), "rate", copies.alias("copies"))
