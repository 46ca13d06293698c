"""Evaluation of stored runs: indicators without and against a reference, agreement, a row a run, and their files.

``answers`` are rows of ``execucao, pos`` and the fields of an answer (``sources.runs.read_answers``); ``known`` is a
vocabulary.  Every result is a table with a row a run, a document or a pair of runs; nothing of the documents reaches the
driver but a vocabulary's keys.  Runs are told apart by their path.  Empty runs have no row, as they have no answers.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators import metrics as M
from tesserine.operators import retrieval as R
from tesserine.operators import statistics as ST
from tesserine.operators import validation as V
from tesserine.operators import vocabulary as VO
from tesserine.operators.spreading import spread, tasks_for
from tesserine.plans import export as X

RUN, DOCUMENT = "execucao", "dissertacao_id"
ANSWER = [RUN, "resposta"]
THEMES = ("tematica_1", "tematica_2")
#: Keys of a vocabulary at most; they go into the closure of the function that splits texts.
MOST_KEYS = 200_000


def keys_of(known: DataFrame) -> list[str]:
    """A vocabulary's keys; one of more than MOST_KEYS is refused, not cut."""
    rows = known.select("key").distinct().limit(MOST_KEYS + 1).collect()
    if len(rows) > MOST_KEYS:
        raise ValueError(f"the vocabulary has more than {MOST_KEYS} keys")
    return [r["key"] for r in rows]


def every_field(answers: DataFrame) -> Column:
    """All fields of an answer, themes first."""
    return F.concat(F.array(*THEMES), F.coalesce("metodologias", F.array().cast(answers.schema["metodologias"].dataType)))


def with_status(answers: DataFrame) -> DataFrame:
    """``execucao, resposta, dissertacao_id, fields, status`` (the worst of its fields; a field without one is ok)."""
    told = F.transform("fields", lambda f: F.coalesce(f["status"], F.lit(V.OK)))
    return answers.select(RUN, F.col("pos").alias("resposta"), DOCUMENT, every_field(answers).alias("fields")).withColumn("status", V.worst_status(told))


def by_answer(answers: DataFrame, n: int) -> DataFrame:
    """``execucao, resposta, dissertacao_id, metodologias`` in ``n`` tasks, however few files hold the answers."""
    return spread(answers.select(RUN, F.col("pos").alias("resposta"), DOCUMENT, "metodologias"), *ANSWER, DOCUMENT, n=n)


def methods(answers: DataFrame, known: DataFrame, keys: Collection[str]) -> DataFrame:
    """``execucao, resposta, dissertacao_id, id, eixo``: the entries that each answer names."""
    n = tasks_for(answers)
    rows = by_answer(answers, n).select(*ANSWER, DOCUMENT, F.posexplode("metodologias").alias("pos", "f"))
    return VO.methods_of_answers(rows.select(*ANSWER, DOCUMENT, "pos", "f.texto", "f.status"), known, keys, [*ANSWER, DOCUMENT], n)


def written_items(answers: DataFrame, known: DataFrame, keys: Collection[str]) -> DataFrame:
    """``execucao, words, exact, methods`` of each item of methods that states one.  A term is looked up once, whoever says it."""
    fields = by_answer(answers, tasks_for(answers)).select(*ANSWER, F.posexplode("metodologias").alias("pos", "f"))
    rows = fields.select(*ANSWER, "pos", F.coalesce("f.texto", F.lit("")).alias("texto"), "f.status")
    rows = rows.where(~T.marked_empty(F.col("texto"), F.col("status")) & (F.coalesce("status", F.lit("")) != V.ERROR))
    # an item stays with its terms all the way, so that no two tables of all items meet
    said = rows.select(*ANSWER, "pos", word_count(F.col("texto")).alias("words"), F.explode_outer(VO.split_terms(F.col("texto"), keys)).alias("termo"))
    terms = said.where("termo IS NOT NULL").select(F.col("termo").alias("__k"), "termo").distinct()
    sure = VO.recognized(terms, known, "__k").select("termo", (~F.col("id").startswith(VO.FREE)).alias("sure"))
    number = VO.linked(terms, known, "__k").groupBy("termo").agg(F.count(F.lit(1)).alias("n"))
    found = said.join(sure.join(number, "termo"), "termo", "left").groupBy(*ANSWER, "pos").agg(F.first("words").alias("words"), F.bool_and("sure").alias("exact"), F.sum("n").alias("methods"))
    return found.select(RUN, "words", F.coalesce("exact", F.lit(False)).alias("exact"), F.coalesce("methods", F.lit(0)).alias("methods"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def said_theme(name: str) -> Column:
    """The text of a theme; a failed one counts as empty."""
    return F.when(F.coalesce(F.col(name)["status"], F.lit("")) == V.ERROR, "").otherwise(F.trim(F.coalesce(F.col(name)["texto"], F.lit(""))))


def tally(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``execucao`` and a map of values to their numbers."""
    counts = rows.groupBy(RUN, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(RUN).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias(name))


def status_maps(rows: DataFrame, name: str) -> DataFrame:
    """``execucao`` and a map of each status to its number, those not seen with 0."""
    return M.status_counts(rows, [RUN]).groupBy(RUN).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias(name))


def joined(parts: list[DataFrame]) -> DataFrame:
    """Parts of a report beside each other; the first one has every run."""
    return reduce(lambda a, b: a.join(b, RUN, "left"), parts)


def indicators(answers: DataFrame, runs: DataFrame, named: DataFrame, items: DataFrame) -> DataFrame:
    """What needs no reference, a row a run: status, time, attempts, form of the items, axes covered, free terms.

    ``named`` are ``methods``, ``items`` are ``written_items``, ``runs`` bear ``segundos`` and ``tentativas``.
    """
    docs = with_status(answers)
    fields = docs.select(RUN, F.explode("fields").alias("f")).select(RUN, F.coalesce("f.status", F.lit(V.OK)).alias("status"))
    size = answers.groupBy(RUN).agg(F.count(F.lit(1)).alias("dissertacoes"), F.avg(sum(word_count(said_theme(t)) for t in THEMES) / 2).alias("palavras_por_tematica"))
    time = M.time_summary(runs.select(RUN, F.explode("segundos").alias("d", "s")), [RUN], "s")
    tries = tally(runs.select(RUN, F.explode("tentativas").alias("d", "v")).withColumn("v", F.col("v").cast("string")), "v", "tentativas")
    number = named.groupBy(RUN).agg(F.count(F.lit(1)).alias("n_methods"), F.array_sort(F.collect_set(F.when(F.col("eixo").isNull(), F.col("id")))).alias("termos_livres"))
    covered = M.coverage(named, docs.where(F.col("status") != V.ERROR), RUN, "resposta", "eixo")
    form = M.item_format(items, [RUN])
    rows = joined([size, status_maps(fields, "por_campo"), status_maps(docs, "por_dissertacao"), time, tries, number, covered, form])
    zero = lambda c, kind="double": F.coalesce(c, F.lit(0).cast(kind))
    return rows.select(
        RUN, "dissertacoes", F.struct("por_campo", "por_dissertacao").alias("status"),
        F.when(F.col("n").isNotNull(), F.struct(F.col("mean_s").alias("medio_s"), F.col("median_s").alias("mediano_s"), "max_s", F.col("total_s"), "n")).alias("tempo"),
        "tentativas", (zero("n_methods", "long") / F.col("dissertacoes")).alias("metodologias_por_resposta"),
        F.struct(zero("items", "long").alias("itens"), zero("words_per_item").alias("palavras_por_item"), zero("exact_items").alias("itens_exatos"), zero("several_methods").alias("itens_com_varios_metodos")).alias("formato_metodologias"),
        "palavras_por_tematica", zero("mean_axes").alias("eixos_cobertos_medio"),
        F.struct(*(zero(f"answers_{a}", "long").alias(a) for a in M.COVERED_AXES)).alias("respostas_por_eixo"),
        F.coalesce("termos_livres", F.array().cast("array<string>")).alias("termos_livres"),
    )


def embedded_themes(rows: DataFrame, by: list[str], first: Column, second: Column, names: tuple[str, str], encoder: Callable) -> DataFrame:
    """``by...`` and the vectors of two themes; an empty one has none.  Themes are compared as queries, on both sides."""
    vector = lambda t: F.when(t != "", R.embedded(t, "query", encoder))
    return rows.select(*by, vector(first).alias(names[0]), vector(second).alias(names[1]))


class Judged(NamedTuple):
    """Answers against a reference: a row a document, and a row a run."""

    documents: DataFrame
    runs: DataFrame


def against_reference(answers: DataFrame, named: DataFrame, themes: DataFrame, terms: DataFrame, encoder: Callable | None = None) -> Judged:
    """Scores of the answers whose document the reference has; a failed answer names nothing, and scores so.

    ``themes`` (``dissertacao_id, tematica_1, tematica_2``) has a row a document of the reference, ``terms`` its entries
    (``dissertacao_id, id, eixo, mandatory``).  Without an encoder the themes stay out.
    """
    by = [*ANSWER, DOCUMENT]
    keys = with_status(answers).join(themes.select(DOCUMENT), DOCUMENT, "left_semi").select(*by, "status")
    said = named.join(keys.select(*by), by, "left_semi")
    wanted = keys.select(*by).join(terms, DOCUMENT)
    board = M.scoreboard(said, wanted, keys, by, "id")
    strict = M.scoreboard(said, wanted.where("mandatory"), keys, by, "id").select(*by, F.bround("precision", 4).alias("precisao_estrita"))
    lists = M.missing_and_extra(said, wanted, by, "id")
    rounded = [F.bround(c, 4).alias(c) for c in ("precision", "recall", "f1")]
    none = F.array().cast("array<string>")
    documents = keys.join(board, by).join(strict, by).join(lists, by, "left").select(
        *by, "status", *rounded, "hits_p", "predicted", "hits_r", "expected", "precisao_estrita",
        F.coalesce("missing", none).alias("nao_achados"), F.coalesce("extra", none).alias("fora_da_referencia"),
    )
    macro = M.macro(board, [RUN]).select(RUN, *(F.col(f"macro_{c}").alias(f"met_{c}") for c in ("precision", "recall", "f1")), F.col("n").alias("avaliadas"))
    axes = M.macro(M.scoreboard_by_axis(said, wanted, by, "eixo", "id"), [RUN, "eixo"])
    per_axis = axes.groupBy(RUN).agg(F.array_sort(F.collect_list(F.struct("eixo", "macro_precision", "macro_recall", "macro_f1", "n"))).alias("por_eixo"))
    exact = documents.groupBy(RUN).agg(F.avg("precisao_estrita").alias("met_precisao_estrita"))
    interval = ST.bootstrap(documents, RUN, "resposta", "f1").select(RUN, F.array("low", "high").alias("f1_ic95"))
    parts = [macro, M.micro(board, [RUN]), exact, interval, per_axis]
    if encoder is not None:
        own = embedded_themes(answers.select("*", F.col("pos").alias("resposta")).join(keys.select(*by), by, "left_semi"), by, said_theme(THEMES[0]), said_theme(THEMES[1]), ("a1", "a2"), encoder)
        text = lambda t: F.trim(F.coalesce(t, F.lit("")))
        other = embedded_themes(themes, [DOCUMENT], text(THEMES[0]), text(THEMES[1]), ("b1", "b2"), encoder)
        answered = own.join(other, DOCUMENT)
        similarity = M.pair_similarity(F.col("a1"), F.col("a2"), F.col("b1"), F.col("b2"))
        documents = documents.join(answered.select(*by, F.bround(similarity, 4).alias("similaridade_tematicas")), by)
        # each answer of a run with the reference of each answer of that run: this is what a margin is measured against
        pairs = own.select(RUN, F.col("resposta").alias("i"), "a1", "a2").join(answered.select(RUN, F.col("resposta").alias("j"), "b1", "b2"), RUN)
        hits = M.theme_hits(pairs.select(RUN, "i", "j", similarity.alias("similarity")), RUN)
        mean = documents.groupBy(RUN).agg(F.avg("similaridade_tematicas").alias("tem_similaridade"))
        parts += [mean, hits.select(RUN, F.col("baseline").alias("tem_linha_de_base"), F.col("margin").alias("tem_margem"), F.col("hit_at_1").alias("tem_acerto_1"))]
    return Judged(documents, joined(parts))


def comparative_rows(described: DataFrame, told: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """The numbers that matter side by side, a row a run; of the reference's only where there is one."""
    fields = F.aggregate(F.map_values("status.por_campo"), F.lit(0).cast("long"), lambda s, n: s + n)
    rows = described.select(RUN, "modelo", "tecnica", "versao_prompt").join(told, RUN).select(
        RUN, "modelo", "tecnica", "versao_prompt", F.col("dissertacoes").alias("n"),
        M.ratio(F.col("status.por_campo")[V.OK], fields).alias("campos_ok"), F.col("status.por_dissertacao")[V.ERROR].alias("dissertacoes_com_erro"),
        F.col("tempo.medio_s").alias("tempo_medio_s"), F.col("eixos_cobertos_medio").alias("eixos_cobertos"),
        F.col("formato_metodologias.itens_exatos").alias("itens_exatos"), "palavras_por_tematica",
    )
    if judged is None:
        return rows
    return rows.join(judged.select(RUN, *(c for c in judged.columns if c.startswith(("met_", "tem_")))), RUN, "left")


def agreement(answers: DataFrame, named: DataFrame, encoder: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """How far runs agree: of each pair of runs (``a, b``; none in common: nulls), and of each document over all pairs.

    Of several answers of a run to one document the last counts.  Runs are few; a document meets itself once a pair of runs.
    """
    last = answers.groupBy(RUN, DOCUMENT).agg(F.max("pos").alias("resposta"))
    sets = last.join(named.groupBy(*ANSWER).agg(F.array_sort(F.collect_set("id")).alias("ids")), ANSWER, "left").select(RUN, DOCUMENT, F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    rows = M.agreement(sets, RUN, DOCUMENT, "ids")
    values = ["jaccard"]
    if encoder is not None:
        texts = answers.select(RUN, DOCUMENT, F.col("pos").alias("resposta"), *THEMES).join(last, [RUN, DOCUMENT, "resposta"])
        vectors = embedded_themes(texts, [RUN, DOCUMENT], said_theme(THEMES[0]), said_theme(THEMES[1]), ("v1", "v2"), encoder)
        side = lambda name: vectors.select(F.col(RUN).alias(name), DOCUMENT, F.col("v1").alias(f"{name}1"), F.col("v2").alias(f"{name}2"))
        rows = rows.join(side("a"), ["a", DOCUMENT]).join(side("b"), ["b", DOCUMENT])
        rows = rows.select("a", "b", DOCUMENT, "jaccard", M.pair_similarity(F.col("a1"), F.col("a2"), F.col("b1"), F.col("b2")).alias("tematicas"))
        values.append("tematicas")
    names = answers.select(RUN).distinct()
    every = names.select(F.col(RUN).alias("a")).join(names.select(F.col(RUN).alias("b")), F.col("a") < F.col("b"))
    pairs = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("dissertacoes"), *(F.avg(v).alias(v) for v in values))
    return every.join(pairs, ["a", "b"], "left").fillna(0, ["dissertacoes"]), rows.groupBy(DOCUMENT).agg(*(F.avg(v).alias(v) for v in values))


def evaluate(answers: DataFrame, runs: DataFrame, described: DataFrame, known: DataFrame, reference: tuple[DataFrame, DataFrame] | None = None, encoder: Callable | None = None) -> dict[str, DataFrame]:
    """All tables of an evaluation by name; ``reference`` are its themes and terms."""
    keys = keys_of(known)
    named, items = methods(answers, known, keys), written_items(answers, known, keys)
    told = indicators(answers, runs, named, items)
    judged = None if reference is None else against_reference(answers, named, *reference, encoder)
    pairs, documents = agreement(answers, named, encoder)
    found = {"sem_gabarito": told, "execucoes": comparative_rows(described, told, judged and judged.runs), "concordancia_pares": pairs, "concordancia_por_dissertacao": documents}
    if judged is not None:
        found |= {"contra_referencia": judged.runs, "por_dissertacao": judged.documents, "diferencas_pareadas": ST.paired_differences(judged.documents, described)}
    return found


def write_evaluation(found: dict[str, DataFrame], out: str) -> dict[str, DataFrame]:
    """Each table as JSON below ``out``, a run's own tables by run; the tables as read back, so that none is made twice."""
    written = {}
    for name, df in found.items():
        if name in ("sem_gabarito", "contra_referencia", "por_dissertacao"):
            X.write_reports(df, f"{out}/{name}", RUN)
        else:
            df.write.mode("overwrite").json(f"{out}/{name}")
        written[name] = df.sparkSession.read.schema(df.schema).json(f"{out}/{name}")
    return written
