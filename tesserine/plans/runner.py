"""Runs: models times techniques over a corpus, resumed where they stopped, with provenance."""

from __future__ import annotations

import hashlib
import platform
import sys
from collections.abc import Callable, Iterable
from importlib.metadata import PackageNotFoundError, version

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators import retrieval as R
from tesserine.plans import answers as A
from tesserine.plans import prompt as P

GRID = "modelo string, tecnica string, versao_prompt string"


def grid(spark: SparkSession, models: Iterable[str], techniques: Iterable[str], prompt_version: str) -> DataFrame:
    """Every model with every technique."""
    rows = [(m, t, prompt_version) for m in models for t in techniques]
    return spark.createDataFrame(rows, GRID).withColumn("execucao", T.run_name(F.col("modelo"), F.col("tecnica"), F.col("versao_prompt")))


def pending(docs: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    """What a run has not answered yet."""
    return docs if done is None else docs.join(done.select(*keys).distinct(), keys, "left_anti")


def checked_client(make_client: Callable[[], A.Client]) -> None:
    """Fail before a long run, not in it."""
    try:
        make_client()
    except Exception as e:
        raise RuntimeError(f"the model's client can't be made: {e}") from e


def prompts(docs: DataFrame, contexts: DataFrame, entries: DataFrame, prompt_version: str, key: str = "id") -> DataFrame:
    """``key, tecnica, prompt, shown`` from contexts; ``shown`` are the ids the model gets to see."""
    offered = contexts.select(key, "tecnica", F.posexplode_outer("verbetes").alias("at", "__v")).join(R.sent_along(entries.select(F.col("id").alias("__v"), "termo", "eixo", "definicao")), "__v", "left")
    listed = F.array_sort(F.collect_list(F.when(F.col("termo").isNotNull(), F.struct("at", "termo", "eixo", "definicao"))))
    blocks = offered.groupBy(key, "tecnica").agg(P.entry_block(listed).alias("__e"))
    rows = contexts.join(blocks, [key, "tecnica"]).join(docs.select(key, "titulo", "palavras_chave"), key)
    text = P.prompt(P.template(prompt_version), F.col("titulo"), F.col("palavras_chave"), P.sentence_blocks(F.col("frases_tematicas"), F.col("frases_metodologia")), F.col("__e"), F.lit(""))
    shown = F.array_distinct(F.concat(F.transform("frases_tematicas", lambda s: s["frase_id"]), F.transform("frases_metodologia", lambda s: s["frase_id"])))
    return rows.select(key, "tecnica", text.alias("prompt"), shown.alias("shown"))


def stored(spark: SparkSession, out: str, model: str, technique: str, prompt_version: str) -> DataFrame | None:
    """A run's answers as far as they are written; none where there is nothing yet."""
    try:
        answers = spark.read.parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return answers.where((F.col("modelo") == model) & (F.col("tecnica") == technique) & (F.col("versao_prompt") == prompt_version))


def execute(docs: DataFrame, sentences: DataFrame, entries: DataFrame, model: str, technique: str, prompt_version: str, make_client: Callable[[], A.Client], out: str, encoder=None, key: str = "id", fresh: bool = False) -> DataFrame:
    """Answer what is pending and append it to ``out`` (Parquet); a complete run writes nothing.  Returns all its answers.

    ``fresh`` answers all documents again, in place of everything that ``out`` holds.
    """
    spark = docs.sparkSession
    done = None if fresh else stored(spark, out, model, technique, prompt_version)
    rest = pending(docs, done, [key])
    if rest.take(1):
        checked_client(make_client)
        own = sentences.join(rest.select(key), key, "left_semi")
        # prompts, then the model's answers, are written before anything else reads them: retrieval runs once, and no model
        # is asked again because an executor was lost
        of_run = hashlib.sha256(f"{model}|{technique}|{prompt_version}".encode()).hexdigest()[:16]
        asked, raw = f"{out}_asked/{of_run}", f"{out}_raw/{of_run}"
        prompts(rest, R.contexts(rest, own, entries, technique, encoder, key), entries, prompt_version, key).write.mode("overwrite").parquet(asked)
        A.generated(spark.read.parquet(asked).select(key, "prompt"), make_client, [key]).write.mode("overwrite").parquet(raw)
        shown = spark.read.parquet(asked).select(key, F.col("shown").alias("valid"))
        checked = A.validated(spark.read.parquet(raw).join(shown, key), [key]).drop("valid")
        checked.withColumns({"modelo": F.lit(model), "tecnica": F.lit(technique), "versao_prompt": F.lit(prompt_version)}).write.mode("overwrite" if fresh else "append").parquet(out)
    return stored(spark, out, model, technique, prompt_version)


def provenance(spark: SparkSession, model: str, technique: str, prompt_version: str, **more: str) -> DataFrame:
    """``campo, valor``: what a run was made with."""

    def release(name: str) -> str:
        try:
            return version(name)
        except PackageNotFoundError:
            return "-"

    facts = {
        "modelo": model, "tecnica": technique, "versao_prompt": prompt_version,
        "prompt_sha256": hashlib.sha256(P.template(prompt_version).encode()).hexdigest(),
        "python": sys.version.split()[0], "maquina": platform.machine(), "sistema": platform.system(), "spark": spark.version,
        **{f"bibliotecas.{n}": release(n) for n in ("numpy", "pandas", "pyarrow")},
        "temperatura": str(A.TEMPERATURE), "semente": str(A.MODEL_SEED), "contexto": str(A.CONTEXT), **more,
    }
    return spark.createDataFrame(list(facts.items()), "campo string, valor string")
