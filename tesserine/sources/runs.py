"""Stored runs, references and vector indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators import retrieval as R
from tesserine.operators import vocabulary as VO
from tesserine.operators.validation import FIELD

ANSWER = f"dissertacao_id string, tematica_1 {FIELD}, tematica_2 {FIELD}, metodologias array<{FIELD}>, modelo string, versao_prompt string, tecnica string, saida_bruta string"
RUN = "modelo string, tecnica string, versao_prompt string, segundos map<string,double>, tentativas map<string,int>"
REFERENCE = "dissertacao_id string, tematica_1 string, tematica_2 string, metodologias array<struct<termo:string,verbete:string,eixo:string,explicito:boolean,sinonimos:array<string>>>"


def run_of(path: Column, root: str) -> Column:
    """A run's name: its folder's path below ``root``, so folders of one name in two places stay apart."""
    below = F.regexp_extract(path, r"^(?:file:)?/*(.*)/[^/]*$", 1)
    return F.regexp_replace(below, "^.*?" + "\\Q" + root.removeprefix("file:").strip("/") + "\\E/", "")


def read_answers(spark: SparkSession, root: str) -> DataFrame:
    """``execucao, pos`` and the fields of an answer, of every ``respostas.json`` below ``root``; unknown fields are ignored."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "respostas.json").text(root, wholetext=True)
    rows = files.select(run_of(F.input_file_name(), root).alias("execucao"), F.from_json("value", f"array<struct<{ddl(ANSWER)}>>").alias("a"))
    return rows.select("execucao", F.posexplode("a").alias("pos", "x")).select("execucao", "pos", "x.*")


def ddl(columns: str) -> str:
    """``a int, b string`` as the inside of a struct type."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(columns).simpleString()[len("struct<") : -1]


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """``execucao`` and metadata of every ``execucao.json`` below ``root``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "execucao.json").text(root, wholetext=True)
    return files.select(run_of(F.input_file_name(), root).alias("execucao"), F.from_json("value", f"struct<{ddl(RUN)}>").alias("x")).select("execucao", "x.*")


def described(answers: DataFrame, runs: DataFrame) -> DataFrame:
    """Metadata of the runs that have answers: their own file's, else the first answer's."""
    first = answers.groupBy("execucao").agg(*(F.min_by(c, "pos").alias(f"__{c}") for c in ("modelo", "tecnica", "versao_prompt")))
    rows = first.join(runs, "execucao", "left")
    return rows.select("execucao", *(F.coalesce(c, f"__{c}").alias(c) for c in ("modelo", "tecnica", "versao_prompt")), "segundos", "tentativas")


def read_reference(spark: SparkSession, path: str, base: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vocabulary, themes and terms (``dissertacao_id, id, eixo, mandatory``) of a reference.

    Terms that name no entry of the base join the vocabulary after it, with the synonyms listed for them; then all terms are
    looked up.  A term that is mandatory in one line and acceptable in another is mandatory.
    """
    text = spark.read.text(path, wholetext=True)
    items = F.coalesce(F.from_json("value", f"struct<referencias:array<struct<{ddl(REFERENCE)}>>>")["referencias"], F.from_json("value", f"array<struct<{ddl(REFERENCE)}>>"))
    refs = text.select(F.posexplode(items).alias("at", "x")).select("at", "x.*")
    lines = refs.select("at", "dissertacao_id", F.posexplode("metodologias").alias("pos", "m")).select("at", "pos", "dissertacao_id", "m.*")
    later = lines.where(F.coalesce("verbete", F.lit("")) == "").select(
        (F.lit(1_000_000) + F.col("at") * 1_000 + F.col("pos")).cast("int").alias("ord"),
        F.concat(F.lit("ref:"), T.term_key(F.col("termo"))).alias("id"),
        "eixo",
        F.concat(F.array("termo"), F.coalesce("sinonimos", F.array().cast("array<string>"))).alias("formas"),
    )
    known = VO.vocabulary(VO.entry_forms(base).unionByName(later))
    found = VO.recognized(lines.select("dissertacao_id", "termo", "pos", F.col("eixo").alias("own"), F.coalesce("explicito", F.lit(True)).alias("mandatory")), known, "dissertacao_id")
    # of the lines of one kind, the first has the axis
    kind = found.groupBy("dissertacao_id", "id", "mandatory").agg(F.min_by(F.coalesce("eixo", "own"), "pos").alias("eixo"))
    terms = kind.groupBy("dissertacao_id", "id").agg(F.max_by("eixo", "mandatory").alias("eixo"), F.max("mandatory").alias("mandatory"))
    return known, refs.select("dissertacao_id", "tematica_1", "tematica_2"), terms


def reference_of_text(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``dissertacao_id, id, eixo, mandatory`` from free text (``dissertacao_id, metodologias``): all of it is mandatory."""
    terms = rows.select("dissertacao_id", F.posexplode(VO.split_terms(F.col("metodologias"), keys)).alias("at", "termo"))
    terms = terms.where(T.term_key(F.col("termo")) != "naoinformadonoresumo")
    named = VO.linked(terms.select("dissertacao_id", "termo"), known, "dissertacao_id")
    rows = terms.join(named, ["dissertacao_id", "termo"])
    return rows.groupBy("dissertacao_id", "id").agg(F.min_by("eixo", "at").alias("eixo"), F.lit(True).alias("mandatory"))


def write_index(texts: DataFrame, path: str, model: str, encoder: Callable | None = None) -> None:
    """Vectors of ``key, text`` with the model they were made by."""
    texts.select("key", "text", R.embedded(F.col("text"), "passage", encoder).alias("embedding"), F.lit(model).alias("model")).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str, model: str) -> DataFrame:
    """An index; one of another model is refused."""
    index = spark.read.parquet(path)
    if other := index.where(~F.col("model").eqNullSafe(model)).select("model").first():
        raise ValueError(f"the index was made by {other['model']!r}, not by {model!r}")
    return index


def fresh_vectors(texts: DataFrame, index: DataFrame | None, encoder: Callable | None = None) -> DataFrame:
    """``key, text, embedding``: stored where the stored text is the current one, made anew elsewhere."""
    if index is None:
        return texts.select("key", "text", R.embedded(F.col("text"), "passage", encoder).alias("embedding"))
    stored = texts.join(index.select("key", "text", "embedding"), ["key", "text"])
    stale = texts.join(index.select("key", "text"), ["key", "text"], "left_anti")
    return stored.unionByName(stale.select("key", "text", R.embedded(F.col("text"), "passage", encoder).alias("embedding")))
