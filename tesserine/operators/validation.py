"""Evidence checked against the sentences a model was shown; statuses are computed, never taken from the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions import text as T

# Fixed values
OK, NO_EVIDENCE, SILENT, ERROR = "ok", "sem_evidencia", "nao_informado", "erro"
FIELD = "struct<texto:string,evidencia:array<string>,status:string>"


def field(text: Column, evidence: Column, status: Column) -> Column:
    return F.struct(text.alias("texto"), evidence.alias("evidencia"), status.alias("status")).cast(FIELD)


def valid_ids(evidence: Column, valid: Column) -> Column:
    """Cited codes that exist, in order, each once."""
    return F.array_distinct(F.filter(F.transform(evidence, T.sentence_id), lambda i: F.array_contains(valid, i)))


def checked(f: Column, valid: Column) -> Column:
    """One field after the check: a failed one as it is; silence without evidence; else the evidence that holds."""
    text, none = F.trim(f["texto"]), F.array().cast("array<string>")
    ids = valid_ids(f["evidencia"], valid)
    found = field(text, ids, F.when(F.size(ids) > 0, OK).otherwise(NO_EVIDENCE))
    silent = field(F.lit(T.NOT_INFORMED), none, F.lit(SILENT))
    return F.when(f["status"] == ERROR, f.cast(FIELD)).when(T.says_nothing(text), silent).otherwise(found)


def checked_theme(f: Column, valid: Column) -> Column:
    """A theme that is empty or says that nothing was informed is an error."""
    text = F.trim(f["texto"])
    bad = (F.coalesce(f["status"], F.lit("")) != ERROR) & ((text == "") | T.says_nothing(text))
    return F.when(bad, field(text, F.array().cast("array<string>"), F.lit(ERROR))).otherwise(checked(f, valid))


def checked_methods(fields: DataFrame, by: list[str]) -> DataFrame:
    """``by..., pos, texto, evidencia, status`` after check and merge, from rows that also bear ``valid array<string>``.

    If a field failed, an answer's fields stay as they are.  Empty fields go; fields of one key merge into the first, which
    takes over the others' evidence; silence stays only where it stands alone, and an answer left without fields gets it.
    """
    failed = fields.groupBy(*by).agg(F.max((F.col("status") == ERROR).cast("int")).alias("__failed"))
    rows = fields.join(failed, by).withColumn("__f", F.struct("texto", "evidencia", "status"))
    kept = rows.where("__failed = 1").select(*by, "pos", "texto", "evidencia", "status")
    seen = rows.where("coalesce(__failed, 0) = 0").select(*by, "pos", checked(F.col("__f"), F.col("valid")).alias("f"))
    keyed = seen.select(*by, "pos", "f", T.comparison_key(F.col("f.texto")).alias("__k")).where("f.texto <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "f")))
    merged = keyed.groupBy(*by, "__k").agg(ordered.alias("g")).select(
        *by, F.element_at("g", 1)["pos"].alias("pos"), F.element_at("g", 1)["f"].alias("first"),
        F.array_distinct(F.flatten(F.transform("g", lambda x: x["f"]["evidencia"]))).alias("evidencia"),
    )
    status = F.when((F.col("first.status") == NO_EVIDENCE) & (F.size("evidencia") > 0), OK).otherwise(F.col("first.status"))
    merged = merged.select(*by, "pos", F.col("first.texto").alias("texto"), "evidencia", status.alias("status"))
    told = merged.where(F.col("status") != SILENT)
    silent = fields.select(*by).distinct().join(told.unionByName(kept).select(*by).distinct(), by, "left_anti")
    alone = silent.select(*by, F.lit(1).alias("pos"), F.lit(T.NOT_INFORMED).alias("texto"), F.array().cast("array<string>").alias("evidencia"), F.lit(SILENT).alias("status"))
    return kept.unionByName(told).unionByName(alone)


def shown_and_real(sentences: Column, shown: Column | None) -> Column:
    """Ids that evidence may cite: the document's own that the model was shown; all of its own, if that isn't known."""
    own = F.transform(sentences, lambda s: s["id"])
    return own if shown is None else F.when(shown.isNull(), own).otherwise(F.array_intersect(own, shown))


def overall_status(statuses: Column) -> Column:
    """A run's log: error before missing evidence before all else."""
    return F.when(F.array_contains(statuses, ERROR), ERROR).when(F.array_contains(statuses, NO_EVIDENCE), NO_EVIDENCE).otherwise(OK)


def worst_status(statuses: Column) -> Column:
    """A document's status in an evaluation: error, missing evidence, silence, ok, in this order."""
    return F.when(F.array_contains(statuses, ERROR), ERROR).when(F.array_contains(statuses, NO_EVIDENCE), NO_EVIDENCE).when(F.array_contains(statuses, SILENT), SILENT).otherwise(OK)
