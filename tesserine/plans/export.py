"""Results as tables for people: answers, details, the run; reports as JSON, Markdown and, where a writer is installed, XLSX."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators import validation as V

# Fixed values
ANSWER_COLUMNS = ("id", "titulo", "tematica_1", "tematica_2", "metodologias", "modelo")
DETAIL_COLUMNS = ("id", "evidencia_tematica_1", "evidencia_tematica_2", "evidencia_metodologias", "status", "tecnica", "versao_prompt")
MISSING_SENTENCE = "(frase não encontrada no resumo)"
NO_ANSWER = "sem resposta"


def cited(evidence: Column, sentences: Column) -> Column:
    """Cited sentences, each once, in the document's order; ``sentences`` maps ids to texts."""
    line = lambda i: F.concat(i, F.lit(": "), F.coalesce(F.try_element_at(sentences, i), F.lit(MISSING_SENTENCE)))
    return F.array_join(F.transform(T.shown_ids(evidence), line), "\n")


def cited_by_methods(methods: Column, sentences: Column) -> Column:
    """Methods with their codes, and below them each cited sentence once."""
    backed = F.filter(methods, lambda m: F.size(m["evidencia"]) > 0)
    heads = F.transform(backed, lambda m: F.concat(m["texto"], F.lit(" ["), F.array_join(m["evidencia"], ", "), F.lit("]")))
    body = cited(F.flatten(F.transform(backed, lambda m: m["evidencia"])), sentences)
    return F.when(F.size(backed) > 0, F.concat(F.array_join(heads, "; "), F.lit("\n\n"), body)).otherwise("")


def status_text(theme_1: Column, theme_2: Column, methods: Column) -> Column:
    """``ok``, or field by field what isn't."""
    theme = lambda f, name: F.when(f["status"] != V.OK, F.concat(F.lit(f"{name}: "), f["status"]))
    method = F.transform(methods, lambda m: F.when(m["status"] == V.SILENT, F.lit("metodologias: nao_informado")).when(
        m["status"] != V.OK, F.concat(F.lit("metodologia '"), m["texto"], F.lit("': "), m["status"])))
    told = F.array_join(F.array_compact(F.concat(F.array(theme(theme_1, "tematica_1"), theme(theme_2, "tematica_2")), method)), "; ")
    all_failed = (theme_1["status"] == V.ERROR) & (theme_2["status"] == V.ERROR) & F.forall(methods, lambda m: m["status"] == V.ERROR)
    return F.when(all_failed, V.ERROR).when(told == "", V.OK).otherwise(told)


def sheets(docs: DataFrame, answers: DataFrame, sentences: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Answers and details, a row a document; one without an answer has empty cells."""
    texts = sentences.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("frase_id", "texto"))).alias("__s"))
    rows = docs.select(key, "titulo").join(answers, key, "left").join(texts, key, "left")
    empty = lambda c: F.coalesce(c, F.lit(""))
    first = rows.select(F.col(key).alias("id"), "titulo", empty(F.col("tematica_1.texto")).alias("tematica_1"), empty(F.col("tematica_2.texto")).alias("tematica_2"), empty(T.joined_methods(F.col("metodologias"))).alias("metodologias"), empty(F.col("modelo")).alias("modelo"))
    status = F.when(F.col("modelo").isNull(), NO_ANSWER).otherwise(status_text(F.col("tematica_1"), F.col("tematica_2"), F.col("metodologias")))
    evidence = [empty(cited(F.col(f"{t}.evidencia"), F.col("__s"))).alias(f"evidencia_{t}") for t in ("tematica_1", "tematica_2")]
    second = rows.select(F.col(key).alias("id"), *evidence, empty(cited_by_methods(F.col("metodologias"), F.col("__s"))).alias("evidencia_metodologias"), status.alias("status"), empty(F.col("tecnica")).alias("tecnica"), empty(F.col("versao_prompt")).alias("versao_prompt"))
    return first, second


def write_run(docs: DataFrame, answers: DataFrame, facts: DataFrame, folder: str, key: str = "id") -> None:
    """A run's files as people and ``sources.runs`` read them: ``respostas.json`` in the corpus's order, and ``execucao.json``.

    Both are written on the driver's disk line by line, as rows arrive; a run of many documents is read as Parquet instead.
    """
    rows = docs.select(key, "pos").join(answers, key).orderBy("pos").select(F.col(key).alias("dissertacao_id"), "tematica_1", "tematica_2", "metodologias", "modelo", "versao_prompt", "tecnica", "saida_bruta", "segundos", "tentativas")
    Path(folder).mkdir(parents=True, exist_ok=True)
    told: dict[str, Any] = {**{r["campo"]: r["valor"] for r in facts.collect()}, "segundos": {}, "tentativas": {}}
    with open(f"{folder}/respostas.json", "w", encoding="utf-8") as out:
        out.write("[")
        for i, row in enumerate(rows.toLocalIterator()):
            answer = row.asDict(recursive=True)
            for name in ("segundos", "tentativas"):
                told[name][answer["dissertacao_id"]] = answer.pop(name)
            out.write((",\n" if i else "\n") + json.dumps(answer, ensure_ascii=False))
        out.write("\n]\n")
    Path(f"{folder}/execucao.json").write_text(json.dumps(told, ensure_ascii=False, indent=2), encoding="utf-8")


def run_sheet(facts: DataFrame, answers: DataFrame) -> DataFrame:
    """``campo, valor``: provenance, and what the answers' times and attempts come to."""
    sums = answers.agg(F.avg("segundos").alias("mean"), F.sum("segundos").alias("total"), F.count_if(F.col("tentativas") > 1).alias("again"), F.count("segundos").alias("n")).where("n > 0")
    line = lambda name, value: F.struct(F.lit(name).alias("campo"), value.alias("valor"))
    rows = sums.select(F.inline(F.array(
        line("tempo_medio_por_dissertacao_s", F.format_string("%.1f", "mean")),
        line("tempo_total_de_geracao_s", F.format_string("%.0f", "total")),
        line("dissertacoes_que_precisaram_de_2a_tentativa", F.col("again").cast("string")),
    )))
    return facts.unionByName(rows)


def flattened(value: Any, prefix: str = "") -> Iterator[tuple[str, Any]]:
    """Dotted keys and leaves of nested dicts."""
    if isinstance(value, dict) and value:
        for name, inner in value.items():
            yield from flattened(inner, f"{prefix}.{name}" if prefix else str(name))
    else:
        yield prefix, value


def flat_columns(df: DataFrame) -> DataFrame:
    """Structs as dotted columns, to any depth."""
    from pyspark.sql.types import StructType

    def leaves(schema: StructType, path: str = "") -> Iterator[str]:
        for f in schema.fields:
            at = f"{path}.`{f.name}`" if path else f"`{f.name}`"
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, at)
            else:
                yield at

    return df.select(*(F.col(p).alias(p.replace("`", "")) for p in leaves(df.schema)))


def markdown(rows: list[dict[str, Any]]) -> str:
    """A table of all keys in order of appearance; numbers with three digits, null as nothing."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [names, ["---"] * len(names), *([cell(r.get(n)) for n in names] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def write_reports(reports: DataFrame, out: str, run: str = "execucao") -> None:
    """One folder of JSON a run."""
    reports.write.mode("overwrite").partitionBy(run).json(out)


def write_sheets(named: dict[str, DataFrame], out: str) -> None:
    """CSV, a folder a sheet; one file each, as people read them, and a run's documents are few."""
    for name, df in named.items():
        df.coalesce(1).write.mode("overwrite").csv(f"{out}/{name}", header=True, quoteAll=True, escape='"')


def write_workbook(named: dict[str, DataFrame], path: str, charts: dict[str, list[str]] | None = None) -> None:
    """An XLSX workbook on the driver's disk, with bar charts of the named columns, where openpyxl is installed."""
    try:
        from openpyxl import Workbook
        from openpyxl.chart import BarChart, Reference
    except ImportError as e:
        raise RuntimeError("workbooks need openpyxl; write_sheets gives the same as CSV") from e
    book = Workbook()
    book.remove(book.active)
    for name, df in named.items():
        sheet = book.create_sheet(name)
        sheet.append(df.columns)
        for row in df.toLocalIterator():
            sheet.append([v if isinstance(v, (int, float, str, bool, type(None))) else str(v) for v in row])
        sheet.freeze_panes = "B2"
        for i, column in enumerate((charts or {}).get(name, [])):
            chart = BarChart()
            chart.title, at = column, df.columns.index(column) + 1
            chart.add_data(Reference(sheet, min_col=at, min_row=1, max_row=sheet.max_row), titles_from_data=True)
            chart.set_categories(Reference(sheet, min_col=1, min_row=2, max_row=sheet.max_row))
            sheet.add_chart(chart, f"H{2 + 16 * i}")
    book.save(path)
