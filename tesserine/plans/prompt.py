"""Prompts as columns, from a document and its context."""

from __future__ import annotations

import re
from importlib.resources import files
from string import Template

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserine.functions import text as T

# Fixed values
ALL_SENTENCES = "FRASES DO RESUMO"
THEME_SENTENCES = "FRASES DO RESUMO QUE FALAM DO TEMA"
METHOD_SENTENCES = "FRASES DO RESUMO QUE FALAM DO MÉTODO"
ENTRIES = "VERBETES DE REFERÊNCIA (ajudam a nomear o método; não são lista fechada)"
TITLES = "TÍTULOS DE OUTRAS DISSERTAÇÕES PARECIDAS (só para manter os nomes dos temas consistentes; não são esta dissertação)"
NO_KEYWORDS = "(não informadas)"
AXIS_LABELS = {"analise": "análise"}
PLACEHOLDERS = ("titulo", "palavras_chave", "frases", "verbetes", "titulos")


def template(version: str) -> str:
    """The text of a prompt version; its placeholders are written ``${name}``."""
    folder = files("tesserine.plans") / "prompts"
    found = {p.name.removesuffix(".txt"): p for p in folder.iterdir() if p.name.endswith(".txt")}
    if version not in found:
        raise ValueError(f"no prompt version {version!r}; there are {', '.join(sorted(found))}")
    return found[version].read_text(encoding="utf-8")


def sentence_block(title: str, sentences: Column) -> Column:
    """Sentences in the document's order, whatever their scores."""
    in_order = F.array_sort(sentences, lambda a, b: T.position_of(a["frase_id"]) - T.position_of(b["frase_id"]))
    lines = F.transform(in_order, lambda s: F.concat(F.lit("["), s["frase_id"], F.lit("] "), s["texto"]))
    return F.concat(F.lit(title + "\n"), F.array_join(lines, "\n"), F.lit("\n"))


def sentence_blocks(theme: Column, method: Column) -> Column:
    """One block where both searches found the same sentences, else two."""
    ids = lambda s: F.array_sort(F.array_distinct(F.transform(s, lambda x: x["frase_id"])))
    two = F.concat(sentence_block(THEME_SENTENCES, theme), F.lit("\n"), sentence_block(METHOD_SENTENCES, method))
    return F.when(ids(theme) == ids(method), sentence_block(ALL_SENTENCES, theme)).otherwise(two)


def axis_label(axis: Column) -> Column:
    out = axis
    for name, label in AXIS_LABELS.items():
        out = F.when(axis == name, label).otherwise(out)
    return out


def listed(title: str, lines: Column) -> Column:
    """A titled list, or nothing where there are no lines."""
    body = F.concat(F.lit(f"\n{title}\n"), F.array_join(F.transform(lines, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n"))
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, body).otherwise("")


def entry_block(entries: Column) -> Column:
    """Entries (``termo, eixo, definicao``) offered to the model."""
    return listed(ENTRIES, F.transform(entries, lambda v: F.concat(v["termo"], F.lit(" ("), axis_label(v["eixo"]), F.lit("): "), v["definicao"])))


def title_block(titles: Column) -> Column:
    return listed(TITLES, titles)


def prompt(text: str, title: Column, keywords: Column, sentences: Column, entries: Column, titles: Column) -> Column:
    """A template filled in; three or more line ends in a row become two."""
    words = F.array_join(keywords, "; ")
    values = dict(zip(PLACEHOLDERS, (title, F.when(words == "", NO_KEYWORDS).otherwise(words), sentences, entries, titles), strict=True))
    parts, at = [], 0
    for m in Template.pattern.finditer(text):
        name = m["named"] or m["braced"]
        parts.append(F.lit(text[at : m.start()]))
        if m["escaped"] is not None:
            parts.append(F.lit("$"))
        elif name in values:
            parts.append(F.coalesce(values[name], F.lit("")))
        else:
            raise ValueError(f"the template names {m.group()!r}, which is none of {', '.join(PLACEHOLDERS)}")
        at = m.end()
    return F.regexp_replace(F.concat(*parts, F.lit(text[at:])), "\n{3,}", "\n\n")


def placeholders(text: str) -> set[str]:
    return set(re.findall(r"\$\{(\w+)\}", text))
