"""Sentences: cut after every sentence end, then rejoined where the cut was wrong.  Nothing of a text is lost."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions.batches import joined, parts

# Abbreviations after which a sentence goes on.
ABBREVIATIONS = (
    "et al.", "cf.", "Prof.", "Profa.", "Dr.", "Dra.", "Sr.", "Sra.", "p.", "pp.", "n.", "v.", "vol.", "ed.", "org.", "orgs.",
    "coord.", "i.e.", "e.g.", "ex.", "art.", "aprox.",
)
#: Where a sentence may end: an end mark, what closes after it, white space.
CUT = re.compile(r"(?<=[.!?…])[”’»\"')\]]*\s+")
#: What no sentence begins with.
CONTINUES = frozenset("(),;:”’»")


def abbreviated(text: str, start: int, end: int) -> bool:
    """Whether an abbreviation, as a word of its own, ends ``text[start:end]``."""
    for word in ABBREVIATIONS:
        at = end - len(word)
        if at >= start and text.startswith(word, at) and (at == start or text[at - 1] in " ("):
            return True
    return False


def split(text: str | None) -> list[str]:
    """The sentences of a text; each is a slice of it.

    One pass over the possible ends.  An end holds unless an abbreviation stands before it, or what follows continues: a
    small letter, a mark of ``CONTINUES``, or a quotation mark that closes what the sentence has opened.
    """
    text = text or ""
    start = counted = len(text) - len(text.lstrip())
    found, quotes = [], 0
    for cut in CUT.finditer(text):
        after = cut.end()
        if after == len(text):
            break
        end = after - len(cut[0]) + len(cut[0].rstrip())
        quotes += text.count('"', counted, after)
        counted = after
        closing = quotes % 2 == 1 and '"' in (text[after], text[end - 1])
        if not (closing or text[after].islower() or text[after] in CONTINUES or abbreviated(text, start, end)):
            found.append(text[start:end])
            start, quotes = after, 0
    rest = text[start:].strip()
    return [*found, rest] if rest else found


def sentences(text: Column) -> Column:
    """The sentences of a column of texts, by the full rules."""

    @F.arrow_udf("array<string>")
    def of(texts: pa.Array) -> pa.Array:
        return found(texts)

    return of(text)


def found(texts: pa.Array) -> pa.Array:
    """The sentences of each text."""
    kind = pa.list_(pa.string())
    return joined([pa.array([split(t) for t in part], kind) for part in parts(texts)], kind)


def plain_sentences(text: Column) -> Column:
    """Built-in and cruder: a cut after each run of end marks, no rejoining."""
    pieces = F.regexp_extract_all(text, F.lit("[^.!?]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(pieces, lambda p: F.trim(p, F.lit(" \n\t\r"))), lambda p: p != "")


def numbered(docs: DataFrame, key: str, text: str, split_with=sentences) -> DataFrame:
    """``key, pos, frase_id, texto``: one row a sentence, numbered from F1 in each document."""
    rows = docs.select(key, F.posexplode(split_with(F.col(text))).alias("at", "texto"))
    return rows.select(key, (F.col("at") + 1).alias("pos"), F.concat(F.lit("F"), (F.col("at") + 1).cast("string")).alias("frase_id"), "texto")


def gathered(sentence_rows: DataFrame, key: str) -> DataFrame:
    """``key, frases``: the sentences of a document as one ordered array."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.col("frase_id").alias("id"), "texto")))
    return sentence_rows.groupBy(key).agg(ordered.alias("frases")).select(key, F.transform("frases", lambda f: F.struct(f["id"].alias("id"), f["texto"].alias("texto"))).alias("frases"))
