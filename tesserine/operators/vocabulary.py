"""Terms linked to a vocabulary: by the key of one of their forms, else by the entries whose words they hold."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Collection, Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators.spreading import spread, tasks_for

FREE = "livre:"


def vocabulary(entries: DataFrame) -> DataFrame:
    """``key, ord, id, eixo, words`` of every form of every entry (``ord, id, eixo, formas``), the first of a key winning.

    A form with parentheses also counts without them.  Entries added later get larger ``ord``, so they never take a key.
    The result's ``ord`` is a struct (of the entry's, the form's and the cut's place), so that any number of each sorts right.
    """
    forms = entries.select("ord", "id", "eixo", F.posexplode("formas").alias("at", "forma"))
    both = forms.select("ord", "id", "eixo", "at", F.posexplode(F.array("forma", T.without_parentheses(F.col("forma")))).alias("cut", "forma"))
    keyed = both.select(T.term_key(F.col("forma")).alias("key"), "ord", "id", "eixo", "at", "cut", T.term_words(F.col("forma")).alias("words")).where("key <> ''")
    first = Window.partitionBy("key").orderBy("ord", "at", "cut")
    place = keyed.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    return place.select("key", F.struct("ord", "at", "cut").alias("ord"), "id", "eixo", "words")


def entry_forms(base: DataFrame) -> DataFrame:
    """A knowledge base (``ord, id, eixo, termo, sinonimos``) as entries of a vocabulary."""
    return base.select("ord", "id", "eixo", F.concat(F.array("termo"), "sinonimos").alias("formas"))


def recognized(terms: DataFrame, known: DataFrame, key: str, term: str = "termo") -> DataFrame:
    """``terms`` with ``id`` and ``eixo``: of the first form found in the vocabulary; else ``livre:`` and the last form's key."""
    forms = terms.select(key, term).distinct().select(key, term, F.posexplode(T.term_forms(F.col(term))).alias("at", "forma"))
    keyed = forms.select(key, term, "at", T.term_key(F.col("forma")).alias("__form"))
    found = keyed.join(known.select(F.col("key").alias("__form"), "id", "eixo"), "__form", "left")
    best = found.groupBy(key, term).agg(F.min_by(F.when(F.col("id").isNotNull(), F.struct("id", "eixo")), F.when(F.col("id").isNotNull(), F.col("at"))).alias("hit"), F.max_by("__form", "at").alias("last"))
    named = best.select(key, term, F.coalesce("hit.id", F.concat(F.lit(FREE), "last")).alias("id"), F.col("hit.eixo").alias("eixo"))
    return terms.join(named, [key, term])


def contained(terms: DataFrame, known: DataFrame, key: str, term: str = "termo") -> DataFrame:
    """``key, term, id, eixo``: entries all of whose words a term holds, unless another entry's form holds more of them.

    Candidates share a word: forms and terms meet on their rarest-in-the-vocabulary word, not pair by pair.
    """
    words = known.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    spelled = known.where(F.size("words") > 0).select("ord", "id", "eixo", "words", F.explode("words").alias("w")).join(words, "w")
    anchored = spelled.groupBy("ord", "id", "eixo", "words").agg(F.min_by("w", F.struct("n", "w")).alias("w"))
    asked = terms.select(key, term).distinct().withColumn("all", T.term_words(F.col(term)))
    met = asked.select(key, term, "all", F.explode("all").alias("w")).join(anchored, "w").where(F.size(F.array_except("words", "all")) == 0)
    # the longest form of each entry; among equals the first
    longest = met.groupBy(key, term, "id").agg(F.min_by(F.struct("words", "eixo"), F.struct(-F.size("words"), "ord")).alias("best")).select(key, term, "id", F.col("best.words").alias("words"), F.col("best.eixo").alias("eixo"))
    other = longest.select(key, term, F.col("id").alias("__id"), F.col("words").alias("__w"))
    inside = (F.size("__w") > F.size("words")) & (F.size(F.array_except("words", "__w")) == 0) & (F.col("id") != F.col("__id"))
    return longest.join(other, (longest[key] == other[key]) & (longest[term] == other[term]) & inside, "left_anti").select(key, term, "id", "eixo")


def linked(terms: DataFrame, known: DataFrame, key: str, term: str = "termo") -> DataFrame:
    """``key, term, id, eixo``: recognised, else contained, else free; one row an entry."""
    direct = recognized(terms.select(key, term).distinct(), known, key, term)
    sure, free = direct.where(~F.col("id").startswith(FREE)), direct.where(F.col("id").startswith(FREE))
    inside = contained(free.select(key, term), known, key, term)
    rest = free.join(inside.select(key, term).distinct(), [key, term], "left_anti")
    return sure.select(key, term, "id", "eixo").unionByName(inside).unionByName(rest.select(key, term, "id", "eixo"))


# Splitting a text into terms reads from left to right and looks composed strings up, so it is an Arrow function ----------
# What stands between terms, words that begin no term, and the word that short names of methods leave out.
SEPARATOR = re.compile(r"(\s*;\s*|\s*,\s*|\s+e\s+)")
QUALIFYING = re.compile("(?:" + "|".join(T.QUALIFIERS) + r")\b", re.IGNORECASE)
PREPOSITION = re.compile(r"(?:de|da|do|das|dos|para)\s", re.IGNORECASE)
PREFIX = "Pesquisa"
CUTS = [re.compile(pattern, 0 if case else re.IGNORECASE) for pattern, case in T.FORM_CUTS]


def key_of(text: str) -> str:
    """``term_key`` of one string."""

    def one(word: str) -> str:
        ends = ((end, new) for end, new in (*T.PLURALS, ("s", "")) if len(word) > 3 and word.endswith(end))
        end, new = next(ends, ("", ""))
        return word.removesuffix(end) + new

    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return "".join(map(one, re.findall("[a-z0-9]+", plain)))


def forms_of(term: str) -> Iterator[str]:
    """``term_forms`` of one string."""
    yield term
    for cut in CUTS:
        term = cut.sub("", term).strip(" ,.;") or term
        yield term


class Reading(NamedTuple):
    """A way to read a piece of text: as which term, in place of the term before it or after it, and whether only if known."""

    text: str
    in_place: bool = False
    if_known: bool = False


def readings(piece: str, mark: str, before: str | None) -> Iterator[Reading]:
    """The readings of a piece that follows a term, in the order of their trial; the first that holds is taken."""
    if before is not None:
        yield Reading(piece, if_known=True)
        yield Reading(f"{before.split()[0]} {piece}", if_known=True)
        if PREPOSITION.match(piece):
            yield Reading(before + mark + piece, in_place=True)
        if " " not in piece:
            yield Reading(f"{PREFIX} {piece}", if_known=True)
    yield Reading(piece)


def terms_of(text: str, keys: Collection[str]) -> list[str]:
    """Terms of a text about methods: its pieces, each in the first reading that holds given the terms before it."""
    known = lru_cache(maxsize=None)(lambda term: any(key_of(form) in keys for form in forms_of(term)))
    parts = ["", *SEPARATOR.split(text.strip())]

    def read(terms: list[str], part: tuple[str, str]) -> list[str]:
        mark, piece = part[0], part[1].strip(" .")
        if piece and not QUALIFYING.match(piece):
            taken = next(r for r in readings(piece, mark, terms[-1] if terms else None) if not r.if_known or known(r.text))
            terms[len(terms) - taken.in_place :] = [taken.text]
        return terms

    return reduce(read, zip(parts[::2], parts[1::2], strict=True), [])


def split_terms(text: Column, keys: Collection[str]) -> Column:
    """Terms of a column of texts; ``keys`` are those of a vocabulary, which is small enough to send along."""
    sent = frozenset(keys)

    @F.pandas_udf("array<string>")
    def terms(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else terms_of(t, sent))

    return terms(text)


def methods_of_answers(fields: DataFrame, known: DataFrame, keys: Collection[str], by: list[str], n: int | None = None) -> DataFrame:
    """``by..., id, eixo``: the entries that an answer's method fields name (``by..., pos, texto, status``), each once.

    Fields that failed or say that nothing was informed name none.  Where an entry has several axes, the first one stays.
    A term is linked once, whoever says it.  Results come by ``by`` in ``n`` tasks, as many as the fields ask for without it.
    """
    n = n or tasks_for(fields)
    told = fields.where(~T.marked_empty(F.coalesce("texto", F.lit("")), F.col("status")) & (F.coalesce("status", F.lit("")) != "erro"))
    terms = told.select(*by, "pos", F.posexplode(split_terms(F.coalesce("texto", F.lit("")), keys)).alias("at", "termo"))
    named = linked(terms.select(F.col("termo").alias("__k"), "termo").distinct(), known, "__k").select("termo", "id", "eixo")
    # every term has an entry; a left join leaves the many rows of all answers where they are
    rows = spread(terms.join(named, "termo", "left"), *by, n=n)
    return rows.groupBy(*by, "id").agg(F.min_by("eixo", F.struct("pos", "at")).alias("eixo")).select(*by, "id", "eixo")
