"""Text functions as columns.  One Arrow function (Unicode normal forms of short texts); the rest is built in.

Patterns spell their classes out, so that they mean the same in Java, Python and RE2.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ----------------------------------------------------------------------------------------------------------
#: White space in the sense of Unicode.
SPACES = r"\x09-\x0D\x1C-\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
LETTER = r"\p{L}\p{Nl}\p{No}"
#: Windows-1252 in place of the control characters 80-9F; what it leaves undefined, and soft hyphens, go.
CP1252_FROM = "".join(chr(c) for c in range(0x80, 0xA0) if c not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))
CP1252_TO = bytes(map(ord, CP1252_FROM)).decode("cp1252")
CP1252_DROP = "\x81\x8d\x8f\x90\x9d­"
#: Words that retrieval ignores.
RETRIEVAL_STOP_WORDS = (
    "a o as os de da do das dos e em no na nos nas um uma uns umas que com por para pelo pela pelos pelas se ao aos como mais "
    "foi foram ser sua seu suas seus este esta esse essa isso entre sobre sao tem ter ou"
).split()
#: Words that carry no meaning in a term.
TERM_STOP_WORDS = (
    "de da do das dos e em com por para a o as os um uma no na nos nas ao aos meio atraves sobre entre que seu sua"
).split()
#: Expressions that qualify the term before them.
QUALIFIERS = ("proposta por", "proposto por", "segundo", "conforme", "de acordo com", "baseada em", "baseado em", "com base em", "na perspectiva de")
FILLERS = ("de natureza", "de cunho", "de car[áa]ter", "d[eo] tipo", "com abordagem")
#: Patterns of what a term is cut by, one after the other, to find the form that a vocabulary knows; whether case counts.
FORM_CUTS = (
    (r"\s*\([^)]*\)", True),
    (r"\s*,?\s+(?:" + "|".join(QUALIFIERS) + r")\b.*$", False),
    (r"\s+(?:de|da|do)\s+[A-ZÀ-Ý][\w-]*(?:\s+[A-ZÀ-Ý][\w-]*)*\s*$", True),
    (r"\s+(?:" + "|".join(FILLERS) + r")\s+", False),
)
PLURALS = (("oes", "ao"), ("aes", "ao"), ("ais", "al"), ("eis", "el"))
LEFTOVER_KEYWORDS = r"(?is)[\s\xA0]*\bpalavras?[- ]chaves?\s*:.*$"
CLOSERS = "”’»\"')\\]"
SENTENCE_END = rf"[.!?…][{CLOSERS}]*$"
MISPLACED = r"(?i)\b(palavras?[- ]chaves?|abstract|keywords?)\b|\bresumo\s*:"
NOT_INFORMED = "Não informado no resumo"
STEM = 6


#: The method of the ICU library, which Spark brings along, that gives a form.
ICU_FORMS = {"NFC": "compose", "NFD": "decompose"}


def unicode_form(text: Column, form: str) -> Column:
    """Unicode normal form; ASCII texts pass through."""

    @F.pandas_udf("string")
    def normal(values: pd.Series) -> pd.Series:
        return values.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return normal(text)


def sparing_form(text: Column, form: str) -> Column:
    """Unicode normal form, NFD without combining marks, without Python; ASCII texts pass through.

    It names ``text`` several times, so it is for columns, not for long expressions.
    """
    done = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit(ICU_FORMS[form]), text, F.lit(False))
    if form == "NFD":
        done = F.regexp_replace(done, r"\p{Mn}+", "")
    return F.when(F.octet_length(text) == F.char_length(text), text).when(text.isNotNull(), done)


def normalized(text: Column) -> Column:
    """NFC; Windows characters repaired; words cut by a hyphen at a line's end rejoined; white space single and trimmed."""
    text = F.translate(sparing_form(text, "NFC"), CP1252_FROM + CP1252_DROP, CP1252_TO)
    text = F.regexp_replace(text, rf"([{LETTER}])-[ \t]*\r?\n[ \t]*([{LETTER}])", "$1$2")
    return F.trim(F.regexp_replace(text, f"[{SPACES}]+", " "))


def without_leftovers(text: Column) -> Column:
    """A normalised abstract without the list of keywords that was copied along with it."""
    return F.trim(F.regexp_replace(normalized(text), LEFTOVER_KEYWORDS, ""))


def keyword_list(text: Column) -> Column:
    """Keywords separated by commas or semicolons, cleaned, without empty ones; case is kept."""
    return F.filter(F.transform(F.split(normalized(text), "[,;]"), lambda k: F.trim(k)), lambda k: k != "")


def without_marks(text: Column) -> Column:
    """Lower case, without combining marks."""
    return F.regexp_replace(unicode_form(F.lower(text), "NFD"), r"\p{Mn}+", "")


def retrieval_tokens(text: Column) -> Column:
    """Words of at least three letters, accents folded, stop words dropped, cut to six letters."""
    # stop words are shorter than a stem, so none is the beginning of a word that was cut
    stems = F.regexp_extract_all(sparing_form(F.lower(text), "NFD"), F.lit(f"([a-z]{{3,{STEM}}}+)[a-z]*+"), F.lit(1))
    return F.filter(stems, lambda w: ~w.isin(*RETRIEVAL_STOP_WORDS))


def expression(text: Column) -> Column:
    """All words, accents folded, cut to six letters, one space apart: the form in which expressions are looked for."""
    stems = F.regexp_extract_all(sparing_form(F.lower(text), "NFD"), F.lit(f"([a-z0-9]{{1,{STEM}}}+)[a-z0-9]*+"), F.lit(1))
    return F.array_join(stems, " ")


def contains_expression(text: Column, wanted: Column) -> Column:
    """Whether the words of ``wanted`` stand in ``text``, in order and side by side; both as ``expression`` gives them."""
    space = F.lit(" ")
    return (wanted != "") & F.contains(F.concat(space, text, space), F.concat(space, wanted, space))


def singular(word: Column) -> Column:
    """Regular Portuguese plurals undone; words of up to three letters stay."""
    cut = F.when(word.endswith("s"), F.regexp_replace(word, "s$", "")).otherwise(word)
    for end, new in PLURALS:
        cut = F.when(word.endswith(end), F.regexp_replace(word, f"{end}$", new)).otherwise(cut)
    return F.when(F.length(word) <= 3, word).otherwise(cut)


def ascii_words(text: Column) -> Column:
    """Lower-case words of the compatibility form, other letters left out."""
    plain = F.regexp_replace(unicode_form(text, "NFKD"), r"[^\x00-\x7F]+", "")
    return F.regexp_extract_all(F.lower(plain), F.lit("[a-z0-9]+"), F.lit(0))


def term_key(text: Column) -> Column:
    """What two spellings of a term have in common: words in the singular, joined."""
    return F.array_join(F.transform(ascii_words(text), singular), "")


def term_words(text: Column) -> Column:
    """The distinct words that carry a term's meaning, in the singular, sorted."""
    kept = F.filter(ascii_words(text), lambda w: ~w.isin(*TERM_STOP_WORDS))
    return F.array_sort(F.array_distinct(F.transform(kept, singular)))


def without_parentheses(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s*\([^)]*\)", "")


def term_forms(term: Column) -> Column:
    """The forms in which a term is looked up, from the full one to the shortest."""
    cuts = [f"(?{'U' if case else 'Uiu'}){pattern}" for pattern, case in FORM_CUTS]

    def shortened(forms: Column, pattern: Column) -> Column:
        last = F.element_at(forms, -1)
        new = F.trim(F.regexp_replace(last, pattern, F.lit("")), F.lit(" ,.;"))
        return F.when((new != "") & (new != last), F.array_append(forms, new)).otherwise(forms)

    # a fold: written out, each cut would repeat the ones before it several times over
    return F.aggregate(F.array(*map(F.lit, cuts)), F.array(term), shortened)


def sentence_id(code: Column) -> Column:
    """``F2`` from "f 02", "[F2]", "F2." and the like; null where there is none."""
    digits = F.regexp_extract(code, r"[Ff]\s*0*(\d+)", 1)
    return F.when(digits != "", F.concat(F.lit("F"), digits))


def comparison_key(text: Column) -> Column:
    """Lower case, no marks, single spaces, no punctuation at the ends."""
    plain = F.regexp_replace(without_marks(text), f"[{SPACES}]+", " ")
    return F.trim(F.trim(plain), F.lit(" .;:,-"))


def says_nothing(text: Column) -> Column:
    """Whether a field's text is the model's "not informed", by its beginning."""
    return comparison_key(text).startswith("nao informad")


def marked_empty(text: Column, status: Column) -> Column:
    """Whether a stored field counts as not informed, by its status or its exact text."""
    return (F.coalesce(status, F.lit("")) == "nao_informado") | (term_key(text) == "naoinformadonoresumo")


def composite_key(document: Column, sentence: Column) -> Column:
    return F.concat_ws("#", document, sentence)


def entry_text(term: Column, synonyms: Column) -> Column:
    """What of a knowledge-base entry is embedded: its term and synonyms."""
    return F.array_join(F.concat(F.array(term), synonyms), "; ")


def positional_id(prefix: Column | str, position: Column, width: int = 3) -> Column:
    """Prefix and position, zero-padded; ``position`` starts at 1."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    digits = position.cast("string")
    return F.concat(prefix, F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def run_name(model: Column, technique: Column, version: Column, suffix: Column | None = None) -> Column:
    """The name of a run's folder: its parts joined by ``__``; characters that paths don't bear become hyphens."""
    parts = [F.translate(model, ":/", "--"), technique, version]
    return F.concat_ws("__", *parts, *([F.nullif(suffix, F.lit(""))] if suffix is not None else []))


def text_digest(text: Column) -> Column:
    """SHA-256 of a text whose line ends are newlines."""
    return F.sha2(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), 256)


def natural_key(text: Column) -> Column:
    """Sorts "v10" after "v2": numbers in a text are padded to 20 digits."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(\d+)", "00000000000000000000$1"), r"0*(\d{20})(?!\d)", "$1")


def joined_methods(fields: Column) -> Column:
    """Texts of method fields, empty ones left out."""
    return F.array_join(F.filter(F.transform(fields, lambda f: f["texto"]), lambda t: F.coalesce(t, F.lit("")) != ""), "; ")


#: Between the outputs of several attempts, and how a note of a failure begins.
ATTEMPT_MARK = "\n\n----- nova tentativa -----\n\n"
NOTE_STARTS = ("[falha:", "[não lida:")


def attempts(raw: Column, mark: str = ATTEMPT_MARK) -> Column:
    """How many outputs of the model a raw text holds."""
    parts = F.split(raw, F.lit(f"\\Q{mark}\\E"))
    return F.size(F.filter(parts, lambda p: (p != "") & ~p.startswith(NOTE_STARTS[0]) & ~p.startswith(NOTE_STARTS[1])))


def position_of(sentence: Column) -> Column:
    """The number in a sentence's id."""
    return F.substring(sentence, 2, 10).cast("int")


def shown_ids(ids: Column) -> Column:
    """Sentence ids in numerical order, each once."""
    return F.array_sort(F.array_distinct(ids), lambda a, b: position_of(a) - position_of(b))
