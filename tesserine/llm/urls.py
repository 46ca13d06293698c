"""URL filter: a weighted vocabulary counted by an Aho-Corasick automaton, under host rules that may overrule it.

A term counts where the characters beside it are neither a-z nor 0-9.  One strict term rejects a URL, and so do
``soft_needed`` different soft terms.  Null URLs and URLs without ``://`` have an empty host and path; a null URL holds
no term and is allowed.  Long URLs are read whole, in time linear in their length.  Repeated rows give repeated rows; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold_case

#: The vocabulary that is used where none is passed as a table.
STRICT = (
    "bukkake", "camgirls", "camsex", "carding", "casino", "casinos", "creampie", "cumshot", "cvv", "deepthroat", "escorts", "fetishporn", "gangbang", "hentai", "jailbait", "keygen",
    "malware", "milf", "nsfw", "phishing", "porn", "porno", "pornhub", "sexcam", "sexcams", "slutty", "viagra", "warez", "xvideos", "xxx",
)
SOFT = (
    "ad", "ads", "adult", "affiliate", "amateur", "bet", "bets", "betting", "bonus", "cams", "cash", "cheap", "click", "crack", "cracked", "dating", "discount", "escort", "farm", "free",
    "gamble", "gambling", "girls", "hookup", "hot", "jackpot", "loan", "loans", "lottery", "naked", "nude", "payday", "pharmacy", "pills", "poker", "popup", "promo", "replica", "seo",
    "serial", "sex", "sexy", "singles", "slot", "slots", "spam", "torrent", "track", "tracker", "unlimited", "win", "winner", "webcam",
)
SOFT_NEEDED = 2
#: Terms that a table may hold; an automaton of so many takes some 100 MB in each worker.
MOST_TERMS = 1_000_000
INNER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def address(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return fold_case(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def vocabulary(terms: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Strict and soft terms of a table (``term``, ``strict boolean``); strict where a term is both.  Null and empty terms are none."""
    rows = terms.select(fold_case(F.col("term").cast("string")).alias("term"), F.coalesce("strict", F.lit(False)).alias("strict")).where("term <> ''")
    found = rows.groupBy("term").agg(F.max("strict").alias("strict")).limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"a vocabulary of more than {MOST_TERMS} terms")
    return tuple(sorted(r["term"] for r in found if r["strict"])), tuple(sorted(r["term"] for r in found if not r["strict"]))


@lru_cache(maxsize=2)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    """Made once in a worker."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for term in soft:
        made.add_word(term, ("soft", term))
    for term in strict:
        made.add_word(term, ("strict", term))
    if len(made):
        made.make_automaton()
    return made


def terms_in(url: str, made) -> dict[str, list[str]]:
    """The distinct terms of a lower-cased URL that stand between other characters than a-z and 0-9."""
    found: dict[str, set[str]] = {"strict": set(), "soft": set()}
    for last, (weight, term) in made.iter(url) if len(made) else ():
        before, after = last - len(term), last + 1
        if (before < 0 or url[before] not in INNER) and (after == len(url) or url[after] not in INNER):
            found[weight].add(term)
    return {weight: sorted(terms) for weight, terms in found.items()}


def hit_counter(strict: Sequence[str], soft: Sequence[str]):
    """A UDF: lower-cased URLs to the terms found in each, strict and soft."""
    words = tuple(strict), tuple(soft)

    @F.pandas_udf("strict array<string>, soft array<string>")
    def hits(urls: pd.Series) -> pd.DataFrame:
        made = automaton(*words)
        return pd.DataFrame([terms_in(url or "", made) for url in urls], columns=["strict", "soft"])

    return hits


def judge(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    terms: DataFrame | None = None,
    soft_needed: int = SOFT_NEEDED,
    rules: Sequence[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """``key``, ``host``, ``path``, ``rule``, ``verdict``, and the terms found in each URL; ``terms`` as in ``vocabulary``."""
    strict, soft = vocabulary(terms) if terms is not None else (STRICT, SOFT)
    host, path = address(F.col("url"))
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url")).select("key", "url", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hits", hit_counter(strict, soft)(fold_case(F.col("url"))))
    rule = verdict = F.lit(None).cast("string")
    for kind, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == at) | F.col("host").endswith("." + at)) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, at + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    bad = (F.size("hits.strict") > 0) | (F.size("hits.soft") >= soft_needed)
    return rows.select(
        F.col("key").alias(key),
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.col("hits.strict").alias("strict_terms"),
        F.col("hits.soft").alias("soft_terms"),
    )


def judge_sql(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_needed: int = SOFT_NEEDED, rules=RULES) -> str:
    """DuckDB SQL for ``page_id, host, path, rule, verdict, n_strict, n_soft`` of the table ``pages``."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def found(terms):
        return " + ".join(f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)" for t in terms)

    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits) + f" WHEN n_strict > 0 OR n_soft >= {soft_needed} THEN 'block' ELSE 'allow' END"
    return f"""
        WITH rest AS (
            SELECT page_id, coalesce(translate(url, '{upper}', '{lower}'), '') AS low,
                   CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        parts AS (
            SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM rest),
        counted AS (SELECT *, {found(strict)} AS n_strict, {found(soft)} AS n_soft FROM parts)
        SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, n_strict, n_soft FROM counted"""
