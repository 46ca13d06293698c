"""Corpora and knowledge bases from JSON, checked as a whole: every problem is reported, not the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from tesserine.functions import text as T

# Fixed values
AXES = ("natureza", "objetivos", "abordagem", "procedimento", "coleta", "analise")
RAW = "titulo string, resumo string, palavras_chave string"
DOCUMENT = "id string, titulo string, resumo string, palavras_chave array<string>, ano int"
ENTRY = "id string, termo string, eixo string, definicao string, sinais array<string>, sinonimos array<string>"
SHORTEST_ABSTRACT = 300


class ContractError(ValueError):
    """A file breaks its contract; the message has a line for each problem."""


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """``pos, item``: the objects of a JSON array with their place in the file, as variants."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.try_parse_json("value").alias("v")).select(F.posexplode(F.expr("cast(v as array<variant>)")).alias("pos", "item"))


def read_raw(spark: SparkSession, path: str, prefix: str = "D") -> DataFrame:
    """Documents from a raw file: cleaned, ids by their place in the file."""
    items = read_array(spark, path)
    get = lambda f: F.try_variant_get("item", f"$.{f}", "string")
    names = [f.name for f in Ty.StructType.fromDDL(RAW).fields]
    is_text = lambda f: F.schema_of_variant(F.variant_get("item", f"$.{f}", "variant")) == "STRING"
    problems = F.array_compact(F.array(*(F.when(~F.coalesce(is_text(f), F.lit(False)), F.lit(f"no text in '{f}'")) for f in names)))
    raise_problems(items.select((F.col("pos") + 1).cast("string").alias("name"), problems.alias("problems")))
    return items.select(
        T.positional_id(prefix, F.col("pos") + 1).alias("id"),
        T.normalized(get("titulo")).alias("titulo"),
        T.without_leftovers(get("resumo")).alias("resumo"),
        T.keyword_list(get("palavras_chave")).alias("palavras_chave"),
    )


def raise_problems(rows: DataFrame, most: int = 1_000) -> None:
    """``name, problems``: raise one error that lists all problems, and counts those beyond ``most`` items."""
    wrong = rows.where(F.size("problems") > 0)
    found = wrong.limit(most + 1).collect()
    if found:
        lines = [f"{r['name']}: {p}" for r in found[:most] for p in r["problems"]]
        more = [f"and {wrong.count() - most} more items"] if len(found) > most else []
        raise ContractError("\n".join(lines + more))


def contract_problems(items: DataFrame, fields: dict[str, str], required: list[str], axis: str | None = None) -> DataFrame:
    """``name, problems`` of items against a contract: missing, unknown, mistyped and empty fields, unknown axes, repeated ids."""
    names = F.expr("map_keys(try_cast(item as map<string, variant>))")
    get = lambda f, kind: F.try_variant_get("item", f"$.{f}", kind)
    checks = [F.when(~F.array_contains(names, f), F.lit(f"lacks '{f}'")) for f in required]
    for f, kind in fields.items():
        there = F.array_contains(names, f)
        if kind == "string":
            checks.append(F.when(there & (F.coalesce(F.trim(get(f, "string")), F.lit("")) == ""), F.lit(f"'{f}' is empty or no text")))
        elif kind == "array<string>":
            value = get(f, kind)
            checks.append(F.when(there & (value.isNull() | F.exists(value, lambda x: F.coalesce(F.trim(x), F.lit("")) == "")), F.lit(f"'{f}' is no list of texts")))
        else:
            given = F.try_variant_get("item", f"$.{f}", "string").isNotNull()
            checks.append(F.when(there & given & get(f, kind).isNull(), F.lit(f"'{f}' is no number")))
    if axis:
        checks.append(F.when(F.array_contains(names, axis) & ~F.coalesce(get(axis, "string").isin(*AXES), F.lit(False)), F.lit(f"'{axis}' is none of {', '.join(AXES)}")))
    unknown = F.transform(F.filter(names, lambda n: ~n.isin(*fields)), lambda n: F.concat(F.lit("unknown field '"), n, F.lit("'")))
    name = F.coalesce(get("id", "string"), F.concat(F.lit("item "), (F.col("pos") + 1).cast("string")))
    each = items.select(name.alias("name"), F.when(names.isNull(), F.array(F.lit("no JSON object"))).otherwise(F.concat(F.array_compact(F.array(*checks)), unknown)).alias("problems"))
    again = items.select(get("id", "string").alias("name")).where("name IS NOT NULL").groupBy("name").count().where("count > 1")
    return each.unionByName(again.select("name", F.array(F.lit("repeated id")).alias("problems")))


def typed(items: DataFrame, ddl: str) -> DataFrame:
    fields = Ty.StructType.fromDDL(ddl).fields
    return items.select("pos", *(F.try_variant_get("item", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in fields))


def kinds(ddl: str) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in Ty.StructType.fromDDL(ddl).fields}


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A prepared corpus (``pos`` and the fields of a document)."""
    items, fields = read_array(spark, path), kinds(DOCUMENT)
    raise_problems(contract_problems(items, fields, [f for f in fields if f != "ano"]))
    return typed(items, DOCUMENT)


def read_base(spark: SparkSession, path: str) -> DataFrame:
    """A knowledge base (``ord`` and the fields of an entry)."""
    items, fields = read_array(spark, path), kinds(ENTRY)
    raise_problems(contract_problems(items, fields, list(fields), axis="eixo"))
    return typed(items, ENTRY).withColumnRenamed("pos", "ord")


def write_corpus(docs: DataFrame, path: str) -> int:
    """Documents as JSON lines without null fields, read back; their number."""
    docs.write.mode("overwrite").option("ignoreNullFields", True).json(path)
    wanted, got = docs.count(), docs.sparkSession.read.schema(DOCUMENT).json(path).count()
    if wanted != got:
        raise ContractError(f"{wanted} documents were written and {got} read back")
    return got


def warnings(docs: DataFrame) -> DataFrame:
    """``id, warnings array<string>``: leftovers, short or unfinished abstracts, titles met before (first place counts)."""
    first = docs.groupBy(F.lower("titulo").alias("__t")).agg(F.min("id").alias("__first"))
    rows = docs.withColumn("__t", F.lower("titulo")).join(first, "__t")
    leftover = F.regexp_extract("resumo", T.MISPLACED, 0)
    told = F.array_compact(F.array(
        F.when(leftover != "", F.concat(F.lit("holds: "), leftover)),
        F.when(F.length("resumo") < SHORTEST_ABSTRACT, F.concat(F.lit("short: "), F.length("resumo").cast("string"))),
        F.when(~F.rlike("resumo", F.lit(T.SENTENCE_END)), F.lit("unfinished")),
        F.when(F.col("id") != F.col("__first"), F.concat(F.lit("title of "), F.col("__first"))),
    ))
    return rows.select("id", told.alias("warnings"))
