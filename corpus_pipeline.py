"""Corpus pipeline: quality, near-duplicates, secrets, mixture, tokens; part of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of ``documents`` (and whatever other columns came in).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import mixing, neardup, pieces, quality, secrets
from tesserine.llm.common import cut, drop_cut, table
from tesserine.llm.queries import tokenizer


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.  Without labelled rows nothing can be told, and all stay."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    # columns travel under names of their own, whatever they are called
    inner = {c: f"__c{i}" for i, c in enumerate(docs.columns) if c != "doc_id"}
    renamed = docs.select("doc_id", *(F.col(c).alias(n) for c, n in inner.items()))
    judged = quality.score(renamed, model, text=inner["text"], carry=tuple(inner.values())).where("predicted = 1")
    return judged.select(*(F.col(inner.get(c, c)).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more).

    An id whose rows differ in text goes if one of them is a near copy of a smaller id's.
    """
    linked = neardup.link(docs)
    dropped = linked.where(~F.col("kept")).select("doc_id")
    kept = docs.join(dropped.distinct(), "doc_id", "left_anti")
    # rows that repeat an id are one document
    again = cut(docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "again")
    if again.take(1):
        several = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        kept = kept.join(again, "doc_id", "left_anti").unionByName(several)
    return kept.select(*docs.columns)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; ``n_chars`` follows the text."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by the rates that give the languages their target shares of tokens; the mixture covers all."""
    known = table(spark, sf_dir, "labels").select("doc_id").distinct()
    labelled = docs.select("doc_id", "lang").join(known, "doc_id", "left_semi").select(F.col("doc_id").alias("key"), F.col("lang").alias("domain"))
    copies = mixing.mix(docs, labelled, cover=True).select(F.col("doc_id").alias("__id"), F.col("copies").alias("__copies"))
    told = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("__id")))
    many = F.when(F.col("__copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    return told.select(*docs.columns, F.explode(many).alias("__copy")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their spans in the text and the decoded text's digest of every document."""
    encoded = pieces.encode(docs, tokenizer())
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "starts", "ends", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_dedup),
    ("secrets", secret_redaction),
    ("mixture", mixture),
    ("pieces", tokens),
]

#: No stage but the reading of tables can be told in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        drop_cut(before)
    return docs
