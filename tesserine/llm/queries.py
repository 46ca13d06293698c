"""The queries of this subpackage: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, hnsw, mixing, neardup, pieces, quality, secrets, urls, warc, winnow
from .common import table


def tokenizer(name: str = "piece_bpe_32k.model") -> str:
    """Where the installed public vocabularies are."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "documents"), k=3, percent=85)


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derivatives(warc.responses_of_pages(table(spark, sf_dir, "pages")))
    return records.withColumnRenamed("key", "page_id")


def labelled_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled table of the mixing query: the language of the documents that ``labels`` covers."""
    known = table(spark, sf_dir, "labels").select("doc_id").distinct()
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(known, "doc_id", "left_semi").select(F.col("doc_id").alias("key"), F.col("lang").alias("domain"))


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), labelled_languages(spark, sf_dir))
    return mixed.select("doc_id", "tokens", *(F.col("posteriors")[d].alias(f"p_{d}") for d in sorted(mixing.TARGETS)), "rate", "copies")


def op4_quality_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op5_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.size("strict_terms").cast("long").alias("n_strict"), F.size("soft_terms").cast("long").alias("n_soft"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edit_likeness(table(spark, sf_dir, "documents"))


def op7_assignment_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op8_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"))


def op9_small_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode(table(spark, sf_dir, "documents"), tokenizer()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bbit_minhash": op1_bbit_minhash,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op3_soft_mixing": op3_soft_mixing,
    "op4_quality_machine": op4_quality_machine,
    "op5_url_vocabulary": op5_url_vocabulary,
    "op6_winnowing": op6_winnowing,
    "op7_assignment_secrets": op7_assignment_secrets,
    "op8_brown_classes": op8_brown_classes,
    "op9_small_world": op9_small_world,
    "op10_pieces": op10_pieces,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_derivatives": warc.derivatives_sql(),
    "op5_url_vocabulary": urls.judge_sql(),
}
