"""Invented documents, a small base and a canned client: a whole run without a model."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tesserine.plans.answers import Client
from tesserine.sources.corpus import DOCUMENT, ENTRY

MODEL = "mock"
DOCUMENTS = [
    ("M001", "Horta na escola rural", "Este trabalho trata da horta escolar em escolas rurais. Foram feitas entrevistas com doze professoras. Os dados passaram por análise de conteúdo.", ["horta", "escola rural"], 2021),
    ("M002", "Leitura de mapas no ensino médio", "O tema é a leitura de mapas por estudantes do ensino médio. Aplicou-se um questionário a duas turmas.", ["mapas"], None),
    ("M003", "Notas sobre o brincar", "O texto discute o brincar na educação infantil. Propõe que o brincar organize o dia.", [], 2019),
]
ENTRIES = [
    ("entrevista", "Entrevista", "coleta", "conversa orientada por um roteiro", ["roteiro", "entrevistas"], ["entrevista individual"]),
    ("questionario", "Questionário", "coleta", "perguntas respondidas por escrito", ["perguntas"], []),
    ("analise_de_conteudo", "Análise de conteúdo", "analise", "leitura por categorias", ["categorias"], []),
]
#: What the model says of each document: well formed, inside other text, and of a document that states no method.
SAID = {
    "Horta na escola rural": json.dumps({"tematica_1": {"texto": "Horta escolar", "evidencia": ["F1"]}, "tematica_2": {"texto": "Escola rural", "evidencia": ["F1"]}, "metodologias": [{"texto": "Entrevista", "evidencia": ["F2"]}, {"texto": "Análise de conteúdo", "evidencia": ["F3"]}]}),
    "Leitura de mapas no ensino médio": "Segue: " + json.dumps({"tematica_1": {"texto": "Leitura de mapas", "evidencia": ["F1"]}, "tematica_2": {"texto": "Ensino médio", "evidencia": ["F1"]}, "metodologias": [{"texto": "Questionário", "evidencia": ["F2", "F9"]}]}),
    "Notas sobre o brincar": json.dumps({"tematica_1": {"texto": "Brincar", "evidencia": ["F1"]}, "tematica_2": {"texto": "Educação infantil", "evidencia": ["F1"]}, "metodologias": [{"texto": "Não informado no resumo", "evidencia": []}]}),
}


def corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *d) for i, d in enumerate(DOCUMENTS)], f"pos int, {DOCUMENT}")


def base(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *e) for i, e in enumerate(ENTRIES)], f"ord int, {ENTRY}")


def client() -> Client:
    """A client that finds the document by its title in the prompt."""
    return lambda messages: next((said for title, said in SAID.items() if title in messages[0]["content"]), "")
