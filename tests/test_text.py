import random

import pytest
from pyspark.sql import functions as F

from tesserine.functions import sentences as S
from tesserine.functions import text as T


def one(spark, column, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in sorted(rows.select("i", column(F.col("v"))).collect())]


def test_normalized(spark):
    given = ["investiga-\nção", "2022-\n2023", "NAF- Núcleo", "Programa Olhos D\x92água", "a  b\r\n c ", "é n.º 1ª", "x­y\x81", None]
    assert one(spark, T.normalized, *given) == ["investigação", "2022- 2023", "NAF- Núcleo", "Programa Olhos D’água", "a b c", "é n.º 1ª", "xy", None]


def test_keywords_and_leftovers(spark):
    assert one(spark, T.keyword_list, "Cooperativismo, Território,  Gênero,", ";a;;b ") == [["Cooperativismo", "Território", "Gênero"], ["a", "b"]]
    assert one(spark, T.without_leftovers, "Fim. Palavras-chave: a, b\n c", "nada") == ["Fim.", "nada"]


def test_tokens_and_expressions(spark):
    assert one(spark, T.retrieval_tokens, "Análise documental de uma escola", "") == [["analis", "docume", "escola"], []]
    assert one(spark, T.expression, "No município de São-Paulo, 2020") == ["no munici de sao paulo 2020"]
    rows = spark.createDataFrame([("estudo de caso", "de caso"), ("estudo de casos", "de caso"), ("abc", "")], "t string, w string")
    assert [r[0] for r in rows.select(T.contains_expression(F.col("t"), F.col("w"))).collect()] == [True, False, False]


def test_keys_and_forms(spark):
    assert one(spark, T.term_key, "Entrevistas semi-estruturadas", "questões", "n.º") == ["entrevistasemiestruturada", "questao", "no"]
    assert one(spark, T.term_words, "Análise de conteúdo das falas") == [["analise", "conteudo", "fala"]]
    forms = one(spark, T.term_forms, "Análise temática de Laurence Bardin", "Pesquisa de natureza qualitativa", "Estudo (caso), segundo Yin")
    assert forms == [["Análise temática de Laurence Bardin", "Análise temática"], ["Pesquisa de natureza qualitativa", "Pesquisaqualitativa"], ["Estudo (caso), segundo Yin", "Estudo, segundo Yin", "Estudo"]]


def test_ids(spark):
    assert one(spark, T.sentence_id, "F2", "f2", "F 2", "[F2]", "F02", "F2.", "frase", "2") == ["F2"] * 6 + [None] * 2
    assert one(spark, T.comparison_key, " Entrevistas  Semiestruturadas. ") == ["entrevistas semiestruturadas"]
    assert one(spark, T.says_nothing, "Não informado no texto", "Informado") == [True, False]
    rows = spark.createDataFrame([(7,), (1234,)], "n int")
    assert [r[0] for r in rows.select(T.positional_id("D", F.col("n"))).collect()] == ["D007", "D1234"]
    assert sorted(["v10", "v2", "v1a"], key=dict(zip(["v10", "v2", "v1a"], one(spark, T.natural_key, "v10", "v2", "v1a"), strict=True)).get) == ["v1a", "v2", "v10"]


def test_attempts_and_digest(spark):
    m = T.ATTEMPT_MARK
    assert one(spark, T.attempts, "{}", f"x{m}y", f"x{m}y{m}[não lida: z]", "[falha: X: y]") == [1, 2, 2, 0]
    assert len(set(one(spark, T.text_digest, "a\nb", "a\r\nb", "a\rb"))) == 1
    row = spark.sql("SELECT 'qwen3.5:9b' m, 'denso' t, 'v3' v, '' s, 'x' u").select(T.run_name(F.col("m"), F.col("t"), F.col("v"), F.col("s")), T.run_name(F.col("m"), F.col("t"), F.col("v"), F.col("u"))).first()
    assert tuple(row) == ("qwen3.5-9b__denso__v3", "qwen3.5-9b__denso__v3__x")


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("Uma frase. Outra frase.", 2), ("Segundo Souza et al. (2019), sim. Fim.", 2), ("O custo foi 2,5 e n.º 3 caiu. Ok.", 2), ("(cf. Prof. Silva, 2020). Fim.", 2),
        ('Disse "não sei. Talvez." E saiu.', 2), ("Itens: a. b continua.", 1), ("Sem ponto", 1), ("", 0), ("   ", 0), ("Fim!) Outro? Mais…", 3),
    ],
)
def test_sentences(text, n):
    assert len(S.split(text)) == n


def test_sentences_lose_nothing(spark):
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["A", "b", ". ", "! ", " ", '"', "et al. ", ", ", "\n", ")", "é"]) for _ in range(40))
        assert "".join("".join(S.split(text)).split()) == "".join(text.split())
    docs = spark.createDataFrame([(1, "Um. Dois."), (2, None), (3, "")], "id int, text string")
    assert [tuple(r) for r in S.numbered(docs, "id", "text").collect()] == [(1, 1, "F1", "Um."), (1, 2, "F2", "Dois.")]
    assert S.gathered(S.numbered(docs, "id", "text"), "id").first()["frases"][1]["texto"] == "Dois."


def test_forms_without_python_are_the_same(spark):
    """Texts that Spark folds itself, and those that go to Python, against the standard library."""
    import unicodedata

    from pyspark.sql import functions as F
    from tesserine.functions import text as T

    texts = [None, "", "plain", "Ação çÉ", "ǅ x", "e\u0301a", "İstanbul", "ﬁ ½", "“aspas” – …", "日本 é", "\u212b", "ŉ ĳ ß ø Đ", "".join(map(chr, range(0x20, 0x250))), "".join(map(chr, range(0x2000, 0x2060)))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in rows.select("t", T.sparing_form(F.col("t"), "NFC").alias("c"), T.sparing_form(F.lower("t"), "NFD").alias("d"), F.lower("t").alias("low")).collect():
        if r["t"] is None:
            assert (r["c"], r["d"]) == (None, None)
            continue
        assert r["c"] == unicodedata.normalize("NFC", r["t"])
        assert r["d"] == "".join(c for c in unicodedata.normalize("NFD", r["low"]) if unicodedata.category(c) != "Mn")
