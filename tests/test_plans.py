import json

import pytest
from pyspark.sql import functions as F

from tesserine.functions import sentences as S
from tesserine.operators import validation as V
from tesserine.plans import answers as A
from tesserine.plans import export as X
from tesserine.plans import prompt as P
from tesserine.plans import runner
from tesserine.sources import corpus as C
from tesserine.sources import runs as RU

GOOD = {"tematica_1": {"texto": "Saúde", "evidencia": ["F1"]}, "tematica_2": "Idoso", "metodologias": [{"texto": "Entrevista", "evidencia": "F2"}, {"texto": "Entrevista.", "evidencia": ["f3", "F9"]}]}


def field(text, evidence, status="ok"):
    return (text, evidence, status)


@pytest.mark.parametrize(("text", "reason"), [("", "empty"), ("nada", "no JSON"), ('{"a": ', "no JSON"), ('{"a": }', "broken"), ('{"tematica_1": ""}', "lacking"), ('{"tematica_1": 1, "tematica_2": "", "metodologias": []}', "no object"), ('{"tematica_1": "", "tematica_2": "", "metodologias": 3}', "no list")])
def test_unreadable(text, reason):
    with pytest.raises(A.Unreadable, match=reason):
        A.read_output(text)


def test_readable():
    got = A.read_output("```json\n" + json.dumps(GOOD) + "\n```")
    assert got["tematica_2"] == {"texto": "Idoso", "evidencia": [], "status": None}
    assert got["metodologias"][0]["evidencia"] == ["F2"]
    assert len(A.read_output(json.dumps(GOOD | {"metodologias": "Entrevista"}))["metodologias"]) == 1


OUTPUTS = [
    None, "", "  \n", "nada", '{"a": ', '{"a": }', "}{", "[]", "{}", '{"tematica_1": ""}', json.dumps(GOOD), "x " + json.dumps(GOOD) + " y", json.dumps(GOOD | {"tematica_1": 1}), json.dumps(GOOD | {"tematica_2": None}),
    json.dumps(GOOD | {"tematica_2": {}}), json.dumps(GOOD | {"tematica_2": {"texto": None, "evidencia": []}}), json.dumps(GOOD | {"tematica_2": {"texto": "a", "evidencia": 3}}), json.dumps(GOOD | {"tematica_2": {"evidencia": ["F1", 2]}}),
    json.dumps(GOOD | {"metodologias": "só"}), json.dumps(GOOD | {"metodologias": {"texto": "só", "evidencia": "F1"}}), json.dumps(GOOD | {"metodologias": 3}), json.dumps(GOOD | {"metodologias": []}), json.dumps(GOOD | {"metodologias": ["a", 3]}),
    json.dumps(GOOD | {"metodologias": ["a", {"texto": "b", "evidencia": {}}]}), json.dumps(GOOD | {"metodologias": None}), json.dumps(GOOD | {"tematica_1": ["x"]}),
]


def test_both_readers_agree(spark):
    """The reader of columns gives what the reader of one output gives, or the same kind of reason."""
    rows = spark.createDataFrame(list(enumerate(OUTPUTS)), "i int, raw string")
    got = {r["i"]: r["p"] for r in rows.select("i", A.parsed(F.col("raw")).alias("p")).collect()}
    for i, text in enumerate(OUTPUTS):
        p = got[i].asDict(recursive=True)
        try:
            assert (p.pop("reason"), p) == (None, A.read_output(text))
        except A.Unreadable as e:
            p = got[i].asDict(recursive=True)
            assert p.pop("reason").split(" (")[0] == str(e).split(" (")[0], text
            assert p == A.failed()


def test_second_attempt_and_failure():
    said = iter(["oops", json.dumps(GOOD)])
    seen = []
    fields, raw, n = A.ask(lambda m: (seen.append(len(m)), next(said))[1], "p")
    assert (n, seen, fields["tematica_1"]["texto"]) == (2, [1, 3], "Saúde")
    assert A.ATTEMPT_MARK in raw
    fields, raw, n = A.ask(lambda m: "bad", "p")
    assert (n, fields["tematica_1"]["status"]) == (2, "erro")
    assert "[não lida:" in raw

    def broken(messages):
        raise TimeoutError("late")

    assert A.ask(broken, "p")[1] == "[falha: TimeoutError: late]"


def test_validation(spark):
    row = spark.createDataFrame([(field("Tema", ["F1", "f01", "F9"]), field("  ", ["F1"]), field("Não informado", ["F1"]), field("x", [], "erro"), ["F1", "F2"])], f"a {V.FIELD}, b {V.FIELD}, c {V.FIELD}, e {V.FIELD}, valid array<string>")
    got = row.select(*(V.checked_theme(F.col(c), F.col("valid")).alias(c) for c in "abe"), V.checked(F.col("c"), F.col("valid")).alias("c")).first()
    assert tuple(got["a"]) == ("Tema", ["F1"], "ok")
    assert got["b"]["status"] == "erro"
    assert tuple(got["c"]) == ("Não informado no resumo", [], "nao_informado")
    assert got["e"]["status"] == "erro"


def test_methods_merge(spark):
    rows = [
        (1, 0, "Entrevistas", ["F4"], None), (1, 1, "entrevistas.", ["F5", "F4"], None), (1, 2, "Grupo focal", ["F3"], None), (1, 3, "", ["F3"], None), (1, 4, "Não informado", [], None),
        (2, 0, "Não informado", ["F1"], None), (3, 0, "x", ["F1"], "erro"), (3, 1, "y", ["F1"], "ok"), (4, 0, "Caso", ["F8"], None), (4, 1, "CASO", ["F3"], None),
    ]
    df = spark.createDataFrame([(*r, ["F3", "F4", "F5"]) for r in rows], "doc int, pos int, texto string, evidencia array<string>, status string, valid array<string>")
    got = {}
    for r in V.checked_methods(df, ["doc"]).orderBy("doc", "pos").collect():
        got.setdefault(r["doc"], []).append((r["texto"], r["evidencia"], r["status"]))
    assert got[1] == [("Entrevistas", ["F4", "F5"], "ok"), ("Grupo focal", ["F3"], "ok")]
    assert got[2] == [("Não informado no resumo", [], "nao_informado")]
    assert [x[2] for x in got[3]] == ["erro", "ok"]
    assert got[4] == [("Caso", ["F3"], "ok")]


def canned():
    return lambda messages: json.dumps(GOOD)


@pytest.fixture
def small(spark):
    docs = spark.createDataFrame([("D001", "Título", ["idoso"], "Um tema. Usou entrevista. E análise."), ("D002", "Outro", [], "Nada aqui.")], "id string, titulo string, palavras_chave array<string>, resumo string")
    base = spark.createDataFrame([(0, "entrevista", "Entrevista", "coleta", "conversa", ["roteiro"], [])], "ord int, id string, termo string, eixo string, definicao string, sinais array<string>, sinonimos array<string>")
    return docs, S.numbered(docs, "id", "resumo"), base


def test_run_resume_and_sheets(spark, small, tmp_path):
    docs, sentences, base = small
    out = str(tmp_path / "run")
    first = runner.execute(docs.where("id = 'D001'"), sentences, base, "m", "hibrido", "v3", canned, out)
    assert first.count() == 1
    again = runner.execute(docs, sentences, base, "m", "hibrido", "v3", canned, out)
    assert {r["id"]: r["metodologias"][0]["status"] for r in again.collect()} == {"D001": "ok", "D002": "sem_evidencia"}

    def broken():
        raise OSError("down")

    assert runner.execute(docs, sentences, base, "m", "hibrido", "v3", broken, out).count() == 2  # complete: no client is made
    with pytest.raises(RuntimeError, match="down"):
        runner.execute(docs, sentences, base, "other", "hibrido", "v3", broken, out)
    more = docs.unionByName(docs.limit(1).withColumns({"id": F.lit("D003"), "titulo": F.lit("Sem")}))
    rows, details = X.sheets(more, again, sentences)
    assert rows.columns == list(X.ANSWER_COLUMNS)
    assert details.columns == list(X.DETAIL_COLUMNS)
    told = {r["id"]: r for r in details.collect()}
    assert told["D003"]["status"] == "sem resposta"
    assert told["D001"]["evidencia_tematica_1"] == "F1: Um tema."
    assert told["D001"]["status"] == "tematica_2: sem_evidencia"
    facts = {r["campo"]: r["valor"] for r in X.run_sheet(runner.provenance(spark, "m", "hibrido", "v3"), again).collect()}
    assert facts["dissertacoes_que_precisaram_de_2a_tentativa"] == "0"
    X.write_sheets({"respostas": rows}, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv/respostas"), header=True).count() == 3


def test_prompt(spark, small):
    docs, sentences, base = small
    from tesserine.operators import retrieval as R

    for version in ("v1", "v2", "v3"):
        assert P.placeholders(P.template(version)) == set(P.PLACEHOLDERS)
    with pytest.raises(ValueError, match="v1, v2, v3"):
        P.template("v9")
    got = {r["id"]: r for r in runner.prompts(docs, R.contexts(docs, sentences, base, "denso"), base, "v3").collect()}
    assert "[F1] Um tema.\n[F2]" in got["D001"]["prompt"]
    assert P.METHOD_SENTENCES not in got["D001"]["prompt"]
    assert "- Entrevista (coleta): conversa" in got["D001"]["prompt"]
    assert P.NO_KEYWORDS in got["D002"]["prompt"]
    assert "\n\n\n" not in got["D001"]["prompt"]


def test_markdown_and_flattening(spark):
    assert X.markdown([{"a": 1.0, "b": None}, {"a": 2, "c": "x"}]).splitlines()[2] == "| 1.000 |  |  |"
    assert dict(X.flattened({"a": {"b": 1, "c": {"d": 2}}, "e": 3})) == {"a.b": 1, "a.c.d": 2, "e": 3}
    assert X.flat_columns(spark.sql("SELECT struct(1 AS b, struct(2 AS d) AS c) AS a, 3 AS e")).columns == ["a.b", "a.c.d", "e"]


def test_raw_corpus(spark, tmp_path):
    path = tmp_path / "raw.json"
    path.write_text(json.dumps([{"titulo": "A\r\nB", "resumo": "Um estudo investiga-\nção. Palavras-chave: x, y", "palavras_chave": "p,  q,"}, {"titulo": "C", "resumo": "D.", "palavras_chave": ""}]), encoding="utf-8")
    docs = C.read_raw(spark, str(path), "E")
    assert [tuple(r) for r in docs.collect()] == [("E001", "A B", "Um estudo investigação.", ["p", "q"]), ("E002", "C", "D.", [])]
    assert C.write_corpus(docs.withColumn("ano", F.lit(None).cast("int")), str(tmp_path / "out")) == 2
    warned = {r["id"]: r["warnings"] for r in C.warnings(docs).collect()}
    assert warned["E002"] == ["short: 2"]
    path.write_text('[{"titulo": 3, "resumo": "x"}]')
    with pytest.raises(C.ContractError) as e:
        C.read_raw(spark, str(path))
    assert str(e.value).count("\n") == 1


def test_contracts(spark, tmp_path):
    path = tmp_path / "c.json"
    good = {"id": "D001", "titulo": "t", "resumo": "r", "palavras_chave": ["k"]}
    path.write_text(json.dumps([good, good | {"id": "D002", "ano": 2020}]))
    assert [r["ano"] for r in C.read_corpus(spark, str(path)).collect()] == [None, 2020]
    path.write_text(json.dumps([good, good, good | {"id": "D003", "x": 1, "titulo": " "}, {"id": "D004"}, 5]))
    with pytest.raises(C.ContractError) as e:
        C.read_corpus(spark, str(path))
    for part in ("D001: repeated id", "D003: unknown field 'x'", "D003: 'titulo' is empty", "D004: lacks 'resumo'", "item 5: no JSON object"):
        assert part in str(e.value)
    entry = {"id": "a", "termo": "t", "eixo": "coleta", "definicao": "d", "sinais": [], "sinonimos": []}
    path.write_text(json.dumps([entry, entry | {"id": "b", "eixo": "outro"}]))
    with pytest.raises(C.ContractError, match="b: 'eixo' is none of"):
        C.read_base(spark, str(path))


def test_runs_and_reference(spark, tmp_path, small):
    _, _, base = small
    folder = tmp_path / "x" / "m__denso__v3"
    folder.mkdir(parents=True)
    answer = {"dissertacao_id": "D001", **{s: {"texto": "a", "evidencia": [], "status": "ok"} for s in ("tematica_1", "tematica_2")}, "metodologias": [], "modelo": "m", "versao_prompt": "v3", "tecnica": "denso", "saida_bruta": "", "novo": 1}
    (folder / "respostas.json").write_text(json.dumps([answer]))
    answers = RU.read_answers(spark, str(tmp_path))
    assert answers.first()["execucao"] == "x/m__denso__v3"
    assert RU.described(answers, spark.createDataFrame([], "execucao string, " + RU.RUN)).first()["modelo"] == "m"
    ref = tmp_path / "ref.json"
    ref.write_text(json.dumps({"referencias": [{"dissertacao_id": "D001", "tematica_1": "a", "tematica_2": "b", "metodologias": [{"termo": "Entrevistas"}, {"termo": "Mapa mental", "eixo": "analise", "sinonimos": ["mapas"], "explicito": False}, {"termo": "Mapas", "explicito": True}]}]}))
    _, themes, terms = RU.read_reference(spark, str(ref), base)
    assert themes.count() == 1
    assert {r["id"]: (r["eixo"], r["mandatory"]) for r in terms.collect()} == {"entrevista": ("coleta", True), "ref:mapamental": ("analise", True)}


def test_index(spark, tmp_path):
    texts = spark.createDataFrame([("D#F1", "a"), ("D#F2", "b")], "key string, text string")
    RU.write_index(texts, str(tmp_path / "i"), "e")
    index = RU.read_index(spark, str(tmp_path / "i"), "e")
    changed = spark.createDataFrame([("D#F1", "a"), ("D#F2", "c")], "key string, text string")
    assert RU.fresh_vectors(changed, index).count() == 2
    with pytest.raises(ValueError, match="made by"):
        RU.read_index(spark, str(tmp_path / "i"), "other")
