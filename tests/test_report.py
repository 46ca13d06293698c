import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.operators import vocabulary as VO
from tesserine.plans import report as RE
from tesserine.sources import runs as RU


def encoder(texts):
    """Two directions: what speaks of health, and all else."""
    return np.array([[1.0, 0.0] if "saude" in t else [0.0, 1.0] for t in texts], np.float32)


def answer(doc, first, second, methods, status="ok"):
    field = lambda t, s="ok": {"texto": t, "evidencia": [], "status": s}
    return {"dissertacao_id": doc, "tematica_1": field(first, status), "tematica_2": field(second, status), "metodologias": [field(*m) if isinstance(m, tuple) else field(m, status) for m in methods], "modelo": "m", "versao_prompt": "v1", "tecnica": "denso", "saida_bruta": ""}


@pytest.fixture(scope="module")
def stored(tmp_path_factory):
    root = tmp_path_factory.mktemp("stored")
    runs = {
        "m__denso__v1": [answer("D1", "saude geral", "ensino", ["Entrevistas", "Mapa mental"]), answer("D2", "ensino", "escola nova", ["Grupo focal e entrevista"]), answer("D3", "", "", [""], "erro"), answer("D9", "x", "y", [("Não informado no resumo", "nao_informado")])],
        "m__denso__v2": [answer("D1", "ensino", "saude", ["Entrevista"]), answer("D2", "ensino", "escola", ["Questionário"])],
    }
    for name, answers in runs.items():
        (root / name).mkdir()
        (root / name / "respostas.json").write_text(json.dumps(answers), encoding="utf-8")
        (root / name / "execucao.json").write_text(json.dumps({"modelo": "m", "tecnica": "denso", "versao_prompt": name[-2:], "segundos": {a["dissertacao_id"]: 2.0 * i for i, a in enumerate(answers)}, "tentativas": {a["dissertacao_id"]: 1 + (i == 0) for i, a in enumerate(answers)}}))
    base = [("entrevista", "Entrevista", "coleta"), ("grupo_focal", "Grupo focal", "coleta"), ("questionario", "Questionário", "coleta"), ("estudo_de_caso", "Estudo de caso", "procedimento")]
    (root / "base.json").write_text(json.dumps([{"id": i, "termo": t, "eixo": e, "definicao": "d", "sinais": [], "sinonimos": []} for i, t, e in base]))
    (root / "ref.json").write_text(json.dumps([
        {"dissertacao_id": "D1", "tematica_1": "saude", "tematica_2": "ensino", "metodologias": [{"termo": "Entrevista"}, {"termo": "Estudo de caso"}, {"termo": "Grupo focal", "explicito": False}]},
        {"dissertacao_id": "D2", "tematica_1": "ensino", "tematica_2": "escola", "metodologias": [{"termo": "Entrevista"}, {"termo": "Grupo focal", "explicito": False}]},
        {"dissertacao_id": "D3", "tematica_1": "saude", "tematica_2": "ensino", "metodologias": [{"termo": "Entrevista"}]},
    ]))
    return root


@pytest.fixture(scope="module")
def evaluated(spark, stored):
    from tesserine.sources import corpus as C

    base = C.read_base(spark, str(stored / "base.json"))
    known, themes, terms = RU.read_reference(spark, str(stored / "ref.json"), base)
    answers = RU.read_answers(spark, str(stored))
    runs = RU.read_runs(spark, str(stored))
    found = RE.evaluate(answers, runs, RU.described(answers, runs), known, (themes, terms), encoder)
    return RE.write_evaluation(found, str(stored / "out"))


def test_indicators(evaluated):
    got = {r["execucao"]: r.asDict(recursive=True) for r in evaluated["sem_gabarito"].collect()}
    one = got["m__denso__v1"]
    assert one["dissertacoes"] == 4
    # a stored status counts as it stands; one not seen counts 0
    assert one["status"]["por_campo"] == {"ok": 9, "erro": 3, "nao_informado": 1, "sem_evidencia": 0}
    assert one["status"]["por_dissertacao"] == {"ok": 2, "erro": 1, "nao_informado": 1, "sem_evidencia": 0}
    assert one["tempo"] == {"medio_s": 3.0, "mediano_s": 3.0, "max_s": 6.0, "total_s": 12.0, "n": 4}
    assert one["tentativas"] == {"1": 3, "2": 1}
    assert one["metodologias_por_resposta"] == 1.0
    assert one["formato_metodologias"] == {"itens": 3, "palavras_por_item": pytest.approx(7 / 3), "itens_exatos": pytest.approx(2 / 3), "itens_com_varios_metodos": pytest.approx(1 / 3)}
    assert one["palavras_por_tematica"] == pytest.approx((2 + 1 + 1 + 2 + 0 + 0 + 1 + 1) / 8)
    assert one["eixos_cobertos_medio"] == pytest.approx(2 / 3)
    assert one["respostas_por_eixo"] == {"abordagem": 0, "procedimento": 0, "coleta": 2, "analise": 0}
    assert one["termos_livres"] == ["livre:mapamental"]
    assert got["m__denso__v2"]["formato_metodologias"]["itens_exatos"] == 1.0


def test_against_reference(evaluated):
    rows = {(r["execucao"][-2:], r["dissertacao_id"]): r for r in evaluated["por_dissertacao"].collect()}
    assert {k for k in rows if k[0] == "v1"} == {("v1", "D1"), ("v1", "D2"), ("v1", "D3")}  # D9 is not in the reference
    first, second, failed = (rows["v1", d] for d in ("D1", "D2", "D3"))
    assert (first["precision"], first["recall"], first["f1"], first["precisao_estrita"]) == (0.5, 0.5, 0.5, 0.5)
    assert (first["nao_achados"], first["fora_da_referencia"]) == (["estudo_de_caso"], ["livre:mapamental"])
    assert (second["precision"], second["recall"], second["precisao_estrita"]) == (1.0, 1.0, 0.5)  # acceptable ones save precision only
    assert (failed["f1"], failed["status"], failed["similaridade_tematicas"]) == (0.0, "erro", 0.0)
    assert rows["v2", "D1"]["similaridade_tematicas"] == 1.0  # themes have no order
    runs = {r["execucao"][-2:]: r for r in evaluated["contra_referencia"].collect()}
    assert runs["v1"]["met_f1"] == pytest.approx(0.5)
    assert runs["v1"]["met_precisao_estrita"] == pytest.approx(1 / 3)
    assert runs["v1"]["avaliadas"] == 3
    assert [a["eixo"] for a in runs["v1"]["por_eixo"]] == ["coleta", "procedimento"]
    assert 0 <= runs["v1"]["f1_ic95"][0] <= runs["v1"]["f1_ic95"][1] <= 1


def test_rows_and_agreement(evaluated):
    rows = {r["execucao"][-2:]: r for r in evaluated["execucoes"].collect()}
    assert (rows["v1"]["n"], rows["v1"]["campos_ok"], rows["v1"]["dissertacoes_com_erro"]) == (4, pytest.approx(9 / 13), 1)
    assert rows["v2"]["tem_similaridade"] == 1.0
    assert len(evaluated["execucoes"].columns) == 19
    pair = evaluated["concordancia_pares"].first()
    # D1: {entrevista, mapa mental} and {entrevista}; D2: nothing in common
    assert (pair["dissertacoes"], pair["jaccard"], pair["tematicas"]) == (2, pytest.approx(0.25), 1.0)
    assert {r["dissertacao_id"]: r["jaccard"] for r in evaluated["concordancia_por_dissertacao"].collect()} == {"D1": 0.5, "D2": 0.0}
    change = evaluated["diferencas_pareadas"].first()
    assert (change["a"][-2:], change["changes"], change["n"]) == ("v2", "versao_prompt", 2)


def test_without_reference_or_answers(spark, stored):
    known = VO.vocabulary(spark.createDataFrame([], "ord int, id string, eixo string, formas array<string>"))
    answers, runs = RU.read_answers(spark, str(stored)), RU.read_runs(spark, str(stored))
    found = RE.evaluate(answers, runs, RU.described(answers, runs), known)
    assert "tem_similaridade" not in found["execucoes"].columns
    assert found["execucoes"].count() == 2
    none = answers.where(F.lit(False))
    assert [df.count() for df in RE.evaluate(none, runs, RU.described(none, runs), known).values()] == [0, 0, 0, 0]


def test_large_vocabulary_is_refused(spark, monkeypatch):
    monkeypatch.setattr(RE, "MOST_KEYS", 1)
    with pytest.raises(ValueError, match="more than 1 keys"):
        RE.keys_of(spark.createDataFrame([("a",), ("b",)], "key string"))
