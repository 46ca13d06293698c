import json

import pytest

from tesserine import __main__ as main


def test_mock_run_and_comparison(spark, tmp_path, capsys):
    out = tmp_path / "runs"
    (folder,) = main.main(["run", "--mock", "--tecnica", "sem_rag", "--ids", "M002", "--saida", str(out)], spark)
    answers = json.loads((out / "mock__sem_rag__v3/respostas.json").read_text(encoding="utf-8"))
    assert [a["dissertacao_id"] for a in answers] == ["M002"]
    assert main.main(["run", "--mock", "--tecnica", "sem_rag", "--saida", str(out)], spark) == [folder]
    answers = json.loads((out / "mock__sem_rag__v3/respostas.json").read_text(encoding="utf-8"))
    assert [a["dissertacao_id"] for a in answers] == ["M001", "M002", "M003"]  # in the corpus's order, whatever was asked first
    assert answers[1]["metodologias"] == [{"texto": "Questionário", "evidencia": ["F2"], "status": "ok"}]
    assert answers[2]["metodologias"][0]["status"] == "nao_informado"
    facts = json.loads((out / "mock__sem_rag__v3/execucao.json").read_text(encoding="utf-8"))
    assert set(facts["tentativas"].values()) == {1}
    assert len(facts["sha256_do_corpus"]) == len(facts["prompt_sha256"]) == 64
    main.main(["compare", "--mock", "--sem-embedding", "--sugestoes", str(out), "--saida", str(tmp_path / "told")], spark)
    assert "| mock__sem_rag__v3 | mock | sem_rag | v3 | 3 | 0.900 | 0 |" in capsys.readouterr().out


def test_digest_is_of_rows_not_of_order(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "i int, t string")
    assert main.digest(rows.orderBy("i").repartition(2)) == main.digest(rows.orderBy("t", ascending=False))
    assert main.digest(rows) != main.digest(rows.limit(1)) != main.digest(rows.union(rows))


def test_prepare(spark, tmp_path, capsys):
    (tmp_path / "raw.json").write_text(json.dumps([{"titulo": "A", "resumo": "Curto.", "palavras_chave": "x, y"}]))
    main.main(["prepare", "--bruto", str(tmp_path / "raw.json"), "--prefixo", "C", "--saida", str(tmp_path / "corpus")], spark)
    said = capsys.readouterr().out
    assert "1 documents" in said
    assert "C001: short: 6" in said


def test_what_is_needed(capsys):
    with pytest.raises(SystemExit):
        main.main(["run", "--saida", "x"])
    assert "--corpus, --base, --cliente, --modelo" in capsys.readouterr().err
