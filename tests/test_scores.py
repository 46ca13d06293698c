import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.operators import metrics as M
from tesserine.operators import retrieval as R
from tesserine.operators import statistics as ST
from tesserine.operators import vocabulary as VO


def board(spark, said, wanted, accepted=()):
    p = spark.createDataFrame([("d", t) for t in said], "doc string, term string")
    r = spark.createDataFrame([("d", t, True) for t in wanted] + [("d", t, False) for t in accepted], "doc string, term string, mandatory boolean")
    return M.scoreboard(p, r, spark.createDataFrame([("d",)], "doc string"), ["doc"]).first()


@pytest.mark.parametrize(
    ("said", "wanted", "accepted", "scores"),
    [("acd", "ab", "c", (2 / 3, 1 / 2, 4 / 7)), ("", "", "", (1, 1, 1)), ("", "a", "", (0, 0, 0)), ("a", "", "", (0, 1, 0))],
)
def test_scoreboard(spark, said, wanted, accepted, scores):
    b = board(spark, said, wanted, accepted)
    assert (b["precision"], b["recall"], b["f1"]) == pytest.approx(scores)


def test_macro_micro(spark):
    p = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "x")], "doc int, term string").withColumn("run", F.lit("r"))
    r = spark.createDataFrame([(1, "a", True), (1, "b", True), (1, "e", True), (2, "c", True), (2, "z", True), (2, "y", False)], "doc int, term string, mandatory boolean").withColumn("run", F.lit("r"))
    b = M.scoreboard(p, r, p, ["run", "doc"])
    macro, micro = M.macro(b, ["run"]).first(), M.micro(b, ["run"]).first()
    assert macro["macro_precision"] == pytest.approx(3 / 4)
    assert macro["macro_recall"] == pytest.approx((2 / 3 + 1 / 2) / 2)
    assert (micro["micro_precision"], micro["micro_recall"]) == pytest.approx((3 / 4, 3 / 5))
    found = {r["doc"]: (r["missing"], r["extra"]) for r in M.missing_and_extra(p, r, ["doc"]).collect()}
    assert found == {1: (["e"], []), 2: (["z"], ["x"])}


def test_axis_without_terms_has_no_row(spark):
    p = spark.createDataFrame([(1, "coleta", "a"), (1, None, "livre")], "doc int, axis string, term string")
    r = spark.createDataFrame([(1, "coleta", "a", True), (1, "analise", "b", False)], "doc int, axis string, term string, mandatory boolean")
    assert [(x["axis"], x["f1"]) for x in M.scoreboard_by_axis(p, r, ["doc"]).collect()] == [("coleta", 1.0)]


def test_pair_similarity(spark):
    v = {"s": [1.0, 0.0], "a": [0.0, 1.0], "e": [0.8, 0.6]}
    rows = [(v["s"], v["a"], v["a"], v["e"]), (v["s"], None, v["s"], v["a"]), (None, None, v["s"], v["a"])]
    df = spark.createDataFrame(rows, "a1 array<double>, a2 array<double>, b1 array<double>, b2 array<double>")
    got = [r[0] for r in df.select(M.pair_similarity(*map(F.col, ("a1", "a2", "b1", "b2")))).collect()]
    assert got == pytest.approx([0.9, 0.5, 0.0])


def test_agreement_and_jaccard(spark):
    rows = [("a", "d1", ["x", "y"]), ("b", "d1", ["x", "y"]), ("a", "d2", ["x", "y", "z"]), ("b", "d2", ["z", "q", "w"]), ("b", "d3", [])]
    got = M.agreement(spark.createDataFrame(rows, "run string, doc string, t array<string>"), "run", "doc", "t")
    assert got.groupBy("a", "b").agg(F.avg("jaccard")).first()[2] == pytest.approx(0.6)
    assert got.where("doc = 'd2'").first()["jaccard"] == pytest.approx(0.2)
    assert spark.range(1).select(M.jaccard(F.array(), F.array())).first()[0] == 1.0


def test_status_counts_and_times(spark):
    rows = spark.createDataFrame([("r", "ok"), ("r", "ok"), ("r", "erro"), ("r", None)], "run string, status string")
    assert {r["status"]: r["n"] for r in M.status_counts(rows, ["run"]).collect()} == {"ok": 3, "sem_evidencia": 0, "nao_informado": 0, "erro": 1}
    times = spark.createDataFrame([("r", 10.0), ("r", 20.0), ("r", 30.0), ("q", None)], "run string, s double")
    assert [tuple(r) for r in M.time_summary(times, ["run"], "s").collect()] == [("r", 20.0, 20.0, 30.0, 60.0, 3)]


def test_hits(spark):
    pairs = [("r", i, j, float(i == j) if i else 0.5) for i in range(3) for j in range(3)] + [("q", 0, 0, 1.0)]
    got = {r["run"]: r for r in M.theme_hits(spark.createDataFrame(pairs, "run string, i int, j int, similarity double"), "run").collect()}
    assert got["q"]["baseline"] is None
    assert got["r"]["hit_at_1"] == pytest.approx(2 / 3)
    assert got["r"]["baseline"] == pytest.approx(1 / 6)


def test_fusion_and_ranks(spark):
    dense = spark.createDataFrame([("d", i, s) for i, s in enumerate((0.9, 0.1, 0.5))], "doc string, pos int, score double")
    lexical = spark.createDataFrame([("d", i, s) for i, s in enumerate((0.0, 30.0, 2.0))], "doc string, pos int, score double")
    both = R.fused(R.ranks(dense, "doc", "score", "pos"), R.ranks(lexical, "doc", "score", "pos", positive=True), "doc", "pos")
    top = R.top(both, "doc", "score", "pos", 3).orderBy("rank").collect()
    assert [r["pos"] for r in top] == [1, 2, 0]
    assert top[0]["score"] == pytest.approx(1 / 63 + 1 / 61)


def test_bm25_against_plain_python(spark):
    sentences = [["a", "b", "a"], ["b", "c"], ["c", "c", "d", "e"], []]
    query = ["a", "c", "c", "q"]
    docs = [s or ["_"] for s in sentences]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    words = {w for d in docs for w in d}
    idf = {w: math.log(n - sum(w in d for d in docs) + 0.5) - math.log(sum(w in d for d in docs) + 0.5) for w in words}
    mean = sum(idf.values()) / len(idf)
    idf = {w: v if v >= 0 else 0.25 * mean for w, v in idf.items()}
    want = [sum(idf[w] * d.count(w) * 2.5 / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in query if w in d) for d in docs]
    rows = spark.createDataFrame([("g", i, s) for i, s in enumerate(sentences)], "g string, i int, tokens array<string>")
    asked = spark.createDataFrame([("g", w) for w in query], "g string, token string")
    for one in (asked, asked.select("token")):
        got = {r["i"]: r["score"] for r in R.bm25(rows, one, "g", "i").collect()}
        assert [got[i] for i in range(4)] == pytest.approx(want)


def test_contexts_keep_to_their_document(spark):
    docs = spark.createDataFrame([("D1", "Saúde do idoso", ["idoso"]), ("D2", "Escola rural", [])], "id string, titulo string, palavras_chave array<string>")
    rows = [(d, i + 1, f"F{i + 1}", f"{d} frase {i} com entrevista e análise") for d in ("D1", "D2") for i in range(7)]
    sentences = spark.createDataFrame(rows, "id string, pos int, frase_id string, texto string")
    base = spark.createDataFrame([(i, f"v{i}", t, "coleta", "x", [], []) for i, t in enumerate(("Entrevista", "Questionário", "Grupo focal"))], "ord int, id string, termo string, eixo string, definicao string, sinais array<string>, sinonimos array<string>")
    for technique in R.TECHNIQUES:
        found = {r["id"]: r for r in R.contexts(docs, sentences, base, technique).collect()}
        assert set(found) == {"D1", "D2"}
        for d, r in found.items():
            assert all(s["texto"].startswith(d) for s in r["frases_tematicas"] + r["frases_metodologia"])
            assert len(r["frases_tematicas"]) == (7 if technique == "sem_rag" else 5)
            assert len(r["verbetes"]) == (0 if technique == "sem_rag" else 3)
            if technique == "denso":
                scores = [s["score"] for s in r["frases_tematicas"]]
                assert scores == sorted(scores, reverse=True)
    with pytest.raises(ValueError, match="unknown technique"):
        R.contexts(docs, sentences, base, "outra")


def test_bootstrap_is_numpy(spark):
    rows = spark.createDataFrame([("a", i, float(i % 2)) for i in range(20)], "g string, i int, v double")
    got = ST.bootstrap(rows, "g", "i", "v").first()
    draw, values = np.random.default_rng(42), np.array([0.0, 1.0] * 10)
    means = sorted(values[draw.integers(0, 20, 20)].mean() for _ in range(5000))
    assert (got["low"], got["high"]) == (means[125], means[4874])


def test_paired(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", 0.5), ("z", 0.5), ("only", 1.0)], "d string, v double")
    b = spark.createDataFrame([("x", 0.0), ("y", 0.5), ("z", 0.5)], "d string, v double")
    r = ST.paired(ST.differences(a, b, [], "d", "v"), []).first()
    assert (r["n"], r["won"], r["lost"], r["tied"]) == (3, 1, 0, 2)
    assert r["mean"] == pytest.approx(1 / 3)


def test_paired_differences_of_runs(spark):
    runs = spark.createDataFrame([("m__t__v2", "m", "t", "v2"), ("m__t__v10", "m", "t", "v10"), ("n__u__v2", "n", "u", "v2")], "execucao string, modelo string, tecnica string, versao_prompt string")
    scores = spark.createDataFrame([("m__t__v2", "d", 0.4), ("m__t__v10", "d", 0.6), ("n__u__v2", "d", 1.0)], "execucao string, dissertacao_id string, f1 double")
    (row,) = ST.paired_differences(scores, runs).collect()
    assert (row["a"], row["b"], row["changes"], row["n"], row["won"]) == ("m__t__v10", "m__t__v2", "versao_prompt", 1, 1)


ENTRIES = [(0, "qualitativa", "abordagem", ["Pesquisa qualitativa", "Abordagem qualitativa"]), (1, "entrevista", "coleta", ["Entrevista"]), (2, "semi", "coleta", ["Entrevista semiestruturada"]), (3, "documental", "procedimento", ["Pesquisa documental"]), (4, "biblio", "procedimento", ["Pesquisa bibliográfica"]), (5, "caso", "procedimento", ["Estudo de caso (único)"])]


def test_vocabulary(spark):
    known = VO.vocabulary(spark.createDataFrame(ENTRIES, "ord int, id string, eixo string, formas array<string>"))
    terms = ["Pesquisa de natureza qualitativa", "estudo de casos", "Coisa nova", "Entrevista semi-estruturada com roteiro", "Entrevistas com idosos"]
    rows = spark.createDataFrame([(1, t) for t in terms], "doc int, termo string")
    direct = {r["termo"]: (r["id"], r["eixo"]) for r in VO.recognized(rows, known, "doc").collect()}
    assert direct[terms[0]] == ("qualitativa", "abordagem")
    assert direct[terms[1]] == ("caso", "procedimento")
    assert direct[terms[2]] == ("livre:coisanova", None)
    named = {}
    for r in VO.linked(rows, known, "doc").collect():
        named.setdefault(r["termo"], set()).add(r["id"])
    assert named[terms[4]] == {"entrevista"}
    assert named[terms[2]] == {"livre:coisanova"}


def test_split_terms(spark):
    known = VO.vocabulary(spark.createDataFrame(ENTRIES, "ord int, id string, eixo string, formas array<string>"))
    keys = [r["key"] for r in known.select("key").collect()]
    assert VO.terms_of("Pesquisa bibliográfica e documental", keys) == ["Pesquisa bibliográfica", "Pesquisa documental"]
    assert VO.terms_of("Estudo de caso, segundo Yin; Entrevista.", keys) == ["Estudo de caso", "Entrevista"]
    assert VO.terms_of("Inventário Social e de Saúde", keys) == ["Inventário Social e de Saúde"]
    assert VO.terms_of("Revisão teórica e documental", keys) == ["Revisão teórica", "Pesquisa documental"]
    fields = spark.createDataFrame([("r", "d", 0, "Entrevista e Pesquisa documental", "ok"), ("r", "d", 1, "Não informado no resumo", "nao_informado"), ("r", "d", 2, "x", "erro")], "run string, doc string, pos int, texto string, status string")
    got = VO.methods_of_answers(fields, known, keys, ["run", "doc"])
    assert {(r["id"], r["eixo"]) for r in got.collect()} == {("entrevista", "coleta"), ("documental", "procedimento")}


def test_fused_in_place(spark):
    from tesserine.operators import retrieval as R

    rows = [(g, p, (p * 7 + g) % 5 / 4 - 0.5, None if p % 4 == 0 else (p * 3 + g) % 6 / 3 - 0.5) for g in (1, 2) for p in range(23)]
    df = spark.createDataFrame(rows, "g int, p int, a double, b double")
    plain = R.fused(R.ranks(df, "g", "a", "p"), R.ranks(df, "g", "b", "p", positive=True), "g", "p")
    placed = df.select("g", "p", R.fused_in_place("a", "b", "g", "p").alias("score"))
    assert {tuple(r) for r in placed.collect()} == {tuple(r) for r in plain.collect()}


def test_best_of_fusion(spark):
    from tesserine.operators import retrieval as R

    rng = np.random.default_rng(3)
    rows = [(g, p, *(None if rng.random() < 0.2 else float(rng.integers(0, 40)) for _ in "ab")) for g, size in ((1, 400), (2, 3), (3, 90)) for p in range(size)]
    df = spark.createDataFrame([*rows, (4, 1, None, None)], "g int, p int, a double, b double")
    listed = lambda s: R.ranks(df.where(F.col(s).isNotNull()), "g", s, "p")
    for n, k in ((5, 60), (3, 1), (10, 0)):
        plain = R.top(R.fused(listed("a"), listed("b"), "g", "p", k), "g", "score", "p", n)
        in_a_list = df.where("a IS NOT NULL OR b IS NOT NULL")
        best = R.fused_best(*(df.select("g", "p", F.col(s).alias("score")) for s in "ab"), "g", "p", n, k).select("g", "p", "score", "rank")
        assert sorted(map(tuple, best.collect())) == sorted(map(tuple, plain.select("g", "p", "score", "rank").collect()))
        assert best.join(in_a_list, ["g", "p"], "left_anti").count() == 0


def test_expressions_in_sentences(spark):
    from tesserine.operators import retrieval as R

    chosen = spark.createDataFrame([(1, 2, "de campo e roteiro."), (1, 1, "Entrevistas na pesquisa"), (2, 1, "Nada"), (3, 1, "")], "id int, rank int, texto string")
    entries = spark.createDataFrame([(0, "Pesquisa de campo", ["roteiro", "roteiros"], ["Entrevista", "!!"]), (1, "campo de pesquisa", [], ["nada"])], "ord int, termo string, sinais array<string>, sinonimos array<string>")
    # the sentences are read in order of rank, so "pesquisa de campo" stands across two; both spellings of a sign count
    assert {tuple(r) for r in R.literal_hits(chosen, entries, "id").collect()} == {(1, 0, 2.0 + 2.0 + 1.0 + 1.0), (2, 1, 2.0)}
