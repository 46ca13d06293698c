"""Steps whose cost must not grow faster than their input: what they give, and how they are planned."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserine import queries as Q
from tesserine.functions import batches as BA
from tesserine.functions import sentences as S
from tesserine.operators import blocks as BL
from tesserine.operators import metrics as M
from tesserine.operators import retrieval as R
from tesserine.operators import vocabulary as VO


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_coverage_meets_no_table_with_itself(spark):
    rows = spark.createDataFrame([("a", 1, "A"), ("a", 1, "A"), ("a", 1, "B"), ("a", 2, "x"), ("b", 1, None), ("c", 9, "B")], "run string, doc int, axis string")
    found = M.coverage(rows, rows.where("run <> 'c'"), "run", "doc", "axis", ("A", "B"))
    assert "Join" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [("a", 1.0, 1, 1), ("b", 0.0, 0, 0)]


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 8)).astype("float32").round(1).tolist()


def test_theme_hits_of_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(BL, "BLOCK_ROWS", 4)
    n = 30
    own = [(i % 2, i, a, None if i == 3 else b) for i, (a, b) in enumerate(zip(vectors(n, 1), vectors(n, 2)))]
    other = [(i % 2, i, a, b) for i, (a, b) in enumerate(zip(vectors(n, 1), vectors(n, 3)))]
    # copies: as good as the own reference, so no hit
    other += [(0, n + 2 * i, a, b) for i, (_, _, a, b) in enumerate(other[:6:2])] + [(1, 7, *other[1][2:])]
    a = spark.createDataFrame(own, "run int, i long, a1 array<float>, a2 array<float>")
    b = spark.createDataFrame(other, "run int, j long, b1 array<float>, b2 array<float>")
    pairs = a.join(b, "run").select("run", "i", "j", M.pair_similarity(F.col("a1"), F.col("a2"), F.col("b1"), F.col("b2")).alias("similarity"))
    want, got = ({r["run"]: r for r in df.collect()} for df in (M.theme_hits(pairs, "run"), M.theme_hits_of(a, b, "run")))
    assert set(got) == set(want) == {0, 1}
    for run in want:
        assert got[run]["documents"] == want[run]["documents"] and got[run]["hit_at_1"] == want[run]["hit_at_1"]
        assert got[run]["baseline"] == pytest.approx(want[run]["baseline"]) and got[run]["margin"] == pytest.approx(want[run]["margin"])


def test_nearest_gives_few_rows_a_block(spark, monkeypatch):
    monkeypatch.setattr(BL, "BLOCK_ROWS", 8)
    rows = [(i, i % 2, None if i == 4 else v) for i, v in enumerate(vectors(10, 1) * 4)]
    every = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    asked = every.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("__q"))
    pairs = every.join(asked, "label").where("vec_id <> query_id").select("query_id", "vec_id", R.dot(F.col("__q"), F.col("embedding")).alias("s"))
    found = R.nearest(asked, every, "label", 5)
    assert found.count() < pairs.count()
    assert R.top(found, "query_id", "s", "vec_id", 5).sort("query_id", "rank").collect() == R.top(pairs, "query_id", "s", "vec_id", 5).sort("query_id", "rank").collect()


def test_answers_are_dealt_by_their_number(spark):
    answers = spark.createDataFrame([("r", "d", 0, "blue", None)], "run string, doc string, pos int, texto string, status string")
    known = VO.vocabulary(spark.createDataFrame([(0, "blue", "a", ["blue"])], "ord int, id string, eixo string, formas array<string>"))
    assert "RepartitionByExpression" in plan(VO.methods_of_answers(answers, known, ["blue"], ["run", "doc"], n=3))
    assert "RepartitionByExpression" in plan(Q.QUERIES["check_answers"](spark, "/root/testdata/sf0.001"))


def scans(df, column):
    """Scans of files for a column in the plan that was carried out."""
    df.collect()
    done = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("FileScan" in line and f"{column}#" in line.split("]")[0] for line in done.splitlines())


@pytest.mark.parametrize("name", ["bm25_topk", "rrf_fusion"])
def test_texts_are_read_for_counts_and_for_scores_alone(spark, tmp_path, name):
    rows = [(i, "ab"[i % 2], f"alpha beta w{'xyz'[i % 3] * 3} delta{'q' * (i % 4)}", 20 + i % 5) for i in range(40)] + [(40, None, "alpha", 3), (41, "a", None, None)]
    spark.createDataFrame(rows, "doc_id long, lang string, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "alpha deltaqq deltaqq wxxx")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert scans(Q.QUERIES[name](spark, str(tmp_path)), "text") == 3  # the third is the benchmark's


def test_sent_along_weights_are_the_same(spark):
    items = spark.createDataFrame([(g, i, ["t" + str(j) for j in range(i % 5)] * 2) for g in "ab" for i in range(12)] + [(None, 1, ["t1"])], "g string, i int, tokens array<string>")
    query = spark.createDataFrame([("t1",), ("t1",), ("t3",), ("_",), ("none",)], "token string")
    a, b = (sorted(map(tuple, R.bm25(items, query, "g", "i", groups).collect()), key=str) for groups in (None, 3))
    assert a == b and len(a) == 25


def test_edges_before_counts_smaller_edges(spark):
    rows = [(x, [float(e) for e in range(n)]) for n in range(0, 13, 3) for x in (-1.0, 0.0, 0.5, 2.0, 5.5, 11.0, 99.0)]
    df = spark.createDataFrame(rows, "x double, edges array<double>")
    for r in df.select("x", "edges", R.edges_before("edges", "x", 12).alias("n")).collect():
        assert r["n"] == sum(e < r["x"] for e in r["edges"])


@pytest.mark.parametrize("name", ["expression_hits", "bm25_topk", "missing_extra", "normalize_text"])
def test_texts_do_not_go_to_python(spark, name):
    assert "ArrowEvalPython" not in plan(Q.QUERIES[name](spark, "/root/testdata/sf0.001"))


def shuffled(df):
    """Rows that the plan that was carried out wrote for its shuffles."""
    df.collect()
    found, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            found += node.metrics().apply("shuffleRecordsWritten").value()
        below = node.children()
        nodes += [below.apply(i) for i in range(below.size())]
        nodes += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
    return found


@pytest.fixture
def odd(spark, tmp_path):
    """Documents whose keys come again, without a text, without an id or a language, with ids below zero."""
    rows = [(i, "xy"[i % 2], f"alpha nuance beta{'z' * (i % 3)} omega {'delta ' * i}") for i in range(25)]
    rows += [(3, "y", "gamma alpha"), (3, "y", None), (4, "x", ""), (None, "x", "alpha"), (None, "x", "zeta"), (-3, "y", "nuance"), (60, "x", None), (61, None, "omega")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(i, f"alpha zeta nuance {'beta omega' if i % 2 else 'gamma'}") for i in range(-3, 15)] + [(5, "kappa omega"), (40, "alpha"), (None, "alpha"), (6, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["prf_by_group", "missing_extra"])
def test_scores_of_odd_documents_are_those_of_sql(spark, odd, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{odd}/{t}.parquet/*.parquet'")
    show = lambda rows: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert show(map(tuple, Q.QUERIES[name](spark, odd).collect())) == show(con.execute(Q.SQL[name]).fetchall())


@pytest.mark.parametrize("name", ["prf_by_group", "missing_extra"])
def test_sets_of_a_frequent_key_are_those_of_sql(spark, tmp_path, name):
    import duckdb

    ids = [None] * 80 + [3] * 70 + [4] * 2 + [5]
    rows = [(key, "x", f"alpha omega nu{'bcd'[i % 3]} zeta{'efg'[i % 3] * (i % 2)}" if i % 9 else (None, "")[i % 2]) for i, key in enumerate(ids)] + [(None, None, "kappa")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, "alpha zeta beta"), (4, "omega kappa"), (5, "gamma")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    show = lambda rows: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert show(map(tuple, Q.QUERIES[name](spark, str(tmp_path)).collect())) == show(con.execute(Q.SQL[name]).fetchall())


def test_sets_of_a_frequent_key_do_not_meet_in_one_row(spark, tmp_path):
    spark.createDataFrame([(None, "x", "alpha omega")] * 80 + [(3, "x", "beta")], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, "alpha")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sets = Q._sets(spark, str(tmp_path), "doc_id")
    assert "Generate explode" in plan(sets)
    assert sorted((str(r["doc_id"]), sorted(r["said"])) for r in sets.collect()) == [("3", ["beta"]), ("None", ["alpha", "omega"])]


@pytest.mark.parametrize("name", ["prf_by_group", "missing_extra", "prf_macro_micro"])
def test_terms_do_not_leave_their_document(spark, tmp_path, name):
    words = ["ab" + x + y for x in "cdefgh" for y in "cdefgh"]
    spark.createDataFrame([(i, "x", " ".join(words)) for i in range(30)], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, "abcc abdd other") for i in range(20)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert shuffled(Q.QUERIES[name](spark, str(tmp_path))) < 30 * len(words) / 4


def python_steps(df):
    """The Python steps of the plan that was carried out, and for each how many others hold a process in the same stage."""
    df.collect()
    found, nodes = [], [(df._jdf.queryExecution().executedPlan(), [])]
    while nodes:
        node, above = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "ArrowEvalPythonExec":
            found.append(above)
            above = [*above, node.udfs().apply(0).name()]
        if "Exchange" in kind:
            above = []
        below = node.children()
        nodes += [(below.apply(i), above) for i in range(below.size())] if kind != "ReusedExchangeExec" else []
        nodes += [(node.executedPlan(), above)] if kind == "AdaptiveSparkPlanExec" else [(node.plan(), above)] if kind.endswith("QueryStageExec") else []
    return found


def test_contexts_make_sentences_and_vectors_once(spark):
    # sentences, their vectors, those of the titles and those of the base
    steps = python_steps(Q.QUERIES["hybrid_contexts"](spark, "/root/testdata/sf0.001"))
    assert steps == [[]] * 4


@pytest.mark.parametrize("name", ["expression_hits", "hybrid_contexts", "link_terms", "run_scores", "status_counts"])
def test_own_rows_need_no_python(spark, name):
    assert "LogicalRDD" not in plan(Q.QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_texts_are_python_strings_a_part_at_a_time(monkeypatch):
    texts = [None, "", "é" * 100, "a. B" * 30, "x", None, "long " * 100, "y"]
    array = pa.array(["skipped", *texts]).slice(1)
    for limit in (1, 200, 300, 1_000, 1 << 20):
        got = list(BA.parts(array, limit))
        assert [t for part in got for t in part] == texts
        assert all(len(part) == 1 or sum(len((t or "").encode()) for t in part) <= limit for part in got)
    assert len(list(BA.parts(array, 1))) == len(texts) and list(BA.parts(pa.array([], pa.string()))) == []
    seen = []

    def encode(part):
        seen.append(len(part))
        return np.array([[len(t), i] for i, t in enumerate(part)], "float32").reshape(-1, 2)

    # the functions that run in the workers give each text its own row, whatever the parts
    monkeypatch.setattr(BA.parts, "__defaults__", (300,))
    assert R.vectors_of(array, "passage", encode).to_pylist() == [[len(f"passage: {t or ''}"), i] for part in BA.parts(array) for i, t in enumerate(part)]
    assert seen == [len(part) for part in BA.parts(array)] and len(seen) > 2
    assert S.found(array).to_pylist() == [S.split(t) for t in texts]
