"""Each stage on its own input, odd rows included, and the whole chain."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tesserine.llm import queries
from test_operators import brute_components

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def docs(spark):
    table = queries.table(spark, SF, "documents")
    odd = [(9_001, None, None, None, None), (9_002, "", "en", "s", 0), (None, "Um texto qualquer, sem id.", None, "s", 26), (9_003, "of the " * 30_000, "en", "s", 210_000)]
    more = spark.createDataFrame(odd, table.schema)
    return table.unionByName(more).unionByName(table.where("doc_id < 5")).withColumns({"copies": F.lit(1), "kept": F.lit(1), "tokens": F.lit(1), "score": F.lit(1), "predicted": F.lit(0)}).cache()


@pytest.mark.parametrize("at", range(5))
def test_stage(spark, docs, at):
    name, stage = pipeline.STAGES[at]
    out = stage(spark, docs, SF).cache()
    rows, n = out.count(), docs.count()
    if at < 4:
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    if name == "quality":
        good = queries.table(spark, SF, "labels").where("quality = 1").select("doc_id")
        kept = out.join(good, "doc_id", "left_semi").count()
        assert kept >= 0.99 * docs.join(good, "doc_id", "left_semi").count()
        bad = queries.table(spark, SF, "labels").where("quality = 0").select("doc_id")
        assert out.join(bad, "doc_id", "left_semi").count() <= 0.2 * docs.join(bad, "doc_id", "left_semi").count()
    if name == "near_duplicates":
        all_rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        components, _ = brute_components(all_rows, 5, 80)
        goes = {i for (i, t), c in zip(all_rows, components, strict=True) if i is not None and (t or "").split() and c != i}
        kept = [r["doc_id"] for r in out.collect()]
        assert sorted(map(str, kept)) == sorted(str(i) for i in {i for i, _ in all_rows} - goes)
    if name == "secrets":
        assert rows == n
        assert out.where(F.rlike("text", F.lit("[0-9a-f]{24,}"))).count() == 0
        assert out.where("text IS NOT NULL AND n_chars <> length(text)").count() == 0
    if name == "mixture":
        assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        assert rows > n
    if name == "pieces":
        assert rows == n
        assert out.where("n_tokens <> size(starts)").count() == 0


def test_run(spark):
    assert pipeline.ORACLE_SQL is None
    assert [f.__name__ for _, f in pipeline.STAGES] == ["quality_filter", "near_dedup", "secret_redaction", "mixture", "tokens"]
    out = pipeline.run(spark, SF)
    assert out.count() > 0
    assert "ids" in out.columns
