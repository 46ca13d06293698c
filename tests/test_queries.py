"""Every query with SQL gives what DuckDB gives, on the smallest tables."""

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


def canon(df):
    names = sorted(df.columns)
    show = lambda v: "null" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return names, sorted(tuple(map(show, row)) for row in df[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.execute(entry.oracle_sql()[name]).df()
    assert canon(entry.queries()[name](spark, str(SF)).toPandas()) == canon(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["split_sentences_rules", "hybrid_contexts", "split_terms", "bootstrap_ci"])
def test_runs(spark, name):
    assert entry.queries()[name](spark, str(SF)).count() > 0


def test_bootstrap_takes_all_resamples(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = pd.DataFrame({"doc_id": np.arange(300), "lang": ["de", "en", "en"] * 100, "quality": rng.integers(0, 10_000, 300)})
    rows[["doc_id", "lang"]].to_parquet(tmp_path / "documents.parquet")
    rows[["doc_id", "quality"]].to_parquet(tmp_path / "labels.parquet")
    got = {r["lang"]: (r["low"], r["high"]) for r in entry.queries()["bootstrap_ci"](spark, str(tmp_path)).collect()}
    for lang, part in rows.groupby("lang"):
        values = part["quality"].to_numpy(float)
        means = {}
        for resamples in (1_000, 5_000):
            draw = np.random.default_rng(42)
            means[resamples] = np.sort([values[draw.integers(0, len(values), len(values))].mean() for _ in range(resamples)])
        assert got[lang] == (means[5_000][125], means[5_000][4874])
        assert got[lang] != (means[1_000][25], means[1_000][974])
