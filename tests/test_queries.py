"""Every query with SQL against DuckDB on the smallest tables, and invariants of the reports."""

import math
import os
from collections import Counter

import duckdb
import pytest

from tidemill.plans import registry

SQL = registry.oracle_sql()
SLOW = {"fit_ovr_svc", "fit_gbt", "stacking_oof", "tune_grid", "fit_rf", "feature_importance"}


@pytest.fixture(scope="module")
def duck(tiny):
    d = duckdb.connect()
    for f in os.listdir(tiny):
        d.execute(f"create view {f[:-8]} as select * from '{tiny}/{f}'")
    return d


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return round(float(v), 9) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, tiny, duck, name):
    df = registry.queries()[name](spark, tiny)
    columns = sorted(df.columns)
    mine = Counter(tuple(norm(r[c]) for c in columns) for r in df.collect())
    c = duck.execute(SQL[name])
    names = [x[0] for x in c.description]
    assert sorted(names) == columns
    at = [names.index(x) for x in columns]
    assert mine == Counter(tuple(norm(r[i]) for i in at) for r in c.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL) - SLOW))
def test_runs(spark, tiny, name):
    assert registry.queries()[name](spark, tiny).count() >= 0


@pytest.mark.parametrize("name", ["char_ngram_ranges", "tfidf_char"])
def test_ngrams_of_odd_keys(spark, tmp_path, name):
    """Rows without a key and of one key are one document each; no row per document and n-gram is shuffled."""
    rows = [(1, "A cat sat"), (1, "the cat"), (None, "a cat and a hat"), (None, "that\t\u3000cat"), (2, None), (3, " "), (4, "Cat hats"), (5, "a b c")] + [(k, f"x{k}") for k in range(10, 40)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.queries()[name](spark, str(tmp_path))
    assert "hashpartitioning(doc_id" not in df._jdf.queryExecution().executedPlan().toString()
    d = duckdb.connect()
    d.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    c = d.execute(SQL[name])
    names = [x[0] for x in c.description]
    assert Counter(tuple(norm(r[c]) for c in names) for r in df.collect()) == Counter(tuple(norm(v) for v in r) for r in c.fetchall())


def test_invariants(spark, tiny):
    q = registry.queries()
    n = spark.read.parquet(f"{tiny}/merged_records.parquet").count()
    assert sum(r["n"] for r in q["label_distribution"](spark, tiny).collect()) == n
    assert q["validate_kept"](spark, tiny).count() + q["validate_removed"](spark, tiny).count() == n
    c = {r["metric"]: r for r in q["pipeline_comparison"](spark, tiny).collect()}
    assert c["tokens"]["removed"] >= 0 and c["vocabulary"]["removed"] >= 0
    for r in q["length_correlation"](spark, tiny).collect():
        assert r[r["metric"]] == 1.0


def test_entry(spark, tiny):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
