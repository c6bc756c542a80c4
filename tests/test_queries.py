"""Every registered query outside llm runs, and gives the rows of its SQL."""

import pytest

from lexspark import catalog, catalog_stores  # noqa: F401
from tests.compare import same
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    same(catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns
    assert df.count() > 0


def test_evaluation_takes_every_word(spark, duck, tmp_path):
    words = ["alpha", "beta", "gamma", "delta", *[f"unheard{k}" for k in range(12)]]
    spark.createDataFrame([(0, " ".join(words[:4]), "s")], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(words + words[:1]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    row = catalog.QUERIES["retrieval_evaluation"](spark, str(tmp_path)).first()
    assert (row["coverage"], row["passed"]) == (0.25, False)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 40
    assert set(e.oracle_sql()) <= set(e.queries())
