"""The queries of this subpackage that SQL can state, against DuckDB."""

import pytest

from karstflow.llm import quality, queries
from test_contracts import ROWS, SCHEMA
from test_queries import bag


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
@pytest.mark.parametrize("awkward", [False, True])
def test_sql(spark, tmp_path, name, awkward):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    if awkward:
        folder = str(tmp_path)
        spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    files = f"{folder}/documents.parquet" + ("/*.parquet" if awkward else "")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{files}')")
    found = con.execute(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, folder)
    assert bag([c[0] for c in found.description], found.fetchall()) == bag(df.columns, df.collect())


def test_stored_ledger(spark):
    """Ablations and another version's verdicts come from the stored bits alone."""
    book = quality.written(quality.ledger(spark.createDataFrame(ROWS, SCHEMA)), "ledger")
    bits = [r.fail_bits for r in book.collect()]
    assert [r.kept for r in quality.verdicts(book, 1).collect()] == [not b & 3 for b in bits]
    assert {r.rule: r.n_failed for r in quality.ablations(book).collect()} == {r.name: sum(b >> r.bit & 1 for b in bits) for r in quality.RULES}
