"""The corpus queries that SQL can state, against DuckDB."""

import duckdb
import pytest

from tests.conftest import DATA
from tests.test_queries import canonical
from tidemark.llm import queries

ROWS = {"op11_spelling_variants": 15_665, "op12_conversation_trie": 391, "op13_html_text": 250}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/sf0.01/{table}.parquet'")
    got, want = canonical(queries.queries()[name](spark, str(DATA / "sf0.01")).toPandas()), canonical(con.execute(queries.SQL[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == ROWS.get(name, 1000)
    assert got.equals(want.astype(got.dtypes.to_dict()))
