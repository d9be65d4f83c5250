"""Every registered query against its SQL form."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as contract
from raterscope.operators import classifiers
from raterscope.plans import catalog

from conftest import DATA

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()
SQL = {n: q for n, q in contract.oracle_sql().items() if n.startswith("q_")}
QUERIES = contract.queries()
# Here these run with small models: what their SQL checks does not depend on the size.
FITTED = {"q_rf_oof", "q_svm_oof", "q_oof", "q_model_compare", "q_learning_curve", "q_score"}
# Too few raters to learn from in the smallest tables.
LARGER = {"q_model_compare", "q_learning_curve"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for folder in (DATA, DATA.replace("0.001", "0.01")):
        connection.execute(f'CREATE SCHEMA "{folder}"')
        for table in TABLES:
            connection.execute(f"""CREATE VIEW "{folder}".{table} AS SELECT * FROM '{folder}/{table}.parquet'""")
    return connection


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_result(spark, duck, name, monkeypatch):
    if name in FITTED:
        small = classifiers.builders(rounds=3, trees=5, svm_iterations=10)
        monkeypatch.setattr(catalog, "_builders", lambda: small)
    folder = DATA.replace("0.001", "0.01") if name in LARGER else DATA
    duck.execute(f"SET search_path = '\"{folder}\"'")
    df = QUERIES[name](spark, folder)
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    expected = Counter(cursor.fetchall())
    found = Counter(tuple(row) for row in df.select(*columns).collect())
    assert found == expected


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns[0] == "user_id" and len(df.columns) == 11
    assert df.count() > 0


def test_no_row_key_clash_in_scored_queries(spark):
    rows = QUERIES["q_lr_oof"](spark, DATA)
    assert rows.count() == rows.select("user_id").distinct().count()
