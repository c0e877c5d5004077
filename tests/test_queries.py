import duckdb
import pytest

from vigilframe import queries, queries_more  # noqa: F401  registers its queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(df):
    columns = sorted(df.columns)
    text = df[columns].astype(str).replace({"None": "", "nan": "", "<NA>": "", "NaT": ""})
    return text.sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = plain(queries.queries()[name](spark, sf).toPandas()), plain(duck.sql(queries.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want), got.merge(want, how="outer", indicator=True).query("_merge != 'both'").head(6).to_string()


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_gives_rows(spark, sf, name):
    assert queries.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
