import __spark_entry__ as entry
import pytest


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row["summary"]["total_rows"] > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["inspect_columns", "recipe_replay", "kb_recommendations"])
def test_against_sql(spark, data_folder, name):
    duckdb = pytest.importorskip("duckdb")
    import check

    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_folder}/{t}.parquet'")
    df = entry.queries()[name](spark, data_folder)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(names, cursor.fetchall())
