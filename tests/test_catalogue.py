import duckdb
import pytest

from taskloom.plans import catalogue, pools, reviewing  # noqa: F401

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def norm(df):
    names = sorted(df.columns)
    out = df[names].astype(object).where(df[names].notna(), None).astype(str).replace(r"\.0$", "", regex=True)
    return out.sort_values(names).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_matches_sql(spark, db, name):
    got = norm(catalogue.QUERIES[name](spark, DIR).toPandas())
    assert got.equals(norm(db.sql(catalogue.ORACLE[name]).df()))
