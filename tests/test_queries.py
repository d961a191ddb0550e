"""Every registered query with SQL gives the SQL's rows."""

import duckdb
import pytest

from feedweave.plans import catalogue, feed, gate, library, sources  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rounded(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = rounded(tuple(r[c] for c in columns) for r in df.collect())
    if name in catalogue.ORACLES:
        want = db.sql(catalogue.ORACLES[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert got == rounded(tuple(r[i] for i in at) for r in want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_highlighted_parts_of_odd_texts_are_those_of_the_sql(spark, tmp_path):
    made = ["", None, "\U0001f600the x The", "x\U0001f600the", "a\x01the\x01b", "\x01", "a\U0001f600\x01b the", "the", "thethe", " ", "\x01\x01the", "nİtheſthe\r\nTHE"]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalogue.QUERIES["highlight_parts"](spark, str(tmp_path)).collect()
    assert rounded(tuple(r) for r in got) == rounded(con.sql(catalogue.ORACLES["highlight_parts"]).fetchall())
