"""Every registered query against its SQL."""

import glob
import os

import duckdb
import pytest

from cairnframe import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return db


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(r[i] for i in order) for r in values], key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, duck):
    df = catalogue.queries()[name](spark, SF)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in catalogue.oracle_sql():
        want = duck.sql(catalogue.oracle_sql()[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.columns, want.fetchall())
    else:
        assert got


def test_order_of_the_flagship(spark):
    prices = [r[2] for r in catalogue.flagship(spark, SF).collect()]
    assert prices == sorted(prices, reverse=True) and len(prices) > 100


@pytest.mark.parametrize("name", ["sort_asc_nulls_last_whole", "sort_desc_nulls_last_whole", "sort_stable_chain_whole", "sort_utf8_dropped_key_whole"])
def test_whole_sorts_keep_every_row_in_order(name, spark, duck):
    df = catalogue.queries()[name](spark, SF)
    want = duck.sql(catalogue.oracle_sql()[name])
    got = [tuple(r) for r in df.select(*want.columns).collect()]
    assert got == want.fetchall() and len(got) == spark.read.parquet(f"{SF}/orders.parquet").count()
    if "nulls" in name:
        assert got[-1][1] is None


def test_csv_keeps_odd_texts(spark, tmp_path):
    texts = ["plain", None, "", "NA", "=NA", "NULL", "12", " a", "a ", "a\t", "\na\r\n", " ", '"', '";"', "\x01", "\x00", 'a\x00"b', "\ufeffa", "a;b\nc"]
    langs = ["en", "fr", None, "NA", "", " de "]
    odd = [(i, t, langs[i % len(langs)]) for i, t in enumerate(texts * len(langs))]
    for name, rows_ in {"odd": odd, "nulls first": [(i, None, "fr") for i in range(8_200)] + [(8_200, "a", "en")], "numbers": [(1, "07", "1"), (2, "8", None)]}.items():
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(rows_, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{path}/documents.parquet")
        db = duckdb.connect()
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
        df = catalogue.queries()["csv_custom_delimiter"](spark, path)
        want = db.sql(catalogue.oracle_sql()["csv_custom_delimiter"])
        assert df.dtypes == [("doc_id", "bigint"), ("lang", "string"), ("text", "string")]
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
