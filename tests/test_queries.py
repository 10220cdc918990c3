"""Every query that has a SQL twin against DuckDB, on the same tables."""

import unicodedata

import duckdb
import pytest

import __spark_entry__ as entry
from verseloom.functions.text import FOLD_FROM, fold
from verseloom.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"
TABLES = "documents embeddings pages conversations labels benchmark region nation customer orders lineitem".split()


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted((tuple(r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    norm = lambda x: [tuple(int(v) if isinstance(v, float) and v == int(v) else v for v in r) for r in x]
    ours, theirs = norm(rows(QUERIES[name](spark, SF).toPandas())), norm(rows(db.sql(ORACLE_SQL[name]).df()))
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_fold_equals_python(spark):
    letters = [c for c in FOLD_FROM if not 0x300 <= ord(c) < 0x370]
    got = spark.createDataFrame([(c,) for c in letters], "c string").select("c", fold("c").alias("f")).collect()
    for r in got:
        assert r["f"] == "".join(x for x in unicodedata.normalize("NFD", r["c"]) if not unicodedata.combining(x)).lower()
