"""Every query with SQL gives DuckDB's rows at the smallest size, whatever the number of partitions."""

import collections
import decimal
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

from sparrowgrid.plans import QUERIES, SQL  # noqa: E402


def same(rows, columns, cursor):
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(columns)
    key = sorted(columns)

    def plain(x):
        if isinstance(x, decimal.Decimal):
            return float(x)
        return round(x, 6) if isinstance(x, float) else x

    left = collections.Counter(str(tuple(plain(r[c]) for c in key)) for r in rows)
    right = collections.Counter(str(tuple(plain(r[names.index(c)]) for c in key)) for r in cursor.fetchall())
    assert left == right


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    found = QUERIES[name](spark, SF)
    same(found.collect(), found.columns, duck.execute(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_partitions_do_not_matter(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(str, QUERIES["version_projection"](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
