"""Each registered query of the reference's operators against its DuckDB SQL, as the driver does it, on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
D = "/root/testdata/sf0.001"
if not os.path.isdir(D):
    pytest.skip("no test tables", allow_module_level=True)

from skein.plans import graph_queries, index_queries, registry, search_queries  # noqa: E402, F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def rows(names, data):
    def value(x):
        if x is None or x != x:
            return ""
        return f"{float(x):.9g}" if isinstance(x, (int, float)) and not math.isinf(x) else str(x)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(value(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, D)
    got = rows(df.columns, df.collect())
    if name in registry.ORACLES:
        r = db.execute(registry.ORACLES[name])
        names = [c[0] for c in r.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, r.fetchall())
    assert got, "a query that finds nothing shows nothing"


def test_entry_survives_without_the_corpus_operators(spark):
    import __spark_entry__ as e

    assert set(registry.QUERIES) <= set(e.queries()) and set(registry.ORACLES) <= set(e.oracle_sql())
    assert e.entry(spark).count() > 0
