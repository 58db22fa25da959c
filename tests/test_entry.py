"""The driver's contract, and the registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() == 60
    assert df.columns == ["seed_pos", "src", "draw", "dst", "ts", "weight", "padded"]


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the synthetic tables are not here")
def test_graph_queries_agree_with_sql(spark):
    from tidegraph.plans import catalog

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")

    def plain(rows, names):
        at = sorted(range(len(names)), key=lambda i: names[i])
        return sorted((tuple(round(float(r[i]), 6) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else r[i] for i in at) for r in rows), key=repr)

    for name, sql in catalog.ORACLES.items():
        df = catalog.QUERIES[name](spark, SF)
        found = con.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(names) == sorted(df.columns), name
        assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), names), name
