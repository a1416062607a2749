import os

import duckdb
import pytest

import __spark_entry__ as entry
from lattica.plans import catalogue

DATA = "/root/testdata/sf0.001"
CHEAP = ["graph_edges", "label_counts", "single_edge_mni", "path2_mni", "edge_dedupe_first", "jaccard_edges", "priority_label", "degree_quantile_label", "result_merge", "timed_out_cells", "edge_label_round"]


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain(rows):
    return sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", CHEAP)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    found = entry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert plain(found.select(*columns).collect()) == plain(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
