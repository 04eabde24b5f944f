"""Every query beside its SQL on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, rows

D = "/root/testdata/sf0.001"
CORE = {name for r in entry._registries() for name, f in r.queries.items() if not f.__module__.startswith("kelindan.llm")}

pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & CORE))
def test_same_as_sql(spark, con, name):
    got, want = entry.queries()[name](spark, D).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


#: Queries without SQL: the operators are held against brute force elsewhere; here each must give rows of its columns.
WITHOUT_SQL = {
    "g4_betweenness": ["node", "betweenness"], "g5_louvain": ["node", "community"], "g6_focal_sets": ["component", "n_nodes", "mean_edge_weight", "is_focal"], "t1_similarity_text_composed": ["row_no", "similarity_text"],
    "t24_display_text": ["pair_id", "shown"], "m_text_model_forms": ["doc_id", "social", "squeezed", "plain"], "t16_capped_pick": ["pair_id"], "h8_group_similarity": None, "m23_bootstrap": None, "m24_paired_bootstrap": None,
    "m34_label_stability": None, "t26_identical_clusters": ["component", "n"],
}


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_gives_rows(spark, name):
    df = entry.queries()[name](spark, D)
    assert df.count() > 0 and (WITHOUT_SQL[name] is None or df.columns == WITHOUT_SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
