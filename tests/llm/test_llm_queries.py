"""The registered queries run on the smallest tables, and the package stands apart."""

from __future__ import annotations

import os
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from kelindan.llm.queries import R
from tools.compare import TABLES, rows

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")

COLUMNS = {
    "p1_found": ["src_table", "key_1", "key_2"], "p2_found": ["src_table", "key_1", "key_2"], "p4_found": ["record_id_1", "record_id_2"], "p6_found": ["comment_id", "sentiment_label"],
    "p7_found": ["pair_id", "pii_type", "start_at"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(R.queries))
def test_runs(spark, name):
    df = R.queries[name](spark, D)
    got = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
    if name.endswith("_found"):
        assert len({tuple(r) for r in got}) == len(got)
    if name.endswith("_found") and "key_2" in df.columns:
        assert all(r.key_1 < r.key_2 for r in got)


@pytest.mark.parametrize("name", sorted(R.oracle))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    assert rows(R.queries[name](spark, D).toPandas()) == rows(con.execute(R.oracle[name]).df())


def test_nothing_else_imports_the_package():
    root = Path(entry.__file__).parent / "kelindan"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"kelindan\.llm|from \.+llm", p.read_text()), p
