from __future__ import annotations

import pytest

from kelindan.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "6g", "spark.driver.host": "127.0.0.1"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture()
def rows():
    """Rows of a DataFrame as sorted tuples."""

    def get(df, *columns):
        df = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in df.collect()), key=repr)

    return get
