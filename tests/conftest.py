import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from check import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def edges(spark):
    """edges("0>1 1>2") as (func_id, src, dst, ord)."""

    def make(text, func_id=1):
        rows = [(func_id, *e.split(">"), i) for i, e in enumerate(text.split())]
        return spark.createDataFrame(rows, "func_id bigint, src string, dst string, ord int")

    return make


@pytest.fixture(scope="session")
def table(spark):
    """table("func_id bigint, node string", rows)."""
    return lambda schema, rows: spark.createDataFrame(rows, schema)


def got(df, *columns):
    """The rows as a set of tuples, or of values for one column."""
    rows = df.select(*columns).collect()
    return {r[0] if len(columns) == 1 else tuple(r) for r in rows}
