import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tidemark-tests")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Rows and a DDL schema to a frame; timestamps and dates may be given as text."""

    def build(schema, *rows):
        fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
        text = ", ".join(f"{n} {'STRING' if t.startswith(('TIMESTAMP', 'DATE')) or t == 'MONEY' else t}" for n, t in fields)
        df = spark.createDataFrame([tuple(r) for r in rows], text)
        casts = [f"cast({n} as {'decimal(18,2)' if t == 'MONEY' else t}) {n}" for n, t in fields]
        return df.selectExpr(*casts)

    return build


@pytest.fixture
def rows():
    def collect(df, *columns):
        return sorted(tuple(r) for r in df.select(*columns).collect())

    return collect
