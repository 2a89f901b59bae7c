import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyspan.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores="4", partitions="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Collect a DataFrame as a sorted list of plain tuples of the named columns."""

    def collect(df, *columns):
        chosen = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in chosen.collect()), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))

    return collect
