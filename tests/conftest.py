import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pathloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make(spark):
    """make("a string, b int", rows) -> DataFrame"""
    from pathloom.operators.joins import lookup_table

    return lambda schema, rows: lookup_table(spark, rows, schema)


LONG = "scen_id string, Variable string, year int, value double"


@pytest.fixture(scope="session")
def long(make):
    return lambda rows: make(LONG, rows)


def rows(df, *order):
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))
