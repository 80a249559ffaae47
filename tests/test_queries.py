"""Every registered query against its SQL."""

import pytest

from compare import differences, duck
from conftest import SMALL
from querybook import RUN, SQL


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_its_sql():
    assert set(RUN) == set(SQL)


@pytest.mark.parametrize("name", sorted(RUN))
def test_query(spark, con, name):
    assert differences(RUN[name](spark, SMALL), con, SQL[name]) == []
