import pytest

import __spark_entry__ as entry
from kvlake.llm import queries
from tests.compare import check


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    assert check(spark, entry, name, "/root/testdata/sf0.001") > 0
