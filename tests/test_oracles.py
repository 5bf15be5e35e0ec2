"""Every query of the library with SQL, side by side with DuckDB."""

import pytest
from compare import difference

from tidelog.plans import queries as plans

SF = "/root/testdata/sf0.001"


#: Queries that have no rows on the supplied tables; others with the same function have some.
EMPTY = {"d_rare_sequences"}


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_matches_sql(spark, name):
    """Rows that are there, and equal: a result without rows is no evidence."""
    assert difference(plans.queries()[name](spark, SF), plans.oracle_sql()[name], SF) == ("no rows" if name in EMPTY else "")
