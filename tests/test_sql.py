"""Every registered query with SQL against DuckDB, and the others for their rows."""

import pytest
from compare import DATA, same

from orolith.plans import catalog

SF = f"{DATA}/sf0.001"
#: Queries whose rows lie outside the smallest tables.
WIDER = {"closed_mask", "clipped_surface"}


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, name):
    same(catalog.QUERIES[name](spark, SF), catalog.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, f"{DATA}/sf0.01" if name in WIDER else SF).count() > 0
