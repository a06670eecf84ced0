"""Every registered query of the engine against its SQL."""

from __future__ import annotations

import pytest
from compare import run_sql, same_rows
from conftest import SMALL

from folio.plans import catalogue


@pytest.mark.parametrize("name", catalogue.ORACLES)
def test_query_equals_sql(spark, name):
    same_rows(catalogue.QUERIES[name](spark, SMALL), run_sql(catalogue.ORACLES[name], SMALL))
