"""Every registered query against its SQL on the smallest tables."""

import __spark_entry__ as contract
import pytest
from compare import oracle_rows, spark_rows
from docloom import oracle
from docloom.queries import registered

FOLDER = "/root/testdata/sf0.001"


# Trained by passes over the rows: tested against a plain version in test_linear.py.
WITHOUT_SQL = {"linear_gate"}


@pytest.mark.parametrize("name", sorted(set(registered()) - WITHOUT_SQL))
def test_same_as_sql(spark, name):
    assert spark_rows(registered()[name](spark, FOLDER)) == oracle_rows(
        FOLDER, oracle.statements()[name]
    )


def test_entry(spark):
    assert contract.entry(spark).count() == 200


def test_every_query_has_sql():
    assert set(registered()) - WITHOUT_SQL == set(oracle.statements())
