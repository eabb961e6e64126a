"""Queries that run in several statements, against their SQL."""

import pytest

from tests.test_engine import agree


@pytest.mark.parametrize("name", ["local_gate", "collapse_guard"])
def test_gates_of_cleaned_texts(spark, name):
    agree(spark, name)
