"""Shared by the operator tests (a conftest here would shadow the parent's)."""

import pytest

SF01 = "/root/testdata/sf0.01"


@pytest.fixture()
def frame(spark):
    """Small crafted tables spread over partitions."""
    def make(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)
    return make
