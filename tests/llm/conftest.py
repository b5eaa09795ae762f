from __future__ import annotations

import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from lotline.llm.common import ship

    ship(spark)


@pytest.fixture
def frame(spark):
    """A DataFrame in a few partitions, also of no rows."""

    def make(rows, schema, parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make


@pytest.fixture
def table(spark, tmp_path):
    """The same, as a table: its rows stay in their partitions from read to read."""

    def make(rows, schema):
        path = str(tmp_path / f"t{len(list(tmp_path.iterdir()))}")
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make
