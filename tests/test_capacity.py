"""Keeping or computing again, delivery and batches."""

import pytest
from pyspark import StorageLevel

from meshlark.plans import capacity


def test_storage():
    assert capacity.storage_for(10, 100) == StorageLevel.MEMORY_ONLY
    assert capacity.storage_for(110, 100, 20) == StorageLevel.MEMORY_AND_DISK
    assert capacity.storage_for(130, 100, 20) is None
    assert capacity.storage_for(10, 100, repeatable=False) is None
    with pytest.raises(ValueError):
        capacity.storage_for(1, -1)


def test_kept_by_the_plans_size(spark):
    df = spark.range(1000)
    assert capacity.estimated_bytes(df) == 8000
    assert capacity.kept(df, 100).storageLevel == StorageLevel.NONE
    assert capacity.kept(df, 8000).storageLevel.useMemory
    df.unpersist()


def test_shares():
    assert capacity.field_share(1000, 2, 4) == 250
    assert capacity.shares({"a": 10, "b": 30}, 100) == {"a": 10, "b": 30}
    assert capacity.shares({"a": 10, "b": 30}, 20) == {"a": 5, "b": 15}
    with pytest.raises(ValueError):
        capacity.field_share(10, 5, 4)


def test_delivery_and_batches(spark):
    df = spark.range(10, numPartitions=3)
    assert [r.id for r in capacity.delivered(df, 10)] == list(range(10))
    with pytest.raises(ValueError):
        list(capacity.delivered(df, 11))
    wide = df.selectExpr("id", "array(1.0d) as v", "'x' as path")
    assert capacity.batch_columns(wide, ["path"]) == ["id", "v"]
    with pytest.raises(TypeError):
        capacity.batch_columns(wide, [])
