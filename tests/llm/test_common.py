from __future__ import annotations

import numpy as np
from turnloom.llm import common


def test_filter_passes_all_keys_and_few_others(spark):
    keys = spark.range(0, 40_000, 2).repartition(5)
    held = common.Filter(keys)
    assert held.passes(np.arange(0, 40_000, 2)).all()
    assert held.passes(np.arange(1, 40_000, 2)).mean() < 0.05
    assert not common.Filter(keys.where("id < 0")).passes(np.arange(100)).any()


def test_filter_of_more_keys_than_it_has_room_for(spark, monkeypatch):
    """It lets others through, but no key is lost."""
    monkeypatch.setattr(common.Filter, "LARGEST", 1 << 13)
    held = common.Filter(spark.range(0, 40_000, 2))
    assert held.bits == 1 << 13 and held.passes(np.arange(0, 40_000, 2)).all()


def test_temporary_tables_are_deleted(spark):
    path = common.temporary_table(spark, "test")
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    common._delete_tables()
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
