from __future__ import annotations

import pytest

from mnemion.operators import graph
from mnemion.sources.staging import discard, stage


def test_discard_deletes_staged_tables_only(spark, tmp_path):
    source = str(tmp_path / "tables" / "t.parquet")
    spark.range(5).write.parquet(source)
    with pytest.raises(ValueError):
        discard(spark.read.parquet(source).where("id > 1").distinct())
    assert spark.read.parquet(source).count() == 5
    staged = stage(spark.range(3), "three")
    discard(staged)
    with pytest.raises(Exception):
        staged.count()


def test_operators_leave_their_sources(spark, tmp_path):
    source = str(tmp_path / "tables" / "edges.parquet")
    spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "src string, dst string").write.parquet(source)
    assert graph.label_propagation(spark.read.parquet(source)).count() == 5
    assert spark.read.parquet(source).count() == 3
