"""Tables are replaced as a whole or not at all."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from panelwright.sources import readers


def held(spark, path):
    return sorted(r.id for r in spark.read.option("header", True).csv(path).collect())


def test_a_failed_run_leaves_the_version_before(spark, tmp_path):
    path = f"{tmp_path}/t"
    readers.write_csv(spark.range(5), path)
    broken = spark.range(50).repartition(4).select(F.when(F.col("id") == 41, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="killed"):
        readers.write_csv(broken, path)
    assert held(spark, path) == ["0", "1", "2", "3", "4"] and [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(Exception, match="killed"):
        readers.write_csv(broken, f"{tmp_path}/other")
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_a_run_that_ended_between_its_renames_is_cleared_up(spark, tmp_path):
    path = tmp_path / "t"
    readers.write_csv(spark.range(3), str(path))
    path.rename(tmp_path / "t.old")
    readers.write_csv(spark.range(4), str(path))
    assert held(spark, str(path)) == ["0", "1", "2", "3"] and [p.name for p in tmp_path.iterdir()] == ["t"]


def test_attempts_leave_one_version_and_manifests_tell_of_lost_files(spark, tmp_path):
    path = tmp_path / "t"
    for _ in range(3):
        readers.write_csv(spark.range(20).repartition(3), str(path))
    assert readers.written_csv(spark, str(path)).count() == 20
    told = json.loads((path / readers.MANIFEST).read_text())
    assert len(told["files"]) == 3 and told["columns"] == ["id"]
    readers.write_csv(spark.range(0), f"{tmp_path}/none", single=True)
    assert readers.written_csv(spark, f"{tmp_path}/none").count() == 0
    (path / sorted(told["files"])[0]).unlink()
    with pytest.raises(ValueError, match="whole"):
        readers.written_csv(spark, str(path))
