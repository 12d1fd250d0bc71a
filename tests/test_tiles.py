"""The order of pairs: files of all pairs take little more than a bit a row."""

import os

from tidemark.operators import provenance as O


def test_files_of_pairs_are_small(spark, tmp_path):
    n = 3000
    by_artifact = spark.range(n).selectExpr("'a' AS artifact_id", "id * 7919 % 100003 AS unit").repartition(1)
    none = spark.createDataFrame([], "entity string, unit bigint")
    found = O.related_pairs(by_artifact.selectExpr("unit AS seed"), none, by_artifact)
    path = str(tmp_path / "pairs")
    found.write.parquet(path)
    rows = spark.read.parquet(path)
    assert rows.count() == n * (n - 1)
    size = sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.endswith(".parquet"))
    assert size < 0.75 * n * (n - 1)
