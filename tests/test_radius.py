"""Pairs within a radius."""

import re

from tessera.operators import joins as J


def test_radius_join_deals_one_file_over_all_cores(spark, tmp_path):
    spark.range(50).selectExpr("id AS k", "id % 7 * 1.0D AS x", "id % 5 * 1.0D AS y").coalesce(1).write.parquet(f"{tmp_path}/p")
    p = spark.read.parquet(f"{tmp_path}/p")
    j = J.radius_join(p, p, ["x", "y"], 1.0)
    assert j.count() == sum((a % 7 - b % 7) ** 2 + (a % 5 - b % 5) ** 2 <= 1 for a in range(50) for b in range(50))
    assert re.search(r"RepartitionByExpression|Repartition \d+, true", j._jdf.queryExecution().optimizedPlan().toString())
