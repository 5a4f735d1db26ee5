"""Point densities over studies."""

import re

from pyspark.sql import functions as F

from tessera.operators import studies as U


def test_dealt_points_meet_cells_as_counts_of_studies(spark):
    """Before any join the points of a draw are one row a study and number: what is shuffled doesn't follow the points."""
    points = spark.range(3000).selectExpr("id AS k", "id % 5 AS study", "1.0D + id % 3 AS w")
    d = U.density_null(points, "k", "study", "w", ["x", "y"], U.range_grid(spark, [(0, 1, 5), (0, 1, 5)]).select(F.col("d1").alias("x"), F.col("d2").alias("y")), 1.5, 4)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[b#\d+, study#\d+L?, _i#\d+L?\]", plan)
    assert d.count() == 4 and all(0 < r.highest <= 1 for r in d.collect())
