"""Table functions for SQL users; Catalyst inlines them, nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

GRID_POINTS = """
CREATE OR REPLACE TEMPORARY FUNCTION grid_points(low DOUBLE, high DOUBLE, size INT)
RETURNS TABLE (idx INT, value DOUBLE)
RETURN SELECT i, low + i * ((high - low) / (size - 1)) FROM explode(sequence(0, size - 1)) AS t(i)"""

SEGMENT_PLAN = """
CREATE OR REPLACE TEMPORARY FUNCTION segment_plan(frames BIGINT, size BIGINT, stride BIGINT, n BIGINT)
RETURNS TABLE (seg BIGINT, v_start BIGINT, v_end BIGINT)
RETURN SELECT i, (frames - size - (n - 1) * stride) div 2 + i * stride,
              (frames - size - (n - 1) * stride) div 2 + i * stride + size
FROM explode(CASE WHEN size + (n - 1) * stride <= frames THEN sequence(0L, n - 1) END) AS t(i)"""


def register(spark: SparkSession) -> None:
    """Make ``grid_points`` and ``segment_plan`` known to the session's SQL."""
    spark.sql(GRID_POINTS)
    spark.sql(SEGMENT_PLAN)
