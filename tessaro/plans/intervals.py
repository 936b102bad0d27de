"""Queries on intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import periods_and_gaps
from .tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Periods and gaps of each take, of turns and of spans, in hundredths of a second."""

    def timed(track: str) -> DataFrame:
        hundredths = [F.round(F.col(f"{side}_s") * 100).cast("long").alias(f"{side}_cs") for side in ("start", "end")]
        return table(spark, folder, track).select(F.lit(track).alias("track"), "source_id", "take", *hundredths)

    return periods_and_gaps(timed("turns").unionByName(timed("spans")), ["track", "source_id", "take"], "start_cs", "end_cs")


P1_FOUND = """
WITH timed AS (
    SELECT 'turns' AS track, source_id, take, CAST(round(start_s * 100) AS BIGINT) AS s, CAST(round(end_s * 100) AS BIGINT) AS e FROM turns
    UNION
    SELECT 'spans', source_id, take, CAST(round(start_s * 100) AS BIGINT), CAST(round(end_s * 100) AS BIGINT) FROM spans
), reached AS (
    SELECT *, max(e) OVER (PARTITION BY track, source_id, take ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM timed WHERE e > s
), numbered AS (
    SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY track, source_id, take ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
    FROM reached
)
SELECT track, source_id, take, 'period' AS kind, min(s) AS start_cs, max(e) AS end_cs FROM numbered GROUP BY track, source_id, take, island
UNION ALL
SELECT track, source_id, take, 'gap', before, s FROM reached WHERE s > before
"""

QUERIES = {"p1_found": p1_found}
SQL = {"p1_found": P1_FOUND}
