"""Queries on turns and spans as sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import periods_and_gaps
from ..operators.search import ranked
from ..operators.sequence import asof_match, covering, first_appearance_rank, overlap_counts, sliding_windows
from .tables import table

PAD = 30


def _timed(spark: SparkSession, folder: str, name: str, key: str, *more: str) -> DataFrame:
    sides = [F.round(F.col(f"{side}_s") * 100).cast("long").alias(f"{side}_cs") for side in ("start", "end")]
    return table(spark, folder, name).select(key, "source_id", "take", *more, *sides)


def speech_islands(spark: SparkSession, folder: str) -> DataFrame:
    """Spans padded by 0.3 s on either side, not before 0, and merged."""
    spans = _timed(spark, folder, "spans", "span_id").where("end_cs > start_cs")
    padded = spans.select("source_id", "take", F.greatest(F.col("start_cs") - PAD, F.lit(0)).alias("start_cs"), (F.col("end_cs") + PAD).alias("end_cs"))
    return periods_and_gaps(padded, ["source_id", "take"], "start_cs", "end_cs").where("kind = 'period'").drop("kind")


def span_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 3 s every 2.9 s along each span."""
    return sliding_windows(_timed(spark, folder, "spans", "span_id"), ["span_id"], "start_cs", "end_cs", 300, 290)


def range_join_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many turns each span overlaps."""
    found = overlap_counts(_timed(spark, folder, "spans", "span_id"), _timed(spark, folder, "turns", "turn_id"), ["source_id", "take"], "span_id", "start_cs", "end_cs")
    return found.withColumnRenamed("n", "turns")


def asof_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The last span of the same take that began at or before each turn."""
    return asof_match(_timed(spark, folder, "turns", "turn_id"), _timed(spark, folder, "spans", "span_id"), ["source_id", "take"], "turn_id", "start_cs", "span_id", "start_cs")


def point_in_interval(spark: SparkSession, folder: str) -> DataFrame:
    """The midpoint of each turn within the spans padded by 0.3 s: the span if there is exactly one."""
    turns = _timed(spark, folder, "turns", "turn_id").where("end_cs > start_cs")
    middle = F.floor((F.col("start_cs") + F.col("end_cs")) / 2).cast("long")
    points = turns.select("turn_id", "source_id", "take", middle.alias("at_cs"))
    spans = _timed(spark, folder, "spans", "span_id").where("end_cs > start_cs").select("span_id", "source_id", "take", (F.col("start_cs") - PAD).alias("start_cs"), (F.col("end_cs") + PAD).alias("end_cs"))
    return covering(points, spans, ["source_id", "take"], "turn_id", "at_cs", "span_id", "start_cs", "end_cs").drop("n")


def speaker_label_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Speaker labels of each take numbered by first appearance."""
    turns = _timed(spark, folder, "turns", "turn_id", "speaker").where("start_cs IS NOT NULL")
    return first_appearance_rank(turns, ["source_id", "take"], "speaker", ["start_cs", "turn_id"])


def speaker_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Talk time and turns of each label of a source."""
    turns = _timed(spark, folder, "turns", "turn_id", "speaker").where("end_cs > start_cs")
    return turns.groupBy("source_id", "speaker").agg(F.sum(F.col("end_cs") - F.col("start_cs")).alias("talk_cs"), F.count("*").alias("turns"))


def longest_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The two longest turns of each source, by words."""
    words = F.size(F.split(F.trim("text"), r"[ \t\n]+"))
    turns = table(spark, folder, "turns").where("trim(text) <> ''").select("source_id", "turn_id", words.cast("long").alias("words"))
    return ranked(turns, "source_id", [F.desc("words"), F.asc("turn_id")], 2)


_TIMED = """
turns_cs AS (SELECT turn_id, source_id, take, speaker, text, CAST(round(start_s * 100) AS BIGINT) AS start_cs, CAST(round(end_s * 100) AS BIGINT) AS end_cs FROM turns),
spans_cs AS (SELECT span_id, source_id, take, CAST(round(start_s * 100) AS BIGINT) AS start_cs, CAST(round(end_s * 100) AS BIGINT) AS end_cs FROM spans)
"""

QUERIES = {
    "speech_islands": speech_islands, "span_windows": span_windows, "range_join_counts": range_join_counts, "asof_spans": asof_spans, "point_in_interval": point_in_interval,
    "speaker_label_ranks": speaker_label_ranks, "speaker_statistics": speaker_statistics, "longest_turns": longest_turns,
}
SQL = {
    "speech_islands": f"""
WITH {_TIMED}, padded AS (
    SELECT DISTINCT source_id, take, greatest(start_cs - 30, 0) AS s, end_cs + 30 AS e FROM spans_cs WHERE end_cs > start_cs
), reached AS (
    SELECT *, max(e) OVER (PARTITION BY source_id, take ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM padded
), numbered AS (
    SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, take ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM reached
)
SELECT source_id, take, min(s) AS start_cs, max(e) AS end_cs FROM numbered GROUP BY source_id, take, island""",
    "span_windows": f"""
WITH {_TIMED}, counted AS (
    SELECT *, CAST(greatest(ceil((end_cs - start_cs - 300) / 290.0), 0) AS INT) AS n FROM spans_cs WHERE end_cs > start_cs
), listed AS (
    SELECT *, unnest(range(n + 1)) AS k FROM counted
)
SELECT span_id, CAST(k AS INT) AS window_no, start_cs + k * 290 AS window_start, least(start_cs + k * 290 + 300, end_cs) AS window_end FROM listed""",
    "range_join_counts": f"""
WITH {_TIMED}
SELECT span_id, count(*) AS turns FROM spans_cs s JOIN turns_cs t USING (source_id, take)
WHERE s.end_cs > s.start_cs AND t.end_cs > t.start_cs AND s.start_cs < t.end_cs AND t.start_cs < s.end_cs GROUP BY span_id""",
    "asof_spans": f"""
WITH {_TIMED}, matched AS (
    SELECT turn_id, span_id, row_number() OVER (PARTITION BY turn_id ORDER BY s.start_cs DESC, span_id DESC) AS n
    FROM turns_cs t JOIN spans_cs s ON s.source_id = t.source_id AND s.take = t.take AND s.start_cs <= t.start_cs
)
SELECT t.turn_id, m.span_id FROM turns_cs t LEFT JOIN matched m ON m.turn_id = t.turn_id AND m.n = 1""",
    "point_in_interval": f"""
WITH {_TIMED}, points AS (
    SELECT turn_id, source_id, take, (start_cs + end_cs) // 2 AS m FROM turns_cs WHERE end_cs > start_cs
)
SELECT turn_id, CASE WHEN count(*) = 1 THEN min(span_id) END AS span_id
FROM points p JOIN spans_cs s USING (source_id, take) WHERE s.end_cs > s.start_cs AND s.start_cs - 30 < m + 1 AND m < s.end_cs + 30 GROUP BY turn_id""",
    "speaker_label_ranks": f"""
WITH {_TIMED}, seen AS (
    SELECT source_id, take, speaker, min((start_cs, turn_id)) AS f FROM turns_cs WHERE start_cs IS NOT NULL AND speaker IS NOT NULL GROUP BY ALL
)
SELECT source_id, take, speaker, CAST(row_number() OVER (PARTITION BY source_id, take ORDER BY f, speaker) AS INT) AS number FROM seen""",
    "speaker_statistics": f"WITH {_TIMED} SELECT source_id, speaker, CAST(sum(end_cs - start_cs) AS BIGINT) AS talk_cs, count(*) AS turns FROM turns_cs WHERE end_cs > start_cs GROUP BY source_id, speaker",
    "longest_turns": r"""
WITH counted AS (
    SELECT source_id, turn_id, len(regexp_split_to_array(trim(text, ' '), '[ \t\n]+')) AS words FROM turns WHERE trim(text, ' ') <> ''
)
SELECT source_id, turn_id, CAST(words AS BIGINT) AS words, CAST(row_number() OVER (PARTITION BY source_id ORDER BY words DESC, turn_id) AS INT) AS rank FROM counted
QUALIFY rank <= 2""",
}
