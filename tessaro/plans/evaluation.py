"""Queries that score answers and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics as M
from .tables import table


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "qa_turns")


def citation_precision(spark: SparkSession, folder: str) -> DataFrame:
    """The share of cited chunks that were given; null where none is cited."""
    cited, given = F.array_distinct("cited_chunk_ids"), F.col("source_chunk_ids")
    share = F.when(F.size(cited) > 0, F.size(F.array_intersect(cited, given)) / F.size(cited))
    return _answers(spark, folder).select("id", F.round(share, 4).alias("precision"))


def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Recall and mean reciprocal rank of the given chunks for the cited ones, by model."""
    found, wanted = F.col("source_chunk_ids"), F.col("cited_chunk_ids")
    rows = _answers(spark, folder).select("model", M.recall_at_k(found, wanted, 3).alias("recall"), M.reciprocal_rank(found, wanted, 3).alias("rr"))
    return rows.groupBy("model").agg(F.count("*").alias("answers"), F.count("recall").alias("judged"), M.mean_or_null(F.col("recall")).alias("recall_at_3"), M.mean_or_null(F.col("rr")).alias("mrr_at_3"))


def token_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    tokens = F.col("completion_tokens")
    return _answers(spark, folder).groupBy("model").agg(
        F.count(tokens).alias("n"), F.round(M.percentile(tokens, 0.5), 3).alias("p50"), F.round(M.percentile(tokens, 0.9), 3).alias("p90"), F.min(tokens).alias("least"), F.max(tokens).alias("most")
    )


def decline_agreement(spark: SparkSession, folder: str) -> DataFrame:
    """How well the flag agrees with the decline phrase in the answer, by model."""
    said = F.when(F.col("answer").isNotNull(), X.declines(F.col("answer")))
    return M.agreement(_answers(spark, folder), ["model"], F.col("declined"), said)


def criteria_check(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics of each model against thresholds; what can't be measured neither passes nor fails."""
    long = retrieval_metrics(spark, folder).select("model", F.explode(F.create_map(F.lit("recall_at_3"), "recall_at_3", F.lit("mrr_at_3"), "mrr_at_3")).alias("metric", "value"))
    threshold = F.when(F.col("metric") == "recall_at_3", 0.9).otherwise(0.5)
    return long.select("model", "metric", "value", threshold.alias("threshold"), (F.col("value") >= threshold).alias("pass"))


def run_compare(spark: SparkSession, folder: str) -> DataFrame:
    """The mean number of tokens of each model in odd and even months."""
    rows = _answers(spark, folder).withColumn("odd", F.month("created_at") % 2 == 1)
    mean = lambda odd: rows.where(F.col("odd") == odd).groupBy("model").agg(F.round(F.avg("completion_tokens"), 4).alias("value"))
    return M.compare_runs(mean(True), mean(False), "model", "value")


def answer_word_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Word errors between each question and its answer."""
    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    rows = _answers(spark, folder).select("id", words("question").alias("q"), words("answer").alias("a"))
    return rows.select("id", F.size("q").alias("words"), M.word_errors(F.col("q"), F.col("a")).alias("errors"))


def speaker_votes(spark: SparkSession, folder: str) -> DataFrame:
    """For each speaker name the label it most often stands for in its sources, with its share of the turns."""
    digit = F.regexp_extract(F.coalesce("speaker", F.lit("")), r"([0-9]+)", 1)
    turns = table(spark, folder, "turns").where(digit != "").select("source_id", digit.cast("int").alias("number"), F.lower(F.trim("speaker")).alias("label"))
    votes = turns.groupBy("source_id", "number", "label").agg(F.count("*").alias("votes"))
    total = F.sum("votes").over(Window.partitionBy("source_id", "number"))
    best = votes.withColumn("total", total).groupBy("source_id", "number").agg(F.max_by(F.struct("label", "votes", "total"), F.struct("votes", F.col("label"))).alias("b"))
    return best.select("source_id", "number", "b.label", F.round(F.col("b.votes") / F.col("b.total"), 4).alias("share"))


def null_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How many answers of each model lack a value, by column."""
    return _answers(spark, folder).groupBy("model").agg(*(F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in ("question", "answer", "declined", "completion_tokens")))


def event_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type and hour of day, with totals over either."""
    rows = table(spark, folder, "events").select("event_type", F.hour("ts").alias("hour"), "value")
    return rows.cube("event_type", "hour").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total"))


_RETRIEVAL = """
SELECT model, count(*) AS answers, count(recall) AS judged, round(avg(recall), 4) AS recall_at_3, round(avg(rr), 4) AS mrr_at_3 FROM (
    SELECT model,
        CASE WHEN len(cited_chunk_ids) > 0 THEN len(list_distinct(list_intersect(cited_chunk_ids, source_chunk_ids[1:3]))) / len(list_distinct(cited_chunk_ids)) END AS recall,
        CASE WHEN len(cited_chunk_ids) > 0 THEN coalesce(1.0 / nullif(list_position(list_transform(source_chunk_ids[1:3], lambda x: list_contains(cited_chunk_ids, x)), true), 0), 0) END AS rr
    FROM qa_turns
) GROUP BY model"""

QUERIES = {
    "citation_precision": citation_precision, "retrieval_metrics": retrieval_metrics, "token_percentiles": token_percentiles, "decline_agreement": decline_agreement, "criteria_check": criteria_check,
    "run_compare": run_compare, "answer_word_errors": answer_word_errors, "speaker_votes": speaker_votes, "null_shares": null_shares, "event_rollup": event_rollup,
}
SQL = {
    "citation_precision": "SELECT id, round(CASE WHEN len(cited_chunk_ids) > 0 THEN len(list_distinct(list_intersect(cited_chunk_ids, source_chunk_ids))) / len(list_distinct(cited_chunk_ids)) END, 4) AS precision FROM qa_turns",
    "retrieval_metrics": _RETRIEVAL,
    "token_percentiles": "SELECT model, count(completion_tokens) AS n, round(quantile_cont(completion_tokens, 0.5), 3) AS p50, round(quantile_cont(completion_tokens, 0.9), 3) AS p90, min(completion_tokens) AS least, max(completion_tokens) AS most FROM qa_turns GROUP BY model",
    "decline_agreement": """
WITH v AS (
    SELECT model, CAST(declined AS INT) AS a, CAST(contains(lower(answer), 'not found in your documents') AS INT) AS b FROM qa_turns WHERE declined IS NOT NULL AND answer IS NOT NULL
), s AS (
    SELECT model, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po, avg(a) AS pa, avg(b) AS pb FROM v GROUP BY model
)
SELECT model, n, round(po, 4) AS agreement, CASE WHEN abs(1 - (pa * pb + (1 - pa) * (1 - pb))) > 1e-12 THEN round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 4) END AS kappa FROM s""",
    "criteria_check": f"""
WITH r AS ({_RETRIEVAL})
SELECT model, 'recall_at_3' AS metric, recall_at_3 AS value, CAST(0.9 AS DOUBLE) AS threshold, recall_at_3 >= 0.9 AS pass FROM r
UNION ALL SELECT model, 'mrr_at_3', mrr_at_3, CAST(0.5 AS DOUBLE), mrr_at_3 >= 0.5 FROM r""",
    "run_compare": """
WITH m AS (
    SELECT model, month(created_at) % 2 = 1 AS odd, round(avg(completion_tokens), 4) AS value FROM qa_turns GROUP BY ALL
)
SELECT coalesce(b.model, a.model) AS model, b.value AS before, a.value AS after, round(a.value - b.value, 4) AS delta, coalesce(round(a.value - b.value, 4) <= -0.02, false) AS regression
FROM (SELECT * FROM m WHERE odd) b FULL JOIN (SELECT * FROM m WHERE NOT odd) a ON a.model = b.model""",
    "speaker_votes": """
WITH t AS (
    SELECT source_id, CAST(regexp_extract(speaker, '([0-9]+)', 1) AS INT) AS number, lower(trim(speaker, ' ')) AS label FROM turns WHERE regexp_matches(speaker, '[0-9]')
), v AS (
    SELECT source_id, number, label, count(*) AS votes FROM t GROUP BY ALL
), s AS (
    SELECT *, sum(votes) OVER (PARTITION BY source_id, number) AS total, row_number() OVER (PARTITION BY source_id, number ORDER BY votes DESC, label DESC) AS n FROM v
)
SELECT source_id, number, label, round(votes / total, 4) AS share FROM s WHERE n = 1""",
    "null_shares": "SELECT model, count(*) FILTER (question IS NULL) AS no_question, count(*) FILTER (answer IS NULL) AS no_answer, count(*) FILTER (declined IS NULL) AS no_declined, count(*) FILTER (completion_tokens IS NULL) AS no_completion_tokens FROM qa_turns GROUP BY model",
    "event_rollup": "SELECT event_type, CAST(hour(ts) AS INT) AS hour, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY CUBE (event_type, hour(ts))",
}
