"""Queries on the library: sources, chunks and what refers to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .tables import table


def source_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by the hash of their content: the first of each and how many there are."""
    rows = table(spark, folder, "documents").where("text IS NOT NULL")
    return rows.groupBy(F.sha2(F.encode("text", "utf-8"), 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def library_listing(spark: SparkSession, folder: str) -> DataFrame:
    info = lambda k: F.get_json_object("info", f"$.{k}")
    contents = F.when(F.col("kind") == "audio", F.concat_ws(" · ", X.clock(info("duration_s").cast("double")), F.concat(info("speakers"), F.lit(" speakers")))).otherwise(F.concat(info("chunks"), F.lit(" chunks")))
    return table(spark, folder, "sources").select("id", "name", "kind", "status", X.human_size(F.col("size_bytes")).alias("size"), F.date_format("added_at", "yyyy-MM-dd HH:mm").alias("added"), F.coalesce(contents, F.lit("")).alias("contents"))


def status_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "sources").groupBy("kind", "status").agg(F.count("*").alias("sources"), F.sum("size_bytes").alias("bytes"))


def chunk_citations(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk with the text of its citation."""
    sources = table(spark, folder, "sources").select(F.col("id").alias("source_id"), "name")
    rows = table(spark, folder, "chunks").join(sources, "source_id")
    return rows.select("id", X.citation_label(F.col("name"), F.col("page_start"), F.col("page_end"), F.col("start_s")).alias("citation"))


def listing_with_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the name of their source, if there is one."""
    sources = table(spark, folder, "sources").select(F.col("id").alias("source_id"), "name")
    return table(spark, folder, "documents").select("doc_id", "source_id").join(sources, "source_id", "left").select("doc_id", "name")


def sources_with_chunks(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select(F.col("source_id").alias("id"))
    return table(spark, folder, "sources").join(chunks, "id", "left_semi").select("id", "name")


def ready_without_content(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that are ready and have neither chunks nor turns."""
    ready = table(spark, folder, "sources").where("status = 'ready'").select("id")
    for name in ("chunks", "turns"):
        ready = ready.join(table(spark, folder, name).select(F.col("source_id").alias("id")), "id", "left_anti")
    return ready


def answer_history(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that each answer was given, numbered from 1; those that are gone say so."""
    given = table(spark, folder, "qa_turns").select(F.col("id").alias("qa_id"), F.posexplode("source_chunk_ids").alias("n", "chunk_id"))
    chunks = table(spark, folder, "chunks").select(F.col("id").alias("chunk_id"), "source_id")
    names = table(spark, folder, "sources").select(F.col("id").alias("source_id"), "name")
    joined = given.join(chunks, "chunk_id", "left").join(names, "source_id", "left")
    return joined.select("qa_id", (F.col("n") + 1).alias("number"), "chunk_id", F.coalesce("name", F.lit("(removed from the library)")).alias("name"))


def pending_verification(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that cite fewer chunks than half of those they were given, declined ones aside, oldest first."""
    rows = table(spark, folder, "qa_turns").where(~X.declines(F.col("answer")))
    cited, given = F.coalesce(F.size("cited_chunk_ids"), F.lit(0)), F.coalesce(F.size("source_chunk_ids"), F.lit(0))
    return rows.where((given > 0) & (cited * 2 < given)).select("id", cited.alias("cited"), given.alias("given"))


def queue_pop(spark: SparkSession, folder: str) -> DataFrame:
    """The oldest queued source of each kind."""
    queued = table(spark, folder, "sources").where("status = 'queued'")
    return queued.groupBy("kind").agg(F.min(F.struct("added_at", "id")).alias("first")).select("kind", F.col("first.id").alias("id"))


def latest_events(spark: SparkSession, folder: str) -> DataFrame:
    """The last value of each key: an upsert of every event in order of time."""
    last = F.max_by(F.struct("event_id", "value"), F.struct("ts", "event_id"))
    return table(spark, folder, "events").groupBy("user_id", "event_type").agg(last.alias("last")).select("user_id", "event_type", "last.event_id", "last.value")


def event_properties(spark: SparkSession, folder: str) -> DataFrame:
    """A number from a JSON column, summed by type."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, folder, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count(k).alias("given"))


def named_or_queued(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that are queued or have a named speaker, each once."""
    queued = table(spark, folder, "sources").where("status = 'queued'").select("id")
    named = table(spark, folder, "speaker_names").select(F.col("source_id").alias("id"))
    return queued.union(named).distinct()


def element_classes(spark: SparkSession, folder: str) -> DataFrame:
    """How many chunks of each element hold a table row, and their sizes."""
    held = F.col("text").rlike(r"(?m)^\|.*\|")
    return table(spark, folder, "chunks").groupBy("element").agg(F.count("*").alias("chunks"), F.sum(held.cast("long")).alias("with_table"), F.sum(F.char_length("text").cast("long")).alias("characters"))


_CLOCK = "CASE WHEN {0} >= 3600 THEN (CAST(floor({0}) AS BIGINT) // 3600) || ':' || lpad(CAST(CAST(floor({0}) AS BIGINT) % 3600 // 60 AS VARCHAR), 2, '0') ELSE CAST(CAST(floor({0}) AS BIGINT) // 60 AS VARCHAR) END || ':' || lpad(CAST(CAST(floor({0}) AS BIGINT) % 60 AS VARCHAR), 2, '0')"

QUERIES = {
    "source_dedup": source_dedup, "library_listing": library_listing, "status_counts": status_counts, "chunk_citations": chunk_citations, "listing_with_sources": listing_with_sources,
    "sources_with_chunks": sources_with_chunks, "ready_without_content": ready_without_content, "answer_history": answer_history, "pending_verification": pending_verification,
    "queue_pop": queue_pop, "latest_events": latest_events, "event_properties": event_properties, "named_or_queued": named_or_queued, "element_classes": element_classes,
}
SQL = {
    "source_dedup": "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "library_listing": f"""
SELECT id, name, kind, status,
    CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN CAST(round(size_bytes / 1024.0) AS BIGINT) || ' KB' WHEN size_bytes < 1073741824 THEN CAST(round(size_bytes / 1048576.0) AS BIGINT) || ' MB' ELSE CAST(round(size_bytes / 1073741824.0) AS BIGINT) || ' GB' END AS size,
    strftime(added_at, '%Y-%m-%d %H:%M') AS added,
    coalesce(CASE WHEN kind = 'audio' THEN concat_ws(' · ', {_CLOCK.format("CAST(json_extract_string(info, '$.duration_s') AS DOUBLE)")}, json_extract_string(info, '$.speakers') || ' speakers') ELSE json_extract_string(info, '$.chunks') || ' chunks' END, '') AS contents
FROM sources""",
    "status_counts": "SELECT kind, status, count(*) AS sources, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM sources GROUP BY kind, status",
    "chunk_citations": f"""
SELECT c.id, concat_ws(' · ', name, CASE WHEN start_s IS NOT NULL THEN {_CLOCK.format("start_s")}
    WHEN (CASE WHEN coalesce(page_end, 0) = 0 THEN page_start ELSE page_end END) > page_start THEN 'pp. ' || page_start || '–' || page_end ELSE 'p. ' || page_start END) AS citation
FROM chunks c JOIN sources s ON s.id = c.source_id""",
    "listing_with_sources": "SELECT doc_id, name FROM documents d LEFT JOIN sources s ON s.id = d.source_id",
    "sources_with_chunks": "SELECT id, name FROM sources WHERE id IN (SELECT source_id FROM chunks)",
    "ready_without_content": "SELECT id FROM sources s WHERE status = 'ready' AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.source_id = s.id) AND NOT EXISTS (SELECT 1 FROM turns t WHERE t.source_id = s.id)",
    "answer_history": """
WITH given AS (
    SELECT id AS qa_id, unnest(source_chunk_ids) AS chunk_id, generate_subscripts(source_chunk_ids, 1) AS number FROM qa_turns
)
SELECT qa_id, CAST(number AS INT) AS number, chunk_id, coalesce(s.name, '(removed from the library)') AS name FROM given LEFT JOIN chunks c ON c.id = chunk_id LEFT JOIN sources s ON s.id = c.source_id""",
    "pending_verification": """
SELECT id, CAST(coalesce(len(cited_chunk_ids), 0) AS INT) AS cited, CAST(len(source_chunk_ids) AS INT) AS given FROM qa_turns
WHERE NOT coalesce(contains(lower(answer), 'not found in your documents'), false) AND len(source_chunk_ids) > 0 AND coalesce(len(cited_chunk_ids), 0) * 2 < len(source_chunk_ids)""",
    "queue_pop": "SELECT kind, arg_min(id, (added_at, id)) AS id FROM sources WHERE status = 'queued' GROUP BY kind",
    "latest_events": "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type",
    "event_properties": "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(json_extract_string(props, '$.k')) AS given FROM events GROUP BY event_type",
    "named_or_queued": "SELECT id FROM sources WHERE status = 'queued' UNION SELECT source_id FROM speaker_names",
    "element_classes": r"SELECT element, count(*) AS chunks, CAST(sum(CASE WHEN regexp_matches(text, '(?m)^\|.*\|') THEN 1 ELSE 0 END) AS BIGINT) AS with_table, CAST(sum(length(text)) AS BIGINT) AS characters FROM chunks GROUP BY element",
}
