"""Queries that pack, sample, match and check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.packing import fitting, packed
from ..operators.search import held_by_any, ranked
from .tables import table

# English months.
MONTHS = "January February March April May June July August September October November December".split()
_MONTH = "|".join(MONTHS)


def sentence_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of each document packed into parts of at most 1,100 characters; longer sentences stay whole."""
    marked = F.regexp_replace("text", r"([.!?])[ \t\r\n]+", "$1\u0001")
    sentences = F.filter(F.split(marked, "\u0001"), lambda x: F.trim(x) != "")
    rows = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", packed(sentences, 1100).alias("parts"))
    return rows.select("doc_id", F.posexplode("parts").alias("part_no", "part")).select("doc_id", "part_no", F.char_length("part").cast("long").alias("characters"), F.sha2(F.encode("part", "utf-8"), 256).alias("hash"))


def prompt_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Which of the chunks given to an answer fit into 600 tokens, in their order, and how many are dropped."""
    given = table(spark, folder, "qa_turns").select("id", F.posexplode("source_chunk_ids").alias("n", "chunk_id"))
    costs = table(spark, folder, "chunks").select(F.col("id").alias("chunk_id"), X.token_count(F.coalesce("text", F.lit(""))).alias("cost"))
    rows = given.join(costs, "chunk_id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "cost"))).alias("c"))
    kept = fitting(F.col("c.cost"), 600)
    return rows.select("id", F.size(kept).alias("kept"), (F.size("c") - F.size(kept)).alias("dropped"))


def textual_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Dates written with an English month and a year, as ISO dates."""
    found = F.explode(F.regexp_extract_all("text", F.lit(rf"\b((?:{_MONTH}) [0-9]{{1,2}}, [0-9]{{4}})\b"), F.lit(1))).alias("written")
    rows = table(spark, folder, "documents").select("doc_id", found).distinct()
    return rows.select("doc_id", "written", F.date_format(F.try_to_date("written", "MMMM d, yyyy"), "yyyy-MM-dd").alias("iso"))


def order_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Orders whose total isn't the sum of their lines, by status."""
    parts = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("parts")
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(parts)
    rows = table(spark, folder, "orders").join(lines, "o_orderkey", "left")
    wrong = F.coalesce(F.abs(F.col("o_totalprice") - F.col("parts")) > 0.01, F.lit(False))
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.sum(wrong.cast("long")).alias("wrong"), F.count_if(F.col("parts").isNull()).alias("unchecked"))


def answer_history_tail(spark: SparkSession, folder: str) -> DataFrame:
    """The last three questions to each model."""
    rows = table(spark, folder, "qa_turns").select("model", "id", "created_at")
    return ranked(rows, "model", [F.desc("created_at"), F.desc("id")], 3).select("model", "id", "rank")


def control_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Every tenth answer by the hash of its id, a sample that stays the same: for review."""
    digit = F.conv(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 4), 16, 10).cast("int")
    return table(spark, folder, "qa_turns").where(digit % 10 == 0).select("id", F.when(digit % 20 == 0, "number").otherwise("swap").alias("control"))


def fuzzy_speaker_names(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of turns that name a speaker of their source with at most two letters wrong."""
    labels = table(spark, folder, "turns").select("source_id", F.lower(F.trim("speaker")).alias("label")).where("label <> ''").distinct()
    names = table(spark, folder, "speaker_names").select("source_id", F.lower(F.trim("name")).alias("name"))
    rows = labels.join(names, "source_id").withColumn("distance", F.levenshtein("label", "name"))
    return rows.where((F.col("distance") <= 2) & (F.char_length("name") > 4))


def search_trace(spark: SparkSession, folder: str) -> DataFrame:
    """How many chunks hold any term of each fiftieth question, and the most that any of its terms occurs."""
    asked = table(spark, folder, "qa_turns").where("id % 50 = 0").select(F.col("id").alias("qa_id"), "question")
    found = held_by_any(table(spark, folder, "chunks"), X.search_terms(F.lower("text")), asked, "qa_id", X.search_terms(F.lower("question")))
    return found.withColumnRenamed("documents", "chunks")


def incremental_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by month of arrival: how many contents are new in it and how many were there before."""
    rows = table(spark, folder, "documents").where("text IS NOT NULL").select(F.xxhash64("text").alias("h"), F.date_format("ingested_at", "yyyy-MM").alias("month"))
    first = rows.groupBy("h").agg(F.min("month").alias("first"))
    counted = rows.groupBy("h", "month").agg(F.count("*").alias("n")).join(first, "h")
    return counted.groupBy("month").agg(F.sum(F.when(F.col("month") == F.col("first"), 1).otherwise(0)).cast("long").alias("new"), F.sum("n").alias("documents"))


_TERMS = r"list_filter(string_split(array_to_string(list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_./-]+'), lambda r: CASE WHEN regexp_matches(r, '[0-9]') THEN regexp_replace(r, '^[-_./]+|[-_./]+$', '', 'g') ELSE trim(regexp_replace(r, '[-_./]+', ' ', 'g')) END), ' '), ' '), lambda x: x <> '')"
_DIGIT = "CAST('0x' || substr(sha256(CAST(id AS VARCHAR)), 1, 4) AS INT)"

QUERIES = {
    "sentence_chunks": sentence_chunks, "prompt_packing": prompt_packing, "textual_dates": textual_dates, "order_sums": order_sums, "answer_history_tail": answer_history_tail,
    "control_sample": control_sample, "fuzzy_speaker_names": fuzzy_speaker_names, "search_trace": search_trace, "incremental_documents": incremental_documents,
}
SQL = {
    "sentence_chunks": r"""
WITH s AS (
    SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ') <> '') AS s FROM documents WHERE text IS NOT NULL
), p AS (
    SELECT doc_id, list_reduce(s, lambda a, x: CASE WHEN len(a) > 0 AND length(a[-1]) + 1 + length(x[1]) <= 1100 THEN list_append(a[:-2], a[-1] || ' ' || x[1]) ELSE list_append(a, x[1]) END, CAST([] AS VARCHAR[])) AS parts
    FROM (SELECT doc_id, list_transform(s, lambda x: [x]) AS s FROM s)
)
SELECT doc_id, CAST(n AS INT) AS part_no, length(part) AS characters, sha256(part) AS hash FROM (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS n FROM p)""",
    "prompt_packing": """
WITH given AS (
    SELECT id, unnest(source_chunk_ids) AS chunk_id, generate_subscripts(source_chunk_ids, 1) AS n FROM qa_turns
), c AS (
    SELECT g.id, list(CAST(floor(length(coalesce(text, '')) / 3.0) + 1 AS BIGINT) ORDER BY n) AS c FROM given g JOIN chunks k ON k.id = chunk_id GROUP BY g.id
), f AS (
    SELECT id, c, list_reduce(list_transform(c, lambda x: [x, 0]), lambda a, x: CASE WHEN a[1] + x[1] <= 600 THEN [a[1] + x[1], a[2] + 1] ELSE a END, CAST([0, 0] AS BIGINT[])) AS r FROM c
)
SELECT id, CAST(r[2] AS INT) AS kept, CAST(len(c) - r[2] AS INT) AS dropped FROM f""",
    "textual_dates": rf"""
SELECT DISTINCT doc_id, written, strftime(try_strptime(written, '%B %-d, %Y'), '%Y-%m-%d') AS iso
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b((?:{_MONTH}) [0-9]{{1,2}}, [0-9]{{4}})\b', 1)) AS written FROM documents)""",
    "order_sums": """
WITH l AS (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS parts FROM lineitem GROUP BY l_orderkey)
SELECT o_orderstatus, count(*) AS orders, CAST(sum(CASE WHEN abs(o_totalprice - parts) > 0.01 THEN 1 ELSE 0 END) AS BIGINT) AS wrong, count(*) FILTER (parts IS NULL) AS unchecked FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY o_orderstatus""",
    "answer_history_tail": "SELECT model, id, CAST(row_number() OVER (PARTITION BY model ORDER BY created_at DESC, id DESC) AS INT) AS rank FROM qa_turns QUALIFY rank <= 3",
    "control_sample": f"SELECT id, CASE WHEN {_DIGIT} % 20 = 0 THEN 'number' ELSE 'swap' END AS control FROM qa_turns WHERE {_DIGIT} % 10 = 0",
    "fuzzy_speaker_names": """
WITH l AS (SELECT DISTINCT source_id, lower(trim(speaker, ' ')) AS label FROM turns WHERE trim(speaker, ' ') <> ''), n AS (SELECT source_id, lower(trim(name, ' ')) AS name FROM speaker_names)
SELECT source_id, label, name, CAST(levenshtein(label, name) AS INT) AS distance FROM l JOIN n USING (source_id) WHERE levenshtein(label, name) <= 2 AND length(name) > 4""",
    "search_trace": f"""
WITH a AS (SELECT DISTINCT id AS qa_id, unnest({_TERMS.format("lower(question)")}) AS term FROM qa_turns WHERE id % 50 = 0), h AS (
    SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_TERMS.format("lower(text)")}) AS term FROM chunks) GROUP BY ALL
)
SELECT qa_id, count(DISTINCT id) AS chunks, max(tf) AS most FROM a JOIN h USING (term) GROUP BY qa_id""",
    "incremental_documents": """
WITH r AS (SELECT text, strftime(ingested_at, '%Y-%m') AS month FROM documents WHERE text IS NOT NULL), f AS (SELECT text, min(month) AS first FROM r GROUP BY text)
SELECT month, count(DISTINCT CASE WHEN month = first THEN text END) AS new, count(*) AS documents FROM r JOIN f USING (text) GROUP BY month""",
}
