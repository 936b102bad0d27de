"""Queries that parse and check texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .tables import table


def answer_citations(spark: SparkSession, folder: str) -> DataFrame:
    """The source numbers that each answer cites."""
    return table(spark, folder, "qa_turns").where("answer IS NOT NULL").select("id", F.array_join(X.citations(F.col("answer")).cast("array<string>"), ",").alias("cited"))


def declined_answers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "qa_turns").select("id", X.declines(F.col("answer")).alias("declines"))


def document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """The approximate number of tokens of each document."""
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", X.token_count(F.col("text")).alias("tokens"))


def document_dates(spark: SparkSession, folder: str) -> DataFrame:
    """The ISO dates in each document."""
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.array_join(X.iso_dates(F.col("text")), ",").alias("dates"))


def cited_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Every amount of money in an answer, as written and as a number."""
    found = F.regexp_extract_all("answer", F.lit(r"((?:[€$£][0-9][0-9.,]*[0-9]|[€$£][0-9]|[0-9][0-9.,]*[0-9] €|[0-9] €))"), F.lit(1))
    rows = table(spark, folder, "qa_turns").select("id", F.explode(found).alias("written"))
    return rows.select("id", "written", X.amount(F.col("written")).alias("amount"))


def stemmed_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """Words of the questions by their stem."""
    words = F.explode(F.regexp_extract_all(F.lower("question"), F.lit(r"(\p{L}{4,})"), F.lit(1))).alias("word")
    rows = table(spark, folder, "qa_turns").select(words).where(F.col("word").rlike("^[a-z]+$"))
    return rows.groupBy(X.stem(F.col("word")).alias("stem")).agg(F.count("*").alias("words"), F.count_distinct("word").alias("forms"))


def page_loops(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of ten lines or more of which one line makes up three in ten or more."""
    rows = table(spark, folder, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"[\p{L}\p{N}]"))
    counted = rows.groupBy("doc_id", "line").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("lines"), F.max("n").alias("most"))
    return counted.where((F.col("lines") >= 10) & (F.col("most") >= 0.3 * F.col("lines")))


def sparse_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with fewer than forty distinct words of two letters or more."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{2,})"), F.lit(1)))
    rows = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.size(words).alias("words"))
    return rows.where("words < 40")


def table_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the Markdown tables in chunks, with how many cells they have; rules left out."""
    lines = table(spark, folder, "chunks").select("id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = lines.where(F.col("line").rlike(r"^\|.*\|$") & ~F.col("line").rlike(r"^[|:\- ]+$"))
    return rows.select("id", "line_no", (F.size(F.split("line", r"\|")) - 2).alias("cells"))


def criterion_ids(spark: SparkSession, folder: str) -> DataFrame:
    """A short id of each question's text, whatever its white space."""
    plain = F.trim(F.regexp_replace("question", r"[ \t\r\n]+", " "))
    return table(spark, folder, "qa_turns").where("question IS NOT NULL").select("id", F.concat(F.lit("summary:"), F.substring(F.sha2(F.encode(plain, "utf-8"), 256), 1, 12)).alias("criterion"))


def keyword_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """The share of a question's words of three letters or more that its answer takes up."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}{3,})"), F.lit(1)))
    rows = table(spark, folder, "qa_turns").where("question IS NOT NULL AND answer IS NOT NULL").select("id", words("question").alias("q"), words("answer").alias("a"))
    return rows.where(F.size("q") > 0).select("id", F.round(F.size(F.array_intersect("q", "a")) / F.size("q"), 4).alias("overlap"))


_LIST = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"

QUERIES = {
    "answer_citations": answer_citations, "declined_answers": declined_answers, "document_tokens": document_tokens, "document_dates": document_dates, "cited_amounts": cited_amounts,
    "stemmed_vocabulary": stemmed_vocabulary, "page_loops": page_loops, "sparse_documents": sparse_documents, "table_rows": table_rows, "criterion_ids": criterion_ids, "keyword_overlap": keyword_overlap,
}
SQL = {
    "stemmed_vocabulary": f"""
WITH w AS (
    SELECT unnest(regexp_extract_all(lower(question), '\\p{{L}}{{4,}}')) AS word FROM qa_turns
)
SELECT {X.stem_sql("word")} AS stem, count(*) AS words, count(DISTINCT word) AS forms FROM w WHERE regexp_matches(word, '^[a-z]+$') GROUP BY 1""",
    "answer_citations": r"""
WITH marks AS (
    SELECT id, regexp_extract_all(answer, '\[([0-9]+(?:\s*[,/–-]\s*[0-9]+)*)\]', 1) AS m FROM qa_turns WHERE answer IS NOT NULL
), numbers AS (
    SELECT id, flatten(list_transform(m, lambda x: flatten(list_transform(regexp_split_to_array(x, '\s*[,/]\s*'), lambda p: range(CAST(regexp_split_to_array(p, '\s*[–-]\s*')[1] AS BIGINT), CAST(regexp_split_to_array(p, '\s*[–-]\s*')[-1] AS BIGINT) + 1))))) AS n FROM marks
)
SELECT id, array_to_string(list_filter(n, lambda x, i: list_position(n, x) = i), ',') AS cited FROM numbers""",
    "declined_answers": "SELECT id, coalesce(contains(lower(answer), 'not found in your documents'), false) AS declines FROM qa_turns",
    "document_tokens": "SELECT doc_id, CAST(floor(length(text) / 3.0) + 1 AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL",
    "document_dates": rf"""
WITH d AS (
    SELECT doc_id, list_filter(regexp_extract_all(text, '\b([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})\b', 1), lambda x: try_cast(x AS DATE) IS NOT NULL) AS n FROM documents WHERE text IS NOT NULL
)
SELECT doc_id, array_to_string({_LIST.format("n")}, ',') AS dates FROM d""",
    "cited_amounts": r"""
WITH w AS (
    SELECT id, unnest(regexp_extract_all(answer, '(?:[€$£][0-9][0-9.,]*[0-9]|[€$£][0-9]|[0-9][0-9.,]*[0-9] €|[0-9] €)')) AS written FROM qa_turns
), d AS (
    SELECT *, regexp_replace(written, '[^0-9.,-]', '', 'g') AS n FROM w
)
SELECT id, written, CAST(CASE
    WHEN contains(n, '.') AND contains(n, ',') AND instr(reverse(n), ',') < instr(reverse(n), '.') THEN replace(replace(n, '.', ''), ',', '.')
    WHEN contains(n, '.') AND contains(n, ',') THEN replace(n, ',', '')
    WHEN regexp_matches(n, '^-?[0-9]{1,3}(?:[.,][0-9]{3})+$') THEN regexp_replace(n, '[.,]', '', 'g')
    ELSE replace(n, ',', '.') END AS DOUBLE) AS amount FROM d""",
    "page_loops": r"""
WITH l AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents
), c AS (
    SELECT doc_id, line, count(*) AS n FROM l WHERE regexp_matches(line, '[\p{L}\p{N}]') GROUP BY ALL
)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS lines, max(n) AS most FROM c GROUP BY doc_id HAVING sum(n) >= 10 AND max(n) >= 0.3 * sum(n)""",
    "sparse_documents": r"SELECT * FROM (SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(text), '\p{L}{2,}'))) AS INT) AS words FROM documents WHERE text IS NOT NULL) WHERE words < 40",
    "table_rows": r"""
WITH l AS (
    SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM chunks
)
SELECT id, CAST(line_no AS INT) AS line_no, CAST(len(string_split(line, '|')) - 2 AS INT) AS cells FROM l WHERE regexp_matches(line, '^\|.*\|$') AND NOT regexp_matches(line, '^[|:\- ]+$')""",
    "criterion_ids": r"SELECT id, 'summary:' || substr(sha256(trim(regexp_replace(question, '[ \t\r\n]+', ' ', 'g'), ' ')), 1, 12) AS criterion FROM qa_turns WHERE question IS NOT NULL",
    "keyword_overlap": r"""
WITH w AS (
    SELECT id, list_distinct(regexp_extract_all(lower(question), '\p{L}{3,}')) AS q, list_distinct(regexp_extract_all(lower(answer), '\p{L}{3,}')) AS a FROM qa_turns WHERE question IS NOT NULL AND answer IS NOT NULL
)
SELECT id, round(len(list_intersect(q, a)) / len(q), 4) AS overlap FROM w WHERE len(q) > 0""",
}
