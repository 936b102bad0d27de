"""Queries that split and merge the chunks of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.chunking import cells_of, empty_grid, merged_under_heading, split_chunks, split_tables
from .tables import table

LIMIT = 900
TARGET = 1100


def table_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The tables among the chunks, split by rows."""
    rows = table(spark, folder, "chunks").where("element IN ('table', 'chart')")
    return split_tables(rows, ["id"], "text", LIMIT)


def chunk_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk split: tables by rows, text by sentences."""
    parts = split_chunks(table(spark, folder, "chunks"), ["id", "page_start", "page_end"], "text", "element", LIMIT)
    return parts.select("id", "part_no", "page_start", "page_end", F.char_length("part").cast("long").alias("characters"), F.sha2(F.encode("part", "utf-8"), 256).alias("hash"))


def heading_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Successive chunks of text under one heading, merged."""
    merged = merged_under_heading(table(spark, folder, "chunks"), "source_id", ["seq", "id"], "text", "element", "context", TARGET)
    return merged.select("source_id", "run", "part_no", "element", F.char_length("part").cast("long").alias("characters"), F.sha2(F.encode("part", "utf-8"), 256).alias("hash"))


def empty_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The Markdown tables in chunks, their rows and cells, and whether all cells are blank."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.startswith("|") & ~x.rlike(r"^[|:\- ]+$"))
    grid = F.transform(lines, cells_of)
    rows = table(spark, folder, "chunks").where(F.contains("text", F.lit("|"))).select("id", grid.alias("grid")).where(F.size("grid") > 0)
    return rows.select("id", F.size("grid").alias("rows"), F.size(F.flatten("grid")).alias("cells"), empty_grid(F.col("grid")).alias("blank"))


_CELLS = r"list_transform(string_split(regexp_replace(trim({0}, ' '), '^\|+|\|+$', '', 'g'), '|'), lambda c: trim(c, ' '))"
_LABELS = "(len({0}) > 1 AND {0}[1] <> '' AND len(list_distinct({0})) = 1 AND NOT regexp_matches({0}[1], '^[-+()$%.,0-9\\s]+$'))"
_TABLES = rf"""
WITH RECURSIVE given AS (
    SELECT id, text, string_split(text, chr(10)) AS lines FROM chunks WHERE element IN ('table', 'chart') AND text IS NOT NULL
), topped AS (
    SELECT *, coalesce(nullif(list_position(list_transform(lines, lambda x: starts_with(x, '|')), true), 0), 1) AS t FROM given WHERE length(text) > {LIMIT}
), headed AS (
    SELECT id, lines, CASE WHEN len(lines) > t + 1 AND regexp_matches(lines[t + 1], '^[|: -]*$') THEN t + 1 ELSE t END AS n FROM topped
), body AS (
    SELECT id, n, lines, array_to_string(lines[1:n], chr(10)) AS head FROM headed
), steps AS (
    SELECT id, CAST(0 AS BIGINT) AS i, CAST(1 AS BIGINT) AS part_no, CAST(length(head) AS BIGINT) AS used, CAST(0 AS BIGINT) AS held, CAST(NULL AS VARCHAR) AS section, false AS fresh, CAST(NULL AS VARCHAR) AS repeated FROM body
    UNION ALL
    SELECT id, i, part_no + CAST(breaks AS BIGINT),
        CASE WHEN breaks THEN h + CASE WHEN section IS NOT NULL AND NOT labels THEN length(section) + 1 ELSE 0 END ELSE used END + length(line) + 1,
        CASE WHEN breaks THEN 1 ELSE held + 1 END, CASE WHEN labels THEN line ELSE section END, breaks, CASE WHEN breaks AND NOT labels THEN section END
    FROM (
        SELECT *, held > 0 AND used + length(line) + 1 > {LIMIT} AS breaks, {_LABELS.format("cells")} AS labels
        FROM (SELECT s.id, s.i + 1 AS i, part_no, used, held, section, length(head) AS h, lines[n + s.i + 1] AS line, {_CELLS.format("lines[n + s.i + 1]")} AS cells FROM steps s JOIN body b ON b.id = s.id WHERE s.i < len(lines) - n)
    )
), rows AS (
    SELECT s.id, part_no, i, fresh, repeated, lines[n + i] AS line, head FROM steps s JOIN body b ON b.id = s.id WHERE i > 0
), parts AS (
    SELECT id, CAST(part_no AS INT) AS part_no, any_value(head) || coalesce(chr(10) || max(repeated), '') || chr(10) || string_agg(line, chr(10) ORDER BY i) AS part, max(repeated) IS NOT NULL AS goes_on FROM rows GROUP BY id, part_no
    UNION ALL
    SELECT id, 1, head, false FROM body WHERE len(lines) <= n
    UNION ALL
    SELECT id, 1, text, false FROM given WHERE length(text) <= {LIMIT}
)"""
_PACK = "list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({0}, lambda x: [x])), lambda a, x: CASE WHEN len(a) > 0 AND length(a[-1]) + {2} + length(x[1]) <= {1} THEN list_append(a[:-2], a[-1] || {3} || x[1]) ELSE list_append(a, x[1]) END)"

QUERIES = {"table_chunks": table_chunks, "chunk_parts": chunk_parts, "heading_chunks": heading_chunks, "empty_tables": empty_tables}
SQL = {
    "table_chunks": _TABLES + " SELECT id, part_no, part, goes_on FROM parts",
    "chunk_parts": _TABLES
    + rf""", texts AS (
    SELECT id, CASE WHEN length(text) <= {LIMIT} THEN [text] ELSE string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)) END AS s FROM chunks WHERE text IS NOT NULL AND coalesce(element, '') NOT IN ('table', 'chart')
), cut AS (
    SELECT id, list_filter(flatten(list_transform(s, lambda x: list_transform(range(0, (greatest(length(x), 1) - 1) // {LIMIT} + 1), lambda i: substr(x, i * {LIMIT} + 1, {LIMIT})))), lambda x: x <> '' OR len(s) = 1) AS s FROM texts
), packed AS (
    SELECT id, {_PACK.format("s", LIMIT, 1, "' '")} AS p FROM cut
), every AS (
    SELECT id, part_no, part FROM parts UNION ALL SELECT id, CAST(generate_subscripts(p, 1) AS INT), unnest(p) FROM packed
)
SELECT id, part_no, page_start, page_end, length(part) AS characters, sha256(part) AS hash FROM every JOIN chunks USING (id)""",
    "heading_chunks": rf"""
WITH p AS (
    SELECT source_id, seq, id, text, element, context, CASE WHEN element = 'text' AND lag(element) OVER w = 'text' AND context IS NOT DISTINCT FROM lag(context) OVER w THEN 0 ELSE 1 END AS new
    FROM chunks WHERE text IS NOT NULL WINDOW w AS (PARTITION BY source_id ORDER BY seq, id)
), r AS (
    SELECT *, sum(new) OVER (PARTITION BY source_id ORDER BY seq, id) AS run FROM p
), g AS (
    SELECT source_id, run, any_value(element) AS element, list(text ORDER BY seq, id) AS s FROM r GROUP BY source_id, run
), k AS (
    SELECT source_id, run, element, {_PACK.format("s", TARGET, 2, "chr(10) || chr(10)")} AS p FROM g
), u AS (
    SELECT source_id, run, element, CAST(generate_subscripts(p, 1) AS INT) AS part_no, unnest(p) AS part FROM k
)
SELECT source_id, CAST(run AS BIGINT) AS run, part_no, element, length(part) AS characters, sha256(part) AS hash FROM u""",
    "empty_tables": rf"""
WITH l AS (
    SELECT id, list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '|') AND NOT regexp_matches(x, '^[|:\- ]+$')) AS lines FROM chunks WHERE contains(text, '|')
), g AS (
    SELECT id, list_transform(lines, lambda x: {_CELLS.format("x")}) AS grid FROM l WHERE len(lines) > 0
)
SELECT id, CAST(len(grid) AS INT) AS rows, CAST(len(flatten(grid)) AS INT) AS cells, len(list_filter(flatten(grid), lambda c: c <> '')) = 0 AS blank FROM g""",
}
