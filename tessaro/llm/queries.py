"""The queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table
from .answers import defective_answers
from .leaks import leaked
from .quality import FEATURES, kinds_of_text, text_statistics
from .scans import repaired_paragraphs, scan_noise
from .splitting import split_oversized
from .tokens import encode_texts
from .transcripts import calibrated_turns, rolling_takes, speaker_turns


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Clean turns of every take."""
    return speaker_turns(*(table(spark, folder, name) for name in ("turns", "sources", "speaker_names")))


def _delivered(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with a start and a later end as they were delivered: the label as it is, every word of the text."""
    words = F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), " ")
    at = lambda c: F.round(F.col(c) * 100).cast("long")
    rows = table(spark, folder, "turns").select("turn_id", "source_id", "take", at("start_s").alias("start_cs"), at("end_s").alias("end_cs"), F.hash(F.coalesce("speaker", F.lit(""))).alias("speaker"), words.alias("words"))
    once = rows.where("end_cs > start_cs").groupBy("source_id", "take", "start_cs", "speaker", "words").agg(F.min("turn_id").alias("turn_id"), F.max("end_cs").alias("end_cs"), F.bool_or(F.col("words") != "").alias("said"))
    return once.where("said").drop("said")


def p2_paused(spark: SparkSession, folder: str) -> DataFrame:
    """Rows as delivered merged into turns, which end where the label changes or a pause is longer than nine tenths of all silences."""
    return calibrated_turns(_delivered(spark, folder)).drop("speaker")


def p2_rolling(spark: SparkSession, folder: str) -> DataFrame:
    """How many successive rows of each take repeat three words or more of the row before, as captions that roll up do."""
    return rolling_takes(_delivered(spark, folder))


_DELIVERED = r"""
WITH once AS (
    SELECT source_id, take, s, speaker, said, min(turn_id) AS id, max(e) AS e FROM (
        SELECT source_id, take, turn_id, CAST(round(start_s * 100) AS BIGINT) AS s, CAST(round(end_s * 100) AS BIGINT) AS e, coalesce(speaker, '') AS speaker, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS said FROM turns
    ) WHERE e > s AND len(said) > 0 GROUP BY ALL
), ordered AS (
    SELECT *, lag(speaker) OVER w AS last_speaker, lag(e) OVER w AS last_e, lag(said) OVER w AS last_said, max(e) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
    FROM once WINDOW w AS (PARTITION BY source_id, take ORDER BY s, id)
)"""
P2_PAUSED = _DELIVERED + """, pause AS (
    SELECT quantile_cont(s - reach, 0.9) AS pause FROM ordered WHERE s > reach
), numbered AS (
    SELECT *, sum(CASE WHEN last_speaker IS NULL OR last_speaker <> speaker OR s - last_e > pause THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, take ORDER BY s, id) AS turn FROM ordered, pause
)
SELECT source_id, take, min(s) AS start_cs, string_agg(array_to_string(said, ' '), ' ' ORDER BY s, id) AS words FROM numbered GROUP BY source_id, take, turn"""
P2_ROLLING = _DELIVERED + """, counted AS (
    SELECT *, list_max(list_filter(range(0, least(len(said), len(last_said)) + 1), lambda k: last_said[len(last_said) - k + 1:] = said[1:k])) AS again FROM ordered
)
SELECT source_id, take, CAST(count(last_speaker) AS BIGINT) AS pairs, CAST(count(*) FILTER (again >= 3 AND speaker = last_speaker AND s <= last_e) AS BIGINT) AS rolled FROM counted GROUP BY source_id, take"""


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of each oversized chunk."""
    return split_oversized(table(spark, folder, "chunks"), "text", ["id", "page_start", "start_s"]).withColumnRenamed("id", "chunk_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each oversized chunk and the coarsest boundary that suffices."""
    return p3_pieces(spark, folder).where("piece_no = 1").select("chunk_id", "boundary")


P3_FOUND = r"""
WITH long AS (
    SELECT id, text FROM chunks WHERE length(text) > 2000
), parts AS (
    SELECT id, 'paragraph' AS boundary, 1 AS rank, regexp_split_to_array(text, '\n[ \t\r]*\n\s*') AS part FROM long
    UNION ALL
    SELECT id, 'line', 2, regexp_split_to_array(text, '\n') FROM long
    UNION ALL
    SELECT id, 'sentence', 3, regexp_split_to_array(regexp_replace(text, '([.!?…]["”’»)\]]*)\s+', '\1' || chr(10), 'g'), '\n') FROM long
    UNION ALL
    SELECT id, 'word', 4, regexp_split_to_array(text, '\s+') FROM long
    UNION ALL
    SELECT id, 'none', 5, [''] FROM long
)
SELECT id AS chunk_id, arg_min(boundary, rank) AS boundary
FROM parts WHERE list_max(list_transform(part, lambda x: length(trim(x, ' ' || chr(10) || chr(13) || chr(9))))) <= 2000
GROUP BY id
"""


P3_PIECES = rf"""
WITH RECURSIVE big AS (
    SELECT id, page_start, start_s, text, length(text) AS n FROM chunks WHERE length(text) > 2000
), spaces AS (
    SELECT id, i, c, i - row_number() OVER (PARTITION BY id ORDER BY i) AS run FROM (SELECT id, i, substr(text, i, 1) AS c FROM (SELECT id, text, unnest(range(1, n + 1)) AS i FROM big)) WHERE regexp_matches(c, '[\s\p{{Z}}]')
), runs AS (
    SELECT r.id, s, e, CASE WHEN lines > 1 THEN 4 WHEN lines = 1 THEN 3 WHEN regexp_matches(substr(text, CAST(greatest(s - 3, 1) AS BIGINT), CAST(least(4, s) AS BIGINT)), '[.!?…]["\x27”’»)\]]*$') THEN 2 ELSE 1 END AS level
    FROM (SELECT id, min(i) - 1 AS s, max(i) AS e, count(*) FILTER (c = chr(10)) AS lines FROM spaces GROUP BY id, run) r JOIN big ON big.id = r.id
), parts AS (
    SELECT id, CAST(0 AS BIGINT) AS a, n AS b FROM big
    UNION ALL
    SELECT id, unnest([a, x]) AS a, unnest([x, b]) AS b FROM (
        SELECT p.id, p.a, p.b, coalesce(arg_min(e, (-level, abs(e - (p.a + p.b) // 2), e)), (p.a + p.b) // 2) AS x FROM parts p LEFT JOIN runs r ON r.id = p.id AND e > p.a AND e < p.b WHERE p.b - p.a > 1800 GROUP BY p.id, p.a, p.b
    )
), leaves AS (
    SELECT id, a, b, row_number() OVER w AS piece_no, lag(a) OVER w AS before FROM parts WHERE b - a <= 1800 WINDOW w AS (PARTITION BY id ORDER BY a)
), low AS (
    SELECT *, greatest(before, a - 200) AS low FROM leaves
), began AS (
    SELECT l.id, a, b, piece_no, CASE WHEN piece_no = 1 THEN a WHEN low > before AND NOT regexp_matches(substr(any_value(text), low, 1), '[\s\p{{Z}}]') AND min(e) FILTER (r.s >= low) < a THEN min(e) FILTER (r.s >= low) ELSE low END AS begin
    FROM low l JOIN big USING (id) LEFT JOIN runs r ON r.id = l.id GROUP BY l.id, a, b, piece_no, low, before
)
SELECT b.id AS chunk_id, page_start, start_s, CAST(piece_no AS INT) AS piece_no, substr(text, begin + 1, b.b - begin) AS piece, CAST(a - begin AS INT) AS repeated,
    CASE WHEN piece_no > 1 THEN coalesce(['word', 'sentence', 'line', 'paragraph'][level], 'none') END AS cut, boundary
FROM began b JOIN big USING (id) JOIN ({P3_FOUND}) f ON f.chunk_id = b.id LEFT JOIN runs r ON r.id = b.id AND r.e = b.a
"""


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each pair with a defective answer, and its defect."""
    return defective_answers(table(spark, folder, "qa_turns"), "id", "question", "answer", table(spark, folder, "common_words")).withColumnRenamed("id", "qa_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The noise of scanned pages, line by line."""
    return scan_noise(table(spark, folder, "document_results"), table(spark, folder, "document_texts"))


def p5_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """The paragraphs of scanned pages, repaired."""
    return repaired_paragraphs(table(spark, folder, "document_results"), table(spark, folder, "document_texts"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every document."""
    return encode_texts(table(spark, folder, "documents"), "doc_id", "text")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each document with the evaluation items of which it holds twelve successive words."""
    return leaked(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "text")


def p7_items(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents each leaked evaluation item reached."""
    return p7_found(spark, folder).groupBy("item_id").agg(F.count("*").alias("documents"))


P7_FOUND = r"""
WITH said AS (
    SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
), wanted AS (
    SELECT item_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL
), runs AS (
    SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: array_to_string(w[i:i + 11], ' '))) AS run FROM wanted
), held AS (
    SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 10, 1)), lambda i: array_to_string(w[i:i + 11], ' '))) AS run FROM said
)
SELECT DISTINCT doc_id, item_id FROM held JOIN runs USING (run)
"""


def p8_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of each document with a visible character."""
    return text_statistics(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "common_words")).select("doc_id", *FEATURES)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each document that is a list, a table or junk."""
    return kinds_of_text(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "common_words")).where("kind <> 'prose'").select("doc_id", "kind")


QUERIES = {"p2_found": p2_found, "p2_paused": p2_paused, "p2_rolling": p2_rolling, "p3_found": p3_found, "p3_pieces": p3_pieces, "p4_found": p4_found, "p5_found": p5_found, "p5_paragraphs": p5_paragraphs, "p6_ids": p6_ids, "p7_found": p7_found, "p7_items": p7_items, "p8_found": p8_found, "p8_statistics": p8_statistics}
SQL = {"p2_paused": P2_PAUSED, "p2_rolling": P2_ROLLING, "p3_found": P3_FOUND, "p3_pieces": P3_PIECES, "p7_found": P7_FOUND, "p7_items": f"SELECT item_id, count(*) AS documents FROM ({P7_FOUND}) GROUP BY item_id"}
