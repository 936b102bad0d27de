"""Queries that list, check and rewrite what the library holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.speech import word_error_rate
from ..operators import metrics as M
from ..operators.intervals import periods_and_gaps
from ..operators.pauses import pause_chunks as split_at_pauses
from ..operators.search import ranked
from ..operators.segments import with_previous
from .sequence import PAD, _timed
from .tables import table

MOST, OVERLAP = 3000, 100
BUDGET = 8 << 20
_NUMBER = r"(?s)^(.*?(?:^|[^\w\[.,-]))(\d{1,3}(?:,\d{3})+|\d+)(\.\d+)?((?:[^\w\].,-].*|[.,-](?:[^\d].*)?)?)$"


def pause_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The speech of each take in parts of at most 30 s, split at the longest pauses."""
    spans = _timed(spark, folder, "spans", "span_id").where("end_cs > start_cs")
    padded = spans.select("source_id", "take", F.greatest(F.col("start_cs") - PAD, F.lit(0)).alias("start_cs"), (F.col("end_cs") + PAD).alias("end_cs"))
    merged = periods_and_gaps(padded, ["source_id", "take"], "start_cs", "end_cs").where("kind = 'period'")
    return split_at_pauses(merged, ["source_id", "take"], "start_cs", "end_cs", MOST, OVERLAP)


def answer_variation(spark: SparkSession, folder: str) -> DataFrame:
    """How far the words of each answer differ from those of the answer before to the same question."""
    rows = table(spark, folder, "qa_turns").where("question IS NOT NULL").select("question", "id", "answer")
    pairs = with_previous(rows, ["question"], ["id"], ["id", "answer"]).where("_previous IS NOT NULL")
    return pairs.select("id", F.col("_previous.id").alias("before"), F.round(word_error_rate(F.col("_previous.answer"), F.col("answer")), 4).alias("wer"))


def info_objects(spark: SparkSession, folder: str) -> DataFrame:
    """The object in each source's info, from the first brace to the last: its fields with a value, and those without one."""
    body = F.regexp_extract("info", r"(?s)(\{.*\})", 1)
    given = F.from_json(body, "map<string,string>")
    rows = table(spark, folder, "sources").where("info IS NOT NULL").select("id", given.alias("m")).where("m IS NOT NULL")
    keys = lambda test: F.array_join(F.array_sort(F.map_keys(F.map_filter("m", test))), ",")
    return rows.select("id", keys(lambda k, v: v.isNotNull()).alias("given"), keys(lambda k, v: v.isNull()).alias("missing"))


def first_values(spark: SparkSession, folder: str) -> DataFrame:
    """The first text under each label of each document, by page and place."""
    rows = table(spark, folder, "document_texts").where("text IS NOT NULL AND trim(text) <> ''")
    first = rows.groupBy("source_id", F.coalesce("label", F.lit("none")).alias("label")).agg(F.min_by(F.struct("item_no", "page_no", "text"), F.struct(F.coalesce("page_no", F.lit(1 << 30)), "item_no")).alias("f"))
    return first.select("source_id", "label", "f.item_no", "f.page_no", F.sha2(F.encode("f.text", "utf-8"), 256).alias("hash"))


def corrupted_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Each answer with its first number outside citations made plainly wrong: three or 37 in a hundred more, whichever is more, grouped as it was."""
    part = lambda i: F.regexp_extract("answer", _NUMBER, i)
    rows = table(spark, folder, "qa_turns").where(F.col("answer").rlike(_NUMBER)).select("id", part(1).alias("a"), part(2).alias("n"), part(3).alias("d"), part(4).alias("z"))
    value = F.regexp_replace("n", ",", "").cast("decimal(20,0)").cast("long")
    wrong = value + F.greatest(F.lit(3), F.floor(value * 0.37 + 0.5).cast("long"))
    shown = F.when(F.contains("n", F.lit(",")), F.format_number(wrong, 0)).otherwise(wrong.cast("string"))
    return rows.where(F.length("n") < 15).select("id", F.concat("a", shown, "d", "z").alias("wrong"))


def agreement_summary(spark: SparkSession, folder: str) -> DataFrame:
    """How well the flag agrees with the decline phrase: by model and over all."""
    said = F.when(F.col("answer").isNotNull(), X.declines(F.col("answer")))
    rows = table(spark, folder, "qa_turns").select("declined", said.alias("said"), F.explode(F.array_distinct(F.array(F.lit("all"), F.coalesce("model", F.lit("none"))))).alias("part"))
    return M.agreement(rows, ["part"], F.col("declined"), F.col("said"))


def metric_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Every metric of each model before and from the middle of the answers' ids on, and whether it got worse; counts never do."""
    rows = table(spark, folder, "qa_turns")
    middle = rows.agg((F.floor((F.min("id") + F.max("id")) / 2)).alias("middle"))
    found, wanted = F.col("source_chunk_ids"), F.col("cited_chunk_ids")
    names = ("n_answers", "recall", "mrr", "declined", "tokens")
    half = rows.join(F.broadcast(middle), F.lit(True)).withColumn("late", F.col("id") > F.col("middle"))
    by = half.groupBy("model", "late").agg(
        F.count("*").cast("double").alias("n_answers"), F.round(F.avg(M.recall_at_k(found, wanted, 3)), 4).alias("recall"), F.round(F.avg(M.reciprocal_rank(found, wanted, 3)), 4).alias("mrr"),
        F.round(F.avg(X.declines(F.col("answer")).cast("int")), 4).alias("declined"), F.round(F.avg("completion_tokens"), 4).alias("tokens"),
    )
    long = by.select("model", "late", F.explode(F.create_map(*(x for n in names for x in (F.lit(n), F.col(n))))).alias("metric", "value"))
    sides = long.groupBy("model", "metric").agg(F.max(F.when(~F.col("late"), F.col("value"))).alias("before"), F.max(F.when(F.col("late"), F.col("value"))).alias("after"))
    delta = F.round(F.col("after") - F.col("before"), 4)
    worse = F.when(F.col("metric") == "n_answers", False).when(F.col("metric").isin("tokens", "declined"), delta >= 0.02).otherwise(delta <= -0.02)
    return sides.select("model", "metric", "before", "after", delta.alias("delta"), F.coalesce(worse, F.lit(False)).alias("regression"))


def recent_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The twenty sources that come first in the list of each kind: those at work before the others, then the newest."""
    busy = F.col("status").isin("queued", "processing")
    rows = table(spark, folder, "sources").select("id", "kind", "name", "status")
    return ranked(rows, "kind", [busy.desc(), F.desc("id")], 20)


def reference_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The answers that each chunk was given to or cited by, by kind, in order."""
    answers = table(spark, folder, "qa_turns")
    one = lambda column, kind: answers.select(F.explode(column).alias("chunk_id"), F.lit(kind).alias("kind"), "id")
    return one("source_chunk_ids", "given").unionByName(one("cited_chunk_ids", "cited")).groupBy("chunk_id", "kind").agg(F.array_join(F.array_sort(F.collect_set("id")).cast("array<string>"), ",").alias("answers"))


def size_budget(spark: SparkSession, folder: str) -> DataFrame:
    """The largest source of each kind and file type against a limit of 8 MB."""
    peak = table(spark, folder, "sources").groupBy("kind", "ext").agg(F.max("size_bytes").alias("peak"))
    return peak.select("kind", "ext", "peak", (F.lit(BUDGET) - F.col("peak")).alias("headroom"), (F.col("peak") <= BUDGET).alias("within"))


def answer_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Answers for display: dollar signs escaped, citations set apart, and a short form that ends with a word."""
    safe = F.regexp_replace(F.replace("answer", F.lit("$"), F.lit("\\$")), r"\[(\d+)\]", "`$1`")
    flat = F.trim(F.regexp_replace("answer", r"[ \t\r\n]+", " "))
    cut = F.regexp_replace(F.substring(flat, 1, 60), r" [^ ]*$", "")
    short = F.when(F.char_length(flat) <= 60, flat).otherwise(F.concat(cut, F.lit("…")))
    return table(spark, folder, "qa_turns").where("answer IS NOT NULL").select("id", safe.alias("shown"), short.alias("short"))


def html_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The HTML tables in documents, with their rows and cells."""
    found = F.posexplode(F.regexp_extract_all("text", F.lit(r"(?is)(<table\b.*?</table>)"), F.lit(1))).alias("table_no", "t")
    rows = table(spark, folder, "documents").where(F.contains("text", F.lit("<table"))).select("doc_id", found)
    return rows.select("doc_id", "table_no", F.regexp_count("t", F.lit(r"(?i)<tr\b")).alias("rows"), F.regexp_count("t", F.lit(r"(?i)<t[dh]\b")).alias("cells"))


def readable_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Converted documents without the lines that hold no letter or digit."""
    kept = F.filter(F.split("markdown", "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]") & ~x.rlike(r"^\s*</?doc>\s*$"))
    rows = table(spark, folder, "document_results").where("markdown IS NOT NULL").select("source_id", kept.alias("k"))
    return rows.select("source_id", F.size("k").alias("lines"), F.sha2(F.encode(F.array_join("k", "\n"), "utf-8"), 256).alias("hash"))


def clean_names(spark: SparkSession, folder: str) -> DataFrame:
    """Speaker names with their blanks collapsed; blank ones and numbers below 1 are none."""
    name = F.trim(F.regexp_replace("name", r"[ \t\r\n]+", " "))
    return table(spark, folder, "speaker_names").where("speaker >= 1").select("source_id", "speaker", name.alias("name")).where("name <> ''")


def to_reprocess(spark: SparkSession, folder: str) -> DataFrame:
    """Ready recordings that lack their speakers, or where fewer speakers have a name than were heard."""
    heard = F.get_json_object("info", "$.speakers").cast("int")
    audio = table(spark, folder, "sources").where("kind = 'audio' AND status = 'ready'").select("id", heard.alias("heard"))
    named = table(spark, folder, "speaker_names").where("trim(name) <> ''").groupBy(F.col("source_id").alias("id")).agg(F.count_distinct("speaker").alias("named"))
    reason = F.when(F.col("heard").isNull(), "speakers").when(F.coalesce("named", F.lit(0)) < F.col("heard"), "names")
    return audio.join(named, "id", "left").select("id", reason.alias("reason")).where("reason IS NOT NULL")


def poor_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Converted documents that were read badly: one line of ten or more is three tenths of them, or there are fewer than forty distinct words."""
    pages = table(spark, folder, "document_results").where("markdown IS NOT NULL")
    words = F.array_distinct(F.regexp_extract_all(F.lower("markdown"), F.lit(r"(\p{L}{2,})"), F.lit(1)))
    lines = pages.select("source_id", F.explode(F.split("markdown", "\n")).alias("l")).select("source_id", F.trim("l").alias("l")).where(F.col("l").rlike(r"[\p{L}\p{N}]"))
    counted = lines.groupBy("source_id", "l").agg(F.count("*").alias("n")).groupBy("source_id").agg(F.sum("n").alias("lines"), F.max("n").alias("most"))
    judged = pages.select("source_id", F.size(words).alias("words")).join(counted, "source_id", "left")
    loops = F.coalesce((F.col("lines") >= 10) & (F.col("most") >= 0.3 * F.col("lines")), F.lit(False))
    return judged.select("source_id", "words", loops.alias("loops"), (loops | (F.col("words") < 40)).alias("poor"))


_KEPT = r"list_filter(string_split(markdown, chr(10)), lambda x: regexp_matches(x, '[\p{L}\p{N}]') AND NOT regexp_matches(x, '^\s*</?doc>\s*$'))"
_SQL_NUMBER = _NUMBER.replace("'", "''")

QUERIES = {
    "pause_chunks": pause_chunks, "answer_variation": answer_variation, "info_objects": info_objects, "first_values": first_values, "corrupted_numbers": corrupted_numbers, "agreement_summary": agreement_summary,
    "metric_changes": metric_changes, "recent_sources": recent_sources, "reference_lists": reference_lists, "size_budget": size_budget, "answer_markdown": answer_markdown, "html_tables": html_tables,
    "readable_pages": readable_pages, "clean_names": clean_names, "to_reprocess": to_reprocess, "poor_pages": poor_pages,
}
SQL = {
    "pause_chunks": f"""
WITH RECURSIVE padded AS (
    SELECT DISTINCT source_id, take, greatest(CAST(round(start_s * 100) AS BIGINT) - 30, 0) AS s, CAST(round(end_s * 100) AS BIGINT) + 30 AS e FROM spans WHERE CAST(round(end_s * 100) AS BIGINT) > CAST(round(start_s * 100) AS BIGINT)
), reached AS (
    SELECT *, max(e) OVER (PARTITION BY source_id, take ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM padded
), numbered AS (
    SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, take ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM reached
), islands AS (
    SELECT source_id, take, CAST(island AS BIGINT) AS n, min(s) AS s, max(e) AS e FROM numbered GROUP BY source_id, take, island
), gaps AS (
    SELECT *, s - lag(e) OVER (PARTITION BY source_id, take ORDER BY n) AS gap FROM islands
), parts AS (
    SELECT source_id, take, min(n) AS a, max(n) AS b, min(s) AS s, max(e) AS e FROM islands GROUP BY source_id, take
    UNION ALL
    SELECT x.source_id, x.take, y.a, y.b, y.s, y.e FROM (
        SELECT p.source_id, p.take, p.a, p.b, p.s, p.e, arg_max(g.n, (g.gap, -g.n)) AS k, arg_max(g.s, (g.gap, -g.n)) AS k_s, arg_max(g.s - g.gap, (g.gap, -g.n)) AS k_e
        FROM parts p JOIN gaps g ON g.source_id = p.source_id AND g.take = p.take AND g.n > p.a AND g.n <= p.b WHERE p.e - p.s > {MOST} AND p.b > p.a GROUP BY ALL
    ) x, LATERAL (SELECT unnest([x.a, x.k]) AS a, unnest([x.k - 1, x.b]) AS b, unnest([x.s, x.k_s]) AS s, unnest([x.k_e, x.e]) AS e) y
), leaves AS (
    SELECT * FROM parts WHERE e - s <= {MOST} OR a = b
), windows AS (
    SELECT *, unnest(range(CAST(greatest(ceil((e - s - {MOST}) / {MOST - OVERLAP}.0), 0) AS BIGINT) + 1)) AS k FROM leaves
)
SELECT source_id, take, s + k * {MOST - OVERLAP} AS start_cs, least(s + k * {MOST - OVERLAP} + {MOST}, e) AS end_cs, k > 0 AS overlaps FROM windows""",
    "info_objects": r"""
WITH j AS (
    SELECT id, regexp_extract(info, '(?s)(\{.*\})', 1) AS o FROM sources WHERE info IS NOT NULL
), k AS (
    SELECT id, o, json_keys(o) AS keys FROM j WHERE json_valid(o)
)
SELECT id, array_to_string(list_sort(list_filter(keys, lambda x: json_extract_string(o, '$.' || x) IS NOT NULL)), ',') AS given, array_to_string(list_sort(list_filter(keys, lambda x: json_extract_string(o, '$.' || x) IS NULL)), ',') AS missing FROM k""",
    "first_values": """
SELECT source_id, label, f.item_no AS item_no, f.page_no AS page_no, sha256(f.text) AS hash FROM (
    SELECT source_id, coalesce(label, 'none') AS label, arg_min({'item_no': item_no, 'page_no': page_no, 'text': text}, (coalesce(page_no, 1073741824), item_no)) AS f FROM document_texts WHERE text IS NOT NULL AND trim(text, ' ') <> '' GROUP BY 1, 2
)""",
    "corrupted_numbers": f"""
WITH p AS (
    SELECT id, regexp_extract(answer, '{_SQL_NUMBER}', 1) AS a, regexp_extract(answer, '{_SQL_NUMBER}', 2) AS n, regexp_extract(answer, '{_SQL_NUMBER}', 3) AS d, regexp_extract(answer, '{_SQL_NUMBER}', 4) AS z FROM qa_turns WHERE regexp_matches(answer, '{_SQL_NUMBER}')
), v AS (
    SELECT *, CAST(replace(n, ',', '') AS BIGINT) AS v FROM p WHERE length(n) < 15
), w AS (
    SELECT *, v + greatest(3, CAST(floor(v * 0.37 + 0.5) AS BIGINT)) AS w FROM v
)
SELECT id, a || CASE WHEN contains(n, ',') THEN format('{{:,}}', w) ELSE CAST(w AS VARCHAR) END || d || z AS wrong FROM w""",
    "agreement_summary": """
WITH v AS (
    SELECT model, CAST(declined AS INT) AS a, CAST(contains(lower(answer), 'not found in your documents') AS INT) AS b FROM qa_turns WHERE declined IS NOT NULL AND answer IS NOT NULL
), s AS (
    SELECT CASE WHEN grouping(model) = 1 THEN 'all' ELSE coalesce(model, 'none') END AS part, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po, avg(a) AS pa, avg(b) AS pb FROM v GROUP BY GROUPING SETS ((model), ())
)
SELECT part, n, round(po, 4) AS agreement, CASE WHEN abs(1 - (pa * pb + (1 - pa) * (1 - pb))) > 1e-12 THEN round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 4) END AS kappa FROM s""",
    "metric_changes": """
WITH m AS (
    SELECT floor((min(id) + max(id)) / 2) AS middle FROM qa_turns
), r AS (
    SELECT model, id > middle AS late, completion_tokens, CASE WHEN coalesce(contains(lower(answer), 'not found in your documents'), false) THEN 1.0 ELSE 0.0 END AS d,
        CASE WHEN len(cited_chunk_ids) > 0 THEN len(list_distinct(list_intersect(cited_chunk_ids, source_chunk_ids[1:3]))) / len(list_distinct(cited_chunk_ids)) END AS recall,
        CASE WHEN len(cited_chunk_ids) > 0 THEN coalesce(1.0 / nullif(list_position(list_transform(source_chunk_ids[1:3], lambda x: list_contains(cited_chunk_ids, x)), true), 0), 0) END AS rr
    FROM qa_turns, m
), b AS (
    SELECT model, late, CAST(count(*) AS DOUBLE) AS n_answers, round(avg(recall), 4) AS recall, round(avg(rr), 4) AS mrr, round(avg(d), 4) AS declined, round(avg(completion_tokens), 4) AS tokens FROM r GROUP BY ALL
), l AS (
    SELECT model, late, unnest(['n_answers', 'recall', 'mrr', 'declined', 'tokens']) AS metric, unnest([n_answers, recall, mrr, declined, tokens]) AS value FROM b
), s AS (
    SELECT model, metric, max(value) FILTER (NOT late) AS before, max(value) FILTER (late) AS after FROM l GROUP BY model, metric
)
SELECT model, metric, before, after, round(after - before, 4) AS delta, coalesce(CASE WHEN metric = 'n_answers' THEN false WHEN metric IN ('tokens', 'declined') THEN round(after - before, 4) >= 0.02 ELSE round(after - before, 4) <= -0.02 END, false) AS regression FROM s""",
    "recent_sources": "SELECT id, kind, name, status, CAST(row_number() OVER (PARTITION BY kind ORDER BY status IN ('queued', 'processing') DESC, id DESC) AS INT) AS rank FROM sources QUALIFY rank <= 20",
    "reference_lists": """
WITH u AS (
    SELECT unnest(source_chunk_ids) AS chunk_id, 'given' AS kind, id FROM qa_turns UNION SELECT unnest(cited_chunk_ids), 'cited', id FROM qa_turns
)
SELECT chunk_id, kind, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS answers FROM u GROUP BY chunk_id, kind""",
    "size_budget": f"SELECT kind, ext, max(size_bytes) AS peak, {BUDGET} - max(size_bytes) AS headroom, max(size_bytes) <= {BUDGET} AS within FROM sources GROUP BY kind, ext",
    "answer_markdown": r"""
WITH f AS (
    SELECT id, regexp_replace(replace(answer, '$', '\$'), '\[(\d+)\]', '`\1`', 'g') AS shown, trim(regexp_replace(answer, '[ \t\r\n]+', ' ', 'g'), ' ') AS flat FROM qa_turns WHERE answer IS NOT NULL
)
SELECT id, shown, CASE WHEN length(flat) <= 60 THEN flat ELSE regexp_replace(substr(flat, 1, 60), ' [^ ]*$', '') || '…' END AS short FROM f""",
    "html_tables": r"""
WITH t AS (
    SELECT doc_id, regexp_extract_all(text, '(?is)<table\b.*?</table>') AS t FROM documents WHERE contains(text, '<table')
), u AS (
    SELECT doc_id, CAST(generate_subscripts(t, 1) - 1 AS INT) AS table_no, unnest(t) AS t FROM t
)
SELECT doc_id, table_no, CAST(len(regexp_extract_all(t, '(?i)<tr\b')) AS INT) AS rows, CAST(len(regexp_extract_all(t, '(?i)<t[dh]\b')) AS INT) AS cells FROM u""",
    "readable_pages": f"SELECT source_id, CAST(len(k) AS INT) AS lines, sha256(array_to_string(k, chr(10))) AS hash FROM (SELECT source_id, {_KEPT} AS k FROM document_results WHERE markdown IS NOT NULL)",
    "clean_names": r"SELECT * FROM (SELECT source_id, speaker, trim(regexp_replace(name, '[ \t\r\n]+', ' ', 'g'), ' ') AS name FROM speaker_names WHERE speaker >= 1) WHERE name <> ''",
    "to_reprocess": """
WITH a AS (
    SELECT s.id, CAST(json_extract_string(info, '$.speakers') AS INT) AS heard, (SELECT count(DISTINCT speaker) FROM speaker_names n WHERE n.source_id = s.id AND trim(name, ' ') <> '') AS named FROM sources s WHERE kind = 'audio' AND status = 'ready'
)
SELECT * FROM (SELECT id, CASE WHEN heard IS NULL THEN 'speakers' WHEN named < heard THEN 'names' END AS reason FROM a) WHERE reason IS NOT NULL""",
    "poor_pages": r"""
WITH l AS (
    SELECT source_id, CAST(len(list_distinct(regexp_extract_all(lower(markdown), '\p{L}{2,}'))) AS INT) AS words, list_filter(list_transform(string_split(markdown, chr(10)), lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS l FROM document_results WHERE markdown IS NOT NULL
), j AS (
    SELECT source_id, words, len(l) >= 10 AND list_max(map_values(list_histogram(l))) >= 0.3 * len(l) AS loops FROM l
)
SELECT source_id, words, coalesce(loops, false) AS loops, coalesce(loops, false) OR words < 40 AS poor FROM j""",
}
