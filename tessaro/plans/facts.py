"""Queries that judge answers by facts, places and fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.canonical import MONTHS, canonical, canonical_sql, contains_words, iso_date
from ..operators import metrics as M
from ..operators.grids import cell_f1
from ..operators.segments import with_previous
from ..operators.skew import sized_join
from .search import _IDS
from .tables import table

# Words that say nothing about a task or a question.
STOP_KEYWORDS = (
    "a an the to of for and or in on at by with from about into over before after up out this that these those is are be will should would can could must need needs "
    "needed it its their our his her him we they he she i you me us next new all any some"
).split()
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_KEYWORDS) + "]"


def canonical_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Each answer in canonical form."""
    return table(spark, folder, "qa_turns").where("answer IS NOT NULL").select("id", canonical(F.col("answer")).alias("text"))


def fact_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Of the codes in each question, as written or with blanks for their dashes, how many its answer takes up; null without codes."""
    rows = table(spark, folder, "qa_turns").select("id", X.identifiers(F.col("question")).alias("facts"), F.coalesce("answer", F.lit("")).alias("answer"))
    asked = rows.where(F.size("facts") > 0).select("id", canonical(F.col("answer")).alias("said"), F.explode("facts").alias("fact"))
    spaced = F.regexp_replace("fact", "-", " ")
    found = asked.select("id", (contains_words(F.col("said"), canonical(F.col("fact"))) | contains_words(F.col("said"), canonical(spaced))).alias("found"))
    return found.groupBy("id").agg(F.count("*").alias("facts"), F.count_if("found").alias("found"), F.round(F.avg(F.col("found").cast("int")), 4).alias("coverage"))


def _places(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select(F.col("id").alias("chunk_id"), "source_id", "page_start", "page_end", "start_s", "end_s")


def place_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """By model: the share of cited chunks at a place of a given chunk, and of given chunks at a place that is cited.

    A place is a page of a source, a stretch of its time, or, without either, the whole source.
    """
    answers = table(spark, folder, "qa_turns").select("id", "model", F.array_distinct("cited_chunk_ids").alias("c"), F.array_distinct("source_chunk_ids").alias("g"))
    places = _places(spark, folder)
    side = lambda column, name: sized_join(answers.select("id", F.explode(column).alias("chunk_id")), places, ["chunk_id"], "inner").select("id", "source_id", F.struct("chunk_id", "page_start", "page_end", "start_s", "end_s").alias(name))
    cited, given = side("c", "chunk"), side("g", "ref")
    met = cited.join(given, ["id", "source_id"]).where(M.at_place(F.col("chunk"), F.col("ref"))).groupBy("id").agg(F.count_distinct("chunk.chunk_id").alias("right"), F.count_distinct("ref.chunk_id").alias("reached"))
    sizes = [part.groupBy("id").agg(F.count("*").alias(name)) for part, name in ((cited, "cited"), (given, "given"))]
    rows = answers.select("id", "model").join(sizes[0], "id").join(sizes[1], "id").join(met, "id", "left")
    share = lambda a, b: F.round(F.avg(F.coalesce(a, F.lit(0)) / F.col(b)), 4)
    return rows.groupBy("model").agg(F.count("*").alias("answers"), share("right", "cited").alias("precision"), share("reached", "given").alias("recall"))


def field_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """What the info of ready sources says against what the tables hold: fields, and how many agree; a missing value must be missing."""
    info = lambda k: F.get_json_object("info", f"$.{k}")
    sources = table(spark, folder, "sources").where("status = 'ready'").select(F.col("id").alias("source_id"), F.create_map(*(x for k in ("chunks", "speakers", "language") for x in (F.lit(k), info(k)))).alias("said"))
    counts = table(spark, folder, "chunks").groupBy("source_id").agg(F.count_distinct("seq").cast("string").alias("chunks"))
    names = table(spark, folder, "speaker_names").groupBy("source_id").agg(F.max("speaker").cast("string").alias("speakers"))
    spoken = table(spark, folder, "documents").where("lang IS NOT NULL AND source_id IS NOT NULL").groupBy("source_id", F.lower("lang").alias("lang")).agg(F.count("*").alias("n"))
    main = spoken.groupBy("source_id").agg(F.max_by("lang", F.struct("n", "lang")).alias("language"))
    held = sources.join(counts, "source_id", "left").join(names, "source_id", "left").join(main, "source_id", "left")
    rows = held.select("said", F.create_map(*(x for k in ("chunks", "speakers", "language") for x in (F.lit(k), F.col(k)))).alias("got")).select(F.explode("said").alias("field", "expected"), "got")
    agree = M.value_matches(F.col("expected"), F.element_at("got", F.col("field")), canonical)
    return rows.groupBy("field").agg(F.count("*").alias("n"), F.count_if(agree).alias("right"), F.round(F.avg(agree.cast("int")), 4).alias("accuracy"))


def keyword_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """The share of a question's keywords, as stems, that its answer takes up, and whether that is half of them or more."""
    words = lambda c: F.array_distinct(F.transform(F.filter(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: (F.char_length(w) > 2) & ~w.isin(STOP_KEYWORDS)), X.stem))
    rows = table(spark, folder, "qa_turns").where("question IS NOT NULL AND answer IS NOT NULL").select("id", words("question").alias("q"), words("answer").alias("a"))
    share = F.size(F.array_intersect("q", "a")) / F.size("q")
    return rows.where(F.size("q") > 0).select("id", F.size("q").alias("keywords"), F.round(share, 4).alias("overlap"), (share >= 0.5).alias("about"))


def table_cell_f1(spark: SparkSession, folder: str) -> DataFrame:
    """How far the table in each chunk agrees with the one in the next table chunk of its source: F1 over cells, rows aligned in order."""
    chunks = table(spark, folder, "chunks").where("element = 'table' AND text IS NOT NULL").select("source_id", "seq", "id", "text")
    pairs = with_previous(chunks, ["source_id"], ["seq", "id"], ["id", "text"]).where("_previous IS NOT NULL")
    return pairs.select("id", F.col("_previous.id").alias("before"), F.round(cell_f1(F.col("_previous.text"), F.col("text")), 4).alias("f1"))


def stem_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of the documents with its stem."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}{3,})"), F.lit(1)))).alias("word")
    return table(spark, folder, "documents").select(words).distinct().where(F.col("word").rlike("^[a-z]+$")).select("word", X.stem(F.col("word")).alias("stem"))


def written_dates(spark: SparkSession, folder: str) -> DataFrame:
    """The dates with a month name, or year first, in documents, and the days they mean."""
    found = F.regexp_extract_all("text", F.lit(_DATE), F.lit(1))
    rows = table(spark, folder, "documents").select("doc_id", F.explode(F.array_distinct(found)).alias("written"))
    return rows.select("doc_id", "written", iso_date(F.col("written")).alias("iso"))


def _action_items(rows: DataFrame, name: str) -> DataFrame:
    """How often each source holds each item: who does it and the stems of what is done."""
    item = F.explode(F.regexp_extract_all("text", F.lit(r"Action: +([^.!?\n]+)"), F.lit(1))).alias("item")
    words = F.filter(F.regexp_extract_all(F.lower("item"), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: (F.char_length(w) > 2) & ~w.isin(STOP_KEYWORDS))
    stems = F.array_join(F.array_sort(F.array_distinct(F.transform(F.slice(words, 2, 1000), X.stem))), " ")
    keyed = rows.select("source_id", item).select("source_id", F.coalesce(F.get(words, F.lit(0)), F.lit("")).alias("owner"), stems.alias("task"))
    return keyed.groupBy("source_id", "owner", "task").agg(F.count("*").alias(name))


def action_items(spark: SparkSession, folder: str) -> DataFrame:
    """The action items said in each recording against those in its chunks: each said one takes one in the chunks with the same owner and task, as long as there are any.

    Equal items need no pairing, so the lesser of both counts is the number of matches.
    """
    said, held = _action_items(table(spark, folder, "turns"), "said"), _action_items(table(spark, folder, "chunks"), "held")
    both = said.join(held, ["source_id", "owner", "task"], "full").na.fill(0, ["said", "held"])
    sums = both.groupBy("source_id").agg(F.sum("said").alias("said"), F.sum("held").alias("held"), F.sum(F.least("said", "held")).alias("matched"))
    share = lambda n: F.when(F.col(n) > 0, F.round(F.col("matched") / F.col(n), 4))
    return sums.select("source_id", "said", "held", "matched", share("said").alias("recall"), share("held").alias("precision"))


_NAMES = "|".join(name.capitalize() for names in MONTHS for name in names if len(name) > 4 or name == "may")
_DATE = rf"\b((?:{_NAMES}) [0-9]{{1,2}}, [0-9]{{4}}|[0-9]{{1,2}} (?:{_NAMES}) [0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})\b"
_BARE = "CASE " + " ".join(f"WHEN ends_with({{0}}, '{s}') AND length({{0}}) >= {len(s) + 3} THEN left({{0}}, -{len(s)})" for s in X.SUFFIXES) + " ELSE {0} END"
_SHORT = "CASE WHEN length({0}) > 3 AND ends_with({0}, 'e') THEN left({0}, -1) ELSE {0} END"
_HALVED = "CASE WHEN length({0}) > 3 AND right({0}, 1) = substr({0}, -2, 1) AND NOT contains('" + X.STAYS_DOUBLE + "', right({0}, 1)) THEN left({0}, -1) ELSE {0} END"


def _stems(words: str) -> str:
    """A list of words as stems, in SQL."""
    for step in (_BARE, _SHORT, _HALVED):
        words = f"list_transform({words}, lambda x: {step.format('x')})"
    return words


_KEYWORDS = f"list_distinct({_stems("list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda x: length(x) > 2 AND NOT list_contains(" + _STOP + ", x))")})"
_BOUNDED = r"contains({0}, {1}) AND {1} <> '' AND regexp_matches({0}, '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape({1}) || '($|[^\p{{L}}\p{{N}}_])')"
_AT = """CASE WHEN r.page_start IS NOT NULL THEN c.page_start IS NOT NULL AND c.page_start <= r.page_start AND r.page_start <= coalesce(nullif(c.page_end, 0), c.page_start)
    WHEN r.start_s IS NOT NULL THEN c.start_s IS NOT NULL AND c.start_s <= coalesce(r.end_s, r.start_s) AND r.start_s <= coalesce(c.end_s, c.start_s) ELSE true END"""

QUERIES = {
    "canonical_answers": canonical_answers, "fact_coverage": fact_coverage, "place_metrics": place_metrics, "field_accuracy": field_accuracy, "keyword_coverage": keyword_coverage,
    "table_cell_f1": table_cell_f1, "stem_forms": stem_forms, "written_dates": written_dates, "action_items": action_items,
}
SQL = {
    "canonical_answers": f"SELECT id, {canonical_sql('answer')} AS text FROM qa_turns WHERE answer IS NOT NULL",
    "fact_coverage": f"""
WITH f AS (
    SELECT DISTINCT id, coalesce(answer, '') AS answer, unnest({_IDS.format("question")}) AS fact FROM qa_turns
), n AS (
    SELECT id, {canonical_sql("answer")} AS said, {canonical_sql("fact")} AS one, {canonical_sql("replace(fact, '-', ' ')")} AS other FROM f
), m AS (
    SELECT id, ({_BOUNDED.format("said", "one")}) OR ({_BOUNDED.format("said", "other")}) AS found FROM n
)
SELECT id, count(*) AS facts, count(*) FILTER (found) AS found, round(avg(CAST(found AS INT)), 4) AS coverage FROM m GROUP BY id""",
    "place_metrics": f"""
WITH a AS (
    SELECT id, model, list_distinct(cited_chunk_ids) AS c, list_distinct(source_chunk_ids) AS g FROM qa_turns
), c AS (
    SELECT u.id AS qa, k.* FROM (SELECT id, unnest(c) AS chunk FROM a) u JOIN chunks k ON k.id = chunk
), r AS (
    SELECT u.id AS qa, k.* FROM (SELECT id, unnest(g) AS chunk FROM a) u JOIN chunks k ON k.id = chunk
), m AS (
    SELECT c.qa, count(DISTINCT c.id) AS hit, count(DISTINCT r.id) AS reached FROM c JOIN r ON r.qa = c.qa AND r.source_id = c.source_id WHERE {_AT} GROUP BY c.qa
), s AS (
    SELECT id, model, (SELECT count(*) FROM c WHERE c.qa = a.id) AS cited, (SELECT count(*) FROM r WHERE r.qa = a.id) AS given, coalesce((SELECT hit FROM m WHERE m.qa = a.id), 0) AS hit, coalesce((SELECT reached FROM m WHERE m.qa = a.id), 0) AS reached FROM a
)
SELECT model, count(*) AS answers, round(avg(hit / cited), 4) AS precision, round(avg(reached / given), 4) AS recall FROM s WHERE cited > 0 AND given > 0 GROUP BY model""",
    "field_accuracy": f"""
WITH s AS (
    SELECT id, info FROM sources WHERE status = 'ready'
), held AS (
    SELECT s.id, info, (SELECT CAST(count(DISTINCT seq) AS VARCHAR) FROM chunks WHERE source_id = s.id HAVING count(*) > 0) AS chunks, (SELECT CAST(max(speaker) AS VARCHAR) FROM speaker_names WHERE source_id = s.id) AS speakers,
        (SELECT arg_max(lang, (n, lang)) FROM (SELECT source_id, lower(lang) AS lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL) d WHERE d.source_id = s.id) AS language FROM s
), f AS (
    SELECT 'chunks' AS field, json_extract_string(info, '$.chunks') AS expected, chunks AS got FROM held
    UNION ALL SELECT 'speakers', json_extract_string(info, '$.speakers'), speakers FROM held
    UNION ALL SELECT 'language', json_extract_string(info, '$.language'), language FROM held
), m AS (
    SELECT field, CASE WHEN expected IS NULL THEN got IS NULL OR trim(got) = '' ELSE coalesce({canonical_sql("expected")} = {canonical_sql("got")}, false) END AS agree FROM f
)
SELECT field, count(*) AS n, count(*) FILTER (agree) AS right, round(avg(CAST(agree AS INT)), 4) AS accuracy FROM m GROUP BY field""",
    "keyword_coverage": f"""
WITH w AS (
    SELECT id, {_KEYWORDS.replace("{0}", "question")} AS q, {_KEYWORDS.replace("{0}", "answer")} AS a FROM qa_turns WHERE question IS NOT NULL AND answer IS NOT NULL
)
SELECT id, CAST(len(q) AS INT) AS keywords, round(len(list_intersect(q, a)) / len(q), 4) AS overlap, len(list_intersect(q, a)) / len(q) >= 0.5 AS about FROM w WHERE len(q) > 0""",
    "stem_forms": f"""
WITH w AS (
    SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\\p{{L}}{{3,}}')) AS word FROM documents
), s AS (
    SELECT list(word) AS l FROM w WHERE regexp_matches(word, '^[a-z]+$')
)
SELECT unnest(l) AS word, unnest({_stems("l")}) AS stem FROM s""",
    "written_dates": rf"""
WITH w AS (
    SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_DATE}')) AS written FROM documents
)
SELECT doc_id, written, CASE WHEN regexp_matches(written, '^[0-9]{{4}}-') THEN strftime(try_cast(written AS DATE), '%Y-%m-%d')
    ELSE strftime(coalesce(try_strptime(written, '%B %-d, %Y'), try_strptime(written, '%-d %B %Y')), '%Y-%m-%d') END AS iso FROM w""",
    "action_items": rf"""
WITH i AS (
    SELECT 1 AS side, source_id, unnest(regexp_extract_all(text, 'Action: +([^.!?\n]+)', 1)) AS item FROM turns UNION ALL SELECT 2, source_id, unnest(regexp_extract_all(text, 'Action: +([^.!?\n]+)', 1)) FROM chunks
), w AS (
    SELECT side, source_id, list_filter(regexp_extract_all(lower(item), '[a-z0-9]+'), lambda x: length(x) > 2 AND NOT list_contains({_STOP}, x)) AS w FROM i
), k AS (
    SELECT source_id, coalesce(w[1], '') AS owner, array_to_string(list_sort(list_distinct({_stems("w[2:]")})), ' ') AS task, count(*) FILTER (side = 1) AS said, count(*) FILTER (side = 2) AS held FROM w GROUP BY ALL
), s AS (
    SELECT source_id, CAST(sum(said) AS BIGINT) AS said, CAST(sum(held) AS BIGINT) AS held, CAST(sum(least(said, held)) AS BIGINT) AS matched FROM k GROUP BY source_id
)
SELECT source_id, said, held, matched, CASE WHEN said > 0 THEN round(matched / said, 4) END AS recall, CASE WHEN held > 0 THEN round(matched / held, 4) END AS precision FROM s""",
}
