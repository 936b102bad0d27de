"""Search queries: every fiftieth question against all chunks, every fiftieth vector against all vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.search import bm25, fuse, identifier_hits, postings, ranked, vector_topk
from ..session import cut
from .tables import table

# Words that a search leaves out.
STOP = (
    "a an and are as at be but by can could did do does for from had has have how i if in into is it its me my of on or our so than that the their them then there these they this those to was we "
    "were what when where which who whom why will with would"
).split()
STRIDE = 50


def _indexed():
    return X.search_terms(F.lower(F.concat_ws("\n", "context", "text")))


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "qa_turns").where(F.col("id") % STRIDE == 0).select(F.col("id").alias("qa_id"), "question")


def search_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").select("id", X.search_text(F.col("text")).alias("search_text"))


def query_terms(spark: SparkSession, folder: str) -> DataFrame:
    terms = X.query_terms(F.col("question"), STOP)
    return table(spark, folder, "qa_turns").select("id", F.array_join(terms, " ").alias("terms"))


def id_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "qa_turns").select("id", F.array_join(X.identifiers(F.col("question")), " ").alias("tokens"))


def postings_stats(spark: SparkSession, folder: str) -> DataFrame:
    listed = postings(table(spark, folder, "chunks"), "id", _indexed())
    return listed.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


def _bm25(spark: SparkSession, folder: str, k: int) -> DataFrame:
    return bm25(table(spark, folder, "chunks"), "id", _indexed(), _questions(spark, folder), "qa_id", X.query_terms(F.col("question"), STOP), k)


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _bm25(spark, folder, 10)


def _identifiers(spark: SparkSession, folder: str, queries: DataFrame, query: str, column: str, k: int) -> DataFrame:
    return identifier_hits(table(spark, folder, "chunks"), "id", F.col("text"), queries, query, X.identifiers(F.col(column)), k)


def identifier_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that hold an identifier of each fiftieth chunk, inside longer ones too."""
    asked = table(spark, folder, "chunks").where(F.col("id") % STRIDE == 0).select(F.col("id").alias("chunk_id"), F.col("text").alias("asked"))
    return _identifiers(spark, folder, asked, "chunk_id", "asked", 10)


def _stages(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The ranked lists for each fiftieth question; its vector, and that of a chunk, is the one with its id."""
    asked = _questions(spark, folder)
    near = _neighbours(spark, folder, 50).join(asked.select(F.col("qa_id").alias("query_id")), "query_id", "left_semi")
    near = near.join(table(spark, folder, "chunks").select(F.col("id").alias("vec_id")), "vec_id", "left_semi")
    again = ranked(near.select(F.col("query_id").alias("qa_id"), F.col("vec_id").alias("id"), "score"), "qa_id", [F.desc("score"), F.asc("id")], 50)
    # Each list has at most fifty rows for each question; it is used more than once.
    return {name: cut(rows) for name, rows in (("ids", _identifiers(spark, folder, asked, "qa_id", "question", 50)), ("bm25", _bm25(spark, folder, 50)), ("vectors", again))}


def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers, words and vectors fused by rank."""
    return fuse(list(_stages(spark, folder).values()), "qa_id", "id")


def _places(value: Column, places: int) -> Column:
    """Rounded as SQL's ``round`` does, by the product with a power of ten; ``F.round`` goes by the written digits."""
    return F.round(value * 10.0**places) / 10.0**places


def search_modes(spark: SparkSession, folder: str) -> DataFrame:
    """What each way of searching gives for each fiftieth question, with the rank and the score to five places.

    By words alone a question with identifiers fuses them with the words; one without keeps its scores.
    """
    found = _stages(spark, folder)
    coded = found["ids"].select("qa_id").distinct()
    words = fuse([found["ids"], found["bm25"].join(coded, "qa_id", "left_semi")], "qa_id", "id").unionByName(found["bm25"].join(coded, "qa_id", "left_anti").where("rank <= 8"))
    modes = {"bm25": words, "vectors": found["vectors"].where("rank <= 8"), "hybrid": fuse(list(found.values()), "qa_id", "id")}
    every = None
    for mode, rows in modes.items():
        one = rows.select(F.lit(mode).alias("mode"), "qa_id", "id", _places(F.col("score"), 5).alias("score"), "rank")
        every = one if every is None else every.unionByName(one)
    return every


def _neighbours(spark: SparkSession, folder: str, k: int) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return vector_topk(vectors, "vec_id", "embedding", vectors.where(F.col("vec_id") % STRIDE == 0), k)


def vector_top10(spark: SparkSession, folder: str) -> DataFrame:
    return _neighbours(spark, folder, 10).select("query_id", "vec_id", "rank")


def vector_recall_by_label(spark: SparkSession, folder: str) -> DataFrame:
    """Of the ten nearest, the share with the query's label, and the reciprocal rank of the first other row with it."""
    labels = table(spark, folder, "embeddings").select("vec_id", "label")
    near = _neighbours(spark, folder, 11).where("query_id <> vec_id").join(labels, "vec_id").withColumnRenamed("label", "found")
    judged = near.join(labels.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    per = judged.groupBy("query_id", "label").agg(F.avg((F.col("found") == F.col("label")).cast("double")).alias("precision"), F.min(F.when(F.col("found") == F.col("label"), F.col("rank"))).alias("first"))
    return per.groupBy("label").agg(F.count("*").alias("queries"), F.round(F.avg("precision"), 4).alias("mean_precision"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr"))


_TERMS = r"list_filter(string_split(array_to_string(list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_./-]+'), lambda r: CASE WHEN regexp_matches(r, '[0-9]') THEN regexp_replace(r, '^[-_./]+|[-_./]+$', '', 'g') ELSE trim(regexp_replace(r, '[-_./]+', ' ', 'g')) END), ' '), ' '), lambda x: x <> '')"
_IDS = r"list_filter(list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_./-]+'), lambda r: regexp_replace(r, '^[-_./]+|[-_./]+$', '', 'g')), lambda x: length(x) >= 3 AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[\p{{L}}_./-]'))"
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"
_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_LOWERED = f"list_transform({_TERMS.format('question')}, lambda x: lower(x))"
_QUERY = f"""CASE WHEN len(list_filter(lowered, lambda x: NOT list_contains({_STOP}, x))) > 0 THEN list_filter(once, lambda x: NOT list_contains({_STOP}, x)) ELSE once END"""
_ASKED = f"""
    SELECT id AS qa_id, {_QUERY} AS terms FROM (
        SELECT id, lowered, {_DISTINCT.format("lowered")} AS once FROM (SELECT id, {_LOWERED} AS lowered FROM qa_turns{{where}})
    )
"""
_WORDS = f"SELECT id, {_TERMS.format("lower(concat_ws(chr(10), context, text))")} AS terms FROM chunks"
_BM25 = f"""
WITH words AS ({_WORDS}), lengths AS (
    SELECT id, coalesce(len(terms), 0) AS dl FROM words
), collection AS (
    SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM lengths
), listed AS (
    SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM words) GROUP BY ALL
), asked AS (
    SELECT DISTINCT qa_id, unnest(terms) AS term FROM ({_ASKED.replace("{where}", " WHERE id % 50 = 0")})
), idf AS (
    SELECT term, greatest(ln((n_docs - count(*) + 0.5) / (count(*) + 0.5)), 1e-6) AS idf, avgdl FROM listed, collection GROUP BY term, n_docs, avgdl
), scored AS (
    SELECT qa_id, id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM asked JOIN listed USING (term) JOIN idf USING (term) JOIN lengths USING (id) GROUP BY qa_id, id
), bm AS (
    SELECT qa_id, id, score, CAST(row_number() OVER (PARTITION BY qa_id ORDER BY score DESC, id) AS INT) AS rank FROM scored
)"""
def _hits(asked: str, query: str) -> str:
    return f"""texts AS (
    SELECT id, lower(text) AS t, length(text) - 2 AS dl FROM chunks WHERE length(text) > 2
), sizes AS (
    SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM texts
), wanted AS (
    SELECT DISTINCT {query}, lower(unnest({asked})) AS term
), found AS (
    SELECT id, dl, term, (length(t) - length(replace(t, term, ''))) / length(term) AS tf FROM texts JOIN (SELECT DISTINCT term FROM wanted) ON contains(t, term) WHERE length(term) > 2
), weighed AS (
    SELECT id, term, greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM found JOIN (SELECT term, count(*) AS df FROM found GROUP BY term) USING (term), sizes
), best AS (
    SELECT {{q}}, id, round(max(w), 6) AS score FROM wanted JOIN weighed USING (term) GROUP BY ALL
), ids AS (
    SELECT {{q}}, id, score, CAST(row_number() OVER (PARTITION BY {{q}} ORDER BY score DESC, id) AS INT) AS rank FROM best
)"""


_HITS = _hits(_IDS.format("question"), "id AS qa_id").replace("AS term\n), found", "AS term FROM qa_turns WHERE id % 50 = 0\n), found").replace("{q}", "qa_id")
_CHUNK_HITS = _hits(_IDS.format("text"), "id AS chunk_id").replace("AS term\n), found", "AS term FROM chunks WHERE id % 50 = 0\n), found").replace("{q}", "chunk_id")
_NEAR = """
WITH q AS (
    SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0
), near AS (
    SELECT query_id, vec_id, round(list_inner_product(e, CAST(embedding AS DOUBLE[])), 9) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(e, CAST(embedding AS DOUBLE[])), 9) DESC, vec_id) AS INT) AS rank
    FROM q, embeddings
)"""

_FUSED = (
    _BM25
    + ", " + _HITS + ", " + _NEAR.split("WITH ", 1)[1]
    + """, vectors AS (
    SELECT query_id AS qa_id, vec_id AS id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM (
        SELECT * FROM near WHERE rank <= 50 AND query_id IN (SELECT id FROM qa_turns) AND vec_id IN (SELECT id FROM chunks)
    )
), lists AS (
    SELECT 'ids' AS list, qa_id, id, rank FROM ids WHERE rank <= 50 UNION ALL SELECT 'bm25', qa_id, id, rank FROM bm WHERE rank <= 50 UNION ALL SELECT 'vectors', qa_id, id, rank FROM vectors
), fused AS (
    SELECT qa_id, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM lists GROUP BY qa_id, id
), hybrid AS (
    SELECT * FROM (SELECT qa_id, id, score, CAST(row_number() OVER (PARTITION BY qa_id ORDER BY score DESC, id) AS INT) AS rank FROM fused) WHERE rank <= 8
)"""
)

QUERIES = {
    "search_text": search_text, "query_terms": query_terms, "id_tokens": id_tokens, "postings_stats": postings_stats, "bm25_topk": bm25_topk, "identifier_topk": identifier_topk,
    "hybrid_search": hybrid_search, "search_modes": search_modes, "vector_topk": vector_top10, "vector_recall_by_label": vector_recall_by_label,
}
SQL = {
    "search_text": f"SELECT id, array_to_string({_TERMS.format('text')}, ' ') AS search_text FROM chunks",
    "query_terms": f"SELECT qa_id AS id, array_to_string(terms, ' ') AS terms FROM ({_ASKED.replace("{where}", "")})",
    "id_tokens": f"SELECT id, array_to_string({_DISTINCT.format('t')}, ' ') AS tokens FROM (SELECT id, {_IDS.format('question')} AS t FROM qa_turns)",
    "postings_stats": f"SELECT term, count(DISTINCT id) AS documents, count(*) AS occurrences FROM (SELECT id, unnest(terms) AS term FROM ({_WORDS})) GROUP BY term",
    "bm25_topk": _BM25 + " SELECT qa_id, id, score, rank FROM bm WHERE rank <= 10",
    "identifier_topk": "WITH " + _CHUNK_HITS + " SELECT chunk_id, id, score, rank FROM ids WHERE rank <= 10",
    "hybrid_search": _FUSED + " SELECT * FROM hybrid",
    "search_modes": _FUSED + """, coded AS (
    SELECT qa_id, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM lists WHERE list <> 'vectors' AND qa_id IN (SELECT qa_id FROM ids) GROUP BY qa_id, id
), worded AS (
    SELECT * FROM (SELECT qa_id, id, score, CAST(row_number() OVER (PARTITION BY qa_id ORDER BY score DESC, id) AS INT) AS rank FROM coded) WHERE rank <= 8
    UNION ALL SELECT qa_id, id, score, rank FROM bm WHERE rank <= 8 AND qa_id NOT IN (SELECT qa_id FROM ids)
)
SELECT 'bm25' AS mode, qa_id, id, round(score, 5) AS score, rank FROM worded UNION ALL SELECT 'vectors', qa_id, id, round(score, 5), rank FROM vectors WHERE rank <= 8 UNION ALL SELECT 'hybrid', qa_id, id, round(score, 5), rank FROM hybrid""",
    "vector_topk": _NEAR + " SELECT query_id, vec_id, rank FROM near WHERE rank <= 10",
    "vector_recall_by_label": _NEAR + """, judged AS (
    SELECT query_id, a.label AS label, b.label AS found, rank FROM near JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = near.vec_id WHERE rank <= 11 AND query_id <> near.vec_id
), per AS (
    SELECT query_id, label, avg(CASE WHEN found = label THEN 1.0 ELSE 0.0 END) AS precision, min(CASE WHEN found = label THEN rank END) AS first FROM judged GROUP BY query_id, label
)
SELECT label, count(*) AS queries, round(avg(precision), 4) AS mean_precision, round(avg(coalesce(1.0 / first, 0)), 4) AS mrr FROM per GROUP BY label""",
}
