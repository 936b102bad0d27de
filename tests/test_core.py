import json

import pytest
from pyspark.sql import functions as F

from tessaro.functions import text as X
from tessaro.operators import metrics as M
from tessaro.operators.search import bm25, fuse, identifier_hits, vector_topk
from tessaro.operators.segments import PARTITION, range_sorted
from tessaro.operators.sequence import asof_match, first_appearance_rank, overlap_pairs, sliding_windows
from tessaro.operators.skew import salted_join, sized_join
from tessaro.sources.files import content_addressed, transcript_segments
from tessaro.sources.sinks import cascade_deleted, replace_partitions, upserted
from tessaro.streaming.events import deduplicated, drain, read_events, windowed_counts


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("column", "text", "expected"),
    [
        (X.search_text, "The PO-2031-77, well-known/old.", "The PO-2031-77 well known old"),
        (X.search_text, "", ""),
        (X.search_text, None, None),
        (X.identifiers, "See PO-77 and 123 or a1 and PO-77, v2.0", ["PO-77", "v2.0"]),
        (X.citations, "So [2][1, 3], [4-6] and [3].", [2, 1, 3, 4, 5, 6]),
        (X.citations, "none [x] [6-4]", []),
        (X.declines, "Not found in your documents.", True),
        (X.declines, None, False),
        (X.token_count, "abcdef", 3),
        (X.stem, "shipments", "ship"),
        (X.stem, "running", "run"),
        (X.iso_dates, "2031-02-30 2031-02-03 2031-02-03", ["2031-02-03"]),
        (X.amount, "€1.234,50", 1234.5),
        (X.amount, "1.234", 1234.0),
        (X.amount, "12,5", 12.5),
        (X.amount, "none", None),
    ],
)
def test_text_functions(spark, column, text, expected):
    assert one(spark, column, text) == expected


def test_clock_and_size(spark):
    row = spark.createDataFrame([(3725.9, 2048)], "s double, b long").select(X.clock(F.col("s")), X.human_size(F.col("b")), X.clock(F.lit(None).cast("double"))).first()
    assert tuple(row) == ("1:02:05", "2 KB", None)


def test_salted_join_keeps_every_row(spark):
    left = spark.createDataFrame([(1, i) for i in range(300)] + [(None, -1), (2, -2)], "k long, v long")
    right = spark.createDataFrame([(1, "a")], "k long, name string")
    joined = salted_join(left, right, ["k"])
    assert joined.count() == 302 and joined.where("name = 'a'").count() == 300
    assert salted_join(left, right, ["k"], "inner").count() == 300
    assert salted_join(left.limit(0), right, ["k"]).count() == 0
    for most in (0, 1 << 20):
        assert sized_join(left, right, ["k"], most_bytes=most).count() == 302
        assert sized_join(left, right.select("k"), ["k"], "left_semi", most).count() == 300


def test_range_sorted_is_sorted_over_all_partitions(spark):
    df = spark.createDataFrame([(i * 7 % 5, i * 13 % 101) for i in range(500)], "k long, v long")
    rows = range_sorted(df, ["k"], ["v"]).collect()
    seen = sorted(rows, key=lambda r: (r[PARTITION], r["k"], r["v"]))
    assert [(r["k"], r["v"]) for r in seen] == sorted((r["k"], r["v"]) for r in rows)


def test_asof_against_brute_force(spark):
    left = [(i, "a" if i % 3 else None, None if i % 17 == 0 else i * 5 % 97) for i in range(120)]
    right = [(i, "a" if i % 2 else None, None if i % 11 == 0 else i * 7 % 89) for i in range(80)]
    found = asof_match(spark.createDataFrame(left, "l long, k string, t long"), spark.createDataFrame(right, "r long, k string, t long"), ["k"], "l", "t", "r", "t")
    expected = {}
    for l, k, t in left:
        before = [(u, r) for r, kk, u in right if kk == k and u is not None and t is not None and u <= t]
        expected[l] = max(before)[1] if before else None
    assert {r["l"]: r["r"] for r in found.collect()} == expected
    empty = spark.createDataFrame([], "r long, k string, t long")
    assert asof_match(spark.createDataFrame(left, "l long, k string, t long"), empty, ["k"], "l", "t", "r", "t").where("r IS NOT NULL").count() == 0


def test_overlap_against_brute_force(spark):
    left = [(i, 1, i * 11 % 200, i * 11 % 200 + i % 40) for i in range(60)]
    right = [(i, 1, i * 17 % 190, i * 17 % 190 + 3 + i % 90) for i in range(60)] + [(99, 1, None, 5)]
    schema = "{0} long, k long, s long, e long"
    found = overlap_pairs(spark.createDataFrame(left, schema.format("l")), spark.createDataFrame(right, schema.format("r")), ["k"], "l", "r", "s", "e", 25)
    expected = {(a, b) for a, _, s, e in left for b, _, u, v in right if u is not None and e > s and v > u and s < v and u < e}
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected


def test_windows_and_first_appearance(spark):
    spans = spark.createDataFrame([(1, 0, 650), (2, 0, 300), (3, 5, 5), (4, None, 3)], "id long, s long, e long")
    rows = {(r["id"], r["window_start"], r["window_end"]) for r in sliding_windows(spans, ["id"], "s", "e", 300, 290).collect()}
    assert rows == {(1, 0, 300), (1, 290, 590), (1, 580, 650), (2, 0, 300)}
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (1, None, 0)], "k long, n string, t long")
    assert {(r["n"], r["number"]) for r in first_appearance_rank(df, ["k"], "n", ["t"]).collect()} == {("b", 1), ("a", 2)}


def test_search_and_fusion(spark):
    docs = spark.createDataFrame([(1, "red pump PO-7"), (2, "blue pump pump"), (3, None), (4, "")], "id long, text string")
    asked = spark.createDataFrame([(10, "pump PO-7"), (11, "nothing")], "q long, question string")
    terms = lambda c: X.search_terms(F.lower(F.col(c)))
    found = bm25(docs, "id", terms("text"), asked, "q", terms("question"))
    assert [(r["q"], r["id"], r["rank"]) for r in found.orderBy("q", "rank").collect()] == [(10, 1, 1), (10, 2, 2)]
    ids = identifier_hits(docs, "id", F.col("text"), asked, "q", X.identifiers(F.col("question")))
    assert [(r["q"], r["id"]) for r in ids.collect()] == [(10, 1)]
    assert [r["id"] for r in fuse([found, ids], "q", "id").orderBy("rank").collect()] == [1, 2]


def test_vector_search_in_blocks(spark):
    vectors = spark.createDataFrame([(i, [float(i % 3), float(i % 5)]) for i in range(50)] + [(99, None)], "id long, v array<double>")
    asked = vectors.where("id % 10 = 0")
    whole, blocks = ({tuple(r) for r in vector_topk(vectors, "id", "v", asked, 4, block).collect()} for block in (100, 2))
    assert whole == blocks and len(whole) == 20
    assert vector_topk(vectors, "id", "v", vectors.where("id < 0")).count() == 0


def test_metrics(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"]), ([], ["a"]), (["a"], [])], "r array<string>, h array<string>")
    assert [r[0] for r in df.select(M.word_errors(F.col("r"), F.col("h"))).collect()] == [2, 1, 1]
    votes = spark.createDataFrame([("m", True, True), ("m", False, False), ("m", True, False), ("m", None, True), ("n", True, True)], "m string, a boolean, b boolean")
    rows = {r["m"]: (r["n"], r["agreement"], r["kappa"]) for r in M.agreement(votes, ["m"], F.col("a"), F.col("b")).collect()}
    assert rows == {"m": (3, 0.6667, 0.4), "n": (1, 1.0, None)}
    ids = spark.createDataFrame([([5, 6, 7], [7, 9]), ([1], [])], "f array<long>, w array<long>")
    assert [tuple(r) for r in ids.select(M.recall_at_k(F.col("f"), F.col("w"), 3), M.reciprocal_rank(F.col("f"), F.col("w"), 3)).collect()] == [(0.5, 1 / 3), (None, None)]
    before, after = (spark.createDataFrame(x, "m string, v double") for x in ([("a", 0.9), ("b", 0.5)], [("a", 0.8), ("c", 0.1)]))
    assert {r["m"]: r["regression"] for r in M.compare_runs(before, after, "m", "v").collect()} == {"a": True, "b": False, "c": False}


def test_sources_and_sinks(spark, tmp_path):
    for name, content in (("a.pdf", b"one"), ("b.PDF", b"one"), ("c.wav", b"two"), ("d.xyz", b"three")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    rows = {r["name"]: r["kind"] for r in content_addressed(spark, str(tmp_path / "in")).collect()}
    assert rows == {"a.pdf": "document", "c.wav": "audio", "d.xyz": None}
    (tmp_path / "t.json").write_text(json.dumps({"language": "en", "segments": [{"start": 0, "end": 1.5, "text": "hi"}, {"start": 2, "end": 3, "text": "yo", "speaker": 1}]}))
    assert [(r["seq"], r["text"], r["speaker"]) for r in transcript_segments(spark, str(tmp_path / "t.json")).orderBy("seq").collect()] == [(0, "hi", None), (1, "yo", 1)]
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    for _ in range(2):
        replace_partitions(df, out, "id")
    replace_partitions(spark.createDataFrame([(2, "c")], "id long, v string"), out, "id")
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "c")]
    new = spark.createDataFrame([(2, "x"), (2, "y"), (3, None)], "id long, v string")
    assert sorted(map(tuple, upserted(df, new, ["id"], F.col("v")).collect())) == [(1, "a"), (2, "y"), (3, None)]
    left = cascade_deleted({"t": df}, {"t": "id"}, spark.createDataFrame([(1,)], "gone long"))
    assert [tuple(r) for r in left["t"].collect()] == [(2, "b")]


def test_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = spark.range(40).selectExpr("id AS event_id", "timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, id) AS ts", "IF(id % 2 = 0, 'a', 'b') AS event_type", "CAST(id AS DOUBLE) AS value")
    rows.repartition(3).write.parquet(path)
    streamed = drain(windowed_counts(read_events(spark, path)))
    batch = windowed_counts(spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp")))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))
    assert deduplicated(read_events(spark, path)).isStreaming
